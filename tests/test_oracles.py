"""Every catalogued query with SQL against DuckDB on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if not re.match(r"op\d", n))


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(_cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_no_site_or_page_is_left_out(spark, duck):
    run = lambda name: entry.queries()[name](spark, SF)
    brands = {r["site_id"]: r["brand"] for r in run("observed_brands").collect()}
    assert set(brands) == {r["site_id"] for r in run("page_selection").collect()}
    some = {r["site_id"]: r["brand"] for r in run("observed_values").collect()}
    assert some.items() < brands.items() and None not in brands.values()
    assert run("blank_pages").count() == duck.execute("SELECT count(*) FROM pages").fetchone()[0]


def test_title_state_equals_sql_on_odd_titles(spark, tmp_path):
    """References outside the list of the SQL, cut or named ones, tags inside, white space of all kinds, missing HTML."""
    inside = ["a &quot;b&quot; c", "bread &amp;&amp;&amp and&amp", "&amp;lt; &copy; &middot; &#65;", "x<b>y</b>", "\u00a0 a\u000bb \t\n c\u2003 ", "\u2028a\u0085", "", "caf\u00e9 \U0001f600", "&nbsp;x&nbsp;", "y" * 70 + "&quot;"]
    htmls = [f"<html><head><TITLE lang=x>{t}</Title></head><body><title>second</title></body></html>" for t in inside] + ["<!-- <title>in a comment of the page</title> -->", "<title>open", "<p>none</p>", "", None]
    spark.createDataFrame([(i, f"https://x{i}.example/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.execute(entry.oracle_sql()["title_state"]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["title_state"](spark, str(tmp_path)).select("page_id", "state", "measurement").collect()) == want and len(want) == len(htmls)
