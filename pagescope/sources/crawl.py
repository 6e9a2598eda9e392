"""A crawl of many sites as tables: robots, home pages, candidates from menus and sitemaps, pages, and what the audit must know.

Each step is a table in the given folder, so that no page is fetched twice; sites meet
only in joins by site_id, and a task fetches the pages of a host one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescope.functions import crawl as R
from pagescope.functions import html as H
from pagescope.functions import urls as U
from pagescope.operators import pages as P
from pagescope.sources import fetch, readers


def crawl_sites(homes: DataFrame, folder: str, agent: str = "PagescopeBot/0.1", get: Callable[..., dict] = fetch.safe_get, max_pages: int = U.MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """homes: url -> (pages in the form of artifacts_from_pages, about in the form of audit).

    A site whose robots.txt refuses, or cannot be had, is not fetched and is blocked
    before the fetch. Pages that are not fetched for want of time have the status
    skipped and the reason budget; other errors are rows of about.
    """
    spark = homes.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    homes = homes.select(U.normalize_url(F.col("url")).alias("url")).withColumn("site_id", U.host_of(F.col("url"))).filter("site_id IS NOT NULL").groupBy("site_id").agg(F.min("url").alias("url"))
    origin = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    asked = homes.select("site_id", F.col("url").alias("home"), F.concat(origin, F.lit("/robots.txt")).alias("url"))
    got = fetch.fetch_table(asked.select("url"), agent=agent, get=get, types=None).select("url", "status", F.col("html").alias("text"))
    rules = kept(asked.join(got, "url").select("site_id", F.col("home").alias("url"), "status", R.robots(F.col("status"), F.col("text"), F.col("home"), agent).alias("robots")), "robots")
    free = rules.filter("robots.allowed").select("site_id", "url", F.col("robots.crawl_delay").alias("delay"))

    first = kept(fetch.fetch_table(free.select("url", "delay"), agent=agent, get=get), "homes")
    menu = first.filter("html IS NOT NULL").join(free.select("site_id", "url"), "url").select("site_id", "final_url", H.page_features(F.col("html")).alias("f"))
    menu = menu.select("site_id", "final_url", F.posexplode(F.filter("f.anchors", lambda a: a["in_nav"])["href"]).alias("place", "href")).select("site_id", U.url_join(F.col("final_url"), F.col("href"))["url"].alias("url"), F.lit("nav").alias("source"), "place")

    listed = rules.filter("robots.allowed").select("site_id", F.posexplode("robots.sitemaps").alias("place", "sitemap"))
    raw = lambda names, name: kept(fetch.fetch_table(names.select(F.col("sitemap").alias("url")).distinct(), agent=agent, get=get, types=None).select(F.col("url").alias("sitemap"), R.sitemap(F.encode("html", "UTF-8")).alias("s")), name)
    top = raw(listed.filter(F.col("place") < R.MAX_CHILDREN), "sitemaps")
    below = raw(top.filter(F.size("s.pages") == 0).select(F.explode(F.slice("s.children", 1, R.MAX_CHILDREN)).alias("sitemap")), "sitemaps-below")
    maps = readers.expand_sitemaps(listed, top.unionByName(below), R.MAX_CHILDREN).select("site_id", "url", F.lit("sitemap").alias("source"), F.xxhash64("url").alias("place"))

    candidates = menu.withColumn("place", F.col("place").cast("long")).unionByName(maps).filter("url IS NOT NULL")
    chosen = kept(P.select_candidates(candidates, free.select("site_id", "url"), max_pages).join(free.select("site_id", "delay"), "site_id"), "chosen")
    rest = fetch.fetch_table(chosen.filter("pos > 0").select("url", "delay", F.col("pos").cast("long").alias("place")), agent=agent, get=get)
    rows = readers.page_entry(kept(first.unionByName(rest), "pages"))
    out = chosen.select("site_id", "url", F.col("pos").cast("long").alias("place")).join(rows, "url")
    out = out.select(F.xxhash64("site_id", "place").alias("page_id"), "place", "url", "html", "status", "page_status", "skip_reason", "x_robots_tag", "error_kind", "fetch_ms", "site_id")

    notes = out.groupBy("site_id").agg(
        F.collect_list(F.when(F.col("page_status") == "error", F.struct(F.lit("fetch").alias("stage"), F.col("error_kind").alias("type"), F.col("url").alias("message")))).alias("errors"), F.sum("fetch_ms").alias("crawl_ms"),
    )
    about = rules.join(notes, "site_id", "left").select(
        "site_id", "url", "robots", (~F.col("robots.allowed")).alias("blocked_before_fetch"), "errors", F.lit(agent).alias("user_agent"), F.col("robots.determinable").alias("robots_checked"), "crawl_ms",
    )
    return out.drop("site_id", "error_kind", "fetch_ms"), about
