"""From crawled pages to one row a site: selection, homepage, parsed features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescope.functions import html as H
from pagescope.functions import text as X
from pagescope.functions import urls as U

GEOMETRY = (
    "struct<viewport_height:double,viewport_width:double,body_font_px:double,above_fold_text:string,"
    "headings:array<struct<tag:string,top:double,text:string,font_px:double>>,interactive:array<struct<tag:string,top:double,text:string,font_px:double>>,"
    "overlays:array<struct<tag:string,coverage:double,top:double>>>"
)

#: What a page row may bring besides page_id, url and html: type, and value where it does not.
DEFAULTS = {"status": ("int", 200), "page_status": ("string", "ok"), "skip_reason": ("string", None), "blocked_kind": ("string", None), "nav_state": ("string", None), "x_robots_tag": ("string", None), "rendered_html": ("string", None), "geometry": (GEOMETRY, None)}


def with_site(pages: DataFrame) -> DataFrame:
    """Adds site_id (host without www) and depth of the path."""
    return pages.withColumns({"site_id": U.host_of(F.col("url")), "depth": U.path_depth(F.col("url"))})


def select_pages(pages: DataFrame, max_pages: int = U.MAX_PAGES) -> DataFrame:
    """At most max_pages pages a site, the shallowest first, then by page_id, or by place if pages has it; pos counts from 0, 0 is the homepage.

    The limit is the crawl budget of the audit. Only ids and depths are ranked, so
    the shuffle carries no html; the rank is pushed down as a group limit.
    """
    first = ["place"] if "place" in pages.columns else ["depth", "page_id"]
    order = Window.partitionBy("site_id").orderBy(*first)
    ranked = with_site(pages).filter(F.col("site_id").isNotNull())
    return ranked.withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < max_pages)


def select_candidates(candidates: DataFrame, homes: DataFrame, max_pages: int = U.MAX_PAGES) -> DataFrame:
    """site_id, url, source ('nav' or 'sitemap'), place -> the homepage and the best candidates.

    Sitemap candidates count only where navigation gives fewer than max_pages - 1;
    of equal URLs the one from navigation stays.
    """
    own = candidates.join(homes.select("site_id", F.col("url").alias("home")), "site_id")
    own = own.withColumn("url", U.normalize_url(F.col("url"))).filter(U.is_auditable(F.col("url"), F.col("home")) & (F.col("url") != U.normalize_url(F.col("home"))))
    rank = F.when(F.col("source") == "nav", 0).otherwise(1)
    one = own.withColumn("_n", F.row_number().over(Window.partitionBy("site_id", "url").orderBy(rank, "place"))).filter("_n = 1")
    navs = F.count(F.when(rank == 0, 1)).over(Window.partitionBy("site_id"))
    one = one.withColumn("_navs", navs).filter((rank == 0) | (F.col("_navs") < max_pages - 1))
    order = Window.partitionBy("site_id").orderBy(rank, U.path_depth(F.col("url")), "place", "url")
    best = one.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") < max_pages).select("site_id", "url", "source", "pos")
    first = homes.select("site_id", U.normalize_url(F.col("url")).alias("url"), F.lit("homepage").alias("source"), F.lit(0).alias("pos"))
    return first.unionByName(best)


def with_features(pages: DataFrame) -> DataFrame:
    """Parses each page once: adds f (tree features) and what regular expressions read from the raw html."""
    raw = F.coalesce("html", F.lit(""))
    return pages.withColumns({"f": H.page_features(raw), "visible": X.visible_text(raw), "lang": X.detect_language(raw), "meta_robots": X.meta_robots(raw)})


def page_row(with_html: bool = False) -> Column:
    """What the checks need of a page, without its html."""
    raw = F.coalesce("html", F.lit(""))
    rendered = F.coalesce(F.when(F.col("rendered_html") != "", F.col("rendered_html")), raw)
    cols = [
        F.col("pos"), F.col("url"), F.col("status"), F.col("page_status"), F.col("skip_reason"), F.col("blocked_kind"), F.col("x_robots_tag"), F.col("nav_state"), F.col("meta_robots"),
        F.length("visible").alias("raw_chars"), F.length(X.visible_text(rendered)).alias("rendered_chars"), F.col("rendered_html").isNotNull().alias("rendered"),
        X.framework_markers(raw).alias("markers"), X.empty_mount(raw).alias("mount"), (raw != "").alias("has_html"), F.col("geometry"), F.col("f"), F.col("lang"),
    ]
    return F.struct(*cols, *([F.col("html")] if with_html else []))


def artifacts_from_pages(pages: DataFrame, max_pages: int = U.MAX_PAGES) -> DataFrame:
    """site_id, url, language, pages (array by pos, at most max_pages): one row a site.

    Columns status, page_status, blocked_kind, x_robots_tag, rendered_html and
    geometry are taken where pages has them; a page without is an answered page
    without render, as in an offline audit.
    """
    for name, (kind, value) in DEFAULTS.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(value).cast(kind))
    rows = with_features(select_pages(pages, max_pages)).select("site_id", page_row().alias("p"))
    sites = rows.groupBy("site_id").agg(F.array_sort(F.collect_list("p"), lambda a, b: a["pos"] - b["pos"]).alias("pages"))
    home = F.get("pages", F.lit(0))
    return sites.select("site_id", home["url"].alias("url"), home["lang"].alias("language"), "pages")
