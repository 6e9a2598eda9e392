"""Readers of crawled sites and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescope.functions import urls as U
from pagescope.operators.pages import GEOMETRY

_PAGE = (
    "struct<url:string,role:string,status:string,skip_reason:string,blocked_kind:string,raw:struct<status:int,content_type:string,byte_size:bigint,html_sha256:string,html:string,headers:map<string,string>>,"
    f"rendered:struct<available:boolean,browser_available:boolean,mode:string,html:string,render_ms:bigint,geometry:{GEOMETRY},nav_state:string>,meta_robots:string,x_robots_tag:string>"
)
#: A crawled site as one document.
ARTIFACT = (
    "requested_url string, final_url string, fetched_at string, user_agent string, robots struct<checked:boolean,allowed:boolean,crawl_delay:double,status:int,sitemaps:array<string>>, "
    "ai_crawlers struct<determinable:boolean,allowed:map<string,boolean>,blocked:array<string>>, language struct<detected:string,source:string,supported:boolean>, "
    f"pages array<{_PAGE}>, blocked_before_fetch boolean, timing struct<fetch_ms:bigint,render_ms:bigint,total_ms:bigint,deadline_s:double>, errors array<struct<stage:string,type:string,message:string>>, _corrupt string"
)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Site documents from JSON; a document that cannot be read keeps its text in _corrupt and nothing else."""
    return spark.read.schema(ARTIFACT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)


def _site_of(artifacts: DataFrame):
    return U.host_of(F.coalesce("final_url", "requested_url"))


def pages_of_artifacts(artifacts: DataFrame) -> DataFrame:
    """One row a page in the form that the audit takes; place puts the homepage first, page_id is a hash of site and place."""
    rows = artifacts.select(_site_of(artifacts).alias("site"), F.posexplode("pages").alias("place", "p")).filter("p IS NOT NULL AND p.url IS NOT NULL")
    home = F.when(F.col("p.role") == "homepage", 0).otherwise(1)
    r = F.col("p.rendered")
    shown = F.coalesce(r["available"], F.lit(False))
    return rows.select(
        F.xxhash64("site", "place").alias("page_id"), (home * 1_000_000 + F.col("place")).alias("place"), F.col("p.url").alias("url"), F.col("p.raw.html").alias("html"), F.col("p.raw.status").alias("status"),
        F.coalesce("p.status", F.lit("error")).alias("page_status"), F.col("p.skip_reason").alias("skip_reason"), F.col("p.blocked_kind").alias("blocked_kind"), F.col("p.x_robots_tag").alias("x_robots_tag"),
        F.when(shown, r["html"]).alias("rendered_html"), F.when(shown, r["geometry"]).alias("geometry"), r["nav_state"].alias("nav_state"),
    )


def sites_of_artifacts(artifacts: DataFrame) -> DataFrame:
    """site_id, url, language, robots, blocked_before_fetch, errors, fetched_at, user_agent, robots_checked, crawl_ms: one row a site.

    A document that could not be read, or that says nothing of a part, has null there;
    the checks that need it are unknown. Two documents of a site count as the later one.
    """
    robots = F.struct(
        F.coalesce("robots.allowed", F.lit(True)).alias("allowed"), F.coalesce("ai_crawlers.determinable", F.lit(False)).alias("determinable"),
        F.coalesce("ai_crawlers.allowed", F.create_map().cast("map<string,boolean>")).alias("ai"), F.col("robots.crawl_delay").alias("crawl_delay"), F.col("robots.sitemaps").alias("sitemaps"),
    )
    bad = F.when(F.col("_corrupt").isNotNull(), F.array(F.struct(F.lit("fetch").alias("stage"), F.lit("unreadable_document").alias("type"), F.substr("_corrupt", F.lit(1), F.lit(80)).alias("message"))))
    rows = artifacts.select(
        F.coalesce(_site_of(artifacts), F.when(F.col("_corrupt").isNotNull(), F.concat(F.lit("unreadable-"), F.lower(F.hex(F.xxhash64("_corrupt")))))).alias("site_id"), F.coalesce("final_url", "requested_url").alias("url"),
        F.col("language.detected").alias("language"), robots.alias("robots"), "blocked_before_fetch", F.coalesce(bad, "errors").alias("errors"), "fetched_at", "user_agent", F.col("robots.checked").alias("robots_checked"), F.col("timing.total_ms").alias("crawl_ms"),
    ).filter("site_id IS NOT NULL")
    names = [c for c in rows.columns if c != "site_id"]
    return rows.groupBy("site_id").agg(F.max_by(F.struct(*names), F.coalesce("fetched_at", F.lit(""))).alias("s")).select("site_id", "s.*")


def read_html_files(spark: SparkSession, path: str, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """Local HTML files as pages, each a site of its own, without robots or render; larger files are left out, as a fetch would refuse them."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= max_bytes)
    key = F.xxhash64("path")
    host = F.concat(F.lit("https://f"), F.lower(F.hex(key)), F.lit(".local.invalid/"))
    return files.select(key.alias("page_id"), F.concat(host, F.url_encode(F.element_at(F.split("path", "/"), -1))).alias("url"), F.decode("content", "UTF-8").alias("html"))


def page_entry(fetched: DataFrame) -> DataFrame:
    """Fetched rows -> page rows: status, skip reason and digest of the body."""
    s = F.when(F.col("error_kind").isin("unsafe_url", "content_type", "too_large", "content_encoding", "budget"), "skipped").when(F.col("error_kind").isNotNull(), "error").otherwise("ok")
    return fetched.withColumns({"page_status": s, "skip_reason": F.when(s == "skipped", F.col("error_kind")), "html_sha256": F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256), "x_robots_tag": F.element_at("headers", "x-robots-tag")})


def expand_sitemaps(listed: DataFrame, contents: DataFrame, most: int = 3) -> DataFrame:
    """site_id, url: pages of the first sitemaps of a site; an index is followed one level.

    listed: site_id, sitemap, place; contents: sitemap, s (pages, children).
    """
    first = listed.filter(F.col("place") < most).join(contents, "sitemap").select("site_id", "place", "s")
    direct = first.select("site_id", F.explode("s.pages").alias("url"))
    children = first.filter(F.size("s.pages") == 0).select("site_id", F.explode(F.slice("s.children", 1, most)).alias("sitemap"))
    return direct.unionByName(children.join(contents, "sitemap").select("site_id", F.explode("s.pages").alias("url"))).distinct()
