"""The whole audit as one lazy plan: pages -> a row a site with checks, resolution, scorecard and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescope.operators import pages, site
from pagescope.sources import readers
from pagescope.sources.overlay import overlay_sql


def test_pages(spark: SparkSession, sf_dir: str, overlay: bool = True) -> DataFrame:
    """The table of crawled pages, with the overlay of signals."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return rows.withColumn("html", F.expr(overlay_sql())) if overlay else rows


@dataclass
class Audit:
    """sites: one row a site with everything; results and resolved: its check rows, each from one parse of each page."""

    sites: DataFrame

    @property
    def results(self) -> DataFrame:
        return self.sites.select("site_id", "language", F.inline("checks"))

    @property
    def resolved(self) -> DataFrame:
        return self.sites.select("site_id", F.inline("resolved"))


def audit(crawled: DataFrame, about: DataFrame | None = None) -> Audit:
    """crawled: page_id, url, html (and what artifacts_from_pages takes); about: site_id and some of site.OPTIONAL, language or url.

    A site that is only in about has no pages, and all its checks are unknown.
    """
    sites = pages.artifacts_from_pages(crawled)
    if about is not None:
        own = [c for c in about.columns if c in ("language", "url")]
        about = about.select(*[F.col(c).alias(f"_{c}") if c in own else F.col(c) for c in about.columns])
        sites = sites.join(about, "site_id", "full")
        sites = sites.withColumns({c: F.coalesce(f"_{c}", c) if c == "language" else F.coalesce(c, f"_{c}") for c in own}).drop(*[f"_{c}" for c in own])
    return Audit(site.with_checks(sites))


def audit_artifacts(artifacts: DataFrame) -> Audit:
    """Crawled site documents with their robots rules, language, errors and times."""
    return audit(readers.pages_of_artifacts(artifacts), readers.sites_of_artifacts(artifacts))


def full_report(crawled: DataFrame, about: DataFrame | None = None) -> DataFrame:
    return site.report(audit(crawled, about).sites)
