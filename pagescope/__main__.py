"""Command line: audits, the checks of one category, advice, and detection quality.

    python -m pagescope audit (--pages PAGES.parquet | --artifacts JSON | --html FILES) --out FOLDER [--robots ROBOTS.parquet] [--ci]
    python -m pagescope checks CATEGORY (--pages ... | --artifacts ... | --html ...) --out FOLDER
    python -m pagescope advise (--pages ... | --artifacts ... | --html ...) --out FOLDER
    python -m pagescope quality --labels LABELS.json --reports FOLDER --out FOLDER
    python -m pagescope registry FILE.json [--lenient]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescope import registry


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagescope", description="Audits crawled sites.")
    commands = parser.add_subparsers(dest="command", required=True)
    source = argparse.ArgumentParser(add_help=False)
    one = source.add_mutually_exclusive_group(required=True)
    one.add_argument("--pages", help="Parquet with page_id, url, html and what else a crawl knows")
    one.add_argument("--artifacts", help="JSON documents, one a site")
    one.add_argument("--html", help="local HTML files, each a site")
    source.add_argument("--robots", help="Parquet with site_id and robots")
    source.add_argument("--out", required=True)
    run = commands.add_parser("audit", parents=[source], help="a report for each site")
    run.add_argument("--ci", action="store_true", help="exit with 1 if there is a critical finding")
    checks = commands.add_parser("checks", parents=[source], help="the check results of one category")
    checks.add_argument("category", choices=list(registry.CATEGORIES))
    commands.add_parser("advise", parents=[source], help="filled templates and recommendations")
    quality = commands.add_parser("quality", help="precision and recall of reports against labels")
    quality.add_argument("--labels", required=True, help="JSON with fixture, must_find, must_not_find; fixture is a site_id")
    quality.add_argument("--reports", required=True, help="folder of reports")
    quality.add_argument("--out", required=True)
    read = commands.add_parser("registry", help="reads and validates a registry of checks")
    read.add_argument("file")
    read.add_argument("--lenient", action="store_true")
    return parser


def _audit(spark: SparkSession, args: argparse.Namespace):
    from pagescope.plans import audit as A
    from pagescope.sources import readers

    if args.artifacts:
        return A.audit_artifacts(readers.read_artifacts(spark, args.artifacts))
    crawled = spark.read.parquet(args.pages) if args.pages else readers.read_html_files(spark, args.html)
    return A.audit(crawled, spark.read.parquet(args.robots) if args.robots else None)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "registry":
        with open(args.file, encoding="utf-8") as f:
            found = registry.read_registry(f.read(), strict=not args.lenient)
        print(f"{len(found)} checks")
        return 0

    from pagescope.operators import quality, report, site

    spark = SparkSession.builder.appName("pagescope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "quality":
        reports = spark.read.json(args.reports)
        got = reports.select(F.col("site.site_id").alias("fixture"), F.explode("findings.check_id").alias("check_id"))
        labels = spark.read.schema("fixture string, must_find array<string>, must_not_find array<string>").option("multiLine", True).json(args.labels)
        _write(quality.precision_recall(labels, got), args.out)
        return 0
    rows = _audit(spark, args).sites
    if args.command == "checks":
        wanted = [c.check_id for c in registry.CHECKS.values() if c.category == args.category]
        _write(rows.select("site_id", F.inline("checks")).filter(F.col("check_id").isin(wanted)), args.out)
    elif args.command == "advise":
        out = site.with_advice(site.with_findings(rows))
        corrective = F.transform("findings", lambda f: F.struct(f["id"].alias("finding_id"), f["check_id"].alias("check_id"), f["suggested_action"].alias("suggested_action")))
        _write(out.select("site_id", corrective.alias("corrective"), "recommendations", F.struct("suppressed", "gated").alias("diagnostics")), args.out)
    else:
        report.write_report(site.report(rows), args.out)
        if args.ci:
            said = F.exists("findings", lambda f: f["severity"] == "critical")
            return int(not spark.read.json(args.out).filter(said).isEmpty())
    return 0


if __name__ == "__main__":
    sys.exit(main())
