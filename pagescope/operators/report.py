"""Findings, rankings, gaps and verdicts as tables; writing and checking reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescope import registry as R
from pagescope.functions import text as X
from pagescope.operators import score as S

REASON_TEXT = {"not_measured": "was not measured", "language_not_supported": "the language is not supported", "blocked": "the site refused the audit"}


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(X.lit_array(R.SEVERITIES), severity).cast("int"), F.lit(99)) - 1


def severity_for_state(severity: Column, state: Column) -> Column:
    """Partial is one tier lower, and medium at least."""
    lower = F.when(severity == "critical", "high").otherwise("medium")
    return F.when(state == "partial", lower).otherwise(severity)


def findings(resolved: DataFrame) -> DataFrame:
    """Failed and partial checks with wording, points and a dense id by severity, category, check, page and evidence."""
    rows = S.with_registry(resolved).filter(F.col("state").isin("fail", "partial"))
    rows = rows.withColumns({
        "severity": severity_for_state(F.col("severity"), F.col("state")),
        "points_recoverable": S.points(F.col("state")),
        "confidence": F.col("confidence_class"),
        "title": F.when(F.col("state") == "partial", F.concat(F.col("title"), F.lit(": partly"))).otherwise(F.col("failure_title")),
        "evidence": F.coalesce(F.when(F.col("evidence") != "", F.col("evidence")), F.lit("see the measurement")),
    })
    digest = F.substr(F.sha2(F.encode("evidence", "UTF-8"), 256), F.lit(1), F.lit(12))
    order = Window.partitionBy("site_id").orderBy(severity_rank(F.col("severity")), "category", "check_id", F.coalesce("page_url", F.lit("")), digest)
    return rows.withColumn("id", F.format_string("F-%03d", F.row_number().over(order))).select(
        "site_id", "id", "title", "severity", "category", "check_id", "state", "confidence", "measurement", "evidence", "selector", "page_url", "points_recoverable", F.col("remedy").alias("do")
    )


def next_actions(found: DataFrame) -> DataFrame:
    """Findings by what fixing them is worth."""
    order = Window.partitionBy("site_id").orderBy(F.desc("points_recoverable"), severity_rank(F.col("severity")), "id")
    return found.withColumn("rank", F.row_number().over(order)).select("site_id", "rank", F.col("id").alias("finding_id"), "title", "severity", F.col("points_recoverable").alias("score_gain"), "do")


def not_checked(resolved: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories below the coverage floor and why: causes of suppression first, then the reasons of the checks; at most five."""
    thin = categories.filter(F.col("coverage") < R.COVERAGE_FLOOR).select("site_id", "category", "coverage")
    titles = F.broadcast(R.checks_frame(resolved.sparkSession).select(F.col("check_id").alias("suppressed_by"), F.lower("failure_title").alias("cause")))
    rows = S.with_registry(resolved).select("site_id", "category", "suppressed_by", "reason").join(titles, "suppressed_by", "left")
    said = F.coalesce(*[F.when(F.col("reason") == k, v) for k, v in REASON_TEXT.items()], F.col("reason"))
    why = rows.groupBy("site_id", "category").agg(
        F.sort_array(F.collect_set(F.concat(F.lit("blocked by an earlier problem: "), F.col("cause")))).alias("causes"),
        F.sort_array(F.collect_set(F.when(F.col("suppressed_by").isNull(), said))).alias("codes"),
    )
    return thin.join(why, ["site_id", "category"]).select("site_id", "category", "coverage", F.slice(F.concat("causes", "codes"), 1, 5).alias("reasons"))


def verdict(score: Column, coverage: Column) -> Column:
    """The first band whose least score is met; no band where too little was measured."""
    out = F.when(score.isNull() | coverage.isNull() | (coverage < R.COVERAGE_FLOOR), R.UNMEASURED)
    for least, sentence in R.BANDS:
        out = out.when(score >= least, sentence)
    return out


def partial_reason(sites: DataFrame, resolved: DataFrame, errors: DataFrame) -> DataFrame:
    """Why an audit is partial: blocked, budget, analyzer_failed, render_failed, fetch_failed; null if it is not.

    sites: site_id, blocked_before_fetch, pages (array with page_status and skip_reason); errors: site_id, stage.
    """
    seen = errors.groupBy("site_id").agg(F.collect_set("stage").alias("stages"))
    lost = resolved.groupBy("site_id").agg(F.bool_and(F.col("state") == "unknown").alias("all_unknown"))
    rows = sites.join(seen, "site_id", "left").join(lost, "site_id", "left")
    stages = F.coalesce("stages", F.array().cast("array<string>"))
    page = lambda test: F.exists("pages", test)
    reason = (
        F.when(F.col("blocked_before_fetch"), "blocked").when(page(lambda p: p["page_status"] == "blocked"), "blocked")
        .when(page(lambda p: p["skip_reason"] == "budget"), "budget").when(F.array_contains(stages, "analyze"), "analyzer_failed")
        .when(F.array_contains(stages, "render"), "render_failed").when(F.array_contains(stages, "fetch") | page(lambda p: p["page_status"] == "error") | F.coalesce("all_unknown", F.lit(False)), "fetch_failed")
    )
    return rows.select("site_id", reason.alias("partial_reason"))


def write_report(reports: DataFrame, path: str) -> None:
    """One JSON document a line."""
    reports.select(F.to_json("report").alias("value")).write.mode("overwrite").text(path)


def violations(reports: DataFrame) -> DataFrame:
    """site_id, problem: reports that break an invariant of the output."""
    r = F.col("report")
    problem = (
        F.when(~r["summary"]["score"].between(0, 100), "score out of range")
        .when(F.size(r["next_actions"]) != F.size(r["findings"]), "next actions do not cover the findings")
        .when(F.exists(r["findings"], lambda f: ~f["severity"].isin(R.SEVERITIES)), "unknown severity")
        .when(F.exists(r["categories"], lambda c: c["score"].isNull() != (c["coverage"] == 0)), "a score without coverage")
    )
    return reports.select("site_id", problem.alias("problem")).filter("problem IS NOT NULL")


def any_critical(found: DataFrame) -> bool:
    """The gate of a build: is there a critical finding?"""
    return not found.filter(F.col("severity") == "critical").isEmpty()
