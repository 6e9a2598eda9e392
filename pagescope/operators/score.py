"""Scores, coverage and confidence of resolved states. Sums are whole numbers (credit counts double), so results are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescope import registry as R
from pagescope.operators.resolve import EXCLUDED


def credit2() -> Column:
    """Twice the credit of a state; null for states that do not count."""
    return F.when(F.col("state") == "pass", 2).when(F.col("state") == "partial", 1).when(F.col("state") == "fail", 0)


def with_registry(resolved: DataFrame) -> DataFrame:
    dim = R.checks_frame(resolved.sparkSession).select("check_id", "category", "weight", "severity", "confidence_class", "category_weight", "place", "title", "failure_title", "remedy")
    return resolved.join(F.broadcast(dim), "check_id")


def category_sums(resolved: DataFrame) -> DataFrame:
    """site_id, category, category_weight, earned2, scored, verified, total, evaluated, unknown: one row a site and category."""
    counts = ~F.col("state").isin(EXCLUDED)
    return with_registry(resolved).groupBy("site_id", "category", "category_weight").agg(
        F.coalesce(F.sum(F.col("weight") * credit2()), F.lit(0)).cast("long").alias("earned2"),
        F.coalesce(F.sum(F.when(counts, F.col("weight"))), F.lit(0)).cast("long").alias("scored"),
        F.coalesce(F.sum(F.when(counts & (F.col("confidence_class") == "verified"), F.col("weight"))), F.lit(0)).cast("long").alias("verified"),
        F.sum("weight").cast("long").alias("total"),
        F.count_if(F.col("state") != "unknown").alias("evaluated"),
        F.count_if(F.col("state") == "unknown").alias("unknown"),
    )


def category_scores(resolved: DataFrame) -> DataFrame:
    """score (null if nothing counts) and coverage of each category."""
    s = category_sums(resolved)
    score = F.when(F.col("scored") > 0, 100.0 * F.col("earned2") / (2 * F.col("scored")))
    return s.withColumns({"score": score, "coverage": F.col("scored") / F.col("total")})


def site_scores(resolved: DataFrame) -> DataFrame:
    """overall score, coverage, confidence, counts: one row a site, from at most one row a category."""
    c = category_scores(resolved)
    has = F.col("score").isNotNull()
    return c.groupBy("site_id").agg(
        (F.sum(F.when(has, F.col("score") * F.col("category_weight"))) / F.sum(F.when(has, F.col("category_weight")))).alias("overall"),
        (F.sum(F.col("coverage") * F.col("category_weight")) / F.sum("category_weight")).alias("coverage"),
        F.coalesce(F.try_divide(F.sum("verified"), F.sum("scored")), F.lit(0.0)).alias("confidence"),
        F.sum("evaluated").alias("checks_evaluated"),
        F.sum("unknown").alias("checks_unknown"),
    )


def points(state: Column) -> Column:
    """Points of the overall score that a check in that state could win: full weights as denominators, 0 if it does not count."""
    lost = F.when(state == "fail", 1.0).when(state == "partial", 0.5).otherwise(0.0)
    return lost * F.col("weight") * F.col("category_weight") / float(sum(R.CATEGORIES.values()))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("site_id").agg(F.count("*").alias("total_findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in R.SEVERITIES])


def score_rollup(resolved: DataFrame) -> DataFrame:
    """Earned and possible weight by category, and over all categories (category null), over all sites."""
    counts = ~F.col("state").isin(EXCLUDED)
    return with_registry(resolved).rollup("category").agg(
        F.coalesce(F.sum(F.col("weight") * credit2()), F.lit(0)).cast("long").alias("earned2"),
        F.coalesce(F.sum(F.when(counts, F.col("weight"))), F.lit(0)).cast("long").alias("scored"),
        F.count("*").alias("checks"),
    )
