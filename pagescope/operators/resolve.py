"""Check results to resolved states: completeness, language gate, suppression by failed prerequisites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescope import registry as R
from pagescope.functions import text as X
from pagescope.operators.hold import hold

EXCLUDED = ["unknown", "not_applicable"]


def bind(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results of known checks and states, errors): the first row of each site and check stays."""
    spark = results.sparkSession
    known = F.broadcast(R.checks_frame(spark).select("check_id"))
    errors = results.join(known, "check_id", "left_anti").select("site_id", F.lit("analyze").alias("stage"), F.lit("unknown_check").alias("type"), F.col("check_id").alias("message"))
    good = results.join(known, "check_id", "left_semi")
    good = good.withColumn("state", F.when(F.col("state").isin(R.STATES), F.col("state")).otherwise("unknown"))
    order = Window.partitionBy("site_id", "check_id").orderBy("page_url", "measurement")
    return good.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n"), errors


def resolve_states(results: DataFrame, sites: DataFrame) -> DataFrame:
    """24 rows a site: check_id, state, original_state, suppressed_by, reason and the measured fields.

    sites: site_id, language, and blocked_before_fetch if known. One shuffle by
    site; prerequisites are followed level by level in the row, so no self-join.
    """
    fields = F.struct("state", "measurement", "evidence", "selector", "page_url", "reason")
    maps = results.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("check_id", fields))).alias("m"))
    blocked = F.coalesce(F.col("blocked_before_fetch"), F.lit(False)) if "blocked_before_fetch" in sites.columns else F.lit(False)
    rows = sites.select("site_id", X.language_supported(F.col("language"), R.SUPPORTED_LANGUAGES).alias("gate"), blocked.alias("blocked")).join(maps, "site_id", "left")
    return hold(with_resolved(rows), "resolved").select("site_id", F.inline("resolved"))


def _graph() -> Column:
    """id, gated, verified, level and places of the prerequisites of each check, in registry order: one literal."""
    place = {c: i for i, c in enumerate(R.CHECKS)}
    rows = [{"id": c.check_id, "gated": c.requires_language, "verified": c.confidence_class == "verified", "level": R.LEVELS[c.check_id], "needs": [place[d] for d in sorted(c.depends_on)]} for c in R.CHECKS.values()]
    return X.lit_rows(rows)


def with_resolved(rows: DataFrame) -> DataFrame:
    """rows with m (map of check_id to measured fields), gate and blocked: adds resolved, an array in registry order.

    A check that is not stopped takes the cause of the first prerequisite, by id, that
    failed and is verified, or that has a cause itself; level after level.
    """
    rows = rows.withColumn("_g", _graph()).withColumn("_s0", F.expr(
        "transform(_g, c -> named_struct('check_id', c.id, 'stop', CASE WHEN blocked THEN 'blocked' WHEN c.gated AND NOT gate THEN 'language_not_supported' END, 'cause', CAST(NULL AS STRING), 'own', element_at(m, c.id)))"
    ))
    last = max(R.LEVELS.values())
    rows = hold(rows, "_s0")
    for n in range(1, last + 1):
        s = f"_s{n - 1}"
        failed = f"CASE WHEN _g[d].verified AND {s}[d].stop IS NULL AND {s}[d].cause IS NULL AND {s}[d].own.state = 'fail' THEN _g[d].id END"
        cause = f"get(filter(flatten(transform(_g[i].needs, d -> array({failed}, {s}[d].cause))), x -> x IS NOT NULL), 0)"
        rows = rows.withColumn(f"_s{n}", F.expr(f"transform({s}, (r, i) -> CASE WHEN r.stop IS NULL AND _g[i].level = {n} THEN named_struct('check_id', r.check_id, 'stop', r.stop, 'cause', {cause}, 'own', r.own) ELSE r END)"))
        rows = hold(rows, f"_s{n}")
    reason = "coalesce(r.stop, CASE WHEN r.cause IS NOT NULL THEN 'suppressed_by_failed_prerequisite' END, r.own.reason, CASE WHEN r.own IS NULL THEN 'not_measured' END)"
    state = "coalesce(r.own.state, 'unknown')"
    fields = {
        "check_id": "r.check_id", "state": f"CASE WHEN r.stop IS NOT NULL OR r.cause IS NOT NULL THEN 'unknown' ELSE {state} END", "original_state": state, "suppressed_by": "r.cause", "reason": reason,
        **{f: f"r.own.{f}" for f in ("measurement", "evidence", "selector", "page_url")},
    }
    out = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return rows.withColumn("resolved", F.expr(f"transform(_s{last}, r -> named_struct({out}))")).drop("_g", *[f"_s{n}" for n in range(last + 1)])
