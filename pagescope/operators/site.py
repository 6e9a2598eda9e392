"""Everything about a site in its own row: checks, resolution, scores, findings, gaps, advice, report.

The registry is known when the plan is made, so what joins and aggregates over
check rows say elsewhere (`resolve`, `score`, `report`, `advise`) is here a column
over arrays of 24 entries. A page is parsed once, and nothing is shuffled after a
site's pages have met.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescope import registry as R
from pagescope.functions import text as X
from pagescope.functions.figures import py_round
from pagescope.operators import advise as A
from pagescope.operators import checks as C
from pagescope.operators import report as P
from pagescope.operators import resolve as V
from pagescope.operators.hold import hold

#: What a site row may bring besides its pages, and what it has where it does not.
OPTIONAL = {
    "robots": "struct<allowed:boolean,determinable:boolean,ai:map<string,boolean>,crawl_delay:double,sitemaps:array<string>>", "blocked_before_fetch": "boolean",
    "errors": "array<struct<stage:string,type:string,message:string>>", "fetched_at": "string", "user_agent": "string", "robots_checked": "boolean", "crawl_ms": "bigint",
}


def with_checks(sites: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Adds what is missing of OPTIONAL, checks (array in registry order) and resolved (array in registry order)."""
    for name, kind in OPTIONAL.items():
        if name not in sites.columns:
            sites = sites.withColumn(name, F.lit(None).cast(kind))
    rows = hold(C.with_check_rows(sites), "checks")
    fields = ["state", "measurement", "evidence", "selector", "page_url", "reason"]
    rows = rows.withColumn("m", F.map_from_entries(F.transform("checks", lambda c: F.struct(c["check_id"], F.struct(*[c[f].alias(f) for f in fields])))))
    rows = rows.withColumns({"gate": X.language_supported(F.col("language"), R.SUPPORTED_LANGUAGES), "blocked": F.coalesce("blocked_before_fetch", F.lit(False))})
    return hold(V.with_resolved(rows).drop("m", "gate", "blocked"), "resolved")


def _registry() -> Column:
    """The registry as an array of structs in its order: one literal, read when the plan is optimised."""
    total = float(sum(R.CATEGORIES.values()))
    rows = [
        {"category": c.category, "weight": c.weight, "verified": c.confidence_class == "verified", "severity": c.severity, "confidence": c.confidence_class, "title": c.title, "failure_title": c.failure_title,
         "summary": c.summary, "partial_summary": c.partial_summary, "signal": c.signal, "impact": c.impact, "remedy": c.remedy, "points": c.weight * R.CATEGORIES[c.category] / total,
         "threshold": json.dumps(R.THRESHOLDS[c.check_id], sort_keys=True) if c.check_id in R.THRESHOLDS else None}
        for c in R.CHECKS.values()
    ]
    return X.lit_rows(rows)


def with_scores(rows: DataFrame) -> DataFrame:
    """Adds categories (with score and coverage, by name), overall, coverage, confidence, checks_evaluated, checks_unknown."""
    counted = "r.state IN ('pass', 'partial', 'fail')"
    entry = {
        "category": "c.category", "total": "c.weight", "earned2": "c.weight * CASE r.state WHEN 'pass' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END", "scored": f"CASE WHEN {counted} THEN c.weight ELSE 0 END",
        "verified": f"CASE WHEN {counted} AND c.verified THEN c.weight ELSE 0 END", "evaluated": "CASE WHEN r.state <> 'unknown' THEN 1 ELSE 0 END", "unknown": "CASE WHEN r.state = 'unknown' THEN 1 ELSE 0 END",
    }
    rows = rows.withColumn("_reg", _registry()).withColumn("_e", F.expr(f"zip_with(resolved, _reg, (r, c) -> named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in entry.items())}))")).drop("_reg")
    names = sorted(R.CATEGORIES)
    of = lambda name: [f"aggregate(filter(_e, e -> e.category = '{name}'), 0L, (s, e) -> s + cast(e.{k} AS bigint)) AS {k}" for k in list(entry)[1:]]
    rows = hold(rows.withColumn("_sums", F.expr("array(" + ", ".join(f"struct('{n}' AS category, {', '.join(of(n))})" for n in names) + ")")), "_sums").drop("_e")
    scored = "s -> struct(s.category, CASE WHEN s.scored > 0 THEN 100D * s.earned2 / (2 * s.scored) END AS score, s.scored / s.total AS coverage, s.scored, s.verified, s.evaluated, s.unknown)"
    rows = hold(rows.withColumn("categories", F.expr(f"transform(_sums, {scored})")).drop("_sums"), "categories")
    weights = ", ".join(f"{float(R.CATEGORIES[n])}D" for n in names)
    each = lambda body: f"aggregate(zip_with(categories, array({weights}), (c, w) -> {body}), 0D, (s, x) -> s + x)"
    whole = lambda field: f"aggregate(categories.{field}, 0L, (s, x) -> s + x)"
    return hold(rows.selectExpr(
        "*", f"try_divide({each('coalesce(c.score * w, 0D)')}, {each('CASE WHEN c.score IS NOT NULL THEN w ELSE 0D END')}) AS overall", f"{each('c.coverage * w')} / {float(sum(R.CATEGORIES.values()))}D AS coverage",
        f"coalesce(try_divide({whole('verified')}, {whole('scored')}), 0D) AS confidence", f"{whole('evaluated')} AS checks_evaluated", f"{whole('unknown')} AS checks_unknown",
    ), "overall", "coverage", "confidence", "checks_evaluated", "checks_unknown")


def _finding(r: Column, c: Column) -> Column:
    severity, partial = P.severity_for_state(c["severity"], r["state"]), r["state"] == "partial"
    return F.struct(
        P.severity_rank(severity).alias("rank"), c["category"].alias("category"), r["check_id"].alias("check_id"), F.coalesce(r["page_url"], F.lit("")).alias("place"),
        F.when(partial, F.concat(c["title"], F.lit(": partly"))).otherwise(c["failure_title"]).alias("title"), severity.alias("severity"), r["state"].alias("state"),
        c["confidence"].alias("confidence"), F.when(partial, c["partial_summary"]).otherwise(c["summary"]).alias("plain_summary"), c["signal"].alias("signal"),
        r["measurement"].alias("measurement"), c["threshold"].alias("threshold"), F.coalesce(F.when(r["evidence"] != "", r["evidence"]), F.lit("see the measurement")).alias("evidence"), r["selector"].alias("selector"),
        r["page_url"].alias("page_url"), c["impact"].alias("impact"), F.when(partial, 0.5 * c["points"]).otherwise(c["points"]).alias("points_recoverable"), c["remedy"].alias("do"),
    )


_PUBLIC = ["title", "severity", "category", "check_id", "state", "confidence", "plain_summary", "signal", "measurement", "threshold", "evidence", "selector", "page_url", "impact", "points_recoverable", "do"]


def with_findings(rows: DataFrame) -> DataFrame:
    """Adds findings (array, numbered by severity, category and check) and next_actions (array by what fixing is worth)."""
    rows = rows.withColumn("_reg", _registry())
    rows = rows.withColumn("_f", F.array_sort(F.filter(F.zip_with("resolved", "_reg", _finding), lambda f: f["state"].isin("fail", "partial")))).drop("_reg")
    rows = rows.withColumn("findings", F.transform("_f", lambda f, i: F.struct(F.format_string("F-%03d", i + 1).alias("id"), *[f[k].alias(k) for k in _PUBLIC]))).drop("_f")
    rows = hold(rows, "findings")
    ranked = F.array_sort(F.transform("findings", lambda f: F.struct((-f["points_recoverable"]).alias("p"), P.severity_rank(f["severity"]).alias("r"), f["id"].alias("finding_id"), f["title"].alias("title"), f["severity"].alias("severity"), f["points_recoverable"].alias("score_gain"), f["do"].alias("do"))))
    return rows.withColumn("next_actions", F.transform(ranked, lambda a, i: F.struct((i + 1).alias("rank"), *[a[k].alias(k) for k in ("finding_id", "title", "severity", "score_gain", "do")])))


def with_gaps(rows: DataFrame) -> DataFrame:
    """Adds not_checked: categories below the coverage floor, with causes of suppression first, then reasons of checks; at most five."""
    causes = F.create_map(*[F.lit(x) for c in R.CHECKS.values() for x in (c.check_id, f"blocked by an earlier problem: {c.failure_title.lower()}")])
    known = F.create_map(*[F.lit(x) for pair in P.REASON_TEXT.items() for x in pair])
    gaps = []
    for place, name in enumerate(sorted(R.CATEGORIES)):
        of = F.array(*[F.get("resolved", F.lit(i)) for i, c in enumerate(R.CHECKS.values()) if c.category == name])
        first = F.transform(F.filter(of, lambda r: r["suppressed_by"].isNotNull()), lambda r: F.element_at(causes, r["suppressed_by"]))
        then = F.transform(F.filter(of, lambda r: r["suppressed_by"].isNull() & r["reason"].isNotNull()), lambda r: F.coalesce(F.element_at(known, r["reason"]), r["reason"]))
        both = F.slice(F.concat(F.array_sort(F.array_distinct(first)), F.array_sort(F.array_distinct(then))), 1, 5)
        gaps.append(F.struct(F.lit(name).alias("category"), F.get("categories", F.lit(place))["coverage"].alias("coverage"), both.alias("reasons")))
    return rows.withColumn("not_checked", F.filter(F.array(*gaps), lambda g: g["coverage"] < R.COVERAGE_FLOOR))


def with_advice(rows: DataFrame) -> DataFrame:
    """Adds to each finding its filled template, and recommendations, suppressed and gated (detectors that did not speak)."""
    home = F.get("pages", F.lit(0))
    rows = rows.withColumn("_v", F.when(home.isNotNull(), A.observed_values(home, F.col("url"))).otherwise(F.create_map().cast("map<string,string>")))
    shape = "struct<target:string,snippet:string,validation:string>"
    templates = F.create_map(*[x for check, *parts in A.TEMPLATES for x in (F.lit(check), F.struct(*[F.lit(p).cast("string").alias(n) for n, p in zip(("target", "snippet", "validation"), parts, strict=True)]).cast(shape))])

    def advised(f: Column) -> Column:
        t = F.element_at(templates, f["check_id"])
        left = F.array_union(X.placeholders_left(t["snippet"], F.col("_v")), X.placeholders_left(t["validation"], F.col("_v")))
        action = F.struct(f["do"].alias("summary"), f["severity"].alias("priority"), t["target"].alias("target"), X.fill(t["snippet"], F.col("_v")).alias("snippet"), X.fill(t["validation"], F.col("_v")).alias("validation"), left.alias("placeholders_remaining"))
        return F.struct(f["id"].alias("id"), *[f[k].alias(k) for k in _PUBLIC if k != "do"], action.alias("suggested_action"))

    rows = rows.withColumn("_d", F.when(home["has_html"], A.detector_rows()))
    covered = F.transform("findings", lambda f: f["check_id"])
    fired = F.filter(F.coalesce("_d", F.array().cast(A.DETECTED)), lambda d: d["measurement"].isNotNull())
    rows = rows.withColumns({"_fired": fired, "_covered": covered, "findings": F.transform("findings", advised)})
    kept = F.filter("_fired", lambda d: ~F.coalesce(F.array_contains(F.col("_covered"), d["check_id"]), F.lit(False)))
    gone = F.filter("_fired", lambda d: F.coalesce(F.array_contains(F.col("_covered"), d["check_id"]), F.lit(False)))
    gate = X.language_supported(F.col("language"), R.SUPPORTED_LANGUAGES)
    return rows.withColumns({
        "recommendations": F.transform(kept, lambda d, i: F.struct(F.format_string("R-%03d", i + 1).alias("id"), d["detector"].alias("detector"), d["category"].alias("category"), d["title"].alias("title"), d["measurement"].alias("measurement"))),
        "suppressed": F.transform(gone, lambda d: F.struct(d["detector"].alias("detector"), d["check_id"].alias("suppressed_by"))),
        "gated": F.when(gate, F.array().cast("array<string>")).otherwise(X.lit_array([d[0] for d in A.DETECTORS if d[3]])),
    }).drop("_v", "_d", "_fired", "_covered")


def partial_reason() -> Column:
    """Why the audit of a row is partial; null if it is not."""
    page = lambda test: F.exists("pages", test)
    stage = lambda name: F.coalesce(F.exists("errors", lambda e: e["stage"] == name), F.lit(False))
    return (
        F.when(F.coalesce("blocked_before_fetch", F.lit(False)) | page(lambda p: p["page_status"] == "blocked"), "blocked").when(page(lambda p: p["skip_reason"] == "budget"), "budget")
        .when(stage("analyze"), "analyzer_failed").when(stage("render"), "render_failed")
        .when(stage("fetch") | page(lambda p: p["page_status"] == "error") | (F.col("checks_evaluated") == 0), "fetch_failed")
    )


def _count(severity: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["severity"] == severity))


def scorecard(rows: DataFrame) -> DataFrame:
    """One row a site: overall score and its reliability, the four category scores, counts of findings."""
    rows = with_findings(with_scores(rows))
    score = {n: F.get("categories", F.lit(i))["score"].alias(n) for i, n in enumerate(sorted(R.CATEGORIES))}
    counts = [_count(s).cast("long").alias(s) for s in R.SEVERITIES]
    return rows.select(
        "site_id", "overall", "coverage", "confidence", "checks_evaluated", "checks_unknown", *[score[n] for n in R.CATEGORIES],
        F.size("findings").cast("long").alias("total_findings"), *counts, P.verdict(F.col("overall"), F.col("coverage")).alias("verdict"),
    )


def report(rows: DataFrame) -> DataFrame:
    """site_id, report: a nested struct a site, with figures rounded as published."""
    rows = with_advice(with_gaps(with_findings(with_scores(rows)))).withColumn("_why", partial_reason())
    cats = F.transform("categories", lambda c: F.struct(c["category"].alias("category"), py_round(c["score"], 1).alias("score"), py_round(c["coverage"], 3, 1).alias("coverage"), P.verdict(c["score"], c["coverage"]).alias("verdict")))
    reliable = F.coalesce(F.col("coverage") >= R.COVERAGE_FLOOR, F.lit(False)) & F.col("overall").isNotNull()
    summary = F.struct(
        F.size("findings").alias("total_findings"), *[_count(s).alias(s) for s in R.SEVERITIES], F.coalesce(py_round(F.col("overall"), 0).cast("int"), F.lit(0)).alias("score"), py_round(F.col("coverage"), 3, 1).alias("coverage"),
        py_round(F.col("confidence"), 3, 1).alias("confidence"), P.verdict(F.col("overall"), F.col("coverage")).alias("verdict"), reliable.alias("headline_reliable"), F.when(~reliable, R.CAVEAT).alias("headline_caveat"), "checks_evaluated", "checks_unknown",
    )
    home, pages = F.get("pages", F.lit(0)), F.col("pages")
    away = F.transform(F.filter(pages, lambda p: p["page_status"] != "ok"), lambda p: F.struct(p["url"].alias("url"), p["page_status"].alias("status"), p["status"].alias("http_status"), F.coalesce(p["blocked_kind"], p["skip_reason"]).alias("reason")))
    crawlers = F.struct(F.coalesce(F.col("robots.determinable"), F.lit(False)).alias("determinable"), F.array_sort(F.map_keys(F.map_filter("robots.ai", lambda _, v: ~v))).alias("blocked"))
    diagnostics = F.struct(
        F.coalesce("crawl_ms", F.lit(0)).alias("crawl_ms"), F.when(home["rendered"], "render").otherwise("static").alias("render_mode"), home["nav_state"].alias("render_nav_state"), F.transform(pages, lambda p: p["url"]).alias("pages_checked"),
        away.alias("pages"), F.col("language").alias("language_detected"), X.language_supported(F.col("language"), R.SUPPORTED_LANGUAGES).alias("language_supported"), F.coalesce("user_agent", F.lit("")).alias("user_agent"),
        F.coalesce("robots_checked", F.lit(False)).alias("robots_checked"), crawlers.alias("ai_crawlers"), F.lit(False).alias("external_lookup"), F.struct("gated", "suppressed").alias("advisor"), "checks_evaluated", "checks_unknown",
        F.coalesce("errors", F.array().cast(OPTIONAL["errors"])).alias("errors"),
    )
    body = F.struct(
        F.struct("site_id", "url", "language").alias("site"), F.col("fetched_at").alias("audited_at"), summary.alias("summary"), cats.alias("categories"), diagnostics.alias("diagnostics"),
        F.col("_why").isNotNull().alias("partial"), F.col("_why").alias("partial_reason"), "findings", "next_actions", "not_checked", "recommendations",
    )
    return rows.select("site_id", body.alias("report"))
