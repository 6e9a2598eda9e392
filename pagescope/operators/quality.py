"""Detection quality: labelled expectations against reported findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(labels: DataFrame, reported: DataFrame) -> DataFrame:
    """fixture (null: all), must_find, found, must_not_find, wrong, recall, precision.

    labels: fixture, must_find, must_not_find (arrays of check ids); reported: fixture, check_id.
    """
    got = reported.groupBy("fixture").agg(F.collect_set("check_id").alias("got"))
    rows = labels.join(got, "fixture", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    rows = rows.select("fixture", F.size("must_find").alias("must_find"), F.size(F.array_intersect("must_find", "got")).alias("found"), F.size("must_not_find").alias("must_not_find"), F.size(F.array_intersect("must_not_find", "got")).alias("wrong"))
    total = rows.rollup("fixture").agg(*[F.sum(c).alias(c) for c in ("must_find", "found", "must_not_find", "wrong")])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    return total.withColumns({"recall": share(F.col("found"), F.col("must_find")), "precision": share(F.col("found"), F.col("found") + F.col("wrong"))})
