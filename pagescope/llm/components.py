"""Connected components of a graph given as a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescope.llm import storage


def connected_components(links: DataFrame) -> DataFrame:
    """links a, b (long) -> node, component (the smallest node reachable).

    Each round a node takes the smallest label among itself and its neighbours,
    then the label of its label; the number of rounds grows with the logarithm of
    the longest way for most graphs. Labels stay in tables, those of past rounds go.
    The links are read once: which of equally good links a task sends may depend on
    the order in which rows reach it, and both directions must come from the same ones.
    """
    spark = links.sparkSession
    once_at, links_at, at = storage.new_path(spark, "links"), storage.new_path(spark, "links"), storage.new_path(spark, "labels")
    both = storage.materialise(links.filter("a <> b").select("a", "b"), "", once_at)
    both = storage.materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "", links_at)
    storage.drop_path(spark, once_at)
    labels = storage.materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "", at)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        new = labels.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        past, at = at, storage.new_path(spark, "labels")
        new = storage.materialise(new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "", at)
        storage.drop_path(spark, past)
        if new.filter("label <> old").isEmpty():
            storage.drop_path(spark, links_at)
            new = storage.materialise(new, "components")
            storage.drop_path(spark, at)
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
