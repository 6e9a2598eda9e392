"""The first screen as running sums: what stands before each element, with chrome at a discount."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagescope.functions import html as H


def fold_offsets(flow: DataFrame) -> DataFrame:
    """page_id, place, tag, length, root -> adds cost and offset.

    Two windows: within a chrome root the characters before an entry decide how
    much of it is cheap; within the page the costs before it are its offset.
    """
    allowance = H.CHROME_CAP / H.CHROME_WEIGHT
    root = Window.partitionBy("page_id", "root").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("length").over(root), F.lit(0))
    cheap = F.greatest(F.lit(0.0), F.least(F.col("length").cast("double"), allowance - used))
    cost = F.when(F.col("root").isNull(), F.col("length").cast("double")).otherwise(cheap * H.CHROME_WEIGHT + (F.col("length") - cheap))
    page = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return flow.withColumn("cost", cost).withColumn("offset", F.coalesce(F.sum("cost").over(page), F.lit(0.0)))


def explode_flow(pages: DataFrame) -> DataFrame:
    """page_id and f -> a row for each entry of the flow."""
    rows = pages.select("page_id", F.posexplode("f.flow").alias("place", "e"))
    return rows.select("page_id", "place", "e.tag", "e.length", "e.root", "e.kind", "e.label")
