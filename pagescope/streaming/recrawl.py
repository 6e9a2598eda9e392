"""Incremental recrawls: the batch operators over micro-batches. An extension; a replay of the same pages gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagescope.operators import site
from pagescope.plans.audit import audit

PAGES = "page_id long, url string, html string, fetched_at timestamp"


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PAGES).parquet(path)


def changed_pages(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Pages whose body was not seen within the watermark."""
    keyed = stream.withColumn("html_sha256", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256))
    return keyed.withWatermark("fetched_at", lateness).dropDuplicatesWithinWatermark(["url", "html_sha256"])


def score_batches(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A scorecard for each micro-batch, in a folder of its own: a batch that runs again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        card = site.scorecard(audit(batch.select("page_id", "url", "html")).sites)
        card.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_cards(cards: DataFrame) -> DataFrame:
    """The last scorecard of each site."""
    return cards.groupBy("site_id").agg(F.max_by(F.struct("overall", "coverage", "verdict"), "batch").alias("c"), F.max("batch").alias("batch")).select("site_id", "batch", "c.*")


def score_trend(scores: DataFrame, size: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """site_id, fetched_at, overall -> mean by window."""
    s = scores.withWatermark("fetched_at", lateness) if scores.isStreaming else scores
    return s.groupBy(F.window("fetched_at", size).alias("w"), "site_id").agg(F.avg("overall").alias("overall")).select(F.col("w.start").alias("start"), "site_id", "overall")


def latest_state(stream: DataFrame) -> DataFrame:
    """url, fetched_at, html_sha256 of the newest crawl of each page, and how often it changed."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, digest, changes = state.get if state.exists else (-1, "", 0)
        for rows in batches:
            for at, new in sorted(zip(rows["fetched_at"].astype("int64"), rows["html_sha256"], strict=True)):
                if at >= last:
                    changes += int(bool(digest) and new != digest)
                    last, digest = at, new
        state.update((last, digest, changes))
        yield pd.DataFrame({"url": [key[0]], "html_sha256": [digest], "changes": [changes]})

    return stream.groupBy("url").applyInPandasWithState(update, "url string, html_sha256 string, changes int", "at long, digest string, changes int", "update", GroupStateTimeout.NoTimeout)
