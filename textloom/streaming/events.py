"""The log of jobs as a stream, their progress, and an index that follows changed chapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "seq long, job_id string, at timestamp, type string, done_words long, total_words long, input_tokens long, cached_tokens long, output_tokens long"
TOKENS = ("input_tokens", "cached_tokens", "output_tokens")


def log(spark: SparkSession, path: str, seen: int | None = None) -> DataFrame:
    """The events of a folder of JSON lines as a stream: from the beginning, or those behind number ``seen``."""
    events = spark.readStream.schema(EVENT).json(path)
    return events if seen is None else events.filter(F.col("seq") > seen)


def last_seen(spark: SparkSession, path: str) -> int:
    """The largest number so far: where a watch from now on begins."""
    return spark.read.schema(EVENT).json(path).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def progress(events: DataFrame) -> DataFrame:
    """``job_id, done_words, total_words, percent, last_seq`` and token totals, for a batch or (in update mode) a stream.

    Counts in the log are totals so far for words and amounts of one step for tokens.
    """
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in TOKENS]
    got = events.groupBy("job_id").agg(F.max("done_words").alias("done_words"), F.max("total_words").alias("total_words"), F.max("seq").alias("last_seq"), *sums)
    percent = F.try_divide(F.col("done_words") * 100.0, F.col("total_words"))
    return got.withColumn("percent", percent)


def expired(touched: Column, now: Column, seconds: int = 7 * 24 * 3600) -> Column:
    """True for what hasn't been touched for so long: sessions and cursors after seven days."""
    return F.unix_seconds(now) - F.unix_seconds(touched) > seconds


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by type in event-time windows with a watermark. Spark's own, for event tables."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def follow(changes: DataFrame, store, records: Callable[[], DataFrame], checkpoint: str):
    """Index the chapters of a stream ``archive, chapter_id`` again, batch by batch; returns the streaming query's writer.

    A batch marks its chapters and refreshes; if it is lost between, the marks are still there and the next batch does both. Work
    goes with the chapters of a batch, and nothing of them comes to the driver.
    """

    def run(batch: DataFrame, _: int) -> None:
        store.mark_dirty(batch)
        store.refresh(records())

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
