"""Structured Streaming over page and event tables: deduplication, alarms, windows, change detection by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of pages from a folder of parquet files; files_per_trigger holds back a fast producer."""
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_pages(pages: DataFrame, seen_at: str | None = None, within: str = "7 days") -> DataFrame:
    """Each page key once over the whole stream, whose state grows with the keys; or, by a time column, once within a span,
    whose state ends with it."""
    keyed = pages.withColumn("key", U.canonical_key(F.col("url")))
    return keyed.withWatermark(seen_at, within).dropDuplicatesWithinWatermark(["key"]) if seen_at else keyed.dropDuplicates(["key"])


def matched(asked: DataFrame, answered: DataFrame, by: str = "url", late: str = "10 minutes", most: str = "1 hour") -> DataFrame:
    """(by, asked_at, answered_at, ...) of two streams: each question with the answers that follow it in time; both sides'
    state ends with the span."""
    a, b = asked.withWatermark("asked_at", late), answered.withWatermark("answered_at", late).withColumnRenamed(by, "_by")
    near = (F.col(by) == F.col("_by")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {most}"))
    return a.join(b, near, "left_outer").drop("_by")


def identical_content(pages: DataFrame, least: int = 3) -> DataFrame:
    """(content_hash, urls): contents that reach `least` distinct addresses; in update mode each alarm comes once it does."""
    hashed = pages.select(T.content_hash(F.col("html")).alias("content_hash"), U.canonical_key(F.col("url")).alias("key"))
    return hashed.groupBy("content_hash").agg(F.approx_count_distinct("key", 0.02).alias("urls")).where(F.col("urls") >= least)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, event_type, events, value): tumbling or sliding counts by event time; rows later than `late` are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("window_start"), "event_type", "events", "value")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, events)."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def on_each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch operator (a diff, an upsert) on each micro-batch, until what is there now is done."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
