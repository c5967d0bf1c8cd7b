"""Live views of uploads, requests and audit events.

Each function takes a DataFrame that may be streaming or not; on a stream the watermark
bounds the state and rows later than it are dropped, on a batch nothing is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "timestamp timestamp, level string, event_type string, actor string, action string, target string, "
    "ip_address string, details map<string,string>, status string, message string"
)


def audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines audit files, read as they arrive."""
    return spark.readStream.schema(AUDIT_SCHEMA).json(folder)


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(folder)


def file_states(events: DataFrame, late: str = "1 day", time: str = "ts") -> DataFrame:
    """Latest state of each file by day, kept up to date with every event (update mode).

    The watermark drops the state of days gone by, so it follows the files under way.
    """
    # The state of a stream has a row per file and day: the day is its window's last moment, time and state are held once, as one value.
    days = events.withWatermark(time, late).select("batch_id", "file_id", time, "status", F.window(time, "1 day").alias("day"))
    days = days.withColumn("day", F.window_time("day"))
    latest = days.groupBy("batch_id", "file_id", "day").agg(F.max(F.struct(time, "status")).alias("_latest"))
    return latest.select("batch_id", "file_id", "_latest.status", F.col(f"_latest.{time}").alias(time, metadata={}))


def batch_progress(states: DataFrame, time: str = "ts") -> DataFrame:
    """Files of each batch by their latest state, from the table that ``tables.keep_latest`` keeps of ``file_states``."""
    files = states.groupBy("batch_id", "file_id").agg(F.max_by("status", F.struct(time, "status")).alias("status"))
    state = F.col("status")
    return files.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(state == "completed").alias("completed"),
        F.count_if(state.isin("failed", "error")).alias("failed"),
        F.count_if(state == "processing").alias("processing"),
    )


def rate_breaches(
    events: DataFrame, limit: int, per: str = "1 minute", late: str = "2 minutes", time: str = "ts", actor: str = "actor"
) -> DataFrame:
    """Actors with more than ``limit`` events in a tumbling window."""
    counted = (
        events.withWatermark(time, late)
        .groupBy(F.window(time, per), actor)
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return counted.filter(F.col("requests") > limit).select(F.col("window.start").alias("window_start"), actor, "requests")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes", time: str = "ts", actor: str = "actor") -> DataFrame:
    """Activity sessions: a pause longer than ``gap`` ends one."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), actor)
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(
        actor, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "events"
    )


def first_uploads(files: DataFrame, late: str = "1 day", time: str = "created_at", key: str = "file_hash") -> DataFrame:
    """(key, time) of one upload per content hash: the first to arrive on a stream, whose
    state is kept for as long as the watermark allows, and the earliest of a batch."""
    if files.isStreaming:
        return files.withWatermark(time, late).dropDuplicatesWithinWatermark([key]).select(key, time)
    return files.groupBy(key).agg(F.min(time).alias(time))


def audit_counts(events: DataFrame, per: str = "1 hour", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Audit events per window, type and status, and their actors, counted exactly.

    A stream can't count distinct values: there each window keeps the set of its actors until the watermark passes it.
    """
    actors = F.size(F.collect_set("actor")).cast("long") if events.isStreaming else F.count_distinct("actor")
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, per), "event_type", "status")
        .agg(F.count(F.lit(1)).alias("events"), actors.alias("actors"))
        .select(F.col("window.start").alias("window_start"), "event_type", "status", "events", "actors")
    )
