"""The live views over event and file tables, as batches and as streams that run."""

from __future__ import annotations

from pyspark.sql import functions as F

from neraca.plans.registry import query
from neraca.session import cut_lineage, discard, scratch
from neraca.sources.views import Views
from neraca.streaming import streams, tables


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(
    "st1_live_progress",
    """SELECT batch_id, count(*) AS files, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
              count(*) FILTER (status = 'processing') AS processing FROM fx_files GROUP BY 1""",
)
def st1_live_progress(v: Views):
    # Every file is seen three times: when it arrives, a little later, and two days later in its final state.
    seen = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(last).alias("last")) for h, last in ((0, False), (1, False), (48, True))]))
    events = v.files.select("batch_id", F.col("id").alias("file_id"), "created_at", "status", seen.alias("e"))
    events = events.select(
        "batch_id", "file_id", F.when(F.col("e.last"), F.col("status")).otherwise("processing").alias("status"),
        (F.col("created_at").cast("timestamp") + F.make_dt_interval(hours=F.col("e.h"))).alias("ts"),
    )
    return streams.batch_progress(streams.file_states(events))


@query(
    "st1_kept_states",
    """SELECT batch_id, count(*) AS files, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
              count(*) FILTER (status = 'processing') AS processing FROM fx_files GROUP BY 1""",
)
def st1_kept_states(v: Views):
    """A running stream of file events and the table it keeps."""
    ts = F.col("created_at").cast("timestamp")
    # Every file is seen twice, two hours before its state as well; the files are derived once for both.
    seen = F.explode(F.array(F.struct(ts.alias("ts"), "status"), F.struct((ts - F.expr("INTERVAL 2 HOURS")).alias("ts"), F.lit("processing").alias("status"))))
    events = v.files.select("batch_id", F.col("id").alias("file_id"), seen.alias("e")).select("batch_id", "file_id", "e.*")
    folder = scratch(v.spark)
    # No day's state is dropped here, so it grows with the files: on disk, not in the heap, and only while the stream runs.
    with tables.state_on_disk(v.spark):
        landed = cut_lineage(events, f"{folder}/in", **{"compression": "zstd", "parquet.block.size": str(tables.SPLIT)})
        states = streams.file_states(v.spark.readStream.schema(events.schema).parquet(f"{folder}/in"), "9000 days")
        tables.keep_latest(states, f"{folder}/states", ["batch_id", "file_id"], ["ts", "status"]).awaitTermination()
    discard(landed)
    tables.forget(v.spark, f"{folder}/states")
    return streams.batch_progress(tables.kept(v.spark, f"{folder}/states", states.schema, ["batch_id", "file_id"], ["ts", "status"]))


@query(
    "st2_rate_breaches",
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS actor, sum(1 + event_id % 4)::BIGINT AS requests
       FROM events GROUP BY 1, 2 HAVING sum(1 + event_id % 4) > 2""",
)
def st2_rate_breaches(v: Views):
    # Each event stands for a burst of one to four requests within its minute.
    burst = v.stream_events.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("event_id") % 4)))
    return streams.rate_breaches(burst, 2).withColumn("window_start", _text("window_start"))


@query(
    "st3_sessions",
    """SELECT actor, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS events
       FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
             FROM (SELECT user_id AS actor, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY actor, s""",
)
def st3_sessions(v: Views):
    out = streams.sessions(v.stream_events)
    return out.withColumn("session_start", _text("session_start")).withColumn("session_end", _text("session_end"))


@query("st4_first_uploads", "SELECT file_hash, min(created_at)::DATE AS first_day FROM fx_files GROUP BY 1")
def st4_first_uploads(v: Views):
    return streams.first_uploads(v.files).select("file_hash", F.to_date("created_at").alias("first_day"))


@query(
    "st3_closed_sessions",
    """SELECT actor, strftime(low, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(high, '%Y-%m-%d %H:%M:%S') AS session_end, events
       FROM (SELECT actor, min(ts) AS low, max(ts) + INTERVAL 30 MINUTES AS high, count(*) AS events
             FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
                   FROM (SELECT user_id AS actor, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY actor, s)
       WHERE high <= (SELECT max(ts) - INTERVAL 30 MINUTES FROM events)""",
)
def st3_closed_sessions(v: Views):
    """Sessions that a running stream has closed: those the watermark has passed."""
    folder = scratch(v.spark)
    rows = v.stream_events.withColumn("ts", F.col("ts").cast("timestamp"))
    cut_lineage(rows, f"{folder}/in")
    found = streams.sessions(v.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    tables.append_batches(found, f"{folder}/sessions").awaitTermination()
    out = tables.appended(v.spark, f"{folder}/sessions", found.schema)
    return out.withColumn("session_start", _text("session_start")).withColumn("session_end", _text("session_end"))


@query(
    "st5_audit_counts",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status,
              count(*) AS events, count(DISTINCT user_id) AS actors FROM events GROUP BY 1, 2, 3""",
)
def st5_audit_counts(v: Views):
    events = v.stream_events.withColumn("status", F.when(F.col("event_type") == "error", "failure").otherwise("success"))
    return streams.audit_counts(events).withColumn("window_start", _text("window_start"))


@query(
    "s20_audit_log",
    """SELECT CASE WHEN event_id % 7 = 3 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at, CASE WHEN event_id % 7 <> 3 THEN event_type END AS event_type,
              CASE WHEN event_id % 7 <> 3 THEN user_id::VARCHAR END AS actor, event_id % 7 = 3 AS corrupt, count(*) AS lines
       FROM events GROUP BY ALL""",
)
def s20_audit_log(v: Views):
    """Audit lines written as files, some cut short, and read by a running stream."""
    folder = scratch(v.spark)
    event = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "event_type", F.col("actor").cast("string").alias("actor"),
        F.col("event_id").cast("string").alias("target"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("details"),
    ))
    line = F.when(F.col("event_id") % 7 == 3, F.expr("substring(_line, 1, length(_line) - 5)")).otherwise(F.col("_line"))
    v.stream_events.withColumn("_line", event).select(line.alias("value")).write.text(f"{folder}/in")
    tables.run_audit(v.spark, f"{folder}/in", f"{folder}/audit").awaitTermination()
    good = tables.audit_events(v.spark, f"{folder}/audit").select(_text("timestamp").alias("at"), "event_type", "actor", F.lit(False).alias("corrupt"))
    bad = tables.corrupt_lines(v.spark, f"{folder}/audit").select(F.lit(None).cast("string").alias("at"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("actor"), F.lit(True).alias("corrupt"))
    return good.unionByName(bad).groupBy("at", "event_type", "actor", "corrupt").agg(F.count(F.lit(1)).alias("lines"))
