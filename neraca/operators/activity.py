"""Users, batches, files, results and messages: filters, look-ups and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neraca.operators.ordered import rank_rows

from neraca.operators.summary import percent


# --- filters --------------------------------------------------------------------------------------


def owned_by(df: DataFrame, user: object, status: str | None = None) -> DataFrame:
    out = df.filter(F.col("user_id") == user)
    return out if status is None else out.filter(F.col("status") == status)


def in_list(df: DataFrame, column: str, listed: str) -> DataFrame:
    """Rows whose ``column`` is in a comma list; blanks are ignored, an empty list keeps all."""
    values = [x.strip() for x in listed.split(",") if x.strip()]
    if not values:
        return df
    wanted = df.sparkSession.createDataFrame([(x,) for x in sorted(set(values))], f"`{column}_text` string")
    return df.join(wanted, F.col(column).cast("string") == F.col(f"{column}_text"), "left_semi")


def search_documents(df: DataFrame, term: str, kind: str = "all") -> DataFrame:
    """Term in the name or the type, without case; and an exact type unless ``all``."""
    hit = F.lower(F.coalesce("name", F.lit(""))).contains(term.lower()) | F.lower(F.coalesce("type", F.lit(""))).contains(term.lower())
    return df.filter(hit if kind == "all" else hit & (F.col("type") == kind))


def search_batches(df: DataFrame, term: str, status: str = "all") -> DataFrame:
    hit = F.lower(F.col("id").cast("string")).contains(term.lower())
    return df.filter(hit if status == "all" else hit & (F.col("status") == status))


def recent(df: DataFrame, column: str, as_of: Column, days: int = 7) -> DataFrame:
    return df.filter(F.col(column) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def same_day(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    return df.filter(F.to_date(column) == F.to_date(as_of))


def newest(df: DataFrame, column: str, limit: int, offset: int = 0, tie: str = "id") -> DataFrame:
    """One page, newest first; ``tie`` makes the order total."""
    ordered = df.orderBy(F.desc(column), F.asc(tie))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_anchors(df: DataFrame, column: str, size: int, tie: str = "id", slice_rows: int | None = None) -> DataFrame:
    """(page, time, id): the first row of every page, newest first; one scan, kept for all readers of a table."""
    rows = df.select(F.lit(0).alias("_all"), F.col(column).alias("_time"), F.col(tie).alias("_id"))
    # Ranks ascend, so the newest come first by their distance from the far end of time.
    back = -F.unix_micros(F.col("_time").cast("timestamp"))
    ranked = rank_rows(rows.withColumn("_back", back), ["_all"], ["_back", "_id"], "_n", slice_rows)
    firsts = ranked.filter((F.col("_n") - 1) % size == 0)
    return firsts.select(((F.col("_n") - 1) / size).cast("long").alias("page"), F.col("_time").alias("time"), F.col("_id").alias("id"))


def page_from(df: DataFrame, column: str, size: int, first: tuple, tie: str = "id") -> DataFrame:
    """The page that begins with ``first`` (time, id), newest first.

    Rows before it are not sorted to be skipped: the bound on time reaches the scan and leaves out row groups.
    """
    time, key = F.lit(first[0]), F.lit(first[1])
    behind = (F.col(column) < time) | ((F.col(column) == time) & (F.col(tie) >= key))
    return df.filter((F.col(column) <= time) & behind).orderBy(F.desc(column), F.asc(tie)).limit(size)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` rows per key.  Spark limits each group before the shuffle, so a hot
    key ships ``n`` rows per task and not all of them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def last_messages(messages: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` messages of each session, with their place in time order."""
    order = [F.desc("turn"), F.asc("role")]
    w = Window.partitionBy("session_id").orderBy(F.asc("turn"), F.desc("role"))
    return first_per_group(messages, ["session_id"], order, n).withColumn("place", F.row_number().over(w))


def upsert_new(existing: DataFrame, fetched: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows win; fetched ids not yet present are added."""
    return existing.unionByName(fetched.join(existing.select(key), key, "left_anti"))


# --- look-ups -----------------------------------------------------------------------------------------


def results_of_users(results: DataFrame, batches: DataFrame) -> DataFrame:
    owners = batches.select(F.col("id").alias("batch_id"), "user_id")
    return results.join(owners, "batch_id")


def results_with_names(results: DataFrame, files: DataFrame) -> DataFrame:
    names = files.select(F.col("id").alias("document_file_id"), F.col("name").alias("filename"))
    return results.join(names, "document_file_id", "left").withColumn("filename", F.coalesce("filename", F.lit("Unknown")))


def users_with_activity(users: DataFrame, batches: DataFrame) -> DataFrame:
    """Every user with the number of batches and the time of the latest."""
    stats = batches.groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_batches"), F.max("created_at").alias("last_activity")
    )
    return users.join(stats, "id", "left").withColumn("total_batches", F.coalesce("total_batches", F.lit(0)))


def batches_with_files(batches: DataFrame, files: DataFrame, shown: int | None = None) -> DataFrame:
    """Batches with their file count and their files, or the first ``shown`` of them.

    With ``shown`` only those files are gathered into a list, so a batch of any size is safe.
    """
    counts = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_files"))
    head = files if shown is None else first_per_group(files, ["batch_id"], [F.asc("id")], shown)
    lists = head.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "name", "status"))).alias("files")
    )
    return (
        batches.join(counts.withColumnRenamed("batch_id", "id"), "id", "left")
        .join(lists.withColumnRenamed("batch_id", "id"), "id", "left")
        .withColumn("total_files", F.coalesce("total_files", F.lit(0)))
    )


# --- statistics -----------------------------------------------------------------------------------------


def admin_counters(users: DataFrame, batches: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    """Thirteen counters in one row, from one pass over the union of three tables."""
    week = as_of - F.expr("INTERVAL 7 DAYS")
    fresh = (F.col("created_at") >= week).alias("fresh")
    people = users.select(F.lit("user").alias("kind"), fresh, "is_active", "is_admin")
    work = batches.select(F.lit("batch").alias("kind"), fresh, "status")
    stored = files.select(F.lit("file").alias("kind"))
    facts = people.unionByName(work, allowMissingColumns=True).unionByName(stored, allowMissingColumns=True)
    user, batch = F.col("kind") == "user", F.col("kind") == "batch"
    state = F.col("status")
    return facts.agg(
        F.count_if(user).alias("users_total"),
        F.count_if(user & F.col("is_active")).alias("users_active"),
        F.count_if(user & ~F.col("is_active")).alias("users_inactive"),
        F.count_if(user & F.col("is_admin")).alias("users_admins"),
        F.count_if(user & F.col("fresh")).alias("users_new"),
        F.count_if(batch).alias("batches_total"),
        *[F.count_if(batch & (state == s)).alias(f"batches_{s}") for s in ("completed", "processing", "partial")],
        F.count_if(batch & state.isin("failed", "error")).alias("batches_failed"),
        F.count_if(batch & F.col("fresh")).alias("batches_this_week"),
        F.count_if(F.col("kind") == "file").alias("files_total"),
    )


def batch_progress(batches: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    """Progress %, failed files, current file and remaining seconds of each batch."""
    status = F.col("status")
    counts = files.groupBy(F.col("batch_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(status == "completed").alias("processed_files"),
        F.count_if(status.isin("failed", "error")).alias("failed_files"),
        F.max_by(F.when(status == "processing", F.col("name")), F.when(status == "processing", F.col("id"))).alias("current_file"),
    )
    joined = batches.join(counts, "id", "left").fillna(0, ["total_files", "processed_files", "failed_files"])
    done, total = F.col("processed_files"), F.col("total_files")
    elapsed = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    eta = F.floor(elapsed.cast("double") / F.nullif(done, F.lit(0)) * (total - done))
    return joined.withColumn("progress", percent(done, total)).withColumn(
        "eta_seconds", F.when((status == "processing") & (done > 0), eta)
    )


def final_status(files: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Cancelled first; else completed when no file failed, failed when none succeeded."""
    ok, bad = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status").isin("failed", "error"))
    counts = files.groupBy("batch_id").agg(ok.alias("processed"), bad.alias("failed"))
    if cancelled is None:
        flagged = counts.withColumn("_cancelled", F.lit(False))
    else:
        marks = cancelled.select("batch_id").distinct().withColumn("_cancelled", F.lit(True))
        flagged = counts.join(marks, "batch_id", "left")
    return flagged.withColumn(
        "final_status",
        F.when(F.col("_cancelled"), "cancelled")
        .when(F.col("failed") == 0, "completed")
        .when(F.col("processed") == 0, "failed")
        .otherwise("partial"),
    ).drop("_cancelled")


def user_dashboard(batches: DataFrame, results: DataFrame) -> DataFrame:
    """Per user: batches by state, success rate, documents, mean time, most frequent type."""
    status = F.col("status")
    work = batches.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "processing").alias("processing"),
        F.count_if(status == "error").alias("failed"),
    )
    seconds = F.coalesce(F.nullif("processing_time", F.lit(0)), F.col("ocr_processing_time"), F.lit(0)).cast("decimal(18,2)")
    owned = results_of_users(results, batches)
    by_type = owned.groupBy("user_id", F.coalesce("document_type", F.lit("unknown")).alias("document_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("seconds")
    )
    # Type names that sort first win ties.
    docs = by_type.groupBy("user_id").agg(
        F.sum("n").alias("total_documents"),
        F.sum("seconds").alias("_seconds"),
        F.min_by("document_type", F.struct(-F.col("n"), F.col("document_type"))).alias("top_type"),
    )
    return (
        work.join(docs, "user_id", "left")
        .withColumn("success_rate", percent(F.col("completed"), F.col("total_batches")))
        .withColumn("total_documents", F.coalesce("total_documents", F.lit(0)))
        .withColumn("mean_seconds", F.coalesce(F.col("_seconds").cast("double") / F.col("total_documents"), F.lit(0.0)))
        .withColumn("top_type", F.coalesce("top_type", F.lit("N/A")))
        .drop("_seconds")
    )


def type_shares(results: DataFrame, top: int | None = None) -> DataFrame:
    """Documents per type with their share in percent, most frequent first."""
    counts = results.groupBy(F.coalesce("document_type", F.lit("unknown")).alias("document_type")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n").cast("double")).scalar()
    shares = counts.withColumn("share", F.col("n").cast("double") / total * 100)
    ordered = shares.orderBy(F.desc("n"), F.asc("document_type"))
    return ordered if top is None else ordered.limit(top)


def point_counts(projects: DataFrame, a: DataFrame, b: DataFrame, c: DataFrame, e: DataFrame) -> DataFrame:
    """Rows of points A, B, C and E per project, 0 included."""
    tagged = None
    for name, rows in zip("abce", (a, b, c, e)):
        part = rows.select("project_id", F.lit(name).alias("_p"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("project_id").agg(*[F.count_if(F.col("_p") == p).alias(f"point_{p}_count") for p in "abce"])
    return projects.join(counts, "project_id", "left").fillna(0, [f"point_{p}_count" for p in "abce"])


def summary_sheet(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Generic export: type, file, confidence in percent, status."""
    return results.select(
        *keys,
        "document_type",
        "original_filename",
        F.format_string("%.1f%%", F.col("confidence").cast("double") * 100).alias("confidence"),
        F.lit("Completed").alias("status"),
    )


def batch_layouts(results: DataFrame) -> DataFrame:
    """Layout of each batch export: its only document type, else ``mixed``."""
    kinds = results.groupBy("batch_id").agg(
        F.countDistinct(F.lower("document_type")).alias("types"), F.min(F.lower("document_type")).alias("_only")
    )
    return kinds.withColumn("layout", F.when(F.col("types") == 1, F.col("_only")).otherwise("mixed")).drop("_only")
