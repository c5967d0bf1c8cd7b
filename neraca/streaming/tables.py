"""Tables that running streams keep: idempotent batches, corrupt lines apart, and the latest row of each key.

A stream writes one folder per micro-batch, named by the batch number and whole once it holds ``_SUCCESS``.  A batch
that is replayed after a failure or a restart overwrites its own folder, so nothing is lost or repeated, and readers
take whole folders only.  The checkpoint of each stream lies next to its table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from neraca.session import delete, settings
from neraca.streaming.streams import AUDIT_SCHEMA

#: Batches after which a kept table is written whole again.
COMPACT = 20
#: Bytes of landed files that one task of a stream with much state reads.
SPLIT = 8 << 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB: on disk, with changelogs instead of snapshots."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def state_on_disk(spark: SparkSession) -> AbstractContextManager[None]:
    """Update-mode streams started inside, to run once over much state, keep it in RocksDB and hold little of the disk.

    A partition's local state goes as soon as its task has written the changelog (a later batch loads it from there), and
    the shuffle files of a step as soon as it ends. Small splits are sorted in memory, without spill. No batch is run
    after the last input only to drop closed state: it would load all state again, and in update mode changes no row.
    """
    store = "spark.sql.streaming.stateStore"
    return settings(spark, {
        f"{store}.providerClass": ROCKSDB,
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
        f"{store}.rocksdb.trackTotalNumberOfRows": "false",
        f"{store}.rocksdb.compression": "zstd",
        f"{store}.compression.codec": "zstd",
        f"{store}.unloadOnCommit": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(SPLIT),
    })


def forget(spark: SparkSession, table: str) -> None:
    """Delete the checkpoint of a stream that has ended and is not started again; its table stays."""
    delete(spark, f"{table}/_checkpoint")


def _folders(spark: SparkSession, table: str, prefix: str) -> dict[int, str]:
    """Number and path of each whole folder of a table."""
    context = spark.sparkContext
    path_of = context._jvm.org.apache.hadoop.fs.Path
    root = path_of(table)
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = {}
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{prefix}=") and files.exists(path_of(status.getPath(), "_SUCCESS")):
            found[int(name.split("=")[1])] = str(status.getPath().toString())
    return found


def start(stream: DataFrame, table: str, write: Callable[[DataFrame, int], None], mode: str, once: bool = True) -> StreamingQuery:
    """Run ``write`` for every micro-batch; ``once`` stops when all that has arrived is done."""
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{table}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_batches(stream: DataFrame, table: str, once: bool = True) -> StreamingQuery:
    """Rows that a stream appends, one folder per micro-batch."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return start(stream, table, write, "append", once)


def appended(spark: SparkSession, table: str, schema) -> DataFrame:
    """All rows of the whole batches of a table."""
    found = _folders(spark, table, "batch")
    return spark.read.schema(schema).parquet(*found.values()) if found else spark.createDataFrame([], schema)


# --- audit log --------------------------------------------------------------------------------

CORRUPT_SCHEMA = "line string"


def audit_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of the audit files, as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``line`` and ``event``; a line that is no event has a null event type or a corrupt record."""
    schema = f"{AUDIT_SCHEMA}, _corrupt_record string"
    return lines.select(F.col("value").alias("line"), F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("event"))


def run_audit(spark: SparkSession, folder: str, table: str, files_per_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Audit events of JSON lines to ``table/events``, lines that are none to ``table/corrupt``; blank lines are skipped."""

    def write(rows: DataFrame, number: int) -> None:
        bad = F.col("event").isNull() | F.col("event._corrupt_record").isNotNull() | F.col("event.timestamp").isNull()
        rows = rows.persist()
        rows.filter(~bad).select("event.*").drop("_corrupt_record").write.mode("overwrite").parquet(f"{table}/events/batch={number}")
        rows.filter(bad).select("line").write.mode("overwrite").parquet(f"{table}/corrupt/batch={number}")
        rows.unpersist()

    lines = audit_lines(spark, folder, files_per_batch).filter(F.trim("value") != "")
    return start(parsed_lines(lines), table, write, "append", once)


def audit_events(spark: SparkSession, table: str) -> DataFrame:
    return appended(spark, f"{table}/events", AUDIT_SCHEMA)


def corrupt_lines(spark: SparkSession, table: str) -> DataFrame:
    return appended(spark, f"{table}/corrupt", CORRUPT_SCHEMA)


# --- the latest row of each key ------------------------------------------------------------------


def _latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    # An order over all other columns is the row itself, so it is not shuffled beside it.
    row = F.max(F.struct(*order)) if {*others} <= {*order} else F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*keys).agg(row.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def keep_latest(stream: DataFrame, table: str, keys: Sequence[str], order: Sequence[str], compact: int = COMPACT, once: bool = True) -> StreamingQuery:
    """The latest row of each key of an update-mode stream.

    A batch writes what it changed; every ``compact`` batches the whole table is written instead, so a batch costs what
    it changes and a reader merges few folders.
    """
    spark, schema = stream.sparkSession, stream.schema

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}", compression="zstd")
        if number % compact == compact - 1:
            kept(spark, table, schema, keys, order, number).write.mode("overwrite").parquet(f"{table}/whole={number}", compression="zstd")

    return start(stream, table, write, "update", once)


def kept(spark: SparkSession, table: str, schema, keys: Sequence[str], order: Sequence[str], until: int | None = None) -> DataFrame:
    """The table that ``keep_latest`` writes, as of the last whole batch, or of batch ``until``."""
    fits = lambda n: until is None or n <= until
    batches = {n: p for n, p in _folders(spark, table, "batch").items() if fits(n)}
    wholes = {n: p for n, p in _folders(spark, table, "whole").items() if fits(n) and n != until}
    base = max(wholes, default=-1)
    paths = [p for n, p in batches.items() if n > base] + [wholes[n] for n in [base] if n >= 0]
    if not paths:
        return spark.createDataFrame([], schema)
    return _latest(spark.read.schema(schema).parquet(*paths), keys, order)
