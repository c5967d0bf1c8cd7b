"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "neraca", **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    On a cluster the submit command supplies master, memory and
    ``spark.checkpoint.dir``; nothing here overrides those.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Small stages keep all cores busy; large ones are sized by the advisory size.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings that hold inside; the session's own come back after."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session, else the one
    set on the context, else a folder in the session's warehouse.  Never one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_neraca_checkpoints"
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder name inside the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/neraca-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder, or ``path``, and read back; ``options`` are the writer's.

    A lost executor costs one re-read and not a replay of every earlier round, and the
    plan of a loop starts afresh: a written table, unlike a checkpointed plan, does not
    carry the constraints of the rounds before it.  ``discard`` deletes it.
    """
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.options(**options).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._neraca_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote, once nothing unfinished reads it."""
    for table in tables:
        delete(table.sparkSession, table._neraca_path)


def delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
