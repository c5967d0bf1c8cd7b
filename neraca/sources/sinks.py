"""Sinks: the reconciliation report and the batch exports, one dataset per sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neraca.plans.export import batch_exports


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_reconciliation(job, folder: str, fmt: str = "parquet", session: str | None = None) -> dict[str, str]:
    """Summary, both match lists and the four left-over lists under ``folder``.

    With ``session`` the same report is kept apart per chat session.
    """
    root = folder if session is None else f"{folder}/session={session}"
    sheets = {
        "summary": job.summary(),
        "point_a_vs_c": job.matches_ac,
        "point_b_vs_e": job.matches_be,
        **job.left_over(),
    }
    return {name: write_table(df, f"{root}/{name}", fmt) for name, df in sheets.items()}


def write_batch_exports(results: DataFrame, folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Every batch in the export of its own layout, one dataset per layout, partitioned by batch.

    Batches that are written again replace their own partitions; those of others stay as they are.
    """
    paths = {}
    for name, df in batch_exports(results).items():
        writer = df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
        writer = writer.option("header", "true") if fmt == "csv" else writer
        writer.save(f"{folder}/{name}")
        paths[name] = f"{folder}/{name}"
    return paths


def export_again(results: DataFrame, folder: str, batches: list[int], fmt: str = "parquet") -> dict[str, str]:
    """New exports of a few batches; a batch whose layout has changed leaves none of the old one behind."""
    context = results.sparkSession.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    sheets = [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []
    for sheet in sheets:
        for batch in batches:
            files.delete(context._jvm.org.apache.hadoop.fs.Path(sheet, f"batch_id={batch}"), True)
    return write_batch_exports(results.filter(F.col("batch_id").isin(batches)), folder, fmt)
