"""Files in and out, and streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from neraca import schema
from neraca.plans.activity_queries import results
from neraca.plans.reconcile import reconcile
from neraca.sources import readers, sinks
from neraca.sources.views import Views
from neraca.streaming import streams

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_load_table(spark, tmp_path, fmt):
    v = Views(spark, FOLDER)
    rows = v.bank.select("row_idx", "account_number", "tanggal", "keterangan", "debet", "kredit")
    path = sinks.write_table(rows, str(tmp_path / fmt), fmt)
    back = readers.load_table(spark, path, "row_idx bigint, account_number string, tanggal date, keterangan string, debet decimal(18,2), kredit decimal(18,2)", fmt)
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    with pytest.raises(ValueError):
        readers.load_table(spark, path, schema.BANK_ROW, "xlsx")


def test_catalogue(spark, tmp_path):
    for name in ("faktur_1.csv", "~tmp.csv", "rek_bca.csv", "batch_2.csv", "note.txt"):
        (tmp_path / name).write_text("x")
    got = readers.catalogue(spark, str(tmp_path), "*.csv").collect()
    assert {r["filename"]: r["document_type"] for r in got} == {"faktur_1.csv": "faktur_pajak", "rek_bca.csv": "rekening_koran", "batch_2.csv": "batch"}
    assert all(len(r["id"]) == 16 and r["file_size"] == 1 for r in got)
    assert [r["filename"] for r in readers.catalogue(spark, str(tmp_path), "*.csv", "batch").collect()] == ["batch_2.csv"]


def test_required_headers(spark):
    good = spark.createDataFrame([(schema.REQUIRED["rekening_koran"],)], "headers array<string>")
    assert readers.require_headers(good, "rekening_koran").count() == 1
    bad = spark.createDataFrame([(["Tanggal"],)], "headers array<string>")
    with pytest.raises(Exception, match="rekening_koran sheet lacks Keterangan"):
        readers.require_headers(bad, "rekening_koran").collect()


def test_report(spark, tmp_path):
    v = Views(spark, FOLDER)
    job = reconcile(v.invoice, v.withholding, v.bank)
    paths = sinks.write_reconciliation(job, str(tmp_path / "report"), "parquet", session="abc")
    rows = {name: spark.read.parquet(path).count() for name, path in paths.items()}
    assert rows["point_a_vs_c"] + rows["point_a_unmatched"] == v.invoice.count()
    assert rows["point_b_vs_e"] + rows["point_e_unmatched"] == v.bank.count()
    assert "session=abc" in paths["summary"]


def test_batch_exports(spark, tmp_path):
    v = Views(spark, FOLDER)
    paths = sinks.write_batch_exports(results(v).withColumn("extracted_data", F.lit("{}")), str(tmp_path / "out"))
    assert sum(spark.read.parquet(p).count() for p in paths.values()) == v.files.count()
    assert "kualitas" in spark.read.parquet(paths["rekening_koran"]).columns
    assert "dokumen_dasar_tanggal" in spark.read.parquet(paths["pph"]).columns


def run_stream(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture
def events(spark, tmp_path):
    v = Views(spark, FOLDER)
    rows = v.stream_events.withColumn("ts", F.col("ts").cast("timestamp"))
    # One closing event far ahead moves the watermark past everything else.
    rows = rows.unionByName(rows.orderBy("ts").limit(1).withColumn("ts", F.lit("2031-01-01").cast("timestamp")).withColumn("actor", F.lit(-1).cast("long")))
    for i, part in enumerate((rows.filter("event_id % 2 = 0 and actor >= 0"), rows.filter("event_id % 2 = 1 and actor >= 0"), rows.filter("actor < 0"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")), rows.filter("actor >= 0")


def keys(df):
    return sorted(map(repr, df.collect()))


def test_sessions_stream(spark, events):
    stream, batch = events
    got = run_stream(spark, streams.sessions(stream), "sessions", "append").filter("actor >= 0")
    assert keys(got) == keys(streams.sessions(batch))


def test_rate_stream(spark, events):
    stream, batch = events
    got = run_stream(spark, streams.rate_breaches(stream, 1, "1 hour"), "rates", "append").filter("actor >= 0")
    assert keys(got) == keys(streams.rate_breaches(batch, 1, "1 hour"))


def test_progress_stream(spark, tmp_path):
    v = Views(spark, FOLDER)
    files = v.files.select("batch_id", F.col("id").alias("file_id"), "status", F.col("created_at").cast("timestamp").alias("ts"))
    early = files.withColumns({"status": F.lit("processing"), "ts": F.col("ts") - F.expr("interval 2 hours")})
    files.unionByName(early).coalesce(1).write.parquet(str(tmp_path / "files"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "files"))
    states = run_stream(spark, streams.file_states(stream, "9000 days"), "progress", "update")
    assert keys(streams.batch_progress(states)) == keys(streams.batch_progress(files))


def test_uploads_stream(spark, tmp_path):
    v = Views(spark, FOLDER)
    files = v.files.withColumn("created_at", F.col("created_at").cast("timestamp"))
    files.coalesce(1).write.parquet(str(tmp_path / "files"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "files"))
    got = run_stream(spark, streams.first_uploads(stream, "9000 days"), "uploads", "append")
    batch = streams.first_uploads(files)
    assert got.dtypes == batch.dtypes and got.count() == batch.count()


def test_audit_stream(spark, tmp_path):
    lines = [
        {"timestamp": f"2024-01-01T0{h}:10:00", "event_type": t, "actor": a, "status": s}
        for h, t, a, s in [(1, "authentication", "a", "success"), (1, "authentication", "b", "success"), (2, "security", "a", "failure")]
    ]
    (tmp_path / "audit").mkdir()
    (tmp_path / "audit" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    log = streams.audit_log(spark, str(tmp_path / "audit"))
    batch = streams.audit_counts(log, time="timestamp")
    assert sorted(r["events"] for r in batch.collect()) == [1, 2]
    got = run_stream(spark, streams.audit_counts(streams.audit_stream(spark, str(tmp_path / "audit")), time="timestamp"), "audit", "complete")
    assert keys(got) == keys(batch)


def test_wide_statement_rows(spark):
    """A layout without an upper width takes rows of any number of cells."""
    from neraca.operators import statement

    cells = ["01/02/2024", "BAYAR", "1,000.00", "0.00", "5,000.00"] + [""] * 95
    rows = [("d", bank, 1, 0, 1, cells) for bank in ("BNI_V1", "BRI", "MANDIRI_V1", "OCBC", "BCA")]
    df = spark.createDataFrame(rows, "doc_id string, bank_code string, page int, table_idx int, row_idx int, cells array<string>")
    assert {r.bank_name for r in statement.normalize_statements(df).filter("bank_name = 'Bank BNI'").collect()} == {"Bank BNI"}
