"""Streams that run, stop and start again; text in parts; deep pages; exports of one batch; bounded name comparison."""

import datetime
import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from neraca.operators import activity, documents, match
from neraca.plans import stream_queries
from neraca.plans.activity_queries import results
from neraca.sources import sinks
from neraca.sources.views import Views
from neraca.streaming import streams, tables

FOLDER = "/root/testdata/sf0.001"
NOON = datetime.datetime(2024, 1, 1, 12)


def lines(n, bad=()):
    return [
        "{broken" if k in bad else json.dumps({"timestamp": f"2024-01-01T0{k % 10}:10:00", "event_type": "security", "actor": f"a{k}", "target": str(k)})
        for k in range(n)
    ]


def test_audit_stream_restarts_without_loss_or_repeats(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "audit")
    inbox.mkdir()
    every = lines(12, bad={3, 7})
    (inbox / "a.json").write_text("\n".join(every[:4]) + "\n\n")
    (inbox / "b.json").write_text("\n".join(every[4:6]))
    tables.run_audit(spark, str(inbox), table, files_per_batch=1).awaitTermination()
    assert tables.audit_events(spark, table).count() == 5 and tables.corrupt_lines(spark, table).count() == 1
    (inbox / "c.json").write_text("\n".join(every[6:]))
    # A batch that fails half-way leaves a folder that is not whole; the restart writes it again.
    (tmp_path / "audit" / "events" / "batch=2").mkdir(parents=True)
    (tmp_path / "audit" / "events" / "batch=2" / "part-0.parquet").write_bytes(b"torn")
    assert tables.audit_events(spark, table).count() == 5
    tables.run_audit(spark, str(inbox), table, files_per_batch=1).awaitTermination()
    tables.run_audit(spark, str(inbox), table, files_per_batch=1).awaitTermination()
    got = sorted(int(r.target) for r in tables.audit_events(spark, table).collect())
    assert got == [k for k in range(12) if k not in (3, 7)]
    assert [r.line for r in tables.corrupt_lines(spark, table).collect()] == ["{broken", "{broken"]


def test_nothing_has_arrived(spark, tmp_path):
    assert tables.audit_events(spark, str(tmp_path / "none")).count() == 0
    assert tables.kept(spark, str(tmp_path / "none"), "k long, v string", ["k"], ["v"]).count() == 0


def test_kept_table_follows_every_batch(spark, tmp_path):
    """After each micro-batch, also over compactions, the table equals a batch over all that has arrived."""
    rng, table, inbox = random.Random(2), str(tmp_path / "kept"), str(tmp_path / "in")
    schema = "batch_id long, file_id long, ts timestamp, status string"
    seen = []
    for step in range(5):
        fresh = [(f % 3, f, NOON + datetime.timedelta(minutes=10 * step + rng.randrange(5)), rng.choice(["processing", "completed", "failed"])) for f in rng.sample(range(9), 4)]
        seen += fresh
        spark.createDataFrame(fresh, schema).coalesce(1).write.mode("append").parquet(inbox)
        states = streams.file_states(spark.readStream.schema(schema).parquet(inbox), "9000 days")
        tables.keep_latest(states, table, ["batch_id", "file_id"], ["ts", "status"], compact=2).awaitTermination()
        kept = tables.kept(spark, table, states.schema, ["batch_id", "file_id"], ["ts", "status"])
        want = streams.batch_progress(spark.createDataFrame(seen, schema))
        assert sorted(streams.batch_progress(kept).collect()) == sorted(want.collect())
    assert len(tables._folders(spark, table, "whole")) >= 2


def test_latest_state_is_held_once(spark):
    """Equal times, null states and null times: as when time and state were two values; an order need not cover the row."""
    schema = "batch_id long, file_id long, ts timestamp, status string"
    day = datetime.timedelta(days=1)
    rows = [
        (1, 1, NOON, "processing"), (1, 1, NOON, "failed"), (1, 1, NOON + day, "completed"), (1, 2, NOON, None), (1, 2, NOON, "failed"), (1, 3, NOON, None),
        (1, 4, None, "failed"), (None, 5, NOON, "completed"), (1, 6, NOON, "failed"), (1, 6, NOON + datetime.timedelta(hours=1), None),
    ]
    events = spark.createDataFrame(rows, schema)
    got = streams.file_states(events, "1 day")
    assert got.schema.simpleString() == "struct<batch_id:bigint,file_id:bigint,status:string,ts:timestamp>"
    assert not any(f.metadata for f in got.schema.fields)
    latest = {(1, 1, "processing", NOON), (1, 1, "completed", NOON + day), (1, 2, "failed", NOON), (1, 3, None, NOON), (None, 5, "completed", NOON), (1, 6, None, NOON + datetime.timedelta(hours=1))}
    assert {tuple(r) for r in got.collect()} == latest
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(" not in plan(got)
    by_all = tables._latest(got, ["batch_id", "file_id"], ["ts", "status"])
    by_time = tables._latest(got.withColumn("more", F.create_map(F.lit("at"), "ts")), ["batch_id", "file_id"], ["ts"])
    want = {r for r in latest if r[:3] != (1, 1, "processing")}
    assert {tuple(r) for r in by_all.collect()} == want and by_all.columns == got.columns
    assert "max_by(" not in plan(by_all) and "max_by(" in plan(by_time) and "more" in by_time.columns
    assert {tuple(r) for r in by_time.drop("more").collect()} == want


def test_kept_states_leave_the_table_only(spark, tmp_path, monkeypatch):
    """The files are derived once, and neither what landed, the checkpoint nor local state outlasts the stream."""
    shipped = lambda n: datetime.datetime(2000, 1, 1) + datetime.timedelta(days=n)
    lines = [(o, 7 * o, o % 4 + s, "RN"[o % 2], "FO"[s % 2], shipped(o + s)) for o in range(40) for s in range(3)] + [(1, 2, 2, "R", "O", shipped(9)), (None, 1, 5, "N", "F", shipped(3)), (3, 1, 99, "N", "F", None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    plans, kept_at, settings = [], str(tmp_path / "kept"), ["spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.unloadOnCommit", "spark.sql.files.maxPartitionBytes"]
    original = stream_queries.cut_lineage

    def landing(df, *more, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return original(df, *more, **options)

    monkeypatch.setattr(stream_queries, "cut_lineage", landing)
    monkeypatch.setattr(stream_queries, "scratch", lambda _: kept_at)
    before = [spark.conf.get(s, None) for s in settings]
    v = Views(spark, str(tmp_path))
    got = {tuple(r) for r in stream_queries.st1_kept_states(v).collect()}
    files = v.files.filter("created_at is not null").collect()
    of = lambda b, s: sum(f.batch_id == b and s in (None, f.status) for f in files)
    assert got == {(b, of(b, None), of(b, "completed"), of(b, "failed"), of(b, "processing")) for b in {f.batch_id for f in files}}
    assert [spark.conf.get(s, None) for s in settings] == before
    assert len(plans) == 1 and plans[0].count("Relation [") == 1
    assert [p.name for p in (tmp_path / "kept").iterdir()] == ["states"]
    assert all(p.name.split("=")[0] in ("batch", "whole") for p in (tmp_path / "kept" / "states").iterdir())


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    tables.on_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def test_closed_state_is_evicted(spark, tmp_path, rocksdb):
    """Sessions close behind the watermark and leave the state; late rows drop; a restart repeats nothing."""
    inbox, table, schema = str(tmp_path / "in"), str(tmp_path / "out"), "ts timestamp, actor long"

    def feed(*rows):
        spark.createDataFrame([(NOON + datetime.timedelta(minutes=m), a) for m, a in rows], schema).coalesce(1).write.mode("append").parquet(inbox)
        found = streams.sessions(spark.readStream.schema(schema).parquet(inbox))
        run = tables.append_batches(found, table)
        run.awaitTermination()
        state = [p["stateOperators"][0] for p in run.recentProgress if p["stateOperators"]]
        out = sorted((r.actor, r.events) for r in tables.appended(spark, table, found.schema).collect())
        return out, (state[-1]["numRowsTotal"] if state else None), sum(s["numRowsDroppedByWatermark"] for s in state)

    assert feed((0, 1), (10, 1), (5, 2))[:2] == ([], 2)
    out, held, _ = feed((600, 3))
    assert out == [(1, 2), (2, 1)] and held == 1
    out, held, dropped = feed((3, 1), (610, 3))
    assert out == [(1, 2), (2, 1)] and dropped == 1 and held == 1
    assert feed((1200, 4))[0] == [(1, 2), (2, 1), (3, 2)]


def test_states_of_closed_days_are_evicted(spark, tmp_path, rocksdb):
    """A day closes once the watermark reaches its end: its state goes, its late rows drop, the next day's rows count."""
    inbox, table, schema = str(tmp_path / "in"), str(tmp_path / "out"), "batch_id long, file_id long, ts timestamp, status string"

    def feed(*rows):
        spark.createDataFrame([(1, f, NOON + datetime.timedelta(hours=h), s) for h, f, s in rows], schema).coalesce(1).write.mode("append").parquet(inbox)
        states = streams.file_states(spark.readStream.schema(schema).parquet(inbox), "1 hour")
        run = tables.keep_latest(states, table, ["batch_id", "file_id"], ["ts", "status"])
        run.awaitTermination()
        state = [p["stateOperators"][0] for p in run.recentProgress if p["stateOperators"]]
        got = {(r.file_id, r.status) for r in tables.kept(spark, table, states.schema, ["batch_id", "file_id"], ["ts", "status"]).collect()}
        return got, state[-1]["numRowsTotal"], sum(s["numRowsDroppedByWatermark"] for s in state)

    assert feed((0, 1, "processing"), (12.9, 2, "processing")) == ({(1, "processing"), (2, "processing")}, 2, 0)
    # The watermark is at 11.9 hours after noon, before the day's end: its rows still count.
    assert feed((11.8, 1, "failed"), (13, 2, "completed")) == ({(1, "failed"), (2, "completed")}, 1, 0)
    # Now it is at the day's end exactly, and the day is closed.
    assert feed((11.9, 1, "completed"), (12, 3, "failed")) == ({(1, "failed"), (2, "completed"), (3, "failed")}, 2, 1)


def test_first_uploads_are_forgotten_behind_the_watermark(spark, tmp_path, rocksdb):
    inbox, table, schema = str(tmp_path / "in"), str(tmp_path / "out"), "created_at timestamp, file_hash string"

    def feed(*rows):
        spark.createDataFrame([(NOON + datetime.timedelta(hours=h), x) for h, x in rows], schema).coalesce(1).write.mode("append").parquet(inbox)
        found = streams.first_uploads(spark.readStream.schema(schema).parquet(inbox), "1 day")
        run = tables.append_batches(found, table)
        run.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
        return sorted(r.file_hash for r in tables.appended(spark, table, found.schema).collect()), held[-1]

    assert feed((0, "x"), (1, "x"), (2, "y")) == (["x", "y"], 2)
    assert feed((3, "x"), (100, "z"))[0] == ["x", "y", "z"]
    assert feed((101, "w")) == (["w", "x", "y", "z"], 2)


def test_text_parts_make_the_whole_text(spark):
    rng = random.Random(4)
    rows = [(d, k, rng.choice([None, "", "é" * rng.randrange(1, 40), "word " * rng.randrange(1, 9)])) for d in range(6) for k in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "doc long, chunk long, text string").repartition(5)
    whole = {r.doc: r.raw_text for r in documents.merge_texts(df, ["doc"]).collect() if r.raw_text}
    for slice_rows in (None, 10):
        parts = documents.merge_text_parts(df, ["doc"], part_bytes=100, slice_rows=slice_rows).orderBy("part").collect()
        got = {}
        for r in parts:
            got.setdefault(r.doc, []).append(r.raw_text)
        assert {d: "\n".join(p) for d, p in got.items()} == whole
        assert max(len(r.raw_text.encode()) for r in parts) < 100 + 90 and max(map(len, got.values())) > 3


def test_deep_pages_reach_the_scan(spark, tmp_path, capsys):
    v = Views(spark, FOLDER)
    rows = v.batches.withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "batches"))
    rows = spark.read.parquet(str(tmp_path / "batches"))
    for slice_rows in (None, 200):
        anchors = {r["page"]: (r["time"], r["id"]) for r in activity.page_anchors(rows, "created_at", 7, slice_rows=slice_rows).collect()}
        assert sorted(anchors) == list(range(-(-rows.count() // 7)))
        for page in (0, 5, max(anchors)):
            got = activity.page_from(rows, "created_at", 7, anchors[page])
            assert [r["id"] for r in got.collect()] == [r["id"] for r in activity.newest(rows, "created_at", 7, 7 * page).collect()]
    got.explain()
    assert "LessThanOrEqual(created_at" in capsys.readouterr().out


def test_one_batch_is_exported_again(spark, tmp_path):
    v = Views(spark, FOLDER)
    rows = results(v).withColumn("extracted_data", F.lit("{}"))
    root = tmp_path / "out"
    sinks.write_batch_exports(rows, str(root))
    stamp = lambda: {str(p): p.stat().st_mtime_ns for p in root.rglob("part-*")}
    before = stamp()
    batch = rows.filter("document_type is not null").select("batch_id").first()[0]
    changed = rows.filter(F.col("batch_id") == batch).withColumn("document_type", F.lit("unheard of"))
    sinks.export_again(changed, str(root), [batch])
    after, mine = stamp(), f"batch_id={batch}/"
    assert {p: t for p, t in before.items() if mine not in p} == {p: t for p, t in after.items() if mine not in p}
    own = {p for p in after if mine in p}
    assert own and all("/mixed/" in p for p in own) and own.isdisjoint(before)


def test_name_bound_is_never_below_the_ratio(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ABCDE ") for _ in range(rng.randrange(12)))
    names = [(word(), word()) for _ in range(400)] + [("", "A"), (None, "A"), ("A.B", "B.A"), ("ABAB", "ABAB")]
    df = spark.createDataFrame(names, "a string, b string").withColumn("bound", match.similarity_bound(F.col("a"), F.col("b")))
    got = df.collect()
    for r in got:
        ratio = difflib.SequenceMatcher(None, r.a, r.b).ratio() if r.a and r.b else 0.0
        assert r.bound >= ratio
    assert got[-1].bound == 1.0 and sum(r.bound < 0.7 for r in got) > 100
