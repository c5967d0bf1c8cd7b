"""Decontamination, mixing and the pipeline."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from neraca.llm import decontaminate, mixing
from odd import documents

FOLDER = "/root/testdata/sf0.001"


def test_masks_hit_every_window_with_two_substitutions():
    n, spoiled = decontaminate.WINDOW, decontaminate.WINDOW - math.ceil(decontaminate.SHARE * decontaminate.WINDOW)
    assert spoiled == 2
    for bad in itertools.combinations(range(n), spoiled):
        assert any(not set(bad) & {o + k for k in mask} for mask in decontaminate.MASKS for o in range(n - mask[-1]))


@pytest.mark.parametrize("length", range(decontaminate.LEAST, decontaminate.WINDOW))
def test_short_masks_too(length):
    (mask,) = decontaminate.masks_for(length)
    spoiled = length - math.ceil(decontaminate.SHARE * length)
    for bad in itertools.combinations(range(length), spoiled):
        assert any(not set(bad) & {o + k for k in mask} for o in range(length - mask[-1]))


def plain_leaks(docs, items):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = words(text), words(item)
        n = min(len(b), decontaminate.WINDOW)
        if len(b) >= decontaminate.LEAST:
            for p, q in itertools.product(range(len(a) - n + 1), range(len(b) - n + 1)):
                if sum(a[p + k] == b[q + k] for k in range(n)) >= math.ceil(decontaminate.SHARE * n):
                    out.add((d, i))
                    break
    return out


def test_leaks_against_all_windows(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice(["of", "the", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 8, 10, 12, 13, 20, 45])))) for k in range(30)] + [(90, None), (91, ""), (92, "the " * 9)]
    docs = []
    for d in range(80):
        text = [word() for _ in range(rng.randrange(120))]
        part = items[rng.randrange(30)][1].split()
        low = rng.randrange(max(1, len(part) - 13))
        part = [w if rng.random() > rng.choice([0, 0.1, 0.25]) else word() for w in part[low:]]
        at = rng.randrange(len(text) + 1)
        docs.append((d, " ".join([*text[:at], *part, *text[at:]]).replace(" of ", " OF, ")))
    docs += [(100, None), (101, ""), (102, "the " * 40), (102, "the " * 40)]
    want = plain_leaks(docs, items)
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 900):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.leaked(table, bench)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 20
        left = sorted(r.doc_id for r in decontaminate.clean(table, bench).collect())
        assert left == sorted(d for d, _ in docs if d not in {d for d, _ in want})


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while seven wizards mix potions", "x")], "item_id long, text string, doc_id string")
    got = sorted(r.doc_id or -1 for r in decontaminate.leaked(documents(spark), bench).collect())
    assert got == [-1, 1, 2, 3, 16]
    assert decontaminate.clean(documents(spark), bench).columns == documents(spark).columns
    assert decontaminate.leaked(documents(spark), bench.limit(0)).count() == 0
    assert decontaminate.clean(documents(spark), bench.limit(0)).count() == documents(spark).count()
    assert decontaminate.leaked(documents(spark, []), bench).count() == 0


def test_raking_meets_the_marginals_by_both_ways(spark):
    rng = random.Random(6)
    cells = [(f"s{a}", rng.choice(["en", None]), f"t{b}") for a in range(5) for b in range(3) for _ in range(2)]
    docs = [(k, *cells[rng.randrange(len(cells))], rng.randrange(1, 900)) for k in range(600)]
    rows = spark.createDataFrame(docs, "doc_id long, source string, lang string, topic string, n_words long")
    targets = {"source": {f"s{a}": (a + 1) / 15 for a in range(5)}}
    near = {tuple(r[:3]): r.chance for r in mixing.chances(rows, targets, 0.4).collect()}
    far = {tuple(r[:3]): r.chance for r in mixing.chances(rows, targets, 0.4, cells=0).collect()}
    assert near.keys() == far.keys() and all(abs(near[k] - far[k]) < 1e-3 for k in near)
    kept = {k: 0.0 for k in targets["source"]}
    for _, s, la, t, n in docs:
        kept[s] += n * near[s, la, t]
    total = sum(d[-1] for d in docs)
    assert abs(sum(kept.values()) - 0.4 * total) < 0.01 * total
    if max(near.values()) < 1:  # no cell is short of words, so the source shares are met
        assert all(abs(kept[s] / sum(kept.values()) - share) < 0.02 for s, share in targets["source"].items())


def shares_and_targets(rows, counted):
    """For each dimension and value: the share of words after ``counted``, and the flattened share before."""
    for d in mixing.DIMS:
        had, has = {}, {}
        for r in rows:
            had[r[d]] = had.get(r[d], 0) + r.n_words
            has[r[d]] = has.get(r[d], 0) + r.n_words * r[counted]
        target, total = mixing.tempered(had), sum(has.values())
        for v in had:
            yield has[v] / total, target[v]


def test_production_mix_meets_its_marginals(spark):
    rows = mixing.op4_mix_sources(spark, "/root/testdata/sf0.01").collect()
    total = sum(r.n_words for r in rows)
    assert max(r.weight for r in rows) > 1  # some cells have fewer words than the mix needs
    assert all(abs(share - target) < 1e-3 for share, target in shares_and_targets(rows, "weight"))
    assert all(abs(share - target) < 0.05 for share, target in shares_and_targets(rows, "copies"))
    assert abs(sum(r.n_words * r.weight for r in rows) - mixing.KEEP * total) < 1e-3 * total
    assert all(r.kept == (r.copies > 0) and r.weight - 1 < r.copies < r.weight + 1 for r in rows)


def test_rake_equals_plain_steps():
    n = np.array([10.0, 20, 30, 40])
    w = mixing.rake(n, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([0.5, 0.5]), np.array([0.7, 0.3])])
    assert np.allclose([w[:2].sum(), w[2:].sum(), w[[0, 2]].sum()], [50, 50, 70])
    assert np.isclose(w[0] * w[3] / (w[1] * w[2]), 10 * 40 / (20 * 30))  # raking keeps the odds ratio


def test_odd_mixing_rows(spark):
    docs = documents(spark)
    assert mixing.sample(docs, keep=1.0).count() == docs.count()
    part = mixing.sample(docs, keep=0.5)
    assert part.columns == docs.columns
    assert part.filter("doc_id = 13").count() in (0, 2)
    assert mixing.sample(documents(spark, [])).count() == 0
    with_topic = docs.withColumn("topic", F.lit(1)).withColumn("chance", F.lit("c"))
    assert mixing.sample(with_topic, keep=1.0).columns == with_topic.columns


def test_pipeline_stages(spark):
    start = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, kept = start, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name in ("mixed", "sharded"):  # whole copies, as many as the mix draws
            copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
        else:
            assert out.count() == len(kept[name])
        if name == "mixed":
            drawn = {r.doc_id: r.copies for r in mixing.weighted(docs).collect() if r.copies}
        if name in ("mixed", "sharded"):
            assert copies == drawn
        if name != "sharded":
            assert out.schema == start.schema
        docs = out
    every = {r.doc_id for r in start.select("doc_id").collect()}
    assert kept["language_id"] == every  # all of these texts are of a language
    assert kept["mixed"] == kept["sharded"] <= kept["decontaminated"] <= kept["near_copies"] < every
    texts = [(r.doc_id, r.text) for r in start.collect() if r.doc_id in kept["near_copies"]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {d for d, t in texts if any(i in t for _, i in items)}
    assert bad and not bad & kept["decontaminated"]
    assert len(kept["mixed"]) > 0.8 * len(kept["decontaminated"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == kept["sharded"]


def test_pipeline_on_odd_and_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, rows in (("odd", None), ("none", [])):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        ids = [r.doc_id for r in docs.collect()]
        assert (len(ids) == 0) == (name == "none")
        assert not {5, 6, 7, 10} & set(ids)
