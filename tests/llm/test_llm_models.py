"""Language identification, quality classifier and quality rules."""

import collections
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from neraca.llm import catalog, languages, quality, rules
from neraca.llm.linear import calibrate, dual_descent, sigmoid
from odd import documents, rows

FOLDER = "/root/testdata/sf0.01"


def test_dual_descent_reaches_the_optimum():
    """Against a slow subgradient descent on the same objective."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 5)), np.where(rng.random(80) < 0.5, 1.0, -1.0)
    x[:, 0] += y
    w = dual_descent([(np.arange(5), r) for r in x], y, 5, 0.5, epochs=500)
    loss = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()
    v = np.zeros(5)
    for t in range(1, 20_000):
        miss = y * (x @ v) < 1
        v -= (v - 0.5 * (x[miss] * y[miss, None]).sum(axis=0)) / (t + 10)
    assert loss(w) <= loss(v) + 1e-3
    a, b = calibrate(x @ w, y)
    assert a > 0 and ((sigmoid(a * (x @ w) + b) >= 0.5) == (y > 0)).mean() > 0.7


def test_held_out_languages(spark):
    found = catalog.QUERIES["op3_language_id"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    assert found.count() == docs.count()
    held = found.filter("held_out").join(docs, "doc_id").filter("lang is not null")
    right, low, high = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right > 0.98 and 0 <= low and high <= 1
    assert found.filter("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0


def test_language_answers_do_not_depend_on_other_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = languages.fit(docs, F.col("doc_id") % 2 == 0)
    assert set(model.inside) == {"germanic", "romance"}
    odd = documents(spark)
    found = languages.predict(odd, model)
    assert set(found.columns) == {*odd.columns, "lang_pred"}
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r.doc_id].add((r.lang_pred, r.score))
    assert got[5] == got[6] == got[7] == got[10] == {("und", 0.0)}
    assert len(got[13]) == 1 and got[1] == got[2] and {lang for lang, _ in got[11]} <= {"en", "de", "fr", "es"}
    assert {r.lang_pred for r in languages.predict(odd, None).collect()} == {"und"}
    assert languages.fit(odd.limit(0), F.lit(True)) is None
    assert languages.predict(documents(spark, []), model).count() == 0


def test_the_language_sample_is_held_once(spark):
    texts = [f"plain words number {k} of a text" for k in range(300)]
    docs = spark.createDataFrame([(k, "en", text) for k, text in enumerate(texts)], "doc_id long, lang string, text string")
    tracemalloc.start()
    try:
        model = languages.fit(docs, F.lit(True))
        held = tracemalloc.get_traced_memory()[1] / (300 * 4 * languages.SIZE)
    finally:
        tracemalloc.stop()
    # The matrix, and its squares as doubles; no rows beside them.
    assert model.top.names == ["germanic"] and held < 4.5


def test_one_language_needs_no_duel(spark):
    docs = spark.createDataFrame([(1, "some words", "xx"), (2, "more words", "xx"), (3, None, "xx"), (4, "null", None)], "doc_id long, text string, lang string")
    found = languages.predict(docs, languages.fit(docs, F.lit(True)))
    assert [(r.lang_pred, r.score) for r in found.orderBy("doc_id").collect()] == [("xx", 1.0), ("xx", 1.0), ("und", 0.0), ("xx", 1.0)]


def test_held_out_quality(spark):
    found = catalog.QUERIES["op1_quality_classifier"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = found.filter("held_out").join(labels, "doc_id").select("score", "quality", "predicted").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].score.min() > held[held.quality == 0].score.median()
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0


def test_indicators_match_a_plain_set():
    texts = [t for _, t, *_ in rows()]
    weights = np.random.default_rng(2).normal(size=quality.SIZE)
    model = quality.Model(weights, 0.1, 1.0, 0.0)
    for text, score in zip(texts, model.scores(pa.array(texts)), strict=True):
        raw = (text or "").encode()
        on = {((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality.BITS) for k in range(len(raw) - 2)}
        w = raw.translate(bytes(quality.tokens.LOWER)).split()
        on |= {quality.TRIGRAMS + k for k in range(3) if any(len(set(w[i : i + k + 2])) == 1 for i in range(len(w) - k - 1))}
        margin = sum(weights[f] for f in on) / max(1, len(on)) ** 0.5 + 0.1
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-9


def test_odd_quality_rows(spark):
    odd = documents(spark)
    labels = spark.createDataFrame([(1, 1), (3, 1), (10, 0), (11, 0), (4, 1), (4, 0), (5, None), (None, 1), (6, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels, F.lit(True))
    found = {r.doc_id: r.score for r in quality.scored(odd, model).collect()}
    assert found[1] == found[2] > found[10] and found[5] == found[6]
    for few in (labels.limit(0), labels.filter("doc_id = 1")):
        scores = {r.score for r in quality.scored(odd, quality.fit(odd, few, F.lit(True))).collect()}
        assert len(scores) == 1
    assert quality.scored(documents(spark, []), model).count() == 0


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)]


def test_statistics_of_whole_texts(spark):
    texts = [t for _, t, *_ in rows()] + ["a b c a b c", "a a a", "a\n\na\n \n ", "x\nx \nx", "#*$%&|<> <<", "a b c d a b\nc d"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert np.stack(rules.statistics(pa.array(texts)), axis=1).tolist() == [plain_statistics(t) for t in texts]


def test_outliers_against_plain_concentration_steps(spark):
    """The distributed estimate equals the same steps in numpy, and plants stand out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5)) * [0.5, 0.3, 0.02, 0.05, 0.05] + [6, 5, 0.1, 0.1, 0.1]
    x[:300] += [0, 0, 0.9, 0, 0.8]
    table = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"x{i} double" for i in range(5))).repartition(5)
    (got,) = rules.estimates(table).collect()
    logs = lambda d: np.round(np.log(d + 1e-3), 2)
    centre = np.percentile(np.round(x, 3), 50, axis=0)
    spread = np.percentile(np.round(np.abs(x - centre), 3), 50, axis=0) * 1.4826
    m, p = centre, np.diag(1 / (spread**2 + rules.FLOOR))
    dist = lambda: np.einsum("ni,ij,nj->n", x - m, p, x - m)
    for step in range(rules.STEPS + 1):
        d = dist()
        near = logs(d) <= np.percentile(logs(d), 100 * rules.HALF) if step < rules.STEPS else d / max(1, np.exp(np.percentile(logs(d), 50)) / rules.MEDIAN) <= rules.REWEIGHT
        m, p = x[near].mean(axis=0), np.linalg.inv(np.cov(x[near].T, bias=True) + np.diag(rules.FLOOR))
    assert np.allclose(got.m, m, atol=1e-2) and np.allclose(got.p, p.ravel(), rtol=0.05, atol=0.5)
    d = dist() / got.scale
    assert (d[:300] > rules.CUTOFF).all() and (d[300:] > rules.CUTOFF).mean() < 0.001


def test_odd_rule_rows(spark):
    out = {r.doc_id: r for r in rules.judged(documents(spark)).collect()}
    assert out[5].n_words == 0 and out[5].base_failed and not out[5].kept
    assert out[11].base_failed  # one word over and over
    assert rules.judged(documents(spark, [])).count() == 0
    many = [(k, " ".join(f"word{(k * 7 + j * j) % 977}" for j in range(60 + k % 9)), "en" if k % 2 else None, None if k % 3 else "s") for k in range(120)]
    many.append((500, " ".join(f"w{j}|<><><><><><><><>" for j in range(70)), None, "rare"))
    few = rules.judged(spark.createDataFrame(many, "doc_id long, text string, lang string, source string"))
    verdict = {r.doc_id: r.kept for r in few.collect()}
    assert not verdict[500] and sum(verdict.values()) >= 119


def test_foreign_texts_are_dropped_among_any_number_of_languages(spark):
    """Families of one language each, then four of four: clean texts stay, texts of an unlearned language go."""
    groups = [[f"x{k}" for k in range(n)] for n in (2, 8, 12)]
    groups.append([k for k in languages.FAMILIES if k not in ("sv", "da", "pt", "ro", "uk", "cs", "no", "bg")] + ["xa"])
    for names in groups:
        rng = np.random.default_rng(len(names))
        word = lambda letters: "".join(rng.choice(list(letters), rng.integers(3, 8)))
        vocabulary = {v: [word("abcdefghijklmnoprstu") for _ in range(40)] for v in names}
        docs = [(100 * n + k, " ".join(rng.choice(vocabulary[v], 40)), v) for n, v in enumerate(names) for k in range(24)]
        foreign = [word("абвгдежзиклмн") for _ in range(40)] + [word("vwxyzqj") for _ in range(40)]
        docs += [(9000 + k, " ".join(rng.choice(foreign[40 * (k % 2) :][:40], 30)), None) for k in range(6)]
        table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
        kept = {r.doc_id for r in corpus_pipeline.language_id(spark, table, "").collect()}
        assert kept == {d for d, _, v in docs if v is not None}


def test_one_outlying_statistic_of_each_kind_is_rejected(spark):
    """Deviations that texts past the base rules can have, in a group that has none of them."""
    rng = np.random.default_rng(5)
    usual = [[float(rng.normal(5.5, 0.3)), float(rng.normal(5, 0.2)), 0.0, 0.0, 0.0] for _ in range(2000)]
    table = spark.createDataFrame([("g", *r) for r in usual], "grp string, " + ", ".join(f"x{i} double" for i in range(5)))
    (fit,) = rules.estimates(table).collect()
    precision = np.array(fit.p).reshape(5, 5)
    for i, value in enumerate((9.9, 12.0, 0.3**0.5, 0.6**0.5, 0.49**0.5)):
        x = np.array([5.5, 5.0, 0.0, 0.0, 0.0])
        x[i] = value
        assert (x - fit.m) @ precision @ (x - fit.m) / fit.scale > rules.CUTOFF
