import random

import pytest

from neraca.llm import lines
from odd import documents


@pytest.mark.parametrize("seed, least", [(1, 1), (2, 9), (3, 30)])
def test_random_lines_against_all_suffixes(spark, seed, least):
    rng = random.Random(seed)
    docs = [(i, "\n".join(rng.choice("abcd") * rng.choice([1, 1, 2, 5]) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    docs += [(40 + k, docs[5][1]) for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    keyed = df.selectExpr("doc_id", "xxhash64(doc_id, text) as key").join(lines.deletions(df, least), "key")
    got = {r.doc_id: sorted(r.deleted) for r in keyed.collect()}
    assert {d: got.get(d, []) for d, _ in docs} == longest(docs, least)


def test_texts_lose_later_copies_only(spark):
    passage = "\n".join(f"sentence number {k} of a passage that several documents share" for k in range(6))
    docs = [(3, "tail\n" + passage), (1, passage + "\nown line"), (2, "head\n\n" + passage + "\n\nfoot"), (4, "short\nlines"), (5, "short\nlines")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, key string")
    got = {r.doc_id: r.text for r in lines.deduplicated(df).collect()}
    assert got == {1: docs[1][1], 2: "head\n\n\nfoot", 3: "tail", 4: "short\nlines", 5: "short\nlines"}


def test_odd_rows(spark):
    docs = documents(spark)
    out = lines.deduplicated(docs)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == docs.count()
    assert lines.deletions(documents(spark, [])).count() == 0


def longest(docs, least):
    """Places of deleted lines by the longest match with any earlier suffix, comparing all pairs."""
    seq = [(i, k, x) for i, (_, text) in enumerate(docs) for k, x in enumerate(y.strip(" \t\r") for y in text.split("\n")) if x]
    out = [set() for _ in docs]
    for p in range(len(seq)):
        best = 0
        for q in range(p):
            n = 0
            while p + n < len(seq) and seq[p + n][0] == seq[p][0] and seq[q + n][0] == seq[q][0] and seq[p + n][2] == seq[q + n][2]:
                n += 1
            best = max(best, n)
        if best and sum(len(x) for *_, x in seq[p : p + best]) >= least:
            out[seq[p][0]].update(k for _, k, _ in seq[p : p + best])
    return {d: sorted(o) for (d, _), o in zip(docs, out, strict=True)}


def found(spark, docs, least):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    keyed = df.selectExpr("doc_id", "xxhash64(doc_id, text) as key").join(lines.deletions(df, least), "key")
    return {r.doc_id: sorted(r.deleted) for r in keyed.collect()}


def test_runs_are_measured_against_the_longest_earlier_match(spark):
    one, two, three, other = (f"{x} of a passage, fifty-five characters long" + "." * 55 for x in ("one", "two", "three", "other"))
    one, two, three, other = (x[:55] for x in (one, two, three, other))
    docs = [(1, f"{one}\n{two}\n{other}"), (2, f"{one}\n{two}\n{three}"), (3, f"{one}\n{two}\n{three}")]
    assert found(spark, docs, 160) == longest(docs, 160) == {1: [], 2: [], 3: [0, 1, 2]}


@pytest.mark.parametrize("seed, letters, least", [(4, "abc", 9), (5, "ab", 12), (6, "abcd", 7)])
def test_shared_openings_against_all_pairs(spark, seed, letters, least):
    rng = random.Random(seed)
    openings = [[rng.choice(letters) for _ in range(20)] for _ in range(3)]
    docs = []
    for i in range(50):
        opening = rng.choice(openings)
        own = [rng.choice(letters) * rng.choice([1, 3]) for _ in range(rng.randint(0, 12))]
        docs.append((i, "\n".join(opening[rng.randint(0, 4) : rng.randint(5, 20)] + own)))
    assert found(spark, docs, least) == longest(docs, least)
