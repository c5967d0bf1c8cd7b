"""The prefix trie against a plain walk over rebuilt conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from neraca.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            who, said = role or "", text or ""
            tie = hashlib.md5(f"{len(who)}:{who}{said}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, who, said))
    convs = {c: [x[3:] for x in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for k in members:
        if k:
            children.setdefault(k[:-1], set()).add(k)
    for k, m in members.items():
        own = (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        for d in range(len(k) + 1):
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in children)
            saved[k[:d]] = saved.get(k[:d], 0) + own
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children.get(k, ())), leaves[k], saved[k], digest(k)) for k, m in members.items()
    )


def collected(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


def talk(rng, n, words=3, longest=9):
    rows = []
    for c in range(n):
        base = rng.randrange(3)
        for t in range(rng.randrange(1, longest)):
            rows.append((c * rng.choice([1, 1, 1, 7]) if c > 5 else c, t, rng.choice(["user", "user", None]), " ".join(["a"] * rng.randrange(words)) + str(base if t < 4 else rng.randrange(2))))
    return rows


@pytest.mark.parametrize("seed,hot,run", [(1, None, 256), (2, 0, 2)])
def test_against_a_plain_walk(spark, monkeypatch, seed, hot, run):
    monkeypatch.setattr(prefixes, "RUN", run)
    rows = talk(random.Random(seed), 150)
    got = prefixes.trie(prefixes.shared_starts(prefixes.sequences(spark.createDataFrame(rows, SCHEMA))), hot)
    assert collected(got) == plain(rebuilt(rows))


def test_long_conversations_and_copies(spark):
    rows = [(c, t, "user", f"t{t}" if t < 100 + c else f"{c}") for c in range(3) for t in range(130)]
    rows += [(100 + c, t, "user", f"t{t}") for c in range(40) for t in range(c % 4)] + [(100 + c, 50, "x", "y z") for c in range(40)]
    given = prefixes.sequences(spark.createDataFrame(rows, SCHEMA))
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((role, text))
    assert collected(prefixes.trie(given)) == plain(want)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "x"), (1, None, "user", "null first"), (1, None, None, None), (1, 0, "", ""), (1, 2, "user", "same"), (1, 2, "user", "same"),
        (2, 1, "user", " \t\n"), (3, 1, "a", "b"), (4, 1, "ab", ""), (-7, 1, "user", "word " * 60_000), (20, 5, "user", "é ñ\x00"), (21, 5, "user", "only"),
        (22, None, None, None), (2**62 + 1, 1, "user", "far"), (2**62 + 2, 1, "user", "far"),
    ]
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", node string, n_convs string, pos long")
    got = prefixes.trie(prefixes.shared_starts(prefixes.sequences(table)))
    want = rebuilt(rows)
    assert collected(got) == plain(want)
    assert prefixes.trie(prefixes.shared_starts(prefixes.sequences(table.limit(0)))).count() == 0
    mute = prefixes.sequences(table.filter("conv_id = 22"))
    mute = prefixes.Sequences(mute.turns.limit(0), mute.convs)
    assert [tuple(r) for r in prefixes.trie(mute).select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "n_ends").collect()] == [(22, 0, 1, 0, 1, 1)]
