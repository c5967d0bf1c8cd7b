import random
import re
from collections import defaultdict

import pytest

from neraca.llm import jaccard
from neraca.llm.components import components
from neraca.session import cut_lineage
from odd import documents, rows


def plain(docs, words, percent):
    """Set size and smallest linked id of each row, from all pairs."""
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            holders[t].append(i)
    for i, s in enumerate(sets):
        for j in {j for t in s for j in holders[t] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    low = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((docs[i][0], len(sets[i]), low[find(i)]) for i in range(len(docs))), key=str)


def found(df, words, percent):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard.near_copies(df, words, percent).collect()), key=str)


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in rows()]
    assert found(documents(spark), 3, 90) == plain(docs, 3, 90)
    assert found(documents(spark, []), 3, 90) == []


@pytest.mark.parametrize("words, percent, seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_families_of_near_copies(spark, words, percent, seed):
    """Families around the threshold, chains, a passage in many texts, and a crowd of similar texts that don't link."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, docs = [word() for _ in range(60)], []
    for _ in range(12):
        text = [word() for _ in range(rng.choice([1, 2, 4, 12, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 14])):
            copy = list(text)
            for _ in range(rng.randrange(1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
    docs += [passage + [word() for _ in range(rng.randrange(80))] for _ in range(60)]
    base = [word() for _ in range(200)]
    docs += [[w if rng.random() > 0.04 else word() for w in base] for _ in range(60)]
    step = list(base)
    for k in range(20):  # a chain: neighbours link, ends don't
        step = list(step)
        step[5 * k] = word()
        docs.append(step)
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(df, words, percent) == plain(docs, words, percent)


def test_a_crowd_gathers_around_its_centre(spark, monkeypatch):
    """Copies that link with the text they come from are one group before the matrix, whatever the others of the crowd are like."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, docs = [word() for _ in range(150)], []
    for k in range(240):
        copy = list(base)
        for _ in range(min(k, rng.choice([1, 1, 2, 2, 3, 4, 6, 8]))):
            copy[rng.randrange(len(copy))] = word()
        docs.append((k, " ".join(copy)))
    grouped, met = [], []
    real = jaccard._open_groups

    def opened(shared, groups, tested, sets, percent):
        grouped.append(groups.groupBy("component").count().agg({"count": "max"}).first()[0])
        pairs = real(shared, groups, tested, sets, percent)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_open_groups", opened)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = plain(docs, 3, 90)
    assert found(df, 3, 90) == want
    linked = max(sum(r[2] == top for r in want) for top in {r[2] for r in want})
    assert grouped[0] + 1 >= 0.9 * linked
    assert met[0] <= len(docs)


def test_one_of_each_keeps_the_smallest_id_and_all_columns(spark):
    docs = documents(spark)
    kept = jaccard.one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    gone = {2, 9} | {13}  # 3 differs in three of nineteen shingles; 13 copies 4
    want = sorted([(False, i) for i in range(1, 17) if i not in gone] + [(True, 0)])
    assert ids == want  # of the null ids only the one without a text stays


def test_components_stop_when_links_are_stars(spark, monkeypatch):
    from neraca.llm import components as module

    written = []
    monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    stars = [(10 * c, 10 * c + k) for c in range(5) for k in range(1, 8)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {(b, a) for a, b in stars}
    assert len(written) == 1  # the links as given, and no round
    written.clear()
    got = {(r.node, r.component) for r in components(spark.createDataFrame([(2, 1), (3, 2), (3, 1)], "a long, b long")).collect()}
    assert got == {(2, 1), (3, 1)}
    assert len(written) == 2  # one round
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(5, k) for k in range(6, 40)]
    rng = random.Random(4)
    links = path + star + [(b, a) for a, b in path[:10]] + [(7, 7), (None, 3)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, **{k: 5 for k in range(6, 40)}}
