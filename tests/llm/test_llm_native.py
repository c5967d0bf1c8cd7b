"""Licences, preference pairs and shards, against their twins and plain versions."""

import hashlib

import pytest

from compare import compare, connect
from neraca.llm import catalog, licenses, preferences, shards
from odd import documents

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twins(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, catalog.QUERIES[name], catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_preference_pairs", "op7_license_scan", "op9_sharding"])
def test_native_plans(spark, name, capsys):
    catalog.QUERIES[name](spark, FOLDER).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def scan(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.sentence_ids, r.licenses) for r in licenses.scanned(df).orderBy("doc_id").collect()]


def test_whole_licences_and_rules(spark):
    two = licenses.TEXTS["bsd-2-clause"]
    got = scan(
        spark, licenses.TEXTS["mit"].replace(" of this", "\nof this"), two, two + "\n\n" + licenses.THIRD_CLAUSE, "prose without an end\nReleased under the MIT License.",
        "released UNDER the mit license", "Released under the MIT License of nobody.", "", None, "Licensed under CC BY-NC 4.0.  All rights reserved.",
        two.split("\n\n")[0],
    )
    assert [x[1] for x in got] == [["mit"], ["bsd-2-clause"], ["bsd-3-clause", "bsd-2-clause"], ["mit"], ["mit"], [], [], [], ["cc-by-nc-4.0", "proprietary"], []]
    assert len(got[-1][0]) == 1  # a known sentence, but no whole rule


def test_odd_licence_rows(spark):
    out = licenses.scanned(documents(spark))
    assert out.count() == documents(spark).count() and {"score", "key"} <= set(out.columns)


def turns(spark, *convs):
    rows = [(c, t, role, text) for c, conv in convs for t, (role, text) in enumerate(conv)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_pairs(spark):
    good = [("user", "hi"), ("assistant", "yes"), ("user", "why"), ("assistant", "because")]
    table = turns(spark, (1, good), (2, [*good[:3], ("assistant", "no <|im_end|>")]), (3, good), (4, [("user", "other")]), (None, good))
    convs = preferences.conversations(table)
    pairs = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (12, 1, 4), (13, 1, 99)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in preferences.formatted(convs, convs, pairs).collect()}
    assert sorted(got) == [10, 11, 12]
    first = got[10]
    assert first.n_prompt_turns == 3 and first.prompt.count(preferences.OPEN) == 3
    assert [first.chosen[s.first : s.end] for s in first.chosen_mask] == ["because<|im_end|>"]
    assert [first.rejected[s.first : s.end] for s in first.rejected_mask] == ["no <\\|im_end|><|im_end|>"]
    assert got[11].n_prompt_turns == 4 and got[11].chosen == got[11].rejected == "" and got[11].chosen_mask == []
    assert got[12].n_prompt_turns == 0 and got[12].prompt == "" and len(got[12].chosen_mask) == 2


def test_null_turns_and_empty_tables(spark):
    table = spark.createDataFrame([(1, None, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    convs = preferences.conversations(table)
    (row,) = preferences.completions(preferences.with_other_ending(convs)).collect()
    assert row.n_prompt_turns == 2 and row.rejected == "" and row.chosen.startswith("<|im_start|>assistant")
    assert preferences.completions(preferences.with_other_ending(preferences.conversations(table.limit(0)))).count() == 0


def test_lookup_table():
    names = [f"n{k}" for k in range(10)]
    table = shards.lookup_table(names, 1009)
    assert {table.count(k) for k in range(10)} <= {100, 101}
    number = lambda name, salt: int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)
    plain = [None] * 1009
    order = lambda n: ((number(n, "offset") + j * (number(n, "skip") % 1008 + 1)) % 1009 for j in range(1009))
    orders = [order(n) for n in names]
    turn = 0
    while None in plain:
        slot = next(s for s in orders[turn % 10] if plain[s] is None)
        plain[slot] = turn % 10
        turn += 1
    assert plain == table
    fewer = shards.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 1009 * 0.2
    for bad in ((names, 1000), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            shards.lookup_table(*bad)


def test_odd_shard_rows(spark):
    docs = documents(spark)
    out = shards.placed(docs)
    assert sorted(out.columns) == sorted([*docs.columns, "slot"]) and out.count() == docs.count()
    assert out.filter("shard is null or slot is null").count() == 0
    assert out.filter("doc_id = 13").select("shard").distinct().count() == 1
    assert shards.placed(documents(spark, [])).count() == 0
