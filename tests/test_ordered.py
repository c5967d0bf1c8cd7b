"""Sliced windows give what plain windows give, on keys cut into many slices."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from neraca.operators.ordered import _thresholds, first_free, nearest_value, previous_value, rank_rows, running_sum


def rows(spark):
    rnd = random.Random(5)
    data = []
    for key, n in (("hot", 400), ("warm", 60), ("cold", 3), (None, 30)):
        for i in rnd.sample(range(10_000), n):
            data.append((key, i, rnd.randint(-50, 50), rnd.choice([None, i])))
    return spark.createDataFrame(data, "k string, i bigint, x bigint, y bigint")


def same(got, want):
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_rank(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("i")
    got = rank_rows(df, ["k"], ["i"], "n", slice_rows=20).select("k", "i", "n")
    same(got, df.select("k", "i", F.row_number().over(w).cast("long").alias("n")))


def test_running_sum(spark):
    df = rows(spark).withColumn("x", F.col("x").cast("decimal(18,2)"))
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    got = running_sum(df, ["k"], ["i"], F.col("x"), "s", slice_rows=20).select("k", "i", "s")
    same(got, df.select("k", "i", F.sum("x").over(w).alias("s")))


def test_previous(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("i")
    got = previous_value(df, ["k"], ["i"], "y", "p", slice_rows=20).select("k", "i", "p")
    same(got, df.select("k", "i", F.lag("y").over(w).alias("p")))


def test_hot_keys_are_cut(spark):
    from neraca.operators.ordered import with_slices

    sliced = with_slices(rows(spark), ["k"], ["i"], 20)
    per_key = {r["k"]: r["n"] for r in sliced.groupBy("k").agg(F.countDistinct("_slice").alias("n")).collect()}
    assert per_key["hot"] >= 15 and per_key["cold"] == 0
    assert sliced.groupBy("k", "_slice").count().filter("_slice is not null").agg(F.max("count")).first()[0] < 60


def test_outliers_and_ties_make_no_large_slice(spark):
    """One far position, one date for every row, and unreadable dates behind all others."""
    from neraca.operators import ordered

    for place in ("case when i = 5 then 99999999 else 20240000 + i % 7 end", "20240101", "case when i % 10 < 8 then 99990000 else i end"):
        df = spark.range(4000).selectExpr("'hot' as k", "id as i").withColumn("day", F.expr(place))
        sliced = ordered.with_slices(df, ["k"], ["day", "i"], 200)
        sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
        assert max(sizes) < 400 and len(sizes) >= 12
        w = Window.partitionBy("k").orderBy("day", "i")
        got = rank_rows(df, ["k"], ["day", "i"], "n", slice_rows=200).select("i", "n")
        same(got, df.select("i", F.row_number().over(w).cast("long").alias("n")))


def test_nearest_value_both_ways(spark):
    df = rows(spark)
    up = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("k").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    for slice_rows in (20, None):
        got = nearest_value(df, ["k"], ["i"], F.col("y"), "a", slice_rows)
        got = nearest_value(got, ["k"], ["i"], F.col("y"), "b", slice_rows, back=True).select("k", "i", "a", "b")
        same(got, df.select("k", "i", F.last("y", True).over(up).alias("a"), F.last("y", True).over(down).alias("b")))


def test_no_slices_without_hot_keys(spark, capsys):
    rank_rows(rows(spark), ["k"], ["i"], "n").explain()
    plan = capsys.readouterr().out
    assert plan.count("Scan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_staircases_add_up():
    rnd = random.Random(3)
    for _ in range(500):
        limits = [rnd.choice([0, 1, 2, 3, 5, 8, 1 << 62]) for _ in range(rnd.randrange(12))]
        edges = _thresholds(limits)
        assert edges == sorted(edges)
        for start in range(12):
            count = start
            for x in limits:
                count += count < x
            assert count == start + sum(t > start for t in edges)


def test_first_free_places(spark):
    rnd = random.Random(8)
    data = [(k, i, rnd.choice([None, rnd.randrange(n), 0])) for k, n in (("hot", 500), ("warm", 70), (None, 30), ("cold", 4)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, i bigint, x bigint").repartition(7)
    want = []
    for k in ("hot", "warm", None, "cold"):
        taken = 0
        for _, i, x in sorted((r for r in data if r[0] == k), key=lambda r: r[1]):
            own = taken if x is None or taken < x else None
            want.append((k, i, own))
            taken += own is not None
    for slice_rows in (20, None):
        got = [(r.k, r.i, r.n) for r in first_free(df, ["k"], ["i"], "x", "n", slice_rows).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
