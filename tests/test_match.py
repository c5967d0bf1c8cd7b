"""Matching against plain loops on random small scopes with ties."""

import datetime
import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neraca.operators import match

DAY = datetime.date(2024, 3, 1)


def confidence(b, e):
    gap = abs((b[1] - e[1]).days)
    pct = abs(b[2] - e[2]) / abs(b[2]) * 100
    ds = 1.0 - gap / 7.0 if gap <= 7 else 0.0
    as_ = 1.0 - pct / 5.0 if pct <= 5 else 0.0
    return ds * 0.6 + as_ * 0.4, pct


def walk(bs, es, need_amount=False):
    used, out = set(), []
    for b in sorted(bs):
        best = None
        if b[1] is None or not b[2]:
            continue
        for e in sorted(es):
            if e[0] in used or e[1] is None or not e[2]:
                continue
            c, pct = confidence(b, e)
            if c >= 0.5 and not (need_amount and pct > 5) and (best is None or c > best[0]):
                best = (c, e[0])
        if best:
            used.add(best[1])
            out.append((b[0], best[1], best[0]))
    return out


def random_scopes(seed, scopes, rows, spread):
    rnd = random.Random(seed)
    left, right = [], []
    for s in range(scopes):
        for side in (left, right):
            for i in rnd.sample(range(100), rnd.randint(0, rows)):
                day = None if rnd.random() < 0.05 else DAY + datetime.timedelta(days=rnd.randint(0, spread))
                amount = rnd.choice([0.0, -100.0, 100.0, 100.0, 101.0, 103.0, 250.0, 260.0, 1000.0])
                side.append((f"s{s}", i, day, amount))
    return left, right


def frames(spark, left, right):
    b = spark.createDataFrame(left, "scope string, row_idx bigint, tanggal date, total double")
    e = spark.createDataFrame(right, "scope string, row_idx bigint, tanggal date, debet double")
    return b.withColumn("total", F.col("total").cast("decimal(18,2)")), e.withColumn("debet", F.col("debet").cast("decimal(18,2)"))


def expected(left, right, need_amount=False):
    out = set()
    for s in {r[0] for r in left}:
        bs = [r[1:] for r in left if r[0] == s]
        es = [r[1:] for r in right if r[0] == s]
        out |= {(s, *m) for m in walk(bs, es, need_amount)}
    return out


def result(df):
    return {(r["scope"], r["b_idx"], r["e_idx"], r["confidence"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_payments_folded(spark, seed):
    left, right = random_scopes(seed, 150, 9, 30)
    assert result(match.match_payments(*frames(spark, left, right))) == expected(left, right)


def test_payments_in_rounds(spark):
    left, right = random_scopes(3, 60, 12, 9)
    got = match.match_payments(*frames(spark, left, right), fold_pairs=20)
    assert result(got) == expected(left, right)


def test_crowded_days(spark):
    """Days on which most pairs are far apart in amount, with more invoices or more payments, and rows in any order."""
    rnd = random.Random(11)
    left, right = [], []
    for s in range(200):
        for side, n in ((left, rnd.randint(1, 30)), (right, rnd.randint(1, 30))):
            for i in rnd.sample(range(100), n):
                amount = float(rnd.choice([100, 101, 105, 250, 260, 900, 1000, 2800, 2910, 5000, rnd.randint(1, 9999)]))
                side.append((f"s{s}", i, DAY + datetime.timedelta(days=rnd.choice([0, 0, 0, 1, 2] if s % 2 else [0])), amount))
    got = match.match_payments(*frames(spark, left, right), fold_pairs=0)
    assert result(got) == expected(left, right)


def test_equal_confidence_of_a_queue_and_a_pair():
    """Invoices of 140 and 280 score some payments of later days like any payment of their own day or the next."""
    late = lambda n, b, e: confidence((0, DAY, b), (0, DAY + datetime.timedelta(days=n), e))[0]
    assert late(2, 140.0, 136.0) == match.QUEUES[0][0] and late(4, 280.0, 275.0) == match.QUEUES[1][0]


def walk_fast(bs, es):
    """The plain walk with one vector per invoice."""
    idx, days, amounts = (np.array(x) for x in zip(*sorted(es)))
    free, out = np.ones(len(idx), bool), set()
    for i, day, amount in sorted(bs):
        pct = np.abs(amount - amounts) / abs(amount) * 100
        gap = np.abs(day - days)
        date_score = np.where(gap <= 7, 1.0 - gap / 7.0, 0.0)
        conf = np.where(free, date_score * 0.6 + np.where(pct <= 5, 1.0 - pct / 5.0, 0.0) * 0.4, -1)
        k = int(conf.argmax())
        if conf[k] >= 0.5:
            free[k] = False
            out.add((i, int(idx[k]), float(conf[k])))
    return out


def test_a_crowded_day_takes_few_rounds(spark, monkeypatch):
    n, spread = 400, 2
    rnd = random.Random(n)
    sides = [[(i, rnd.randrange(spread), float(rnd.randint(1, 10**6))) for i in range(m)] for m in (n, n + n // 10)]
    calls = []
    served = match._served
    monkeypatch.setattr(match, "_served", lambda *a: calls.append(1) or served(*a))
    left, right = ([("s", i, DAY + datetime.timedelta(days=d), x) for i, d, x in side] for side in sides)
    got = match.match_payments(*frames(spark, left, right), fold_pairs=0)
    assert {r[1:] for r in result(got)} == walk_fast(*sides)
    assert 0 < len(calls) <= 40


def test_best_payment_is_the_best_candidate(spark):
    for seed, slice_rows in ((5, None), (6, 25)):
        left, right = random_scopes(seed, 60, 14, 9)
        sides = frames(spark, left, right)
        want = match.best_candidate(match.payment_candidates(*sides))
        assert result(match.best_payment(*sides, slice_rows=slice_rows)) == result(want)


def test_payments_by_amount(spark):
    left, right = random_scopes(4, 80, 10, 12)
    got = match.match_payments(*frames(spark, left, right), require_amount=True)
    assert result(got) == expected(left, right, True)


def test_no_candidate_is_lost(spark):
    left, right = random_scopes(5, 60, 10, 15)
    cand = match.payment_candidates(*frames(spark, left, right))
    want = set()
    for s in {r[0] for r in left}:
        for b in (r[1:] for r in left if r[0] == s and r[2] and r[3]):
            for e in (r[1:] for r in right if r[0] == s and r[2] and r[3]):
                c, _ = confidence(b, e)
                if c >= 0.5:
                    want.add((s, b[0], e[0], c))
    got = [(r["scope"], r["b_idx"], r["e_idx"], r["confidence"]) for r in cand.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_key_pairs(spark):
    rnd = random.Random(9)
    left = [(f"s{rnd.randint(0, 5)}", i, rnd.choice(["01.2-3", "0123", " ", None, "9"])) for i in range(300)]
    right = [(f"s{rnd.randint(0, 5)}", i, rnd.choice(["0123", "01-23", "", "9", "7"])) for i in range(200)]
    a = spark.createDataFrame(left, "scope string, row_idx bigint, buyer string")
    c = spark.createDataFrame(right, "scope string, row_idx bigint, payer string")

    def norm(x):
        return (x or "").replace(".", "").replace("-", "").strip()

    used, want = set(), set()
    for s, i, key in left:
        for t, j, other in right:
            if s == t and norm(key) and norm(key) == norm(other) and (t, j) not in used:
                used.add((t, j))
                want.add((s, i, j))
                break
    for hot in (None, 10):
        got = match.pair_by_key(a, c, "buyer", "payer", slice_rows=hot)
        assert {(r["scope"], r["a_idx"], r["c_idx"]) for r in got.collect()} == want


def test_engine(spark):
    rnd = random.Random(11)
    names = ["PT Maju Jaya", "CV MAJU", "Sinar Abadi Tbk", "", "Abadi Sinar"]

    def side(n):
        return [
            (i, DAY + datetime.timedelta(days=rnd.randint(0, 12)), rnd.choice([100.0, 100.5, 101.0, 99.2, 500.0, -100.0]), rnd.choice(names))
            for i in range(n)
        ]

    left, right = side(40), side(40)
    schema = "row_idx bigint, tanggal date, amount double, vendor_name string"
    got = match.engine_matches(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    import re

    def norm(x):
        x = re.sub(r"\b(PT|CV|UD|TBK|LTD|INC|CORP|LLC|PERSERO)\b", "", x.upper())
        return " ".join(re.sub(r"[^A-Z0-9\s]", "", x).split())

    def score(b, e):
        gap = abs((b[1] - e[1]).days)
        if gap > 3:
            return 0.0
        date = max(1.0 - gap / 6.0, 0.5)
        if b[2] == e[2]:
            amount = 1.0
        else:
            mean = (b[2] + e[2]) / 2
            share = abs(b[2] - e[2]) / mean if mean > 0 else 1.0
            if share > 0.01:
                return 0.0
            amount = max(1.0 - share / 0.01 * 0.3, 0.7)
        x, y = norm(b[3]), norm(e[3])
        name = difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        return date * 0.30 + amount * 0.50 + name * 0.20

    used, want = set(), set()
    for b in left:
        best = None
        for e in right:
            if e[0] not in used:
                c = score(b, e)
                if c >= 0.70 and (best is None or c > best[0]):
                    best = (c, e[0])
        if best:
            used.add(best[1])
            want.add((b[0], best[1], round(best[0], 12)))
    assert {(r["b_idx"], r["e_idx"], round(r["confidence"], 12)) for r in got.collect()} == want


def test_demo_trio(spark):
    """20 sales with slips of the same buyers, 20 purchases with equal payments: all match."""
    from neraca.plans.reconcile import reconcile

    me = "01.234.567.8-901.000"
    inv = [(i, f"K{i}", DAY, me, f"9{i:014d}", 100.0 + i) for i in range(20)]
    inv += [(20 + i, f"M{i}", DAY + datetime.timedelta(days=i * 9), f"8{i:014d}", me, 500.0 + i) for i in range(20)]
    invoices = spark.createDataFrame(inv, "row_idx bigint, nomor_faktur string, tanggal date, npwp_penjual string, npwp_pembeli string, dpp double")
    invoices = invoices.withColumns({"dpp": F.col("dpp").cast("decimal(18,2)"), "ppn": F.lit(0).cast("decimal(18,2)"), "total": F.col("dpp").cast("decimal(18,2)")})
    slips = spark.createDataFrame(
        [(i, f"B{i}", DAY, f"9{i % 20:014d}", me, 10.0) for i in range(40)],
        "row_idx bigint, nomor_bukti_potong string, tanggal date, npwp_pemotong string, npwp_dipotong string, bruto double",
    )
    bank = spark.createDataFrame(
        [(i, me, DAY + datetime.timedelta(days=(i % 20) * 9), 500.0 + i % 20) for i in range(40)],
        "row_idx bigint, account_number string, tanggal date, debet double",
    )
    companies = spark.createDataFrame([(me,)], "company_npwp string")
    out = reconcile(invoices, slips, bank, companies).summary().collect()
    assert len(out) == 1
    row = out[0]
    assert (row["point_a_count"], row["point_b_count"], row["total_auto_matched"], row["total_suggested"]) == (20, 20, 40, 0)
    assert row["match_rate_a_vs_c"] == 100.0 and row["match_rate_b_vs_e"] == 100.0


@pytest.mark.parametrize("need_amount", [False, True])
def test_large_island(spark, need_amount):
    """One crowded scope, settled in bands and never in one group."""
    rnd = random.Random(21)

    def side(n):
        return [("s", i, DAY + datetime.timedelta(days=rnd.randint(0, 6)), round(rnd.uniform(100, 180), 2)) for i in range(n)]

    left, right = side(30), side(22)
    got = match.match_payments(*frames(spark, left, right), require_amount=need_amount, fold_pairs=0)
    assert result(got) == expected(left, right, need_amount)


@pytest.mark.parametrize("need_amount", [False, True])
def test_bands_equal_the_walk_on_many_scopes(spark, need_amount):
    """Folded, in bands and over all candidates: 250 crowded scopes with displaced rows."""
    left, right = random_scopes(31, 250, 8, 6)
    b, e = frames(spark, left, right)
    want = expected(left, right, need_amount)
    assert result(match.match_payments(b, e, require_amount=need_amount)) == want
    assert result(match.match_payments(b, e, require_amount=need_amount, fold_pairs=0)) == want
    assert result(match.settle(match.payment_candidates(b, e, require_amount=need_amount))) == want


def test_row_that_loses_its_payment_late(spark):
    """B0 takes the payment that B1 rates best; B1 still finds the far one of the same day."""
    b, e = frames(
        spark,
        [("s", 0, DAY + datetime.timedelta(days=3), 102.56), ("s", 1, DAY, 100.0)],
        [("s", 0, DAY, 100.0), ("s", 1, DAY, 500.0)],
    )
    for limit in (None, 0):
        assert {r[1:3] for r in result(match.match_payments(b, e, fold_pairs=limit))} == {(0, 0), (1, 1)}
