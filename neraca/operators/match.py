"""Matching of invoices with slips and bank rows.

Frames on either side carry ``scope`` (the unit that is reconciled on its own),
``row_idx`` (file order, unique per scope), ``tanggal`` (date) and ``amount``.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from neraca.functions import score
from neraca.functions.ids import normalize_npwp, normalize_vendor
from neraca.operators.ordered import ANYONE, FREE_ROWS, NO_SLICES, SLICE_ROWS, first_free, nearest_value, rank_rows, running_sum
from neraca.session import cut_lineage, discard

# Islands with at most this many invoice x payment pairs are settled in one group.
FOLD_PAIRS = 250_000
# Beyond this gap no pair can reach the lowest accepted confidence.
MAX_GAP_DAYS = 5


# --- one-to-one by key -------------------------------------------------------------


def pair_by_key(
    a: DataFrame,
    c: DataFrame,
    a_key: str,
    c_key: str,
    scope: Sequence[str] = ("scope",),
    slice_rows: int | None = None,
) -> DataFrame:
    """The n-th row of ``a`` with a key takes the n-th row of ``c`` with that key.

    Blank keys never match.  One ranking pass serves both sides; the pairs then meet
    on ``(scope, key, rank)``, which spreads a hot key over the cluster.
    """
    scope = list(scope)

    def side(df: DataFrame, key: str, tag: str) -> DataFrame:
        return df.select(
            *scope,
            normalize_npwp(F.col(key)).alias("npwp"),
            F.lit(tag).alias("_side"),
            F.col("row_idx").cast("long").alias("row_idx"),
        ).filter(F.col("npwp") != "")

    # Written once: the ranks count the keys first, which would derive both sides again.
    both = cut_lineage(side(a, a_key, "a").unionByName(side(c, c_key, "c")))
    # Both sides of a key lie together, so ranks and pairs take one shuffle.
    ranked = rank_rows(both.repartition(*scope, "npwp"), [*scope, "npwp", "_side"], ["row_idx"], "_rank", slice_rows=slice_rows)
    return (
        ranked.groupBy(*scope, "npwp", "_rank")
        .agg(
            F.max(F.when(F.col("_side") == "a", F.col("row_idx"))).alias("a_idx"),
            F.max(F.when(F.col("_side") == "c", F.col("row_idx"))).alias("c_idx"),
        )
        .filter(F.col("a_idx").isNotNull() & F.col("c_idx").isNotNull())
        .select(*scope, "npwp", "a_idx", "c_idx", F.lit(1.0).alias("confidence"))
    )


# --- pairs near in date and amount ---------------------------------------------------


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    days: int,
    ratio: float,
    left_date: str = "l_date",
    right_date: str = "r_date",
    left_amount: str = "l_amount",
    right_amount: str = "r_amount",
) -> DataFrame:
    """Superset of the pairs at most ``days`` apart whose amounts differ by less than
    the factor ``1 + ratio``; the caller applies its own score to what is left.

    An equi-join on (keys, day bucket, log-amount bucket).  The left side, which should be the
    smaller one, is repeated into the four buckets that it can reach, so every pair meets exactly once.  The
    join sorts and spills: an estimate of the input's size says nothing of the repeated rows, which must
    not be broadcast for it.
    """
    reach = math.log1p(ratio) * 1.01
    width, span = 2 * reach, max(1, 2 * days)

    def day_bucket(c: Column) -> Column:
        return F.floor(c / span).cast("int")

    def amount_bucket(c: Column) -> Column:
        return F.floor(c / width).cast("int")

    def usable(df: DataFrame, date: str, amount: str, d: int, r: float) -> DataFrame:
        """With the first and last bucket that lies ``d`` days and ``r`` in log amount around the row."""
        day, size = F.unix_date(F.col(date)), F.ln(F.abs(F.col(amount).cast("double")))
        return df.filter(F.col(date).isNotNull() & (F.col(amount) != 0)).withColumns(
            {
                "_sign": F.signum(F.col(amount).cast("double")).cast("int"),
                "_day": F.explode(F.sequence(day_bucket(day - d), day_bucket(day + d))) if d else day_bucket(day),
                "_low": amount_bucket(size - r),
                "_up": amount_bucket(size + r),
            }
        )

    near = usable(left, left_date, left_amount, days, reach).withColumn("_size", F.explode(F.sequence("_low", "_up")))
    far = usable(right, right_date, right_amount, 0, 0.0).withColumn("_size", F.col("_low"))
    gap = score.day_gap(F.col(left_date), F.col(right_date))
    return (
        near.drop("_low", "_up")
        .hint("merge")
        .join(far.drop("_low", "_up"), [*keys, "_sign", "_day", "_size"])
        .filter(gap <= days)
        .drop("_sign", "_day", "_size")
    )


def _side(df: DataFrame, prefix: str, scope: Sequence[str], amount: str, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *scope,
        *extra,
        F.col("row_idx").alias(f"{prefix}_idx"),
        F.col("tanggal").alias(f"{prefix}_date"),
        F.col(amount).alias(f"{prefix}_amount"),
    )


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    gap = score.day_gap(F.col("l_date"), F.col("r_date"))
    return (
        pairs.withColumn("date_confidence", score.gated_date_score(gap))
        .withColumn("amount_confidence", score.gated_amount_score(F.col("l_amount"), F.col("r_amount")))
        .withColumn("confidence", (F.col("date_confidence") + F.col("amount_confidence")) / 2)
        .filter(F.col("confidence") >= threshold)
        .withColumn("match_type", score.pair_band(F.col("confidence")))
    )


def score_invoices_and_slips(
    a: DataFrame, c: DataFrame, scope: Sequence[str] = ("scope",), threshold: float = 0.70
) -> DataFrame:
    """Many-to-many: equal id, at most 7 days and 2 % apart, mean score >= threshold."""
    left = _side(a.withColumn("npwp", normalize_npwp(F.col("npwp_pembeli"))), "l", scope, "dpp", ["npwp"])
    right = _side(c.withColumn("npwp", normalize_npwp(F.col("npwp_pemotong"))), "r", scope, "bruto", ["npwp"])
    return _scored(near_pairs(left, right, [*scope, "npwp"], 7, 0.0205), threshold)


def score_invoices_and_payments(
    b: DataFrame, e: DataFrame, scope: Sequence[str] = ("scope",), threshold: float = 0.70
) -> DataFrame:
    """Many-to-many over debit rows: at most 7 days and 2 % apart."""
    left = _side(b, "l", scope, "total")
    right = _side(debit_rows(e), "r", scope, "debet")
    return _scored(near_pairs(left, right, list(scope), 7, 0.0205), threshold)


def debit_rows(bank: DataFrame) -> DataFrame:
    return bank.filter(F.col("debet") > 0)


# --- best match, one-to-one ------------------------------------------------------------


class _Queue(NamedTuple):
    """Rows of ``b`` that accept all ``e`` at certain day steps alike, and take the first that they can have."""

    members: DataFrame  # keys, b_idx, b_date
    confidence: float
    steps: tuple[int, ...]
    tied: bool  # some open pair has the same confidence


def settle(candidates: DataFrame, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """One-to-one choice among ``candidates(keys, b_idx, e_idx, confidence)``.

    The result is that of going through ``b`` in order and giving each its best free
    ``e`` (first on ties).
    """
    live = cut_lineage(candidates.select(*keys, "b_idx", "e_idx", "confidence", F.lit(0).alias("_up")))
    pointers, live, bound = _rounds(live, None, [], None, list(keys))
    discard(live, bound)
    return pointers.drop("_up")


def _rounds(
    live: DataFrame, bound: DataFrame | None, queues: list[_Queue], right: DataFrame | None, keys: list[str], slices: dict | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Final pointers, the pairs still open behind them, and the first ``b`` that ever pointed at each ``e``.

    Every round each ``b`` points at the best ``e`` it may still get; an ``e`` pointed at by several is lost to all but the first
    of them, for good.  When no ``e`` is lost, the pointers are the answer.  All steps are plain aggregates,
    combined before the shuffle, so a popular ``e`` or a ``b`` with many candidates is no hot task.  A whole queue is
    served in one step: see ``_served``.  ``live`` and ``bound`` are deleted once they are replaced.
    """
    best = F.max(F.struct(F.col("confidence").alias("c"), F.col("_up").alias("u"), (-F.col("e_idx")).alias("e"))).alias("_best")
    shape = [*keys, "b_idx", (-F.col("_best.e")).alias("e_idx"), F.col("_best.c").alias("confidence"), F.col("_best.u").alias("_up")]
    while True:
        near = live.groupBy(*keys, "b_idx").agg(best).select(*shape)
        wait, used = None, []
        if queues:
            near = cut_lineage(near)
            used.append(near)
        offers = near
        for queue in queues:
            ahead = offers.filter(F.struct("confidence", "_up") > F.struct(F.lit(queue.confidence), F.lit(0))).select(*keys, "b_idx")
            waiting = cut_lineage(queue.members.join(ahead, [*keys, "b_idx"], "left_anti"))
            used.append(waiting)
            if waiting.isEmpty():
                continue
            served = cut_lineage(_served(waiting, right, bound, queue.steps, keys, slices or {}))
            used.append(served)
            if queue.tied:
                wait = _turned(served, near, queue, keys)
                if not wait.isEmpty():
                    break
                wait = None
            offers = offers.unionByName(served.select(*keys, "b_idx", "e_idx", F.lit(queue.confidence).alias("confidence"), F.lit(0).alias("_up")))
        if wait is not None:
            # The first of a queue who prefers a pair of equal confidence is settled before those behind it.
            live = _raised(live, wait, keys)
            continue
        pointers = cut_lineage(offers.groupBy(*keys, "b_idx").agg(best).select(*shape) if queues else near)
        pointed = pointers.select(*keys, "e_idx", F.col("b_idx").alias("_first"))
        both = pointed if bound is None else pointed.unionByName(bound)
        fresh = cut_lineage(both.groupBy(*keys, "e_idx").agg(F.min("_first").alias("_first")))
        lost = pointers.join(fresh, [*keys, "e_idx"]).filter(F.col("b_idx") > F.col("_first"))
        done = lost.isEmpty()
        if not done:
            kept = cut_lineage(_still_open(live, fresh, keys))
        discard(*used, *([] if bound is None else [bound]))
        bound = fresh
        if done:
            return pointers, live, bound
        discard(live, pointers)
        live = kept


def _still_open(pairs: DataFrame, bound: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose ``e`` no earlier ``b`` has pointed at."""
    kept = pairs.join(bound, [*keys, "e_idx"], "left").filter(F.col("_first").isNull() | (F.col("b_idx") <= F.col("_first")))
    return kept.drop("_first")


def _served(waiting: DataFrame, right: DataFrame, bound: DataFrame | None, steps: tuple[int, ...], keys: list[str], slices: dict) -> DataFrame:
    """(keys, b_idx, e_idx): each of ``waiting``, in order, with the first ``e`` that no earlier ``b`` points at or has here.

    An ``e`` is open to those of its queue who come no later than the first ``b`` that ever pointed at it.  Their number
    is its limit, and the queue's steps over its places are settled by ``first_free``: no pairs, whatever the crowd.
    """
    unit = [*keys, "_day"]
    queue = waiting.select(*keys, F.col("b_date").alias("_day"), F.col("b_idx").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("e_idx"))
    days = F.explode(F.array(*[F.date_add("e_date", -s) for s in steps]))
    places = right.select(*keys, "e_idx", days.alias("_day")).join(queue.select(*unit).distinct(), unit, "left_semi")
    if bound is None:
        places = places.withColumn("_first", F.lit(None).cast("long"))
    else:
        places = places.join(bound, [*keys, "e_idx"], "left")
    rows = queue.unionByName(places.select(*unit, F.col("_first").alias("_at"), F.lit(1).alias("_kind"), "e_idx"))
    # An e that nobody points at stands behind the whole queue.
    rows = rows.withColumn("_at", F.coalesce("_at", F.lit(ANYONE)))
    mine = F.when(F.col("_kind") == 0, 1).otherwise(0)
    counted = running_sum(rows, unit, ["_at", "_kind", "e_idx"], mine, "_n", slice_rows=slices.get("rows"))
    counted = cut_lineage(counted)
    free = first_free(counted.filter("_kind = 1").select(*unit, "e_idx", "_n"), unit, ["e_idx"], "_n", "_rank", slices.get("places"))
    ranked = counted.filter("_kind = 0").select(*unit, F.col("_at").alias("b_idx"), (F.col("_n") - 1).alias("_rank"))
    return free.filter("_rank is not null").join(ranked, [*unit, "_rank"]).select(*keys, "b_idx", "e_idx", "_day")


def _turned(served: DataFrame, near: DataFrame, queue: _Queue, keys: list[str]) -> DataFrame:
    """The first of each queue who has an open pair of the same confidence with an earlier ``e``."""
    pair = near.filter((F.col("confidence") == queue.confidence) & (F.col("_up") == 0)).select(*keys, "b_idx", F.col("e_idx").alias("_other"))
    found = served.join(pair, [*keys, "b_idx"]).filter(F.col("_other") < F.col("e_idx"))
    return found.groupBy(*keys, "_day").agg(F.min(F.struct("b_idx", "_other")).alias("_m")).select(*keys, "_m.b_idx", F.col("_m._other").alias("e_idx"))


def _raised(live: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``live`` with ``pairs`` marked to come before the queue of their confidence."""
    marked = live.join(pairs.withColumn("_mark", F.lit(1)), [*keys, "b_idx", "e_idx"], "left")
    return cut_lineage(marked.withColumn("_up", F.coalesce("_mark", "_up")).drop("_mark"))


def _payment_scores(b_date: Column, b_amount: Column, e_date: Column, e_amount: Column):
    gap = score.day_gap(b_date, e_date)
    percent = score.percent_of_base(b_amount, e_amount)
    date_score = score.linear_date_score(gap)
    amount_score = score.linear_amount_score(percent)
    return gap, percent, date_score, amount_score, score.weighted_confidence(date_score, amount_score)


def payment_sides(b: DataFrame, e: DataFrame, scope: Sequence[str], amount: str = "total") -> tuple[DataFrame, DataFrame]:
    """Rows that can take part: a date, and an amount other than zero."""

    def eligible(df: DataFrame, column: str) -> DataFrame:
        return df.filter(F.col("tanggal").isNotNull() & (F.col(column) != 0))

    return (
        _side(eligible(b, amount), "b", scope, amount),
        _side(eligible(e, "debet"), "e", scope, "debet"),
    )


def payment_candidates(
    b: DataFrame, e: DataFrame, scope: Sequence[str] = ("scope",), require_amount: bool = False
) -> DataFrame:
    """All pairs with confidence >= 0.50, with their scores.

    With ``require_amount`` only pairs within 5 % count, which adds an amount key to
    the join and keeps it linear on a day with many payments.
    """
    left, right = payment_sides(b, e, scope)
    if require_amount:
        pairs = near_pairs(
            left, right, list(scope), MAX_GAP_DAYS, 0.0527, "b_date", "e_date", "b_amount", "e_amount"
        )
    else:
        width = MAX_GAP_DAYS + 1
        left = left.withColumn("_day", F.floor(F.unix_date("b_date") / width))
        right = right.withColumn(
            "_day",
            F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.floor(F.unix_date("e_date") / width) + s)),
        )
        pairs = left.join(right, [*scope, "_day"]).drop("_day")
    gap, percent, date_score, amount_score, confidence = _payment_scores(
        F.col("b_date"), F.col("b_amount"), F.col("e_date"), F.col("e_amount")
    )
    scored = (
        pairs.filter(gap <= MAX_GAP_DAYS)
        .withColumn("date_diff_days", gap)
        .withColumn("amount_diff_pct", percent)
        .withColumn("date_score", date_score)
        .withColumn("amount_score", amount_score)
        .withColumn("confidence", confidence)
        .filter(F.col("confidence") >= 0.50)
    )
    if require_amount:
        scored = scored.filter(F.col("amount_diff_pct") <= 5)
    return scored.withColumn("match_type", score.match_band(F.col("confidence")))


# Lower ends of the confidence bands in which a large island is settled.
BANDS = [0.98, 0.7, 0.5]
# Day steps at which a pair counts whatever its amounts, and its confidence beyond 5 %.
QUEUES = [((1.0 - 0 / 7.0) * 0.6, (0,)), ((1.0 - 1 / 7.0) * 0.6, (-1, 1))]


def _band_pairs(free: DataFrame, right: DataFrame, scope: list[str], low: float, require_amount: bool) -> DataFrame:
    """Pairs of ``free`` rows within 5 % with ``low <= confidence < _high``.

    The band bounds the day gap and the amount gap, so the join looks no further than it
    has to.  Pairs that their day alone decides belong to queues.
    """
    days = min(MAX_GAP_DAYS, int((1.0 - (low - 0.4) / 0.6) * 7.0 + 1e-9))
    percent = min(5.0, (1.0 - (low - 0.6) / 0.4) * 5.0 + 1e-9)
    ratio = 1.0 / (1.0 - percent / 100.0) - 1.0
    near = near_pairs(free, right, scope, days, ratio, "b_date", "e_date", "b_amount", "e_amount")
    gap, pct, _, _, confidence = _payment_scores(F.col("b_date"), F.col("b_amount"), F.col("e_date"), F.col("e_amount"))
    scored = near.filter(pct <= 5).withColumn("confidence", confidence)
    kept = scored.filter((F.col("confidence") >= low) & (F.col("confidence") < F.col("_high")))
    if not require_amount:
        for level, steps in QUEUES:
            kept = kept.filter(~((F.col("confidence") == level) & gap.isin([abs(s) for s in steps])))
    return kept.select(*scope, "b_idx", "e_idx", "confidence", F.lit(0).alias("_up"))


def settle_in_bands(left: DataFrame, right: DataFrame, scope: Sequence[str], require_amount: bool = False) -> DataFrame:
    """The same choice as ``settle`` over all candidates, without writing them all out.

    Candidates are generated band by band, best first, and only for rows that the bands
    so far left without a partner.  A row proposes in its order of preference either way,
    and the outcome does not depend on when it does, so the result is the same.

    Beyond 5 % every payment of a day is as good as any other, so no pairs are written for them: the rows
    that come to that wait in a queue for the first payment of their day, then of the days next to it.
    """
    scope = list(scope)
    row = [*scope, "b_idx"]
    levels = cut_lineage(left.withColumn("_high", F.lit(float("inf"))))
    right = cut_lineage(right)
    slices = _slices(left, right, scope)
    pointers = live = bound = None
    for low in BANDS:
        while True:
            free = levels.filter(F.col("_high") > low)
            if pointers is not None:
                free = free.join(pointers.select(*row), row, "left_anti")
            free = cut_lineage(free)
            if free.isEmpty():
                discard(free)
                break
            fresh = _band_pairs(free, right, scope, low, require_amount)
            if pointers is not None:
                fresh = _still_open(fresh, bound, scope).unionByName(live)
            fresh = cut_lineage(fresh)
            asked = free.select(*row, F.lit(low).alias("_low"))
            moved = cut_lineage(levels.join(asked, row, "left").withColumn("_high", F.coalesce("_low", "_high")).drop("_low"))
            queues = []
            for level, steps in QUEUES if not require_amount else []:
                if low <= level:
                    tied = not fresh.filter(F.col("confidence") == level).isEmpty()
                    queues.append(_Queue(moved.filter(F.col("_high") <= level).select(*row, "b_date"), level, steps, tied))
            if pointers is not None:
                discard(live, pointers)
            discard(levels, free)
            pointers, live, bound = _rounds(fresh, bound, queues, right, scope, slices)
            levels = moved
    discard(levels, right, live, bound)
    return pointers.drop("_up")


def _slices(left: DataFrame, right: DataFrame, scope: list[str]) -> dict:
    """Whether any day of a scope is large enough to be cut, so that the rounds need not count it again."""
    days = left.select(*scope, F.col("b_date").alias("_day")).unionByName(right.select(*scope, F.col("e_date").alias("_day")))
    most = 3 * (days.groupBy(*scope, "_day").count().agg(F.max("count")).first()[0] or 0)
    return {"rows": None if most > SLICE_ROWS else NO_SLICES, "places": None if most > FREE_ROWS else NO_SLICES}


def _islands(left: DataFrame, right: DataFrame, scope: list[str]) -> DataFrame:
    """Days of each scope, cut where more than MAX_GAP_DAYS pass without a row.

    Works on one row per (scope, day), so its windows stay small for any scope.
    """
    days = (
        left.select(*scope, F.col("b_date").alias("_date"), F.lit(1).alias("_b"), F.lit(0).alias("_e"))
        .unionByName(
            right.select(*scope, F.col("e_date").alias("_date"), F.lit(0).alias("_b"), F.lit(1).alias("_e"))
        )
        .groupBy(*scope, "_date")
        .agg(F.sum("_b").alias("_b"), F.sum("_e").alias("_e"))
    )
    w = Window.partitionBy(*scope).orderBy("_date")
    gap = F.datediff("_date", F.lag("_date").over(w))
    starts = days.withColumn("_start", F.when(gap <= MAX_GAP_DAYS, 0).otherwise(1))
    numbered = starts.withColumn("_island", F.sum("_start").over(w))
    whole = Window.partitionBy(*scope, "_island")
    pairs = F.sum("_b").over(whole).cast("double") * F.sum("_e").over(whole)
    return (
        numbered.withColumn("_pairs", pairs)
        .filter(F.col("_pairs") > 0)
        .select(*scope, "_date", "_island", "_pairs")
    )


def _fold_islands(rows: DataFrame, scope: list[str], require_amount: bool) -> DataFrame:
    """Serial choice inside each small island, as one expression over its rows."""
    picked = "array<struct<b_idx:bigint,e_idx:bigint,confidence:double>>"
    entry = F.struct(F.col("_idx").alias("idx"), F.col("_date").alias("day"), F.col("_amount").alias("amount"))
    grouped = rows.groupBy(*scope, "_island").agg(
        F.array_sort(F.collect_list(F.when(F.col("_kind") == "b", entry))).alias("_bs"),
        F.collect_list(F.when(F.col("_kind") == "e", entry)).alias("_es"),
    )

    def choose(done: Column, b: Column) -> Column:
        taken = F.transform(done, lambda m: m["e_idx"])
        free = F.filter("_es", lambda e: ~F.array_contains(taken, e["idx"]))
        if require_amount:
            free = F.filter(free, lambda e: score.percent_of_base(b["amount"], e["amount"]) <= 5)
        rated = F.transform(
            free,
            lambda e: F.struct(
                _payment_scores(b["day"], b["amount"], e["day"], e["amount"])[4].alias("confidence"),
                (-e["idx"]).alias("order"),
            ),
        )
        best = F.array_max(rated)
        match = F.struct(
            b["idx"].alias("b_idx"), (-best["order"]).alias("e_idx"), best["confidence"].alias("confidence")
        )
        return F.when(best["confidence"] >= 0.50, F.concat(done, F.array(match))).otherwise(done)

    none = F.array().cast(picked)
    return grouped.select(
        *scope, F.explode(F.aggregate("_bs", none, lambda d, b: choose(d, b).cast(picked))).alias("_m")
    ).select(*scope, "_m.*")


def match_payments(
    b: DataFrame,
    e: DataFrame,
    scope: Sequence[str] = ("scope",),
    require_amount: bool = False,
    fold_pairs: int | None = None,
) -> DataFrame:
    """Each invoice, in file order, takes the best bank row not yet taken.

    Confidence is 60 % date (7 days) and 40 % amount (5 %), at least 0.50; ``auto``
    from 0.70.  A scope is cut into islands that no pair can span.  Small islands are
    settled in one group each; larger ones in rounds, band by band (``settle_in_bands``).
    With ``require_amount`` only payments within 5 % of the invoice count.
    """
    scope = list(scope)
    limit = FOLD_PAIRS if fold_pairs is None else fold_pairs
    left, right = payment_sides(b, e, scope)
    islands = cut_lineage(_islands(left, right, scope))

    def tagged(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            *scope,
            F.col(f"{p}_date").alias("_date"),
            F.lit(p).alias("_kind"),
            F.col(f"{p}_idx").cast("long").alias("_idx"),
            F.col(f"{p}_amount").alias("_amount"),
        )

    rows = tagged(left, "b").unionByName(tagged(right, "e"))
    small = rows.join(islands.filter(F.col("_pairs") <= limit), [*scope, "_date"])
    chosen = _fold_islands(small, scope, require_amount)
    large_days = islands.filter(F.col("_pairs") > limit).select(*scope, "_date")
    if not large_days.isEmpty():

        def on_large(df: DataFrame, p: str) -> DataFrame:
            days = large_days.withColumnRenamed("_date", f"{p}_date")
            return df.join(days, [*scope, f"{p}_date"], "left_semi")

        chosen = chosen.unionByName(settle_in_bands(on_large(left, "b"), on_large(right, "e"), scope, require_amount))
    return chosen.withColumn("match_type", score.match_band(F.col("confidence")))


def best_candidate(candidates: DataFrame, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Best partner of each invoice: highest confidence, first bank row on ties."""
    best = F.max_by(F.struct("e_idx", "confidence"), F.struct("confidence", -F.col("e_idx")))
    return (
        candidates.groupBy(*keys, "b_idx")
        .agg(best.alias("_best"))
        .select(*keys, "b_idx", "_best.e_idx", "_best.confidence")
    )


def best_payment(b: DataFrame, e: DataFrame, scope: Sequence[str] = ("scope",), slice_rows: int | None = None) -> DataFrame:
    """``best_candidate`` over all pairs, without pairs: an as-of search for the nearest amounts.

    On one day the best payment is the one of the nearest amount below or above the invoice's, or, beyond 5 %, the day's
    first.  Invoices stand on each day they can reach that has payments, between the amounts that were paid on it, and look
    back and ahead: eleven rows an invoice at most, whatever the crowd.
    """
    scope = list(scope)
    left, right = payment_sides(b, e, scope)
    unit = [*scope, "_day"]
    paid = right.groupBy(*scope, F.col("e_date").alias("_day"), F.col("e_amount").alias("_amount")).agg(F.min("e_idx").alias("_idx"))
    what = F.struct(F.col("_idx").alias("idx"), F.col("_amount").alias("amount"))
    first = paid.groupBy(*unit).agg(F.min(what).alias("_first"))
    # Days with payments are listed by bucket; an invoice reaches two buckets at most.
    bucket = lambda c: F.floor(F.unix_date(c) / (2 * MAX_GAP_DAYS + 1))
    listed = first.groupBy(*[F.col(k).alias(f"_l_{k}") for k in scope], bucket(F.col("_day")).alias("_l_bucket")).agg(F.collect_list("_day").alias("_days"))
    reached = F.sequence(bucket(F.date_add("b_date", -MAX_GAP_DAYS)), bucket(F.date_add("b_date", MAX_GAP_DAYS)))
    near = F.filter("_days", lambda d: F.abs(F.datediff(d, F.col("b_date"))) <= MAX_GAP_DAYS)
    same = [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in scope]
    asking = left.withColumn("_bucket", F.explode(reached)).join(listed, [*same, F.col("_bucket") == F.col("_l_bucket")]).select(
        *scope, F.explode(near).alias("_day"), F.col("b_amount").alias("_amount"), F.lit(1).alias("_kind"), "b_idx", "b_date"
    )
    rows = asking.unionByName(paid.select(*unit, "_amount", F.lit(0).alias("_kind"), what.alias("_paid")), allowMissingColumns=True)
    # The day's first payment stands before all amounts.
    rows = cut_lineage(rows.unionByName(first.select(*unit, F.lit(0).alias("_kind"), "_first"), allowMissingColumns=True))
    order = ["_amount", "_kind"]
    if slice_rows is None:
        # Counted once for the three searches.
        most = rows.groupBy(*unit).count().agg(F.max("count")).first()[0] or 0
        slice_rows = None if most > SLICE_ROWS else NO_SLICES
    # Both that look back come first: they share one sort.
    found = nearest_value(rows, unit, order, F.col("_paid"), "_below", slice_rows)
    found = nearest_value(found, unit, order, F.col("_first"), "_day_first", slice_rows)
    found = nearest_value(found, unit, order, F.col("_paid"), "_above", slice_rows, back=True).filter("_kind = 1")

    def rated(one: Column) -> Column:
        confidence = _payment_scores(F.col("b_date"), F.col("_amount"), F.col("_day"), one["amount"])[4]
        return F.struct(confidence.alias("confidence"), (-one["idx"]).alias("order"))

    best = F.array_max(F.transform(F.array_compact(F.array("_below", "_above", "_day_first")), rated))
    chosen = found.withColumn("_best", best).groupBy(*scope, "b_idx").agg(F.max("_best").alias("_best")).filter("_best.confidence >= 0.5")
    return chosen.select(*scope, "b_idx", (-F.col("_best.order")).alias("e_idx"), "_best.confidence")


# --- three-source engine -----------------------------------------------------------------


def name_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two normalised names; 0 when either is blank.

    The function is nested so that it travels to the executors by value.
    """

    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(
            [difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(left, right)]
        )

    return F.pandas_udf(ratios, DoubleType())(a, b)


def similarity_bound(a: Column, b: Column) -> Column:
    """No less than ``name_similarity``: the characters that two names share, in any order, against all of them."""
    held = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(held(a, c), held(b, c))))
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).otherwise(F.lit(2.0) * shared / (F.length(a) + F.length(b)))


def with_name_similarity(pairs: DataFrame, a: str, b: str, name: str = "vendor_similarity") -> DataFrame:
    """``pairs`` with the similarity of two name columns.

    Equal and blank names are decided on the JVM; of the others each distinct pair of names is compared once.
    """
    decided = F.when((F.col(a) == "") | (F.col(b) == "") | F.col(a).isNull() | F.col(b).isNull(), 0.0).when(F.col(a) == F.col(b), 1.0)
    names = pairs.filter(decided.isNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    rated = names.withColumn("_ratio", name_similarity(F.col("_a"), F.col("_b")))
    joined = pairs.join(rated, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left")
    return joined.withColumn(name, F.coalesce(decided, F.col("_ratio"))).drop("_a", "_b", "_ratio")


def engine_candidates(invoices: DataFrame, bank: DataFrame, keys: Sequence[str] = (), threshold: float = 0.70) -> DataFrame:
    """Pairs within 3 days and 1 %, scored with the name similarity of the survivors.

    Both frames hold ``keys, row_idx, tanggal, amount, vendor_name``; give the keys that bound
    who can pay whom, or pairs are sought among all rows.  Date and amount gate
    first; only pairs that could still reach the threshold with equal names are compared.
    """
    left = _side(invoices.withColumn("b_name", normalize_vendor(F.col("vendor_name"))), "b", keys, "amount", ["b_name"])
    right = _side(bank.withColumn("e_name", normalize_vendor(F.col("vendor_name"))), "e", keys, "amount", ["e_name"])
    pairs = near_pairs(left, right, list(keys), 3, 0.0102, "b_date", "e_date", "b_amount", "e_amount")
    gap = score.day_gap(F.col("b_date"), F.col("e_date"))
    gated = (
        pairs.withColumn("date_confidence", score.engine_date_score(gap))
        .withColumn("amount_confidence", score.engine_amount_score(F.col("b_amount"), F.col("e_amount")))
        .filter(F.col("amount_confidence").isNotNull())
        .filter(
            score.engine_confidence(F.col("date_confidence"), F.col("amount_confidence"), F.lit(1.0))
            >= threshold
        )
    )
    # Names that share too few characters can't reach the threshold, so they are not compared.
    within = score.engine_confidence(F.col("date_confidence"), F.col("amount_confidence"), similarity_bound(F.col("b_name"), F.col("e_name")))
    return (
        with_name_similarity(gated.filter(within >= threshold), "b_name", "e_name")
        .withColumn(
            "confidence",
            score.engine_confidence(
                F.col("date_confidence"), F.col("amount_confidence"), F.col("vendor_similarity")
            ),
        )
        .filter(F.col("confidence") >= threshold)
        .withColumn("match_type", score.engine_band(F.col("confidence")))
    )


def engine_matches(invoices: DataFrame, bank: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One-to-one over the engine's candidates, invoices in file order."""
    chosen = settle(engine_candidates(invoices, bank, keys), keys)
    return chosen.withColumn("match_type", score.engine_band(F.col("confidence")))


# --- what is left over ----------------------------------------------------------------------


def unmatched(rows: DataFrame, matches: DataFrame, idx: str, scope: Sequence[str] = ("scope",)) -> DataFrame:
    """Rows whose ``row_idx`` is not among ``matches[idx]`` of their scope."""
    used = matches.select(*scope, F.col(idx).alias("row_idx"))
    return rows.join(used, [*scope, "row_idx"], "left_anti")


def write_back(rows: DataFrame, matches: DataFrame, idx: str, partner: str, scope: Sequence[str] = ("scope",)) -> DataFrame:
    """Rows with ``is_matched``, partner id, confidence and type."""
    status = matches.select(
        *scope,
        F.col(idx).alias("row_idx"),
        F.col(partner).alias("matched_with"),
        F.col("confidence").alias("match_confidence"),
        "match_type",
    )
    return rows.join(status, [*scope, "row_idx"], "left").withColumn(
        "is_matched", F.col("matched_with").isNotNull()
    )


def number_matches(matches: DataFrame, order: str, label: str, scope: Sequence[str] = ("scope",)) -> DataFrame:
    """Match ids ``<label>_<n>`` in file order, counted per scope."""
    ranked = rank_rows(cut_lineage(matches), list(scope), [order], "_n")
    return ranked.withColumn("match_id", F.concat(F.lit(label + "_"), F.col("_n").cast("string"))).drop("_n")
