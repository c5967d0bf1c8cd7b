"""Reconciliation reports: counts, rates, amounts and margin per scope.

Everything is one pass of conditional sums over a union of facts, so partial
aggregates absorb hot scopes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neraca.operators.match import write_back

MONEY = "decimal(28,2)"


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as double, 0 when ``whole`` is 0."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.when(whole == 0, 0.0).otherwise(share)


def _facts(df: DataFrame, scope: Sequence[str], **values: Column) -> DataFrame:
    return df.select(*scope, *[v.alias(k) for k, v in values.items()])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def _sum(name: str, kind: str = "long") -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast(kind).alias(name)


def reconciliation_summary(
    a: DataFrame,
    b: DataFrame,
    c: DataFrame,
    e: DataFrame,
    matches_ac: DataFrame,
    matches_be: DataFrame,
    scope: Sequence[str] = ("scope",),
) -> DataFrame:
    """One row per scope with the counts, rates, amounts and margin of both legs."""
    scope = list(scope)
    ac = matches_ac if "match_type" in matches_ac.columns else matches_ac.withColumn("match_type", F.lit("exact"))
    sales = write_back(a, ac, "a_idx", "c_idx", scope)
    buys = write_back(b, matches_be, "b_idx", "e_idx", scope)
    one, auto = F.lit(1), F.col("match_type") == "auto"
    matched = F.col("is_matched")
    two_places = F.round("match_confidence", 2).cast("decimal(5,2)")
    facts = _union(
        [
            _facts(
                sales,
                scope,
                point_a_count=one,
                total_penjualan=F.col("total"),
                total_penjualan_dpp=F.col("dpp"),
                matched_a=F.when(matched, 1),
                amount_matched=F.when(matched, F.col("total")),
                amount_unmatched=F.when(~matched, F.col("total")),
                confidence=F.when(matched, two_places),
            ),
            _facts(
                buys,
                scope,
                point_b_count=one,
                total_pembelian=F.col("total"),
                total_pembelian_dpp=F.col("dpp"),
                auto_b=F.when(matched & auto, 1),
                suggested=F.when(matched & ~auto, 1),
                amount_matched=F.when(matched & auto, F.col("total")),
                amount_unmatched=F.when(~matched, F.col("total")),
                confidence=F.when(matched & auto, two_places),
            ),
            _facts(c, scope, point_c_count=one),
            _facts(e, scope, point_e_count=one),
        ]
    )
    counts = [
        "point_a_count", "point_b_count", "point_c_count", "point_e_count", "matched_a", "auto_b", "suggested",
    ]
    amounts = [
        "total_penjualan", "total_penjualan_dpp", "total_pembelian", "total_pembelian_dpp",
        "amount_matched", "amount_unmatched", "confidence",
    ]
    sums = facts.groupBy(*scope).agg(*[_sum(n) for n in counts], *[_sum(n, MONEY) for n in amounts])
    paired = F.col("matched_a") + F.col("auto_b") + F.col("suggested")
    rows = F.col("point_a_count") + F.col("point_b_count") + F.col("point_c_count") + F.col("point_e_count")
    auto_matched = F.col("matched_a") + F.col("auto_b")
    margin = (F.col("total_penjualan_dpp") - F.col("total_pembelian_dpp")).cast(MONEY)
    return (
        sums.withColumn("total_auto_matched", auto_matched)
        .withColumn("total_suggested", F.col("suggested"))
        .withColumn("total_unmatched", rows - paired * 2)
        .withColumn(
            "match_rate",
            percent(
                F.col("total_auto_matched"),
                F.col("total_auto_matched") + F.col("total_suggested") + F.col("total_unmatched"),
            ),
        )
        .withColumn(
            "match_rate_a_vs_c",
            F.when(F.col("point_c_count") > 0, percent(F.col("matched_a"), F.greatest("point_a_count", F.lit(1)))).otherwise(0.0),
        )
        .withColumn(
            "match_rate_b_vs_e",
            F.when(F.col("point_e_count") > 0, percent(F.col("auto_b"), F.greatest("point_b_count", F.lit(1)))).otherwise(0.0),
        )
        .withColumn("avg_confidence", F.when(auto_matched == 0, 0.0).otherwise(
            F.try_divide(F.col("confidence").cast("double"), auto_matched.cast("double"))))
        .withColumn("margin_idr", margin)
        .withColumn(
            "margin_pct",
            F.when(F.col("total_penjualan_dpp") > 0, percent(F.col("margin_idr"), F.col("total_penjualan_dpp"))).otherwise(0.0),
        )
        .drop("matched_a", "auto_b", "suggested", "confidence")
    )


def margin(invoices_a: DataFrame, invoices_b: DataFrame, scope: Sequence[str] = ("scope",)) -> DataFrame:
    """Sales minus purchases (tax base), and in percent of sales (0 without sales)."""
    scope = list(scope)
    facts = _union(
        [_facts(invoices_a, scope, sales=F.col("dpp")), _facts(invoices_b, scope, purchases=F.col("dpp"))]
    )
    sums = facts.groupBy(*scope).agg(_sum("sales", MONEY), _sum("purchases", MONEY))
    return sums.withColumn("margin_idr", (F.col("sales") - F.col("purchases")).cast(MONEY)).withColumn(
        "margin_pct", F.when(F.col("sales") > 0, percent(F.col("margin_idr"), F.col("sales"))).otherwise(0.0)
    )


def pair_summary(
    a: DataFrame,
    b: DataFrame,
    c: DataFrame,
    e: DataFrame,
    pairs_ac: DataFrame,
    pairs_be: DataFrame,
    scope: Sequence[str] = ("scope",),
) -> DataFrame:
    """Many-to-many variant: pair counts, and distinct rows left without a partner."""
    scope = list(scope)

    def used(pairs: DataFrame, idx: str, name: str) -> DataFrame:
        return _facts(pairs.select(*scope, idx).distinct(), scope, **{name: F.lit(1)})

    facts = _union(
        [
            *[_facts(df, scope, **{f"point_{p}_count": F.lit(1)}) for p, df in zip("abce", (a, b, c, e))],
            _facts(pairs_ac, scope, matches_a_vs_c=F.lit(1)),
            _facts(pairs_be, scope, matches_b_vs_e=F.lit(1)),
            used(pairs_ac, "l_idx", "used_a"),
            used(pairs_ac, "r_idx", "used_c"),
            used(pairs_be, "l_idx", "used_b"),
            used(pairs_be, "r_idx", "used_e"),
        ]
    )
    names = [c for c in facts.columns if c not in scope]
    sums = facts.groupBy(*scope).agg(*[_sum(n) for n in names])
    rows = F.col("point_a_count") + F.col("point_b_count") + F.col("point_c_count") + F.col("point_e_count")
    out = sums.withColumn("total_matches", F.col("matches_a_vs_c") + F.col("matches_b_vs_e")).withColumn(
        "match_rate", percent(F.col("total_matches"), rows)
    )
    for p in "abce":
        out = out.withColumn(f"unmatched_point_{p}", F.col(f"point_{p}_count") - F.col(f"used_{p}"))
    return out.drop(*[f"used_{p}" for p in "abce"])


def engine_summary(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts by source, match rate and matched / unmatched amounts of the engine.

    ``candidates`` is the tagged union of all sources with ``is_matched``; ``matches``
    is not needed beyond that flag, its invoices carry the matched amount.
    """
    source, matched = F.col("source_type"), F.col("is_matched")
    invoice, bank = source == "faktur_pajak", source == "rekening_koran"
    slip = source.isin("pph21", "pph23")
    return candidates.agg(
        F.count_if(invoice).alias("total_faktur"),
        F.count_if(bank).alias("total_rekening"),
        F.count_if(slip).alias("total_pph"),
        F.count_if(invoice & matched).alias("matched_count"),
        F.count_if(invoice & ~matched).alias("unmatched_faktur"),
        F.count_if(bank & ~matched).alias("unmatched_rekening"),
        F.count_if(slip & ~matched).alias("unmatched_pph"),
        F.count_if(bank & ~matched).alias("belum_dilaporkan"),
        F.coalesce(F.sum(F.when(invoice & matched, F.col("amount"))), F.lit(0)).cast(MONEY).alias("total_matched_amount"),
        F.coalesce(F.sum(F.when(~matched, F.col("amount"))), F.lit(0)).cast(MONEY).alias("total_unmatched_amount"),
    ).withColumn("match_rate", percent(F.col("matched_count"), F.col("total_faktur")) / 100)


def short_summary(summary: DataFrame) -> DataFrame:
    """Fewer fields of a reconciliation summary: every match counts, suggested ones too."""
    matched = F.col("total_auto_matched") + F.col("total_suggested")
    return summary.select(
        "scope",
        matched.alias("total_matched"),
        "total_unmatched",
        percent(matched, matched + F.col("total_unmatched")).alias("match_rate"),
    )
