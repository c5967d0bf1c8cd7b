"""The reconciliation job: split, both matching legs, left-overs and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neraca.functions.ids import normalize_npwp
from neraca.operators import match, split, summary
from neraca.session import cut_lineage


@dataclass
class Reconciliation:
    point_a: DataFrame
    point_b: DataFrame
    point_c: DataFrame
    point_e: DataFrame
    matches_ac: DataFrame
    matches_be: DataFrame

    def left_over(self) -> dict[str, DataFrame]:
        return {
            "point_a_unmatched": match.unmatched(self.point_a, self.matches_ac, "a_idx"),
            "point_c_unmatched": match.unmatched(self.point_c, self.matches_ac, "c_idx"),
            "point_b_unmatched": match.unmatched(self.point_b, self.matches_be, "b_idx"),
            "point_e_unmatched": match.unmatched(self.point_e, self.matches_be, "e_idx"),
        }

    def summary(self) -> DataFrame:
        return summary.reconciliation_summary(
            self.point_a, self.point_b, self.point_c, self.point_e, self.matches_ac, self.matches_be
        )


def reconcile(
    invoices: DataFrame,
    slips: DataFrame,
    bank: DataFrame,
    companies: DataFrame | None = None,
    period: tuple[str, str] | None = None,
    require_amount: bool = False,
) -> Reconciliation:
    """Reconcile every company of ``companies`` (all of them when None) in one job.

    Slips belong to the company they were withheld from, bank rows to the account
    holder.  ``period`` keeps rows dated inside it; off by default.  The rows to match and both match lists
    are written once, to the shared checkpoint folder, and every sheet reads them from there.
    """
    if period is not None:
        low, high = (F.to_date(F.lit(p)) for p in period)
        invoices, slips, bank = (df.filter(F.col("tanggal").between(low, high)) for df in (invoices, slips, bank))
    invoices = cut_lineage(split.keep_first(invoices, ["nomor_faktur"]))
    slips = slips.withColumn("scope", normalize_npwp(F.col("npwp_dipotong")))
    bank = bank.withColumn("scope", normalize_npwp(F.col("account_number")))
    if companies is None:
        a = invoices.withColumn("scope", normalize_npwp(F.col("npwp_penjual")))
        b = invoices.withColumn("scope", normalize_npwp(F.col("npwp_pembeli")))
    else:
        a, b = split.split_points_for(invoices, companies)
        scopes = companies.select(normalize_npwp(F.col("company_npwp")).alias("scope")).distinct()
        slips = slips.join(scopes, "scope", "left_semi")
        bank = bank.join(scopes, "scope", "left_semi")
    slips, bank = cut_lineage(slips), cut_lineage(bank)
    return Reconciliation(
        a,
        b,
        slips,
        bank,
        cut_lineage(match.pair_by_key(a, slips, "npwp_pembeli", "npwp_pemotong")),
        cut_lineage(match.match_payments(b, bank, require_amount=require_amount)),
    )
