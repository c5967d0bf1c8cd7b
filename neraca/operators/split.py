"""Company detection, de-duplication and the sales / purchase split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neraca.functions.ids import normalize_npwp


def company_npwp(invoices: DataFrame, seller: str = "npwp_penjual") -> DataFrame:
    """Most frequent non-blank seller; the smallest wins a tie.  One row."""
    name = F.trim(F.col(seller))
    counts = (
        invoices.select(name.alias("company_npwp"))
        .filter(F.col("company_npwp") != "")
        .groupBy("company_npwp")
        .agg(F.count(F.lit(1)).alias("invoices"))
    )
    return counts.orderBy(F.desc("invoices"), F.asc("company_npwp")).limit(1)


def keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("row_idx",),
    keep_null_keys: bool = False,
) -> DataFrame:
    """First row per key along ``order``.  Null keys count as one key unless
    ``keep_null_keys``.  A partial aggregate, so a hot key is combined map-side."""
    payload = F.struct(*[F.col(c) for c in df.columns])
    firsts = df.groupBy(*keys).agg(F.min_by(payload, F.struct(*order)).alias("_row")).select("_row.*")
    if not keep_null_keys:
        return firsts
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    return firsts.filter(~has_null).unionByName(df.filter(has_null))


def repeated_rows(df: DataFrame, keys: Sequence[str], order: str = "row_idx") -> DataFrame:
    """Every row after the first of its key."""
    firsts = df.groupBy(*keys).agg(F.min(order).alias("_first")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "_first"
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (
        df.join(firsts, same)
        .filter(F.col(order) > F.col("_first"))
        .drop("_first", *[f"_k_{k}" for k in keys])
    )


def split_points(invoices: DataFrame, company: str | Column) -> DataFrame:
    """Flags ``is_a`` (company sells) and ``is_b`` (company buys); both can hold."""
    key = normalize_npwp(F.lit(company) if isinstance(company, str) else company)
    return invoices.withColumn("is_a", normalize_npwp(F.col("npwp_penjual")) == key).withColumn(
        "is_b", normalize_npwp(F.col("npwp_pembeli")) == key
    )


def split_points_for(invoices: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point A and point B of many companies at once, with a ``scope`` column.

    ``companies`` has one column ``company_npwp``.
    """
    scope = companies.select(normalize_npwp(F.col("company_npwp")).alias("scope")).distinct()
    a = invoices.withColumn("scope", normalize_npwp(F.col("npwp_penjual"))).join(scope, "scope", "left_semi")
    b = invoices.withColumn("scope", normalize_npwp(F.col("npwp_pembeli"))).join(scope, "scope", "left_semi")
    return a, b


def split_single(invoices: DataFrame, company: str | Column) -> DataFrame:
    """``point`` is A when the company sells, else B when it buys, else ``none``."""
    key = normalize_npwp(F.lit(company) if isinstance(company, str) else company)
    return invoices.withColumn(
        "point",
        F.when(normalize_npwp(F.col("npwp_penjual")) == key, "A")
        .when(normalize_npwp(F.col("npwp_pembeli")) == key, "B")
        .otherwise("none"),
    )
