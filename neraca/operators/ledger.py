"""Balance chains, chunk validation, row quality and statement summaries.

A ledger row has keys (``account``), an order (``ts, row_idx``), ``debet``, ``kredit`` and the
reported ``saldo``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neraca.functions import dates, money, text
from neraca.operators.ordered import previous_value, rank_rows, running_sum

TOLERANCE = 0.01
CHUNK_ROWS = 50


def _moved() -> Column:
    return F.col("kredit") - F.col("debet")


def expected_chain(
    rows: DataFrame, keys: Sequence[str], order: Sequence, opening: Column | None = None, **options
) -> DataFrame:
    """``expected`` = opening + running (kredit - debet)."""
    summed = running_sum(rows, keys, order, _moved(), "expected", **options)
    return summed if opening is None else summed.withColumn("expected", F.col("expected") + opening)


def previous_balance_check(
    rows: DataFrame, keys: Sequence[str], order: Sequence, tolerance: float = 1.0, **options
) -> DataFrame:
    """``is_mismatch``: the reported balance does not follow from the one before it."""
    lagged = previous_value(rows, keys, order, "saldo", "previous_saldo", **options)
    gap = F.abs(F.col("previous_saldo") + _moved() - F.col("saldo"))
    return lagged.withColumn("is_mismatch", F.coalesce(gap > tolerance, F.lit(False)))


def chunk_rows(
    rows: DataFrame, keys: Sequence[str], order: Sequence, opening: Column | None = None, size: int = CHUNK_ROWS, **options
) -> DataFrame:
    """Rows with ``chunk``, their index in it, and the balance the chunk starts from.

    A chunk starts from the reported balance of the last row of the chunk before it,
    found by a join on the chunk number rather than a walk over the account.
    """
    keys = list(keys)
    opening = F.lit(0).cast(money.MONEY) if opening is None else opening
    ranked = rank_rows(rows, keys, order, "_n", **options)
    numbered = ranked.withColumn("chunk", F.floor((F.col("_n") - 1) / size)).withColumn(
        "index", ((F.col("_n") - 1) % size).cast("long")
    )
    ends = numbered.filter(F.col("_n") % size == 0).select(
        *keys, (F.col("chunk") + 1).alias("chunk"), F.col("saldo").alias("_start")
    )
    return (
        numbered.join(ends, [*keys, "chunk"], "left")
        .withColumn("saldo_start", F.coalesce("_start", opening))
        .drop("_start", "_n")
    )


def validate_chunks(chunked: DataFrame, keys: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """One row per chunk: does its chain hold, are its rows complete.

    Groups have at most one chunk of rows, so the message list stays short.
    """
    keys = list(keys)
    w = (
        Window.partitionBy(*keys, "chunk")
        .orderBy("index")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    off = F.abs(F.col("expected") - F.col("saldo")) > tolerance
    lacks = F.size(
        text.missing_fields(
            {"tanggal": F.col("tanggal"), "keterangan": F.col("keterangan"), "saldo": F.when(F.col("saldo") != 0, F.col("saldo"))}
        )
    )
    checked = (
        chunked.withColumn("expected", F.col("saldo_start") + F.sum(_moved()).over(w))
        .withColumn("_off", F.coalesce(off, F.lit(True)))
        .withColumn("_lacks", lacks)
    )
    note = F.format_string(
        "Txn %d: Expected saldo %s, got %s",
        F.col("index"),
        F.col("expected").cast("decimal(28,2)").cast("string"),
        F.col("saldo").cast("decimal(28,2)").cast("string"),
    )
    notes = F.array_sort(F.collect_list(F.when(F.col("_off"), F.struct("index", note.alias("note")))))
    grouped = checked.groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("rows"),
        F.first("saldo_start").alias("saldo_start"),
        F.max_by("saldo", "index").alias("saldo_end"),
        F.max_by("expected", "index").cast("decimal(28,2)").alias("expected_end"),
        F.max_by("_off", "index").alias("_last_off"),
        F.count_if("_off").alias("broken_rows"),
        F.sum("_lacks").alias("missing_fields"),
        F.array_join(F.transform(notes, lambda n: n["note"]), "; ").alias("error_message"),
    )
    return (
        grouped.withColumn("saldo_match", ~F.col("_last_off"))
        .withColumn("is_valid", (F.col("broken_rows") == 0) & (F.col("missing_fields") == 0))
        .withColumn("needs_review", ~F.col("is_valid"))
        .drop("_last_off")
    )


def reported_chunks(chunked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks as an extractor reports them that sees one at a time: each starts from the balance before its own first row."""
    return chunked.groupBy(*keys, "chunk").agg(
        F.min_by(F.col("saldo") - _moved(), "index").alias("saldo_start"), F.max_by("saldo", "index").alias("saldo_end")
    )


def inter_chunk_check(chunks: DataFrame, keys: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Does each chunk start where the one before it ended: always for ``chunk_rows``, not for ``reported_chunks``."""
    keys = list(keys)
    before = chunks.select(*keys, (F.col("chunk") + 1).alias("chunk"), F.col("saldo_end").alias("previous_end"))
    gap = F.abs(F.col("saldo_start") - F.col("previous_end"))
    return chunks.join(before, [*keys, "chunk"], "left").withColumn(
        "inter_chunk_valid", F.coalesce(gap <= tolerance, F.lit(True))
    )


def closing_offset(rows: DataFrame, keys: Sequence[str], order: Sequence, tolerance: float = TOLERANCE) -> DataFrame:
    """Calculated against reported closing balance; ``saldo_offset`` when they differ."""
    grouped = rows.groupBy(*keys).agg(
        F.sum(_moved()).cast("decimal(28,2)").alias("calculated_end"),
        F.max_by("saldo", F.struct(*order)).alias("actual_end"),
    )
    gap = (F.col("actual_end") - F.col("calculated_end")).cast("decimal(28,2)")
    return grouped.withColumn("difference", gap).withColumn(
        "type", F.when(F.abs(gap) > tolerance, "saldo_offset")
    )


def review_flags(chunks: DataFrame, confidence: DataFrame, keys: Sequence[str], threshold: float = 0.90) -> DataFrame:
    """A chunk needs review when it is invalid or its mean confidence is low.

    ``confidence`` has one ``mean_confidence`` per chunk."""
    joined = chunks.join(confidence, [*keys, "chunk"], "left")
    return joined.withColumn(
        "needs_review", ~F.col("is_valid") | (F.coalesce("mean_confidence", F.lit(1.0)) < threshold)
    )


# --- row quality ----------------------------------------------------------------------------------------

# Quality labels.
QUALITY_HIGH, QUALITY_MEDIUM, QUALITY_LOW = "✅ High", "⚠️ Medium", "❌ Low"


def row_quality(rows: DataFrame, previous: Column) -> DataFrame:
    """``score`` 0-1, ``issues`` and ``label`` of text rows; ``previous`` is the balance
    before the row as a number, null when unknown."""
    date, balance = F.coalesce("tanggal", F.lit("")), F.coalesce("saldo", F.lit(""))
    credit, debit = F.coalesce("kredit", F.lit("")), F.coalesce("debet", F.lit(""))
    no_date = date.isin("", "N/A")
    bad_date = ~no_date & dates.is_unsortable(dates.sort_key(date))
    no_balance = balance.isin("", "N/A", "-")
    number = money.misread_value(balance)
    bad_balance = ~no_balance & number.isNull()
    negative = ~no_balance & F.coalesce(number < 0, F.lit(False))
    has_credit, has_debit = ~text.blank_amount(credit), ~text.blank_amount(debit)

    def amount(c: Column) -> Column:
        return F.when(c.isin("", "-", "N/A"), F.lit(0).cast(money.MONEY)).otherwise(money.misread_value(c))

    gap = F.abs(previous + amount(credit) - amount(debit) - number)
    mismatch = F.coalesce(~no_balance & (gap > 1), F.lit(False))
    no_words = F.coalesce("keterangan", F.lit("")).isin("", "N/A")
    # Issue names and what each takes off the score.
    checks = [
        (no_date, "missing_date", 0.3),
        (bad_date, "invalid_date", 0.2),
        (no_balance, "missing_saldo", 0.2),
        (negative, "negative_saldo", 0.1),
        (bad_balance, "invalid_saldo_format", 0.2),
        (has_credit & has_debit, "both_kredit_debet", 0.3),
        (~has_credit & ~has_debit, "no_mutation", 0.2),
        (mismatch, "saldo_mismatch", 0.15),
        (no_words, "missing_description", 0.05),
    ]
    score = F.lit(1.0)
    for test, _, penalty in checks:
        score = score - F.when(test, penalty).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    issues = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name, _ in checks]))
    return (
        rows.withColumn("score", score)
        .withColumn("issues", issues)
        .withColumn(
            "label",
            F.when(F.col("score") >= 0.8, QUALITY_HIGH).when(F.col("score") >= 0.5, QUALITY_MEDIUM).otherwise(QUALITY_LOW),
        )
    )


def date_position(c: Column) -> Column:
    """The sort key of a statement date as one long."""
    key = dates.sort_key(c)
    return (key["y"].cast("long") * 10000 + key["m"] * 100 + key["d"]).cast("long")


def validate_rows(rows: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Row quality along each account's date order (file order inside a day)."""
    prepared = rows.withColumn("_position", date_position(F.col("tanggal"))).withColumn(
        "_saldo", money.misread_value(F.col("saldo"))
    )
    lagged = previous_value(
        prepared, keys, ["_position", "row_idx"], "_saldo", "_previous", **options
    )
    return row_quality(lagged, F.col("_previous")).drop("_previous", "_saldo")


# --- summaries --------------------------------------------------------------------------------------------


def statement_summary(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Count, sums, first and last balance of each statement."""
    place = F.struct(*order)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("debet").cast("decimal(28,2)").alias("total_debit"),
        F.sum("kredit").cast("decimal(28,2)").alias("total_credit"),
        F.min_by("saldo", place).alias("opening_balance"),
        F.max_by("saldo", place).alias("closing_balance"),
    )


def whole_unit_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums and net change truncated to whole units, as text."""
    debit, credit = F.sum("debet"), F.sum("kredit")

    def whole(c: Column) -> Column:
        return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("decimal(28,0)").cast("string")

    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_transaksi"),
        whole(debit).alias("total_debet"),
        whole(credit).alias("total_kredit"),
        whole(credit - debit).alias("net_change"),
    )


def quality_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of text amounts, mean quality and share of high-quality rows."""

    def value(name: str) -> Column:
        c = F.col(name)
        return F.when(~text.blank_amount(c), F.coalesce(money.misread_value(c), F.lit(0)))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(value(name)), F.lit(0)).cast("decimal(28,2)")

    quality = F.sum(F.col("score").cast("decimal(6,4)")).cast("double") / F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        total("kredit").alias("total_kredit"),
        total("debet").alias("total_debet"),
        (total("kredit") - total("debet")).cast("decimal(28,2)").alias("net_change"),
        quality.alias("avg_quality"),
        (F.count_if(F.col("score") >= 0.8).cast("double") / F.count(F.lit(1)) * 100).alias("high_quality_pct"),
    )


def validation_stats(chunks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Passed, failed and to-be-reviewed chunks with their rates."""
    total = F.count(F.lit(1))
    passed, review = F.count_if("is_valid"), F.count_if("needs_review")
    return chunks.groupBy(*keys).agg(
        total.alias("total_chunks"),
        passed.alias("passed"),
        (total - passed).alias("failed"),
        review.alias("needs_review"),
        (passed.cast("double") / total * 100).alias("pass_rate"),
        (review.cast("double") / total * 100).alias("review_rate"),
    )


def overall_confidence(rows: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """60 % mean row confidence, 40 % share of valid chunks."""
    keys = list(keys)
    mean = F.sum(F.col("confidence").cast("decimal(6,4)")).cast("double") / F.count(F.lit(1))
    rate = F.count_if("is_valid").cast("double") / F.count(F.lit(1))
    return (
        rows.groupBy(*keys)
        .agg(mean.alias("mean_confidence"))
        .join(chunks.groupBy(*keys).agg(rate.alias("pass_share")), keys, "left")
        .withColumn("overall_confidence", F.col("mean_confidence") * 0.6 + F.coalesce("pass_share", F.lit(0.0)) * 0.4)
    )


def drop_repeats(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row, in order, of each statement fingerprint on cleaned amounts."""
    marked = rows.withColumn(
        "_mark", text.fingerprint(F.col("tanggal"), F.col("kredit"), F.col("debet"), F.col("saldo"))
    )
    payload = F.struct(*[F.col(c) for c in rows.columns])
    return (
        marked.groupBy(*keys, "_mark")
        .agg(F.min_by(payload, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def merge_chunks(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of all chunks, the first of equal ``(tanggal, debet, kredit, saldo)`` kept."""
    payload = F.struct(*[F.col(c) for c in rows.columns])
    marks = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_m_{c}") for c in ("tanggal", "debet", "kredit", "saldo")]
    return rows.groupBy(*keys, *marks).agg(F.min_by(payload, F.struct(*order)).alias("_row")).select("_row.*")


def opening_and_closing(chunks: DataFrame, keys: Sequence[str], order: str = "chunk") -> DataFrame:
    """Opening balance of the first chunk, closing balance of the last."""
    return chunks.groupBy(*keys).agg(
        F.min_by("saldo_awal", order).alias("saldo_awal"), F.max_by("saldo_akhir", order).alias("saldo_akhir")
    )
