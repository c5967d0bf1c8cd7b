"""Export jobs: what the report writers put on each sheet, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neraca.functions import dates, money, score, text
from neraca.operators import documents, ledger
from neraca.operators.activity import batch_layouts, summary_sheet


def bank_export(rows: DataFrame, keys: Sequence[str], year: Column, **options) -> DataFrame:
    """Statement rows as exported: dates completed, repeats dropped, quality checked.

    ``rows`` has ``tanggal, keterangan, kredit, debet, saldo`` as text and ``row_idx``.
    The result carries ``_position`` for the date order of the sheet.
    """
    keys = list(keys)
    completed = rows.withColumn("tanggal", dates.complete_date(F.col("tanggal"), year))
    unique = ledger.drop_repeats(completed, keys, ["row_idx"])
    checked = ledger.validate_rows(unique, keys, **options)
    words = text.title_case(text.clean_description(F.col("keterangan")))
    money_in = money.format_rupiah_text(F.col("kredit"))
    money_out = money.format_rupiah_text(F.col("debet"))
    return checked.select(
        *keys,
        "row_idx",
        "_position",
        "tanggal",
        money_in.alias("nilai_masuk"),
        money_out.alias("nilai_keluar"),
        money.format_rupiah_text(F.col("saldo")).alias("saldo"),
        F.when(money_in != "-", words).otherwise("-").alias("sumber_masuk"),
        F.when(money_out != "-", words).otherwise("-").alias("tujuan_keluar"),
        words.alias("keterangan"),
        F.col("label").alias("kualitas"),
    )


def slip_export(slips: DataFrame) -> DataFrame:
    """Slips as exported, with ``sorted_by``: date of the base document, null sorts first."""
    shown = slips.withColumns(
        {
            "sorted_by": F.try_to_date(dates.slash_date(F.col("dokumen_dasar_tanggal")), "dd/MM/yyyy"),
            "dpp": money.format_rupiah_text(F.col("dpp")),
            "pph": money.format_rupiah_text(F.col("pph")),
            "dokumen_dasar_tanggal": dates.slash_date(F.col("dokumen_dasar_tanggal")),
            "tanggal_potong": dates.slash_date(F.col("tanggal_potong")),
        }
    )
    return shown.orderBy(F.asc_nulls_first("sorted_by"), F.asc("row_idx"))


def batch_exports(results: DataFrame, data: str = "extracted_data") -> dict[str, DataFrame]:
    """Rows of every batch in the columns of its layout: one sheet per document type for batches of
    that type alone, and the summary for all others.

    ``results`` has ``batch_id, id, document_type, original_filename, confidence`` and the JSON.
    """
    routed = results.join(batch_layouts(results).select("batch_id", "layout"), "batch_id")
    keys = ["batch_id", "id"]

    def parsed(kinds: list[str], schema: str) -> DataFrame:
        return documents.read_json(routed.filter(F.col("layout").isin(kinds)).select(*keys, data), data, schema).drop(data, "is_invalid")

    slips = documents.flatten_slip(parsed(["pph21", "pph23"], documents.SLIP)).withColumn("row_idx", F.col("id"))
    statements = documents.statement_transactions(parsed(["rekening_koran"], documents.STATEMENT), keys)
    statements = statements.withColumn("row_idx", F.col("row_no").cast("long"))
    known = ["faktur_pajak", "pph21", "pph23", "rekening_koran", "invoice"]
    rest = routed.filter(~F.coalesce(F.col("layout").isin(known), F.lit(False)))
    return {
        "faktur_pajak": documents.item_rows(documents.flatten_tax_invoice(parsed(["faktur_pajak"], documents.TAX_INVOICE))),
        "pph": slip_export(slips),
        "rekening_koran": bank_export(statements, keys, dates.period_year(F.col("periode"))).drop("_position"),
        "invoice": documents.flatten_commercial(parsed(["invoice"], documents.COMMERCIAL)),
        "mixed": summary_sheet(rest, ["batch_id"]),
    }


def _present(df: DataFrame, names: Sequence[str], default: str) -> Column:
    """First of ``names`` the table has, filled with ``default``."""
    for name in names:
        if name in df.columns:
            return F.coalesce(F.col(name).cast("string"), F.lit(default))
    return F.lit(default)


def slip_match_details(matches: DataFrame, invoices: DataFrame, slips: DataFrame, scope: Sequence[str] = ("scope",)) -> DataFrame:
    """Both sides of each invoice and slip match: documents, dates, parties, amounts and goods."""
    a = invoices.select(
        *scope, F.col("row_idx").alias("a_idx"), F.col("nomor_faktur"), F.col("tanggal").alias("tanggal_faktur"), F.col("npwp_pembeli"),
        _present(invoices, ["nama_barang_jasa", "nama_barang"], "-").alias("nama_barang"), _present(invoices, ["quantity", "jumlah"], "-").alias("quantity"),
        "dpp", "ppn", F.col("total").alias("amount"),
    )
    c = slips.select(
        *scope, F.col("row_idx").alias("c_idx"), "nomor_bukti_potong", F.col("tanggal").alias("tanggal_bukti"), "npwp_pemotong", F.col("bruto"), F.col("pph")
    )
    return matches.join(a, [*scope, "a_idx"]).join(c, [*scope, "c_idx"]).withColumn("match_confidence", F.round("confidence", 2)).drop("confidence", "npwp")


def payment_match_details(matches: DataFrame, invoices: DataFrame, bank: DataFrame, scope: Sequence[str] = ("scope",)) -> DataFrame:
    """Both sides of each payment match with its gaps and scores, rounded to two places."""
    b = invoices.select(
        *scope, F.col("row_idx").alias("b_idx"), "nomor_faktur", "tanggal", F.col("npwp_penjual").alias("npwp"), F.col("total").alias("amount"),
        _present(invoices, ["nama_barang_jasa", "nama_barang"], "-").alias("nama_barang"), _present(invoices, ["quantity", "jumlah"], "-").alias("quantity"),
        "dpp", "ppn",
    )
    e = bank.select(*scope, F.col("row_idx").alias("e_idx"), F.col("tanggal").alias("bank_date"), F.col("debet").alias("bank_amount"), "keterangan")
    gap = score.day_gap(F.col("tanggal"), F.col("bank_date"))
    percent = score.percent_of_base(F.col("amount"), F.col("bank_amount"))
    shown = {
        "date_diff_days": gap.cast("long"),
        "amount_diff_pct": F.round(percent, 2),
        "date_score": F.round(score.linear_date_score(gap), 2),
        "amount_score": F.round(score.linear_amount_score(percent), 2),
        "match_confidence": F.round("confidence", 2),
    }
    return matches.join(b, [*scope, "b_idx"]).join(e, [*scope, "e_idx"]).withColumns(shown).drop("confidence", "match_type")


def unmatched_invoices(rows: DataFrame) -> DataFrame:
    """Left-over invoices under their sheet headers; optional columns default to ``-``."""
    return rows.select(
        "scope",
        "row_idx",
        F.col("nomor_faktur").alias("Nomor Faktur"),
        F.col("tanggal").alias("Tanggal Faktur"),
        F.col("npwp_penjual").alias("NPWP Penjual"),
        F.col("npwp_pembeli").alias("NPWP Pembeli"),
        _present(rows, ["nama_barang_jasa", "nama_barang"], "-").alias("Nama Barang"),
        _present(rows, ["quantity", "jumlah"], "-").alias("Quantity"),
        F.col("dpp").alias("DPP"),
        F.col("ppn").alias("PPN"),
        F.col("total").alias("Total"),
    )


def unmatched_slips(rows: DataFrame) -> DataFrame:
    return rows.select(
        "scope",
        "row_idx",
        F.col("nomor_bukti_potong").alias("Nomor Bukti Potong"),
        F.col("tanggal").alias("Tanggal"),
        F.col("npwp_pemotong").alias("NPWP Pemotong"),
        _present(rows, ["nama_pemotong"], "").alias("Nama Pemotong"),
        _present(rows, ["jenis_penghasilan"], "").alias("Jenis Penghasilan"),
        F.col("bruto").alias("Jumlah Bruto"),
        F.col("pph").alias("PPh Dipotong"),
    )


def unmatched_bank_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "scope",
        "row_idx",
        F.col("tanggal").alias("Tanggal"),
        F.col("keterangan").alias("Keterangan"),
        _present(rows, ["cabang"], "").alias("Cabang"),
        F.col("debet").alias("Debet"),
        F.col("kredit").alias("Kredit"),
        _present(rows, ["saldo"], "0").alias("Saldo"),
    )
