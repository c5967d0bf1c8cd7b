"""Extracted documents and landed sheets, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neraca.functions.dates import MONTH_NAMES
from neraca.sources.rendered import id_amount
from neraca.sources.views import Views


def _month_name(day):
    return F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(day) - 1)


def tax_invoices(v: Views) -> DataFrame:
    """JSON of every invoice with its lines as items; some have none, some are broken."""
    line = F.struct(
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
    )
    lines = v.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    named = F.transform(
        "lines",
        lambda x: F.struct(
            F.concat(F.when(x["l_partkey"] % 9 == 0, "Jasa Servis ").otherwise("Barang "), x["l_partkey"].cast("string")).alias("description"),
            F.concat(x["l_quantity"].cast("int").cast("string"), F.lit(",00")).alias("quantity"),
            F.concat(F.lit("Rp "), id_amount(x["l_extendedprice"].cast("decimal(18,2)"))).alias("unit_price"),
        ),
    )
    row = F.col("row_idx")
    day = F.col("tanggal")
    doc = F.struct(
        F.struct(
            F.concat(F.lit("PT "), F.col("npwp_penjual")).alias("name"), F.col("npwp_penjual").alias("npwp"), F.lit("Jl. A 1").alias("address")
        ).alias("seller"),
        F.struct(F.concat(F.lit("CV "), F.col("npwp_pembeli")).alias("name"), F.col("npwp_pembeli").alias("npwp")).alias("buyer"),
        F.struct(
            F.col("nomor_faktur").alias("number"),
            F.concat(F.date_format(day, "dd"), F.lit(" "), _month_name(day), F.date_format(day, " yyyy")).alias("issue_date"),
        ).alias("invoice"),
        F.create_map(
            F.when(row % 2 == 0, "DPP").otherwise("dpp"), F.concat(F.lit("Rp "), id_amount(F.col("dpp"))), F.lit("ppn"), F.col("ppn").cast("string"),
            F.when(row % 3 == 0, "TOTAL").otherwise("Total"), F.col("total").cast("string"),
        ).alias("financials"),
        F.when(row % 10 != 0, named).alias("items"),
    )
    text = F.when(row % 50 == 3, "[1, 2]").when(row % 50 == 4, "{broken").otherwise(F.to_json(doc))
    return v.spread_invoice.join(lines, F.col("l_orderkey") == row).select("row_idx", text.alias("extracted_data"))


def slips(v: Views) -> DataFrame:
    """JSON of every withholding slip, with either spelling of its keys."""
    row, day = F.col("row_idx"), F.col("tanggal")
    even = row % 2 == 0
    masa = F.concat(F.date_format(day, "MM"), F.lit("-"), F.date_format(day, "yyyy"))
    number = F.col("nomor_bukti_potong")
    doc = F.struct(
        F.struct(
            F.when(even, number).alias("nomor"), F.when(~even, number).alias("number"), masa.alias("masa_pajak"),
            F.date_format(day, "yyyy-MM-dd").alias("tanggal"),
        ).alias("dokumen"),
        F.struct(F.when(even, F.col("npwp_dipotong")).alias("npwp"), F.col("npwp_dipotong").alias("nik"), F.lit("PT Penerima").alias("nama")).alias("penerima"),
        F.struct(F.col("npwp_pemotong").alias("npwp"), F.when(even, "PT Pemotong").alias("nama"), F.lit("CV Pemotong").alias("name")).alias("pemotong"),
        F.struct(F.when(row % 3 == 0, "PPh 4(2)").when(row % 3 == 1, "pph 23").alias("jenis_pph"), F.lit("24-104-01").alias("kode")).alias("objek_pajak"),
        F.create_map(
            F.when(even, "DPP").otherwise("Bruto"), F.concat(F.lit("Rp "), F.col("bruto").cast("string")), F.lit("tarif"), F.lit("2%"), F.lit("PPh"), F.col("pph").cast("string")
        ).alias("financials"),
        F.struct(
            F.lit("Faktur").alias("jenis"),
            F.when(row % 7 == 0, "tanpa tanggal").otherwise(F.date_format(day, "dd/MM/yyyy")).alias("tanggal"),
        ).alias("dokumen_dasar"),
    )
    return v.withholding.select("row_idx", F.to_json(doc).alias("extracted_data"))


def commercial(v: Views) -> DataFrame:
    orders = v.table("orders")
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    slash = F.date_format(day, "dd/MM/yyyy")
    doc = F.struct(
        F.struct(F.when(key % 2 == 0, slash).alias("tgl_invoice"), F.when(key % 3 == 0, slash).alias("tanggal")).alias("invoice_info"),
        F.struct(F.when(key % 2 == 0, F.concat(F.lit("PO-"), key.cast("string"))).alias("po_number"), F.when(key % 5 == 1, F.concat(F.lit("P/"), key.cast("string"))).alias("po")).alias("purchase_order"),
        F.struct(F.when(key % 4 == 0, "").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("total"), F.lit("7").alias("grand_total")).alias("summary"),
        F.struct(F.col("o_orderpriority").alias("remarks")).alias("additional"),
    )
    return orders.select(key.alias("id"), F.to_json(doc).alias("extracted_data"))


def statements(v: Views) -> DataFrame:
    """JSON statements of 40 bank rows, signed or split, with either spelling; every
    eleventh has no rows."""
    from neraca.sources.rendered import statement_source

    s = statement_source(v)
    signed = F.col("row_idx") % 3 == 0
    sign = F.when(F.col("debet") > 0, F.concat(F.lit("-"), F.col("debet").cast("string"))).otherwise(F.concat(F.lit("+"), F.col("kredit").cast("string")))
    row = F.struct(
        F.col("row_idx"),
        F.struct(
            F.date_format("day", "dd/MM/yyyy").alias("date"),
            F.when(F.col("row_idx") % 2 == 0, F.col("keterangan")).alias("keterangan"),
            F.when(F.col("row_idx") % 2 == 1, F.col("keterangan")).alias("uraian"),
            F.when(~signed & (F.col("kredit") > 0), F.col("kredit").cast("string")).alias("credit"),
            F.when(~signed & (F.col("debet") > 0), F.col("debet").cast("string")).alias("debet"),
            F.when(signed, sign).alias("mutasi"),
            F.col("saldo").cast("string").alias("balance"),
        ).alias("t"),
    )
    docs = s.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", row["t"].alias("t")))), lambda x: x["t"]).alias("rows"))
    doc = F.struct(
        F.struct(F.lit("Bank X").alias("bank_name"), F.col("doc_id").cast("string").alias("nomor_rekening"), F.lit("Januari 2024").alias("period")).alias("bank_info"),
        F.when(F.col("doc_id") % 11 != 0, F.col("rows")).alias("transactions"),
    )
    return docs.select("doc_id", F.to_json(doc).alias("extracted_data"))


# --- sheets ---------------------------------------------------------------------------------------------------


def _sheet(rows: DataFrame, heads: DataFrame) -> DataFrame:
    return rows.unionByName(heads)


def invoice_sheets(v: Views) -> DataFrame:
    """Invoice sheets, wide in even files and old in odd ones, with a title above the header."""
    row = F.col("row_idx")
    file = (row % 40).alias("file")
    day = F.date_format("tanggal", "dd/MM/yyyy")
    dpp, ppn, total = (F.concat(F.lit("Rp "), id_amount(F.col(c))) for c in ("dpp", "ppn", "total"))
    wide = F.array(F.concat(F.lit(" PT "), F.col("npwp_penjual")), F.lit("Jl. A"), F.col("npwp_penjual"), F.concat(F.lit("CV "), F.col("npwp_pembeli")), F.lit("Jl. B"), F.col("npwp_pembeli"), day, F.col("nomor_faktur"), dpp, ppn, total, F.lit("INV"))
    old = F.array(F.concat(F.lit("PT "), F.col("npwp_penjual")), day, F.col("npwp_penjual"), F.col("nomor_faktur"), F.lit("Jl. A"), dpp, ppn, total)
    # Rows that lack their key fields must drop out again.
    empty = F.array(F.lit(" "), F.lit("x"), F.lit("y"), F.lit(""), F.lit(""), F.lit("5"))
    cells = F.when(row % 97 == 0, empty).when(row % 2 == 0, wide).otherwise(old)
    rows = v.spread_invoice.select(file, (F.floor(row / 40) + 10).alias("row_idx"), cells.alias("cells"))
    return _sheet(rows, _heads(v))


def bank_sheets(v: Views) -> DataFrame:
    row = F.col("row_idx")
    day = F.when(row % 53 == 0, "  ").otherwise(F.date_format("tanggal", "dd/MM/yyyy"))
    cells = F.array(day, id_amount(F.col("kredit")), id_amount(F.col("debet")), F.lit("1.000.000,00"), F.lit("S"), F.lit("T"), F.col("keterangan"))
    rows = v.spread_bank.select((row % 40).alias("file"), (F.floor(row / 40) + 10).alias("row_idx"), cells.alias("cells"))
    return _sheet(rows, _heads(v))


def slip_sheets(v: Views) -> DataFrame:
    row = F.col("row_idx")
    masa = F.date_format("tanggal", "MM-yyyy")
    base = [F.col("nomor_bukti_potong"), masa, F.lit("Final"), F.lit("Normal"), F.col("npwp_dipotong"), F.lit("PT Penerima"), F.lit("kode")]
    amounts = [id_amount(F.col("bruto")), F.lit("-"), id_amount(F.col("pph"))]
    cells = F.when(row % 2 == 0, F.array(*base, *amounts, F.lit("ttd"))).otherwise(F.array(*base, *amounts))
    rows = v.withholding.select((row % 40).alias("file"), (F.floor(row / 40) + 10).alias("row_idx"), cells.alias("cells"))
    return _sheet(rows, _heads(v))


def _heads(v: Views) -> DataFrame:
    """Title, blank and header rows of the 40 files, one set per file that has rows."""
    files = v.table("orders").select((F.col("o_orderkey") % 40).alias("file")).distinct()
    title = F.struct(F.lit(1).cast("long").alias("row_idx"), F.array(F.lit("LAPORAN"), F.lit("")).alias("cells"))
    names = F.array(*[F.lit(x) for x in ("A", "B", "C", "D", "E", "F")])
    header = F.struct((F.lit(2) + F.col("file") % 5).cast("long").alias("row_idx"), names.alias("cells"))
    blank = F.struct(F.lit(9).cast("long").alias("row_idx"), F.array(F.lit(""), F.lit(" ")).alias("cells"))
    return files.select("file", F.inline(F.array(title, header, blank)))
