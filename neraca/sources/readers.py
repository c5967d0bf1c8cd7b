"""Sources: sheets landed as tables, the export catalogue, operational tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neraca.functions.money import sheet_amount
from neraca.functions.text import export_type
from neraca.schema import REQUIRED

FORMATS = {"csv", "json", "parquet", "orc"}


def load_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A reconciliation table with a declared schema; CSV files carry a header."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is none of {sorted(FORMATS)}")
    reader = spark.read.schema(schema).options(**options)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """An operational table, read in ``parts`` ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def catalogue(spark: SparkSession, folder: str, pattern: str = "*", kind: str | None = None) -> DataFrame:
    """Exported files with id, type, size and time, newest first; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    return catalogue_of(files, kind)


def catalogue_of(files: DataFrame, kind: str | None = None) -> DataFrame:
    """Catalogue rows of ``path, length, modificationTime``; temporary files are skipped."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(
        file_id(F.col("path")).alias("id"),
        name.alias("filename"),
        F.col("path").alias("filepath"),
        export_type(name).alias("document_type"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("created_at"),
    ).filter(~F.col("filename").startswith("~"))
    rows = rows if kind is None else rows.filter(F.col("document_type") == kind)
    return rows.orderBy(F.desc("created_at"), F.asc("id"))


def file_id(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 16)


# --- headers ---------------------------------------------------------------------------------------------


def detect_kind(headers: Column) -> Column:
    """Kind of a sheet by its headers, first rule wins."""
    names = F.transform(headers, lambda h: F.trim(h))

    def has(name: str) -> Column:
        return F.array_contains(names, name)

    return (
        F.when(has("Nomor Faktur") & (has("NPWP Penjual") | has("NPWP Pembeli")), "faktur_pajak")
        .when(has("Nomor Bukti Potong") & has("NPWP Pemotong"), "bukti_potong")
        .when(has("Keterangan") & (has("Debet (Rp)") | has("Kredit (Rp)")), "rekening_koran")
        .otherwise("unknown")
    )


def missing_headers(headers: Column, kind: str) -> Column:
    return F.array_except(F.array(*[F.lit(h) for h in REQUIRED[kind]]), headers)


def require_headers(sheets: DataFrame, kind: str) -> DataFrame:
    """The sheets as they are; the job fails on one that lacks a required header."""
    missing = missing_headers(F.col("headers"), kind)
    message = F.concat(F.lit(f"{kind} sheet lacks "), F.array_join(missing, ", "))
    ok = F.when(F.size(missing) == 0, F.col("headers")).otherwise(F.raise_error(message).cast("array<string>"))
    return sheets.withColumn("headers", ok)


def header_rows(rows: DataFrame, key: str = "file") -> DataFrame:
    """Header row of each sheet: the first of rows 1 to 9 with five filled cells."""
    filled = F.size(F.filter("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    top = rows.filter(F.col("row_idx").between(1, 9) & (filled >= 5))
    return top.groupBy(key).agg(F.min("row_idx").alias("header_row"))


def body_rows(rows: DataFrame, key: str = "file") -> DataFrame:
    """Rows below the header that are not empty.  Sheets without a header give none.

    The header rows, a key and a number per sheet, are broadcast: the rows are not shuffled for them."""
    not_empty = F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    below = rows.join(F.broadcast(header_rows(rows, key)), key).filter(F.col("row_idx") > F.col("header_row")).drop("header_row")
    # Empty rows leave through inline(): a filter on cells would be pushed below whatever writes them, and write them
    # again for each cell that it or a later filter names.
    return below.select(F.inline(F.when(not_empty, F.array(F.struct(*below.columns)))))


# --- rows ---------------------------------------------------------------------------------------------------


def _text(position: int) -> Column:
    return F.coalesce(F.trim(F.get("cells", F.lit(position))), F.lit(""))


def _amount(position: int) -> Column:
    return sheet_amount(F.get("cells", F.lit(position)))


# Cell of each field in the wide (11 cells and more) and the old layout.
WIDE = dict(nama_seller=0, alamat_seller=1, npwp_seller=2, nama_buyer=3, alamat_buyer=4, npwp_buyer=5, tanggal=6, nomor_faktur=7, invoice_number=11)
WIDE_AMOUNTS = dict(dpp=8, ppn=9, total=10)
OLD = dict(nama_seller=0, tanggal=1, npwp_seller=2, nomor_faktur=3, alamat_seller=4, invoice_number=8)
OLD_AMOUNTS = dict(dpp=5, ppn=6, total=7)


def invoice_rows(rows: DataFrame) -> DataFrame:
    """Invoices of sheets in either layout; rows without their key fields drop out."""
    wide = F.size("cells") >= 11

    def text(name: str) -> Column:
        old = _text(OLD[name]) if name in OLD else F.lit("")
        return F.when(wide, _text(WIDE[name])).otherwise(old).alias(name)

    picked = rows.select(
        "file",
        F.col("row_idx").alias("row_number"),
        wide.alias("_wide"),
        *[text(n) for n in WIDE],
        *[F.get("cells", F.when(wide, WIDE_AMOUNTS[n]).otherwise(OLD_AMOUNTS[n])).alias(f"_{n}") for n in WIDE_AMOUNTS],
    )
    first = F.when(F.col("_wide"), F.col("tanggal")).otherwise(F.col("nama_seller"))
    kept = picked.filter((first != "") | (F.col("nomor_faktur") != ""))
    return kept.select("file", "row_number", *WIDE, *[sheet_amount(F.col(f"_{n}")).alias(n) for n in WIDE_AMOUNTS])


def bank_rows(rows: DataFrame) -> DataFrame:
    """Statement rows of seven cells; rows without a date drop out."""
    return rows.filter(_text(0) != "").select(
        "file",
        F.col("row_idx").alias("row_number"),
        _text(0).alias("tanggal"),
        _amount(1).alias("nilai_masuk"),
        _amount(2).alias("nilai_keluar"),
        _amount(3).alias("saldo"),
        _text(4).alias("sumber_masuk"),
        _text(5).alias("tujuan_keluar"),
        _text(6).alias("keterangan"),
    )


def slip_rows(rows: DataFrame, cells: int | None = None) -> DataFrame:
    """Withholding rows: among the cells past the sixth, or the last ``cells`` of them, the rightmost
    positive amount is the tax and the next one the gross."""
    n = F.size("cells")
    low = F.lit(5) if cells is None else F.greatest(F.lit(5), n - cells - 1)
    tail = F.reverse(F.slice("cells", (low + 2).cast("int"), F.greatest(n - 1 - low, F.lit(0)).cast("int")))
    positive = F.filter(F.transform(tail, sheet_amount), lambda x: x > 0)
    zero = F.lit(0).cast("decimal(18,2)")
    picked = rows.filter(_text(0) != "").select(
        "file",
        F.col("row_idx").alias("row_number"),
        _text(0).alias("nomor"),
        _text(1).alias("masa_pajak"),
        _text(4).alias("npwp_nik"),
        _text(5).alias("nama_penerima"),
        positive.alias("_found"),
    )
    return picked.select(
        *[c for c in picked.columns if c != "_found"],
        F.coalesce(F.get("_found", F.lit(1)), zero).alias("jumlah_bruto"),
        F.coalesce(F.get("_found", F.lit(0)), zero).alias("pph_dipotong"),
    )


# --- candidates of the three-source engine ------------------------------------------------------------------------


def _candidate(kind: Column, date: Column, amount: Column, vendor: Column, reference: Column, raw: Sequence[str]) -> list[Column]:
    pairs = [x for n in raw for x in (F.lit(n), F.col(n).cast("string"))]
    return [
        kind.alias("source_type"),
        F.col("file").alias("source_file"),
        F.col("row_number").cast("int").alias("source_row"),
        date.alias("date"),
        amount.cast("decimal(18,2)").alias("amount"),
        vendor.alias("vendor_name"),
        reference.alias("reference"),
        F.create_map(*pairs).alias("raw_data"),
    ]


def invoice_candidates(invoices: DataFrame) -> DataFrame:
    raw = ["nama_seller", "npwp_seller", "nama_buyer", "npwp_buyer", "dpp", "ppn", "total", "invoice_number"]
    return invoices.select(
        *_candidate(F.lit("faktur_pajak"), F.col("tanggal"), F.col("total"), F.col("nama_seller"), F.col("nomor_faktur"), raw)
    )


def bank_candidates(bank: DataFrame, shown: int | None = None) -> DataFrame:
    """The larger side is the amount; the text, or its first ``shown`` characters, the name."""
    amount = F.greatest("nilai_masuk", "nilai_keluar")
    name = F.col("keterangan") if shown is None else F.substring("keterangan", 1, shown)
    raw = ["nilai_masuk", "nilai_keluar", "saldo"]
    return bank.select(
        *_candidate(F.lit("rekening_koran"), F.col("tanggal"), amount, name, F.col("keterangan"), raw)
    )


def slip_candidates(slips: DataFrame, kind: str = "pph23") -> DataFrame:
    raw = ["npwp_nik", "jumlah_bruto", "pph_dipotong"]
    return slips.select(
        *_candidate(F.lit(kind), F.col("masa_pajak"), F.col("pph_dipotong"), F.col("nama_penerima"), F.col("nomor"), raw)
    )


def tagged_union(*candidates: DataFrame) -> DataFrame:
    out = candidates[0]
    for more in candidates[1:]:
        out = out.unionByName(more)
    return out
