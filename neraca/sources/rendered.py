"""Texts as they stand in documents, rendered from the given tables.

Each view writes the numbers, dates and names of whole tables in the styles the
parsers must read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neraca.functions.dates import MONTH_NAMES
from neraca.sources.views import Views

MONEY = "decimal(18,2)"


def us_amount(value: Column, places: int = 2) -> Column:
    return F.format_number(value, places)


def id_amount(value: Column, places: int = 2) -> Column:
    return F.translate(us_amount(value, places), ",.", ".,")


def pick(options: list[Column], number: Column) -> Column:
    """One of several renderings by number."""
    out = F.when(number == 0, options[0])
    for i, option in enumerate(options[1:], start=1):
        out = out.when(number == i, option)
    return out


def amounts(v: Views) -> DataFrame:
    """Line prices in twelve written styles."""
    lines = v.spread("lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("decimal(10,1)").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
    )
    price, plain = F.col("price"), F.col("price").cast("string")
    whole = F.floor(price)
    styles = [
        F.concat(F.lit("Rp "), id_amount(price)),
        us_amount(price),
        plain,
        F.concat(F.lit("("), id_amount(price), F.lit(")")),
        id_amount(whole, 0),
        us_amount(whole, 0),
        F.concat(F.lit("-"), us_amount(price)),
        F.lit(""),
        F.lit("-"),
        F.lit("N/A"),
        F.concat(F.lit("IDR "), us_amount(price)),
        F.replace(F.col("quantity").cast("string"), F.lit("."), F.lit(",")),
    ]
    return lines.select("id", "line", "price", pick(styles, (F.col("id") * 7 + F.col("line")) % 12).alias("txt"))


def dates(v: Views) -> DataFrame:
    """Order dates in sixteen written styles."""
    orders = v.spread("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    d = F.col("day")

    def fmt(pattern: str) -> Column:
        return F.date_format(d, pattern)

    name = F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(d) - 1)
    styles = [
        fmt("dd/MM/yyyy"),
        fmt("dd-MM-yyyy"),
        fmt("yyyy-MM-dd"),
        fmt("dd.MM.yyyy"),
        fmt("d/M/yyyy"),
        F.concat_ws(" ", fmt("dd"), F.upper(F.substring(name, 1, 3))),
        F.concat_ws(" ", fmt("d"), name, fmt("yyyy")),
        fmt("dd/MM/yy"),
        fmt("dd/MM"),
        F.concat(fmt("yyyy-MM-dd"), F.lit(" 08:15:30")),
        F.concat(fmt("yyyy-MM-dd"), F.lit("T08:15")),
        F.concat(F.upper(F.date_format(d, "MMMM")), fmt(" d, yyyy")),
        F.lit("tidak ada"),
        F.lit(""),
        F.concat(F.lit("Tgl "), fmt("dd/MM/yyyy"), F.lit(" s/d")),
        F.concat(fmt("MM/dd/yy"), F.lit(" 09:30")),
    ]
    return orders.select("id", "day", pick(styles, F.col("id") % 16).alias("txt"))


def descriptions(v: Views) -> DataFrame:
    """Bank descriptions with prefixes, reference codes and amounts in front."""
    o = v.spread("orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    price = F.col("o_totalprice").cast(MONEY)
    prefix = pick(
        [F.lit(p) for p in ("TRSF E-BANKING CR", "TRSF E-BANKING DB", "BI-FAST DB", "bi-fast cr", "BYR VIA E-BANKING", "KR OTOMATIS", "")],
        key % 7,
    )
    code = pick(
        [
            F.concat(F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("/FTSCY/WS"), F.lpad(cust.cast("string"), 5, "0")),
            F.concat(F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("/ADSCY/0000100")),
            F.lit(""),
        ],
        key % 3,
    )
    amount = pick([price.cast("string"), us_amount(price), F.lit("")], F.floor(key / 3) % 3)
    words = pick(
        [F.lit(w) for w in ("TRUCKING UNICER S1232", "SETORAN TUNAI", "BIAYA ADM", "Pembayaran PAJAK", "GAJI karyawan", "tarik tunai ATM", "BUNGA", "")],
        key % 8,
    )
    return o.select(
        key.alias("id"),
        F.trim(F.concat_ws(" ", prefix, code, amount, words)).alias("txt"),
        F.when(key % 2 == 0, price).otherwise(F.lit(0).cast(MONEY)).alias("debet"),
        F.when(key % 2 == 0, F.lit(0).cast(MONEY)).otherwise(price).alias("kredit"),
    )


def papers(v: Views) -> DataFrame:
    """One printed document per invoice: labelled fields, a party and an item line."""
    d = F.col("tanggal")
    name = F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(d) - 1)
    seller = F.col("npwp_penjual")
    dotted = F.regexp_replace(seller, r"^(\d{2})(\d{3})(\d{3})(\d)(\d{3})(\d{3})$", "$1.$2.$3.$4-$5.$6")
    row = F.col("row_idx")
    serial = F.concat(F.lit("010.000-"), F.date_format(d, "yy"), F.lit("."), F.lpad(row.cast("string"), 8, "0"))
    bank = pick([F.lit(b) for b in ("BANK CENTRAL ASIA", "PT BANK MANDIRI", "BANK BNI", "CIMB NIAGA", "kas")], row % 5)
    lines = [
        F.concat(F.lit("Nama Penjual: PT MITRA "), F.substring(seller, 12, 4)),
        F.concat(F.lit("Alamat: Jl. Merdeka No. "), (row % 90).cast("string")),
        F.concat(F.lit("NPWP : "), F.when(row % 3 == 0, seller).otherwise(dotted)),
        F.concat(F.lit("Nomor Faktur: "), serial),
        F.concat(F.lit("Tanggal Faktur: "), F.date_format(d, "d"), F.lit(" "), name, F.date_format(d, " yyyy")),
        F.lit("Nama Barang Kena Pajak"),
        F.concat(F.lit("Busbar Proteksi "), (row % 7).cast("string"), F.lit(" KV,")),
        F.lit("Panel Listrik;"),
        F.concat(F.lit("Harga Jual: Rp "), id_amount(F.col("dpp"))),
        F.concat((row % 9 + 1).cast("string"), F.lit(" Jasa Instalasi Rp "), id_amount(F.floor("dpp"), 0)),
        F.concat(F.lit("PPN: Rp "), id_amount(F.col("ppn"))),
        F.concat(F.lit("Total: Rp "), id_amount(F.col("total"))),
        F.concat(F.lit("SETORAN CR Rp "), id_amount(F.floor("dpp"), 0)),
        F.concat(F.lit("BIAYA KELUAR "), us_amount(F.floor("ppn"), 0)),
        F.concat(F.lit("PO Number: PO-"), row.cast("string"), F.lit("/"), F.date_format(d, "yyyy")),
        F.concat(F.lit("Rekening "), bank, F.lit(" NO REK: "), F.lpad(row.cast("string"), 12, "7")),
        F.concat(F.lit("Saldo: "), id_amount(F.col("total"))),
        F.concat(F.lit("Periode: "), name, F.date_format(d, " yyyy")),
    ]
    return v.spread_invoice.select("row_idx", F.concat_ws("\n", *lines).alias("txt"))


# --- statement tables ---------------------------------------------------------------------------

STATEMENT_ROWS = 40
PAGE_ROWS = 10


def statement_source(v: Views) -> DataFrame:
    """Bank rows dealt out to statements of 40 rows, each in one of 21 layouts."""
    row = F.col("row_idx")
    balance = (F.col("debet") + F.col("kredit") + 1000000).cast(MONEY)
    return v.spread_bank.select(
        "row_idx",
        F.floor(row / STATEMENT_ROWS).alias("doc_id"),
        (F.floor(row / STATEMENT_ROWS) % 21).alias("layout"),
        (F.floor((row % STATEMENT_ROWS) / PAGE_ROWS) + 1).alias("page"),
        (row % PAGE_ROWS + 1).alias("row_no"),
        F.col("tanggal").alias("day"),
        F.date_add("tanggal", 1).alias("next_day"),
        "keterangan",
        "debet",
        "kredit",
        balance.alias("saldo"),
        "account_number",
    )


_BANKS = [
    "BCA", "BCA_SYARIAH", "BCA_SYARIAH", "BCA_SYARIAH", "BNI_V1", "BNI_V2", "BNI_V2", "BRI", "BSI_SYARIAH",
    "BSI_SYARIAH", "CIMB_NIAGA", "CIMB_NIAGA", "MANDIRI_V1", "MANDIRI_V2", "MANDIRI_V2", "MUFG", "MUFG", "MUFG",
    "OCBC", "PERMATA", "PERMATA",
]
_HEADERS = {10: ["No", "Post Date", "Eff Date", "Cheque No", "Description", "Debit", "Credit", "Balance", "Transaction Ref No"],
            11: ["Tgl. Txn", "Tgl. Valuta", "Uraian", "Cheque", "Debit", "Kredit", "Saldo"]}


def statement_cells(v: Views) -> DataFrame:
    """``doc_id, bank_code, page, table_idx, row_idx, cells`` with header rows, a blank
    row, a short row and an over-wide row among them."""
    s = statement_source(v)
    debit, credit, row = F.col("debet"), F.col("kredit"), F.col("row_idx")
    is_debit = debit > 0
    amount = F.when(is_debit, debit).otherwise(credit)

    def us(c: Column) -> Column:
        return F.when(c == 0, F.lit("-")).otherwise(us_amount(c))

    def local(c: Column) -> Column:
        return F.when(c == 0, F.lit("")).otherwise(F.concat(F.lit("Rp "), id_amount(c)))

    # Every written form once; the layouts below only put them in order.
    s = s.withColumns(
        {
            "slash": F.date_format("day", "dd/MM/yyyy"),
            "next_slash": F.date_format("next_day", "dd/MM/yyyy"),
            "dash": F.date_format("day", "dd-MM-yyyy"),
            "iso": F.date_format("day", "yyyy-MM-dd"),
            "dots": F.date_format("day", "dd.MM.yyyy"),
            "named": F.date_format("day", "dd MMM yyyy"),
            "stamp": F.concat(F.date_format("day", "MM/dd/yy"), F.lit(" 09:30")),
            "next_stamp": F.concat(F.date_format("next_day", "MM/dd/yy"), F.lit(" 09:30")),
            "short": F.when(row % 2 == 0, F.date_format("day", "dd/MM/yyyy")).otherwise(F.date_format("day", "dd/MM")),
            "us_debit": us(debit),
            "us_credit": us(credit),
            "us_amount": us_amount(amount),
            "us_balance": us_amount(F.col("saldo")),
            "id_debit": local(debit),
            "id_credit": local(credit),
            "id_amount": local(amount),
            "id_balance": local(F.col("saldo")),
            "mark": F.when(is_debit, F.concat(F.lit("("), us_amount(amount), F.lit(")"))).otherwise(F.concat(us_amount(amount), F.lit(" CR"))),
            "dk": F.when(is_debit, F.lit("D")).otherwise(F.lit("K")),
            "dbcr": F.when(is_debit, F.lit("DB")).otherwise(F.lit("CR")),
            "word": F.when(is_debit, F.lit("BIAYA TRX")).otherwise(F.lit("SETOR TUNAI")),
            "key": row.cast("string"),
            "ref_or_blank": F.when(row % 3 == 0, F.lit("")).otherwise(row.cast("string")),
            "cheque": F.when(row % 3 == 0, F.lit("CHQ7")).otherwise(F.lit("")),
        }
    )
    written = [
        "slash keterangan =001 mark us_balance",
        "next_slash slash =10:15 =T01 keterangan =ekstra dk id_amount id_balance key =OK =u7 =u8 =K01",
        "next_slash dash =10:15 =T01 keterangan = dk id_amount id_balance key =K01",
        "iso =T01 keterangan dk id_amount id_balance key =K01 =10:15",
        "dash keterangan us_debit us_credit us_balance",
        "slash next_slash =B1 key keterangan us_amount dbcr us_balance",
        "next_slash keterangan us_amount dbcr us_balance key",
        "dots keterangan =TL9 id_debit id_credit id_balance",
        "key slash =11:00 dk us_amount us_balance keterangan",
        "slash =11:00 dk us_amount us_balance keterangan",
        "key stamp next_stamp =CHQ keterangan us_debit us_credit us_balance ref_or_blank",
        "short next_slash keterangan key us_debit us_credit us_balance",
        "named keterangan key us_debit us_credit us_balance",
        "=PT_MAJU account_number slash word =CAB keterangan us_amount us_balance",
        "slash word keterangan us_amount us_balance",
        "slash next_slash us_debit us_credit us_balance =TRX key =BR5 keterangan",
        "slash next_slash us_debit us_credit us_balance =TRX key keterangan",
        "slash us_debit us_credit us_balance keterangan",
        "slash next_slash keterangan id_debit id_credit id_balance",
        "slash next_slash =TC cheque key =C55 keterangan us_debit us_credit us_balance",
        "next_slash =TC keterangan us_debit us_credit us_balance key",
    ]

    def one(word: str) -> Column:
        return F.lit(word[1:].replace("_", " ")) if word.startswith("=") else F.col(word)

    cells = [[one(w) for w in line.split(" ")] for line in written]
    layout = F.col("layout")
    bank = F.get(F.array(*[F.lit(b) for b in _BANKS]), layout.cast("int"))
    base = s.withColumn("bank_code", bank).withColumn("table_idx", F.lit(0))
    shown = base.withColumn("cells", pick([F.array(*c) for c in cells], layout)).select(
        "doc_id", "bank_code", "page", "table_idx", F.col("row_no").alias("row_idx"), "cells"
    )
    header = F.array(*[F.lit(x) for x in ("Tanggal", "Keterangan", "Debet", "Kredit", "Saldo")])
    header = F.when(layout == 10, F.array(*[F.lit(x) for x in _HEADERS[10]])).when(
        layout == 11, F.array(*[F.lit(x) for x in _HEADERS[11]])
    ).otherwise(header)
    heads = base.filter("row_no = 1").select("doc_id", "bank_code", "page", "table_idx", F.lit(0).cast("long").alias("row_idx"), header.alias("cells"))
    # One stray row per page: blank, too short, or wider than any layout of its bank.
    wide = F.array_repeat(F.lit("x"), 40)
    stray = pick([F.array(F.lit(" "), F.lit("")), F.array(F.lit("short"), F.lit("row")), wide], F.col("doc_id") % 3)
    strays = base.filter("row_no = 5").select(
        "doc_id", "bank_code", "page", "table_idx", (F.lit(90) + F.col("row_no")).alias("row_idx"), stray.alias("cells")
    )
    return shown.unionByName(heads).unionByName(strays)


def statement_texts(v: Views) -> DataFrame:
    """Text of each statement: column titles for even documents, nothing for odd ones."""
    docs = statement_source(v).select("doc_id", "layout").distinct()
    first, second = F.lit("CIMB NIAGA\nPOST DATE EFF DATE\n"), F.lit("CIMB NIAGA\nTGL. TXN TGL. VALUTA\n")
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 1, "").when(F.col("layout") == 10, first).when(F.col("layout") == 11, second).otherwise("REKENING").alias("text"),
    )


def bca_texts(v: Views) -> DataFrame:
    """Statements as plain text, one document per 40 rows."""
    s = statement_source(v)
    is_debit = F.col("debet") > 0
    amount = F.when(is_debit, F.concat(F.lit("-"), us_amount(F.col("debet")))).otherwise(us_amount(F.col("kredit")))
    line = F.concat_ws(" ", F.date_format("day", "dd/MM/yyyy"), F.concat(F.lit("PEMBAYARAN INV-"), F.col("row_idx").cast("string")), F.lit("001"), amount, us_amount(F.col("saldo")))
    return _as_text(s, line)


def bank_texts(v: Views, bank: str, flagged: bool) -> DataFrame:
    """Statements of one bank as plain text, with a code and a D/C flag or in columns."""
    s = statement_source(v)
    words = F.concat(F.lit("PEMBAYARAN INV-"), F.col("row_idx").cast("string"))
    is_debit = F.col("debet") > 0
    day = F.date_format("day", "dd/MM/yyyy")
    if flagged:
        amount = F.when(is_debit, F.col("debet")).otherwise(F.col("kredit"))
        line = F.concat_ws(" ", day, F.lit("TRF"), words, F.when(is_debit, "D").otherwise("C"), us_amount(amount), us_amount(F.col("saldo")))
    else:
        line = F.concat_ws(" ", day, words, us_amount(F.col("debet")), us_amount(F.col("kredit")), us_amount(F.col("saldo")))
    return _as_text(s, line).withColumn("bank_code", F.lit(bank))


def cimb_texts(v: Views) -> DataFrame:
    """Even documents in the first text layout, odd ones in the second."""
    s = statement_source(v)
    first = F.concat_ws(" ", F.date_format("day", "MM/dd/yy"), F.lit("09:30 Transfer Masuk"), us_amount(F.col("debet") + 1), us_amount(F.col("kredit") + 1), us_amount(F.col("saldo")))
    second = F.concat_ws(" ", F.date_format("day", "dd/MM"), F.lit("Transfer Keluar"), us_amount(F.col("debet") + 1), us_amount(F.col("kredit") + 1), us_amount(F.col("saldo")))
    return _as_text(s, F.when(F.col("doc_id") % 2 == 0, first).otherwise(second))


def _as_text(rows: DataFrame, line: Column) -> DataFrame:
    """Documents of at most 40 lines, so each list is short."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("row_idx"), line.alias("line"))))
    return rows.groupBy("doc_id").agg(
        F.concat(F.lit("MUTASI REKENING\n"), F.array_join(F.transform(lines, lambda s: s["line"]), "\n")).alias("text")
    )
