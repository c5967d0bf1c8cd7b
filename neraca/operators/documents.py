"""Extracted documents: alias lookup, flattening, items, text fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neraca.functions import dates
from neraca.functions.money import bound
from neraca.operators.ordered import running_sum


def statement_year(docs: DataFrame, keys: Sequence[str], fallback: str, period: str = "periode") -> DataFrame:
    """Most common year of the periods per key, the smallest on ties."""
    year = dates.period_year(F.col(period))
    counts = docs.select(*keys, year.alias("_year")).filter(F.col("_year").isNotNull()).groupBy(*keys, "_year").count()
    best = F.max_by("_year", F.struct("count", -F.col("_year").cast("int")))
    found = counts.groupBy(*keys).agg(best.alias("tahun"))
    return docs.select(*keys).distinct().join(found, list(keys), "left").withColumn(
        "tahun", F.coalesce("tahun", F.lit(fallback))
    )


# --- pages and tables -------------------------------------------------------------------------------


def explode_tables(docs: DataFrame, keys: Sequence[str], pages: str = "pages") -> DataFrame:
    """Rows of all tables of nested OCR results: ``page`` from 1, ``table_idx`` and
    ``row_idx`` from 0, and the cell texts."""
    by_page = docs.select(*keys, F.posexplode(pages).alias("_p", "_page"))
    by_table = by_page.select(*keys, (F.col("_p") + 1).alias("page"), F.posexplode("_page.tables").alias("table_idx", "_table"))
    by_row = by_table.select(*keys, "page", "table_idx", F.posexplode("_table.rows").alias("row_idx", "_row"))
    return by_row.select(*keys, "page", "table_idx", "row_idx", F.col("_row.cells.text").alias("cells"))


def absolute_pages(rows: DataFrame, sizes: DataFrame, keys: Sequence[str], chunk: str = "chunk") -> DataFrame:
    """``page_number`` in the whole document: pages of the chunks before are added.

    ``sizes`` has one row per chunk with its number of ``pages``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, chunk, F.coalesce(F.sum("pages").over(w), F.lit(0)).alias("_before"))
    return rows.join(offsets, [*keys, chunk]).withColumn("page_number", F.col("page") + F.col("_before")).drop("_before")


def page_counts(pages: DataFrame, rows: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Every page with its number of transactions, 0 included."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (
        pages.join(counts, list(keys), "left")
        .withColumn("transaction_count", F.coalesce("_n", F.lit(0)))
        .withColumn("has_data", F.col("transaction_count") > 0)
        .drop("_n")
    )


# --- extracted JSON -------------------------------------------------------------------------------------

_PARTY = "name:string, nama:string, npwp:string, nik:string, address:string, alamat:string, email:string, nitku:string, subunit:string, penandatangan:string, signatory:string"

# Sections and keys of the extracted documents, with their other spellings.
TAX_INVOICE = f"""
    seller struct<{_PARTY}>, buyer struct<{_PARTY}>,
    invoice struct<number:string, issue_date:string, reference:string>,
    financials map<string,string>,
    items array<struct<description:string, quantity:string, unit_price:string, total_price:string>>
"""
SLIP = f"""
    dokumen struct<nomor:string, number:string, masa_pajak:string, tax_period:string, tanggal:string, date:string,
        sifat_pemotongan:string, nature:string, status:string>,
    penerima struct<{_PARTY}>, pemotong struct<{_PARTY}>,
    objek_pajak struct<jenis_pph:string, jenis:string, kode:string, code:string, objek:string, description:string>,
    financials map<string,string>,
    dokumen_dasar struct<jenis:string, type:string, tanggal:string, date:string, nomor:string, number:string, nomor_sp2d:string>
"""
COMMERCIAL = """
    invoice_info struct<invoice_number:string, nomor:string, tgl_invoice:string, tanggal_invoice:string, tanggal:string>,
    purchase_order struct<po_number:string, po:string, tgl_po:string, tanggal_po:string>,
    summary struct<total:string, nilai:string, grand_total:string>,
    additional struct<keterangan:string, remarks:string>
"""
STATEMENT = """
    bank_info struct<nama_bank:string, bank_name:string, bank:string, nomor_rekening:string, account_number:string, no_rekening:string,
        nama_pemilik:string, account_holder:string, nama:string, periode:string, period:string, statement_period:string>,
    saldo_info struct<saldo_awal:string, opening_balance:string, saldo_akhir:string, closing_balance:string, ending_balance:string>,
    transactions array<struct<tanggal:string, date:string, transaction_date:string, keterangan:string, description:string, uraian:string,
        kredit:string, credit:string, debet:string, debit:string, mutasi:string, saldo:string, balance:string, referensi:string, ref:string>>
"""


def read_json(df: DataFrame, column: str, schema: str, name: str = "doc") -> DataFrame:
    """Parsed document in ``name``; what is no JSON object becomes an empty one and is
    flagged ``is_invalid``."""
    text = F.coalesce(F.col(column), F.lit(""))
    looks_right = F.ltrim(text).startswith("{")
    parsed = F.from_json(
        F.when(looks_right, text).otherwise("{}"),
        f"struct<{_as_struct(schema)}, _broken:string>",
        {"columnNameOfCorruptRecord": "_broken"},
    )
    return df.withColumn(name, parsed).withColumn("is_invalid", ~looks_right | F.col(f"{name}._broken").isNotNull())


def _as_struct(schema: str) -> str:
    """Top-level ``name type`` pairs as ``name:type``."""
    import re

    return re.sub(r"(\w+) (struct|array|map)<", r"\1:\2<", " ".join(schema.split()))


def first_filled(*columns: Column, default: str | None = None) -> Column:
    """First value that is neither null nor empty."""
    filled = [F.nullif(c, F.lit("")) for c in columns]
    return F.coalesce(*filled) if default is None else F.coalesce(*filled, F.lit(default))


def lookup(keys: Column, names: Sequence[str]) -> Column:
    """Value of the first of ``names`` in a map, ignoring the case of its keys; ``N/A``
    when missing or blank."""
    entries = F.transform(F.map_entries(keys), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def hit(name: str) -> Column:
        return F.get(F.filter(entries, lambda e: e["key"] == name.lower()), 0)["value"]

    return first_filled(*[hit(n) for n in names], default="N/A")


def flatten_tax_invoice(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Header fields of a VAT invoice next to its items."""
    d = F.col(doc)
    money = d["financials"]

    def amount(*names: str) -> Column:
        return F.nullif(lookup(money, names), F.lit("N/A"))

    return df.select(
        *[c for c in df.columns if c != doc],
        d["seller"]["name"].alias("nama_seller"),
        d["seller"]["address"].alias("alamat_seller"),
        d["seller"]["npwp"].alias("npwp_seller"),
        d["buyer"]["name"].alias("nama_buyer"),
        d["buyer"]["address"].alias("alamat_buyer"),
        d["buyer"]["npwp"].alias("npwp_buyer"),
        d["buyer"]["email"].alias("email_buyer"),
        d["invoice"]["number"].alias("nomor_faktur"),
        d["invoice"]["issue_date"].alias("tanggal"),
        d["invoice"]["reference"].alias("invoice"),
        *[amount(n).alias(n) for n in ("harga_jual", "uang_muka", "dpp", "ppn", "total")],
        F.array_join(F.filter(d["items"]["description"], lambda x: F.coalesce(x, F.lit("")) != ""), ", ").alias("nama_barang_jasa"),
        d["items"].alias("items"),
    )


def flatten_slip(df: DataFrame, doc: str = "doc", default_article: str = "Pasal 23") -> DataFrame:
    """The 22 columns of a withholding slip."""
    from neraca.functions.text import article

    d = F.col(doc)
    na = "N/A"
    kind = first_filled(d["objek_pajak"]["jenis_pph"], d["objek_pajak"]["jenis"])
    spelled = article(kind) if default_article == "Pasal 23" else F.coalesce(kind, F.lit(default_article))
    dpp = lookup(d["financials"], ["dpp", "bruto", "gross_amount"])
    digits = F.regexp_replace(dpp, r"[^0-9.]", "")
    r, p, doc_, base = d["penerima"], d["pemotong"], d["dokumen"], d["dokumen_dasar"]
    return df.select(
        *[c for c in df.columns if c != doc],
        first_filled(doc_["nomor"], doc_["number"], default=na).alias("nomor"),
        first_filled(doc_["masa_pajak"], doc_["tax_period"], default=na).alias("masa_pajak"),
        first_filled(doc_["sifat_pemotongan"], doc_["nature"], default=na).alias("sifat_pemotongan"),
        first_filled(doc_["status"], default=na).alias("status"),
        first_filled(r["npwp"], r["nik"], default=na).alias("penerima_npwp"),
        first_filled(r["nama"], r["name"], default=na).alias("penerima_nama"),
        first_filled(r["nitku"], default=na).alias("penerima_nitku"),
        spelled.alias("jenis_pph"),
        first_filled(d["objek_pajak"]["kode"], d["objek_pajak"]["code"], default=na).alias("kode_objek"),
        first_filled(d["objek_pajak"]["objek"], d["objek_pajak"]["description"], default=na).alias("objek_pajak"),
        F.when(digits != "", digits).otherwise(dpp).alias("dpp"),
        lookup(d["financials"], ["tarif", "rate", "tax_rate"]).alias("tarif"),
        lookup(d["financials"], ["pph", "tax_amount", "withheld"]).alias("pph"),
        first_filled(base["jenis"], base["type"], default=na).alias("dokumen_dasar_jenis"),
        first_filled(base["tanggal"], base["date"], default=na).alias("dokumen_dasar_tanggal"),
        first_filled(base["nomor"], base["number"], default=na).alias("dokumen_dasar_nomor"),
        first_filled(base["nomor_sp2d"], default=na).alias("dokumen_dasar_nomor_sp2d"),
        first_filled(p["npwp"], p["nik"], default=na).alias("pemotong_npwp"),
        first_filled(p["nitku"], p["subunit"], default=na).alias("pemotong_nitku"),
        first_filled(p["nama"], p["name"], default=na).alias("pemotong_nama"),
        first_filled(doc_["tanggal"], doc_["date"], default=na).alias("tanggal_potong"),
        first_filled(p["penandatangan"], p["signatory"], default=na).alias("penandatangan"),
    )


def flatten_commercial(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Order, invoice and total fields of a commercial invoice."""
    d = F.col(doc)
    info, order, total = d["invoice_info"], d["purchase_order"], d["summary"]
    issued = first_filled(info["tgl_invoice"], info["tanggal_invoice"], info["tanggal"], default="N/A")
    return df.select(
        *[c for c in df.columns if c != doc],
        first_filled(order["po_number"], order["po"], default="N/A").alias("po"),
        first_filled(order["tgl_po"], order["tanggal_po"], default="N/A").alias("tgl_po"),
        issued.alias("tgl_invoice"),
        first_filled(d["additional"]["keterangan"], d["additional"]["remarks"], default="").alias("keterangan"),
        first_filled(total["total"], total["nilai"], total["grand_total"], default="N/A").alias("nilai"),
        F.coalesce(F.nullif(info["tanggal"], F.lit("")), issued).alias("tanggal"),
    )


def statement_transactions(df: DataFrame, keys: Sequence[str], doc: str = "doc") -> DataFrame:
    """Rows of all statements under one set of names; a statement without rows is one row.

    A signed ``mutasi`` fills credit or debit where both are blank.
    """
    d = F.col(doc)
    bank = d["bank_info"]
    rows = df.select(
        *keys,
        first_filled(bank["nama_bank"], bank["bank_name"], bank["bank"], default="N/A").alias("nama_bank"),
        first_filled(bank["nomor_rekening"], bank["account_number"], bank["no_rekening"], default="N/A").alias("nomor_rekening"),
        first_filled(bank["periode"], bank["period"], bank["statement_period"], default="N/A").alias("periode"),
        F.posexplode_outer(d["transactions"]).alias("row_no", "t"),
    )
    t = F.col("t")
    move = F.regexp_replace(F.coalesce(t["mutasi"], F.lit("")), r"Rp|IDR|[.,\s]", "")
    credit, debit = first_filled(t["kredit"], t["credit"], default=""), first_filled(t["debet"], t["debit"], default="")
    signed = (move != "") & (credit == "") & (debit == "")
    out = signed & move.startswith("-")
    return rows.select(
        *keys,
        "nama_bank",
        "nomor_rekening",
        "periode",
        F.coalesce("row_no", F.lit(0)).alias("row_no"),
        first_filled(t["tanggal"], t["date"], t["transaction_date"], default="N/A").alias("tanggal"),
        first_filled(t["keterangan"], t["description"], t["uraian"], default="N/A").alias("keterangan"),
        F.when(signed & ~out, F.replace(move, F.lit("+"), F.lit(""))).otherwise(credit).alias("kredit"),
        F.when(out, F.replace(move, F.lit("-"), F.lit(""))).otherwise(debit).alias("debet"),
        first_filled(t["saldo"], t["balance"], default="").alias("saldo"),
        first_filled(t["referensi"], t["ref"], default="").alias("referensi"),
    )


def preferred_layer(layers: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first layer that holds anything; the last one otherwise."""
    out = None
    for name, filled in layers[:-1]:
        out = F.when(filled, name) if out is None else out.when(filled, name)
    return out.otherwise(layers[-1][0])


def is_meaningful(sections: Column) -> Column:
    """Any value of any section is filled (``map<string, map<string,string>>``)."""
    return F.exists(
        F.map_values(sections), lambda s: F.exists(F.map_values(s), lambda v: F.coalesce(v, F.lit("")) != "")
    )


def patch(old: Column, new: Column) -> Column:
    """Shallow update of a map: keys of ``new`` win."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def flatten_fields(df: DataFrame, keys: Sequence[str], doc: str = "doc") -> DataFrame:
    """``(path, value)`` rows of a nested document; lists and maps show as ``n items``.

    The paths come from the schema, so this is one projection and one explode.
    """
    from pyspark.sql import types as T

    def leaves(kind: T.DataType, column: Column, path: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(f.dataType, column[f.name], f"{path}.{f.name}" if path else f.name)]
        if isinstance(kind, (T.ArrayType, T.MapType)):
            value = F.when(column.isNotNull(), F.concat(F.size(column).cast("string"), F.lit(" items")))
        else:
            value = column.cast("string")
        return [F.struct(F.lit(path).alias("path"), value.alias("value"))]

    pairs = F.array(*leaves(df.schema[doc].dataType, F.col(doc), ""))
    filled = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["path"] != "_broken"))
    return df.select(*keys, F.inline(filled))


# --- items -------------------------------------------------------------------------------------------------


def item_totals(items: Column) -> dict[str, Column]:
    """Subtotals (quantity x price, truncated), grand total and summed quantity of a list; a null
    list has none and sums to 0."""
    from neraca.functions.money import parse_price, parse_quantity

    def read(i: Column) -> Column:
        return F.struct(F.coalesce(parse_quantity(i["quantity"]), F.lit(0)).cast("decimal(28,2)").alias("q"), parse_price(i["unit_price"]).alias("p"))

    def counted(x: Column) -> Column:
        floor = lambda product: F.when(product > 0, F.floor(product).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(x["q"].alias("quantity"), bound(x["q"] * x["p"], floor).alias("amount"))

    def parsed(i: Column) -> Column:
        return bound(read(i), counted)

    # Each item is parsed once; the totals fold over what came out.
    start = F.struct(F.array().cast("array<bigint>").alias("subtotals"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("decimal(28,2)").alias("quantity"))
    added = lambda a, x: F.struct(
        F.concat(a["subtotals"], F.array(x["amount"])).alias("subtotals"),
        (a["total"] + x["amount"]).alias("total"),
        (a["quantity"] + x["quantity"]).cast("decimal(28,2)").alias("quantity"),
    )
    none = F.array().cast("array<struct<quantity:decimal(28,2),amount:bigint>>")
    folded = F.aggregate(F.coalesce(F.transform(items, parsed), none), start, added)
    return {"subtotals": folded["subtotals"], "grand_total": folded["total"], "quantity": folded["quantity"]}


def item_lists(items: Column) -> dict[str, Column]:
    """Descriptions, quantities and unit prices, one line per item."""
    from neraca.functions.money import format_rupiah, parse_price, quantity_label

    def lines(of, empty: str) -> Column:
        joined = F.array_join(F.transform(items, of), "\n")
        return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, empty).otherwise(joined)

    return {
        "descriptions": lines(lambda i: F.coalesce(i["description"], F.lit("N/A")), "N/A"),
        "quantities": lines(lambda i: quantity_label(i["quantity"]), "-"),
        "unit_prices": lines(lambda i: format_rupiah(parse_price(i["unit_price"])), "-"),
    }


def item_rows(df: DataFrame, items: str = "items") -> DataFrame:
    """One row per line item, header fields repeated; a document without items keeps one row."""
    header = [c for c in df.columns if c != items]
    # Where extraction found nothing the sheet shows a placeholder.
    rows = df.select(*header, F.posexplode_outer(items).alias("item_no", "_item"))
    return rows.select(
        *header,
        F.coalesce("item_no", F.lit(0)).alias("item_no"),
        F.coalesce(F.col("_item.description"), F.lit("N/A")).alias("description"),
        F.coalesce(F.col("_item.quantity"), F.lit("-")).alias("quantity"),
        F.coalesce(F.col("_item.unit_price"), F.lit("-")).alias("unit_price"),
    )


# --- fields in free text -------------------------------------------------------------------------------------

# Keywords of labelled fields, and patterns tried in order.
FIELD_WORDS = {
    "nama": ["nama penjual", "pengusaha kena pajak", "nama wajib pajak", "nama"],
    "alamat": ["alamat penjual", "alamat wajib pajak", "alamat"],
    "npwp": ["npwp", "nomor pokok wajib pajak"],
    "nomor_faktur": ["nomor faktur", "kode dan nomor seri faktur pajak", "nomor seri"],
    "tanggal": ["tanggal faktur", "tanggal"],
    "dpp": ["dpp", "dasar pengenaan pajak", "harga jual"],
    "ppn": ["ppn", "pajak pertambahan nilai"],
    "total": ["total", "jumlah", "grand total", "nilai total"],
    "invoice": ["invoice", "no invoice", "referensi"],
    "nama_barang_jasa": ["nama barang kena pajak", "nama barang", "nama jasa", "deskripsi"],
}
AMOUNT_FIELDS = ["dpp", "ppn", "total"]
FIELD_PATTERNS = {
    "nomor": [r"(?i)(?:Nomor\s*:?\s*)([A-Z0-9./-]+)", r"(?i)(?:No\.?\s*Bukti\s*:?\s*)([A-Z0-9./-]+)", r"(\d{1,3}[./]\w+[./]\w+[./]\d{2,4})"],
    "masa_pajak": [r"(?i)(?:Masa\s+Pajak\s*:?\s*)([A-Za-z0-9\s/-]+)", r"(?i)(?:Periode\s*:?\s*)([A-Za-z0-9\s/-]+)", r"(\d{2}\s*-\s*\d{4})"],
    "npwp_nik": [r"(?i)(?:NPWP\s*:?\s*)(\d{2}\.?\d{3}\.?\d{3}\.?\d-\d{3}\.\d{3})", r"(?i)(?:NIK\s*:?\s*)(\d{16})"],
    "po": [r"(?i)(?:PO\s*(?:Number|No)?\s*:?\s*)([A-Z0-9/-]+)", r"(?i)(?:Purchase\s+Order\s*:?\s*)([A-Z0-9/-]+)", r"(?i)(?:P\.O\.\s*:?\s*)([A-Z0-9/-]+)"],
    "nilai": [
        r"(?i)(?:Total\s*(?:Amount)?\s*:?\s*)(?:Rp\.?\s*)?(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)",
        r"(?i)(?:Grand\s+Total\s*:?\s*)(?:Rp\.?\s*)?(\d{1,3}(?:[.,]\d{3})*)",
        r"(?i)(?:Amount\s+Due\s*:?\s*)(?:Rp\.?\s*)?(\d{1,3}(?:[.,]\d{3})*)",
    ],
}
MONEY_LINES = [
    (r"(?i)(?:CR|CREDIT|KREDIT|MASUK)\s*(?:Rp\.?\s*)?(\d{1,3}(?:[.,]\d{3})*)", "credit"),
    (r"(?i)(?:\+)\s*(?:Rp\.?\s*)?(\d{1,3}(?:[.,]\d{3})*)", "credit"),
    (r"(?i)(?:DR|DEBIT|KELUAR)\s*(?:Rp\.?\s*)?(\d{1,3}(?:[.,]\d{3})*)", "debit"),
    (r"(?i)(?:\-)\s*(?:Rp\.?\s*)?(\d{1,3}(?:[.,]\d{3})*)", "debit"),
]
ITEM_LINE = r"(\d+)\s+([A-Za-z\s]+?)\s+(?:Rp\.?\s*)?(\d{1,3}(?:[.,]\d{3})*)"
ITEM_BLOCK_END = r"^(harga|dpp|dasar|total|pajak|npwp|alamat|kode|nomor|no\.?|jumlah|invoice)"


def pattern_field(text: Column, name: str) -> Column:
    """First hit of the field's patterns; null when none hits."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in FIELD_PATTERNS[name]])


def labelled_pairs(text: Column) -> Column:
    """``key: value`` lines as an array of structs, keys in lower case."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.contains(":"))
    pairs = F.transform(
        lines,
        lambda s: F.struct(
            F.lower(F.trim(F.substring_index(s, ":", 1))).alias("key"),
            F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def labelled_field(pairs: Column, name: str) -> Column:
    """Value of the first pair whose key holds any of the field's words."""
    from neraca.functions.text import contains_any

    value = F.get(F.filter(pairs, lambda p: contains_any(p["key"], FIELD_WORDS[name])), 0)["value"]
    if name in AMOUNT_FIELDS:
        digits = F.regexp_replace(value, r"[^0-9]", "").try_cast("decimal(38,0)")
        return F.when(digits.isNotNull(), F.concat(F.lit("Rp "), F.format_number(digits, 0)))
    if name == "npwp":
        from neraca.functions.ids import format_npwp

        return format_npwp(value)
    return value


# What is no description in a line of money.
AMOUNT_WORDS = r"(?:Rp\.?\s*)?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?"
SIDE_WORDS = r"(?i)(?:CR|DR|CREDIT|DEBIT|KREDIT|MASUK|KELUAR|\+|\-)"


def text_transactions(docs: DataFrame, keys: Sequence[str], text: str = "text", shown: int | None = None) -> DataFrame:
    """Lines of at least 10 characters with a credit or debit mark and an amount; the words
    are cut after ``shown`` characters, if given."""
    lines = docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    line = F.col("line")
    kind = amount = None
    for pattern, label in MONEY_LINES:
        test, value = line.rlike(pattern), F.regexp_replace(F.regexp_extract(line, pattern, 1), r"[.,]", "")
        kind = F.when(test, label) if kind is None else kind.when(test, label)
        amount = F.when(test, value) if amount is None else amount.when(test, value)
    words = F.regexp_replace(F.regexp_replace(line, AMOUNT_WORDS, ""), SIDE_WORDS, "")
    words = F.trim(F.regexp_replace(words, r"\s+", " "))
    words = words if shown is None else F.substring(words, 1, shown)
    found = lines.filter(F.length("line") >= 10).select(
        *keys, "line_no", kind.alias("kind"), amount.try_cast("decimal(28,0)").alias("amount"), words.alias("description")
    )
    return found.filter(F.col("kind").isNotNull())


def text_totals(transactions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Money in and out: the sum, and never less than the largest amount seen."""
    zero = F.lit(0).cast("decimal(38,0)")

    def total(kind: str) -> Column:
        value = F.when(F.col("kind") == kind, F.col("amount"))
        return F.greatest(F.coalesce(F.sum(value), zero), F.coalesce(F.max(value), zero))

    return transactions.groupBy(*keys).agg(
        total("credit").alias("nilai_uang_masuk"), total("debit").alias("nilai_uang_keluar")
    )


def text_items(docs: DataFrame, keys: Sequence[str], text: str = "text", shown: int | None = None) -> DataFrame:
    """Invoice lines, or the first ``shown``, with quantity, words and amount."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(ITEM_LINE))
    rows = docs.select(*keys, F.posexplode(lines if shown is None else F.slice(lines, 1, shown)).alias("item_no", "line"))
    return rows.select(
        *keys,
        "item_no",
        F.regexp_extract("line", ITEM_LINE, 1).try_cast("long").alias("quantity"),
        F.trim(F.regexp_extract("line", ITEM_LINE, 2)).alias("description"),
        F.regexp_replace(F.regexp_extract("line", ITEM_LINE, 3), r"[.,]", "").try_cast("decimal(28,0)").alias("amount"),
    )


def item_block(text: Column) -> Column:
    """Names of goods after the ``Nama Barang`` label, up to a blank line or the next label
    once something was collected."""
    return bound(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), _item_block)


def _item_block(lines: Column) -> Column:
    start = F.array_position(F.transform(lines, lambda s: F.lower(s).contains("nama barang")), True)

    def step(seen: Column, s: Column) -> Column:
        lower, bare, names = F.lower(s), F.btrim(s, F.lit(" \t\n\x0b\f\r,;")), seen["names"]
        name = ~lower.startswith("rp") & ~s.rlike(r"^\d+$") & (bare != "")
        state = lambda found, done: F.struct(found.alias("names"), done.alias("done"))
        ended = (s == "") | lower.rlike(ITEM_BLOCK_END)
        return F.when(seen["done"], seen).when(ended, state(names, F.size(names) > 0)).when(name, state(F.concat(names, F.array(bare)), F.lit(False))).otherwise(seen)

    # One pass over the lines: what ends the block is looked for once, and nothing behind it.
    none = F.struct(F.array().cast("array<string>").alias("names"), F.lit(False).alias("done"))
    after = lambda n: F.slice(lines, (n + 1).cast("int"), F.size(lines))
    names = bound(start, lambda n: F.when(n > 0, F.aggregate(after(n), none, step)["names"]))
    return bound(names, lambda k: F.when(F.size(k) > 0, F.array_join(F.array_distinct(k), ", ")).otherwise("N/A"))


def coverage(text: Column, expected: Sequence[str], confidence: Column) -> tuple[Column, Column]:
    """Percent of expected words in the text, and its 60/40 mix with the OCR confidence."""
    words = F.array(*[F.lit(w) for w in expected])
    upper = F.upper(text)
    hits = F.size(F.filter(words, lambda w: upper.contains(F.upper(w))))
    share = hits.cast("double") / len(expected) * 100
    return share, share * 0.6 + confidence * 0.4


def merge_texts(chunks: DataFrame, keys: Sequence[str], order: str = "chunk", text: str = "text") -> DataFrame:
    """Texts of the chunks of each document, joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("text"))))
    kept = F.filter(F.transform(parts, lambda p: p["text"]), lambda s: F.coalesce(s, F.lit("")) != "")
    return chunks.groupBy(*keys).agg(F.array_join(kept, "\n").alias("raw_text"))


def merge_text_parts(
    chunks: DataFrame, keys: Sequence[str], order: str = "chunk", text: str = "text", part_bytes: int = 16 << 20, slice_rows: int | None = None
) -> DataFrame:
    """``merge_texts`` for documents of any size: (keys, part, raw_text), in parts of about ``part_bytes``.

    A running sum of bytes says in which part a text begins, so no row holds more than a part and the
    text that ends it.  The parts of a document, joined by line ends in their order, are its whole text.
    """
    filled = chunks.filter(F.coalesce(F.col(text), F.lit("")) != "").withColumn("_bytes", F.octet_length(text).cast("long") + 1)
    summed = running_sum(filled, keys, [order, text], F.col("_bytes"), "_end", slice_rows)
    placed = summed.withColumn("part", F.floor((F.col("_end") - F.col("_bytes")) / part_bytes))
    texts = F.array_sort(F.collect_list(F.struct(F.col("_end").alias("at"), F.col(order), F.col(text).alias("text"))))
    return placed.groupBy(*keys, "part").agg(F.array_join(F.transform(texts, lambda p: p["text"]), "\n").alias("raw_text"))


# --- two extractors, corrections -----------------------------------------------------------------------------


def merge_extractors(first: DataFrame, second: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Metadata of two extractors: the first one's fields, blanks filled by the second.

    Either may lack a document.  ``rows`` counts its transactions; the first extractor's
    rows are used when it has any.  Confidence is .50 for the first plus .30 for the
    second, 0 when neither has rows.
    """
    keys = list(keys)

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"_{tag}"), F.col("rows").alias(f"_{tag}_rows"), *[F.col(f).alias(f"_{tag}_{f}") for f in fields])

    both = side(first, "a").join(side(second, "b"), keys, "full")
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    a_rows, b_rows = F.coalesce("_a_rows", F.lit(0)), F.coalesce("_b_rows", F.lit(0))
    weight = F.when(a, 0.5).otherwise(0.0) + F.when(b, 0.3).otherwise(0.0)
    return both.select(
        *keys,
        *[first_filled(F.col(f"_a_{f}"), F.col(f"_b_{f}")).alias(f) for f in fields],
        F.when(a_rows > 0, "first").when(b_rows > 0, "second").alias("rows_from"),
        F.when((a_rows > 0) | (b_rows > 0), F.least(F.lit(1.0), weight)).otherwise(0.0).alias("confidence"),
    )


def apply_corrections(rows: DataFrame, fixes: DataFrame, additions: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows with field fixes ``(keys, field, corrected)`` laid over them, and rows added."""
    latest = fixes.groupBy(*keys).pivot("field", list(fields)).agg(F.max("corrected"))
    fixed = rows.join(latest.select(*keys, *[F.col(f).alias(f"_fix_{f}") for f in fields]), list(keys), "left")
    kept = fixed.select(
        *[F.coalesce(F.col(f"_fix_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns]
    )
    return kept.unionByName(additions, allowMissingColumns=True)
