"""Descriptions, names, text quality and classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from neraca.functions.money import bound, misread_amount


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_case(c: Column) -> Column:
    """Words capitalised; short words upper; words with digits upper up to 4 letters."""

    def cap(w: Column) -> Column:
        return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))

    def word(w: Column) -> Column:
        limit = F.when(w.rlike(r"\d"), 4).otherwise(3)
        return F.when(F.length(w) <= limit, F.upper(w)).otherwise(cap(w))

    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, word), " ")


# What the description cleaner removes, in order.
DESCRIPTION_PREFIXES = [
    "TRSF E-BANKING CR", "TRSF E-BANKING DB", "BI-FAST DB", "BI-FAST CR", "BYR VIA E-BANKING", "KR OTOMATIS",
]
REFERENCE_CODES = [
    r"\b\d{4}/[A-Z]{5,6}/[A-Z0-9]{5,8}\b\s*",
    r"\b\d{4}/[A-Z]{5,6}/\d+\b\s*",
    r"\b\d{4}/[A-Z]+/[A-Z0-9]+\b\s*",
]
LOOSE_AMOUNTS = [r"\b\d{4,}\.?\d{0,2}\b\s*", r"\b\d{1,3}(?:,\d{3})+(?:\.\d{2})?\b\s*"]


def clean_description(c: Column) -> Column:
    """Bank prefixes, reference codes and amounts removed; the original if nothing is left."""
    out = c
    for prefix in DESCRIPTION_PREFIXES:
        out = F.regexp_replace(out, rf"(?i)^{prefix}\s*", "")
    for code in REFERENCE_CODES:
        out = F.regexp_replace(out, f"(?i){code}", "")
    for amount in LOOSE_AMOUNTS:
        out = F.regexp_replace(out, amount, "")
    out = squeeze(out)
    return F.when(out == "", c).otherwise(out)


def clean_cell(c: Column) -> Column:
    """Spaces squeezed; letters, digits and basic punctuation kept."""
    return F.trim(F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s\-./,]", ""))


# --- classification ---------------------------------------------------------------------------

# Words of the classifiers, first rule wins.
MONEY_SOURCES = [
    (["TRANSFER", "TRSF", "TRF"], "Transfer Masuk"),
    (["SETORAN", "SETOR", "DEPOSIT"], "Setoran"),
    (["BUNGA", "INTEREST"], "Bunga Bank"),
    (["GAJI", "SALARY"], "Gaji"),
    (["KLIRING", "CLEARING"], "Kliring"),
]
MONEY_PURPOSES = [
    (["ATM", "WITHDRAWAL", "TARIK TUNAI"], "Penarikan ATM"),
    (["TRANSFER", "TRSF", "TRF"], "Transfer Keluar"),
    (["BIAYA ADM", "ADM", "ADMIN"], "Biaya Admin"),
    (["PAJAK", "TAX"], "Pajak"),
    (["PULSA", "LISTRIK", "PDAM", "BPJS"], "Pembayaran Tagihan"),
]
FILENAME_TYPES = [
    (["faktur", "pajak"], "faktur_pajak"),
    (["pph21", "pph_21"], "pph21"),
    (["pph23", "pph_23"], "pph23"),
    (["rekening", "koran"], "rekening_koran"),
    (["invoice", "tagihan"], "invoice"),
]
SERVICE_WORDS = ["jasa", "service", "konsultasi", "training", "pelatihan", "sewa", "rent"]
ARTICLE_WORDS = [
    (["pasal 4", "ps 4", "4 ayat 2", "ps.4"], "Pasal 4 ayat 2"),
    (["pasal 23", "ps 23", "ps.23", "pph 23", "pph23"], "Pasal 23"),
    (["pph 4", "pph4"], "Pasal 4 ayat 2"),
]
QUALITY_WORDS = {
    "faktur_pajak": ["faktur", "pajak", "npwp", "ppn", "dpp"],
    "pph21": ["pph", "bukti", "potong", "npwp", "masa"],
    "pph23": ["pph", "bukti", "potong", "npwp", "masa"],
    "rekening_koran": ["saldo", "debit", "kredit", "transaksi", "tanggal"],
    "invoice": ["invoice", "total", "amount", "date", "vendor"],
}
LENGTH_TIERS = [(1500, 0.9), (1000, 0.8), (500, 0.7), (200, 0.6), (100, 0.4)]
LINE_TIERS = [(20, 0.9), (10, 0.8), (5, 0.7), (2, 0.5)]


def first_rule(c: Column, rules: list[tuple[list[str], str]], default: Column) -> Column:
    out = None
    for words, label in rules:
        test = contains_any(c, words)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def money_source(description: Column, credit: Column) -> Column:
    label = first_rule(F.upper(description), MONEY_SOURCES, F.lit("Transfer Masuk"))
    return F.when(credit > 0, label).otherwise("")


def money_purpose(description: Column, debit: Column) -> Column:
    label = first_rule(F.upper(description), MONEY_PURPOSES, F.lit("Pembayaran"))
    return F.when(debit > 0, label).otherwise("")


def type_from_filename(c: Column) -> Column:
    """Document type by words of the name; a tax invoice when none fits."""
    return first_rule(F.lower(c), FILENAME_TYPES, F.lit("faktur_pajak"))


# Words in the names of exported files, first rule wins.
EXPORT_TYPES = [
    (["batch"], "batch"),
    (["faktur", "fp"], "faktur_pajak"),
    (["rek", "bank", "estat", "bni", "bca", "mandiri", "permata", "bri"], "rekening_koran"),
    (["pph 21", "pph21"], "pph21"),
    (["pph 23", "pph23"], "pph23"),
]


def export_type(c: Column) -> Column:
    # Bound: a filter on the type is pushed below the name, which every word would write out again.
    return bound(F.lower(c), lambda name: first_rule(name, EXPORT_TYPES, F.lit("unknown")))


def article(c: Column) -> Column:
    """Income-tax article in its standard spelling; Pasal 23 when blank."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text == "", "Pasal 23").otherwise(first_rule(F.lower(text), ARTICLE_WORDS, c))


def goods_or_service(descriptions: Column) -> Column:
    """``Jasa (Service)`` when any item description holds a service word."""
    filled = F.filter(descriptions, lambda d: F.coalesce(d, F.lit("")) != "")
    service = F.exists(filled, lambda d: contains_any(F.lower(d), SERVICE_WORDS))
    return (
        F.when(F.coalesce(F.size(filled), F.lit(0)) <= 0, "N/A")
        .when(service, "Jasa (Service)")
        .otherwise("Barang (Goods)")
    )


def _tier(value: Column, tiers: list[tuple[int, float]], floor: float) -> Column:
    out = None
    for low, score in tiers:
        out = F.when(value >= low, score) if out is None else out.when(value >= low, score)
    return out.otherwise(floor)


def text_quality(text: Column, kind: Column, head: int | None = None) -> Column:
    """Half length tier, 30 % line tier, 20 % keyword bonus, kept inside 0.1-0.99.

    Keywords are looked for in the whole text, or its first ``head`` characters."""
    seen = F.lower(text if head is None else F.substring(text, 1, head))
    bonus = F.lit(0.0)
    for name, words in QUALITY_WORDS.items():
        hits = reduce(lambda a, b: a + b, [seen.contains(w).cast("int") for w in words])
        bonus = F.when(kind == name, F.least(hits * F.lit(0.05), F.lit(0.15))).otherwise(bonus)
    lines = F.size(F.split(text, "\n"))
    total = _tier(F.length(text), LENGTH_TIERS, 0.2) * 0.5 + _tier(lines, LINE_TIERS, 0.3) * 0.3 + bonus * 0.2
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(
        F.greatest(F.lit(0.1), F.least(F.lit(0.99), total))
    )


def row_completeness(date: Column, description: Column, debit: Column, credit: Column, balance: Column) -> Column:
    """0.25 date, 0.15 text, 0.30 amount, 0.30 balance."""

    def part(test: Column, weight: float) -> Column:
        return F.when(test, weight).otherwise(0.0)

    return (
        part(F.coalesce(date, F.lit("")) != "", 0.25)
        + part(F.coalesce(description, F.lit("")) != "", 0.15)
        + part(debit.isNotNull() | credit.isNotNull(), 0.30)
        + part(balance.isNotNull(), 0.30)
    )


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that are empty, in the given order."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.lit(n)) for n, c in fields.items()])
    )


def distinct_parts(c: Column) -> Column:
    """Comma- or line-separated names, labels dropped, first occurrences kept in order."""
    parts = F.transform(F.split(c, r"[,\r\n]"), lambda p: F.trim(p))
    # Fixed value: labels that start a line which is no name.
    label = r"(?i)^(alamat|npwp|nomor|no invoice|invoice|kode|nama\s+barang|nama\s*(penjual|pembeli|pt|cv))"
    kept = F.array_distinct(F.filter(parts, lambda p: (p != "") & ~p.rlike(label)))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) <= 0, "N/A").otherwise(F.array_join(kept, ", "))


# --- cleaners -------------------------------------------------------------------------------------


def clean_document_number(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_/-]", ""))


def is_person_name(c: Column) -> Column:
    """At least 3 characters, at least 70 % of them letters or digits."""
    alnum = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return (F.length(c) >= 3) & (alnum >= F.length(c) * 0.7)


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[\r\n]+"), lambda t: _strip(t)), lambda t: t != "")


def company_name(c: Column) -> Column:
    """Lines that are no labels, joined and squeezed."""

    def joined(lines: Column) -> Column:
        # Fixed value: labels that start a line which is no company.
        kept = F.filter(lines, lambda t: ~t.rlike(r"(?i)^(alamat|npwp|nomor|kode|invoice)"))
        return F.array_join(bound(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(lines)), " ")

    return _strip(squeeze(bound(_lines(c), joined)))


def address(c: Column) -> Column:
    """Lines up to the first label, joined with commas."""

    def joined(lines: Column) -> Column:
        # Fixed value: labels that end an address.
        flags = F.transform(lines, lambda t: t.rlike(r"(?i)^(npwp|nomor|no\.?|kode|invoice|nama)"))
        upto = lambda stop: F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
        return F.array_join(bound(F.array_position(flags, True), upto), ", ")

    return _strip(bound(_lines(c), joined))


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r,"))


def blank_amount(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin("-", "", "N/A", "0")


def fingerprint(date: Column, credit: Column, debit: Column, balance: Column) -> Column:
    """Key of a statement row on cleaned amounts; blanks count as 0."""
    cleaned = [F.coalesce(F.nullif(misread_amount(c), F.lit("")), F.lit("0")) for c in (credit, debit, balance)]
    return F.concat_ws("_", F.coalesce(date, F.lit("N/A")), *cleaned)
