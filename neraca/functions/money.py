"""Amounts written in Indonesian and international styles, as decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Characters of currency signs, and cells that stand for "no amount".
CURRENCY = r"[Rp$€£¥]"
NO_AMOUNT = ["-", "", "N/A", "n/a"]
AMOUNT_LABELS = {
    "dpp": ["dpp", "dasar pengenaan pajak", "harga jual"],
    "ppn": ["ppn", "pajak pertambahan nilai"],
    "total": ["total", "jumlah", "grand total"],
}


def _last_separator(c: Column) -> Column:
    return F.regexp_extract(c, r"([.,])[^.,]*$", 1)


def _without(c: Column, mark: str) -> Column:
    return F.replace(c, F.lit(mark), F.lit(""))


def _comma_to_dot(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("."))


def _mixed(c: Column) -> Column:
    """Both separators present: the last one is the decimal point."""
    return F.when(_last_separator(c) == ",", _comma_to_dot(_without(c, "."))).otherwise(_without(c, ","))


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), 0)


def clean_amount(c: Column) -> Column:
    """Default parser: a single separator with at most two characters after it is the
    decimal point, otherwise it groups thousands.  Unreadable or blank is 0."""
    bare = F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), CURRENCY, "")), F.lit(" "), F.lit(""))
    has_comma, has_dot = bare.contains(","), bare.contains(".")
    number = (
        F.when(has_comma & has_dot, _mixed(bare))
        .when(has_comma & bare.rlike(r"^[^,]*,.{0,2}$"), _comma_to_dot(bare))
        .when(has_comma, _without(bare, ","))
        .when(has_dot & ~bare.rlike(r"^[^.]*\..{0,2}$"), _without(bare, "."))
        .otherwise(bare)
    )
    return F.coalesce(number.try_cast(MONEY), F.lit(0).cast(MONEY))


def extract_amount(c: Column) -> Column:
    """Row-parser variant: exactly two decimals after a single separator, ``(x)`` is
    negative, and null when there is no amount."""
    text = F.trim(c)
    stripped = F.regexp_replace(text, r"[Rp\s$€£¥]", "")
    negative = stripped.contains("(") & stripped.contains(")")
    value = bound(F.when(negative, F.regexp_replace(stripped, r"[()]", "")).otherwise(stripped), _read_amount)
    signed = F.when(negative, -value).otherwise(value).cast(MONEY)
    return F.when(text.isin(NO_AMOUNT), F.lit(None).cast(MONEY)).otherwise(signed)


def _read_amount(bare: Column) -> Column:
    has_comma, has_dot = bare.contains(","), bare.contains(".")
    number = (
        F.when(has_comma & has_dot, _mixed(bare))
        .when(has_comma & bare.rlike(r"^[^,]*,[^,]{2}$"), _comma_to_dot(bare))
        .when(has_comma, _without(bare, ","))
        .when(has_dot & bare.rlike(r"\..*\.|^[^.]*\.[^.]{3}$"), _without(bare, "."))
        .otherwise(bare)
    )
    return number.try_cast(MONEY)


def sheet_amount(c: Column) -> Column:
    """Sheet cell in Indonesian style: dots group, comma is the decimal point."""
    bare = _comma_to_dot(_without(_without(_without(F.coalesce(c, F.lit("")), "Rp"), " "), "."))
    return F.coalesce(F.trim(bare).try_cast(MONEY), F.lit(0).cast(MONEY))


def misread_amount(c: Column) -> Column:
    """Legacy digits of an amount: US decimals cut, then every separator removed."""
    bare = F.trim(_without(_without(c, "Rp"), "IDR"))
    us = bare.contains(",") & (_last_separator(bare) == ".")
    whole = F.when(us, F.substring_index(bare, ".", 1)).otherwise(bare)
    digits = F.trim(_without(_without(whole, "."), ","))
    return F.when(F.coalesce(c, F.lit("")) == "", c).when(digits != "", digits).otherwise(whole)


def misread_value(c: Column) -> Column:
    """``misread_amount`` as a number; null when it is not one."""
    return misread_amount(c).try_cast(MONEY)


def parse_quantity(c: Column) -> Column:
    """Quantity with a decimal comma, at most two decimals; null when not a number."""
    kept = F.regexp_replace(_comma_to_dot(F.coalesce(c, F.lit(""))), r"[^\d.]", "")
    return F.round(kept.try_cast("decimal(18,4)"), 2).cast(MONEY)


def quantity_label(c: Column) -> Column:
    """``-`` when unreadable, whole numbers without decimals, else two decimals."""
    q = parse_quantity(c)
    return (
        F.when(q.isNull(), F.lit("-"))
        .when(q == F.floor(q), F.floor(q).cast("string"))
        .otherwise(q.cast("string"))
    )


def parse_price(c: Column) -> Column:
    """Whole currency units of a price; 0 when unreadable.  A lone dot is a decimal
    point only with two digits after it; a comma always is."""
    bare = F.trim(_without(_without(F.trim(F.coalesce(c, F.lit(""))), "Rp"), "IDR"))
    whole = lambda v: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("long")
    return F.coalesce(bound(bound(bare, _read_price), whole), F.lit(0).cast("long"))


def _read_price(bare: Column) -> Column:
    has_comma, has_dot = bare.contains(","), bare.contains(".")
    number = (
        F.when(has_comma & has_dot, _comma_to_dot(_without(bare, ".")))
        .when(has_comma, _comma_to_dot(bare))
        .when(has_dot & ~bare.rlike(r"^[^.]*\.[^.]{2}$"), _without(bare, "."))
        .otherwise(bare)
    )
    return number.try_cast("decimal(20,4)")


def format_rupiah(value: Column) -> Column:
    """``Rp 1.234.567`` of a number, truncated; zero and null print as ``-``."""
    return bound(value.cast("decimal(20,2)"), _format_rupiah)


def _format_rupiah(number: Column) -> Column:
    def shown(whole: Column) -> Column:
        text = F.concat(F.lit("Rp "), F.translate(F.format_number(whole, 0), ",", "."))
        return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit("-")).otherwise(text)

    return bound(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("long"), shown)


def format_rupiah_text(c: Column) -> Column:
    """As ``format_rupiah`` for text: separators dropped, the input kept if no number."""
    blank = F.coalesce(c, F.lit("")).isin("-", "N/A", "", "0", "None", "null")

    def shown(bare: Column) -> Column:
        number = lambda value: F.when(value.isNull(), c).otherwise(_format_rupiah(value))
        return F.when(blank | bare.isin("", "-"), F.lit("-")).otherwise(bound(bare.try_cast("decimal(20,2)"), number))

    return bound(F.trim(_without(_without(_without(_without(c, "Rp"), "IDR"), "."), ",")), shown)


def digits_amount(c: Column) -> Column:
    """All digits of a text as one number; null without digits."""
    return F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit("")).try_cast("decimal(38,0)")


def labelled_amount(text: Column, labels: list[str]) -> Column:
    """Amount text after the first of ``labels``; empty when none is there."""
    pattern = r"(?i)(?:" + "|".join(labels) + r")\s*:?\s*(?:Rp\.?\s*)?([0-9.,]+)"
    return F.regexp_extract(text, pattern, 1)


# --- debit / credit -----------------------------------------------------------------------

# Flags and words that tell money out from money in.
DEBIT_FLAGS = ["D", "DEBIT", "DB", "DR"]
CREDIT_FLAGS = ["C", "CREDIT", "CR", "K", "KREDIT"]
DEBIT_WORDS = [
    "TARIK", "BAYAR", "TRANSFER KE", "POTONGAN", "BIAYA", "ADMIN", "PURCHASE", "BELANJA",
    "SETOR KE", "PEMBELIAN", "PEMBAYARAN", "ATM WITHDRAWAL", "DEBIT",
]
CREDIT_WORDS = [
    "SETOR", "TERIMA", "TRANSFER DARI", "BUNGA", "CREDIT", "DEPOSIT", "PENERIMAAN", "MASUK",
    "INCOME", "REVERSAL",
]


def sides(is_debit: Column, amount: Column) -> Column:
    zero = F.lit(0).cast(MONEY)
    return F.struct(
        F.when(is_debit, amount).otherwise(zero).alias("debit"),
        F.when(is_debit, zero).otherwise(amount).alias("credit"),
    )


def read_mark(c: Column) -> tuple[Column, Column]:
    """Is a mutation money out, and its text without the mark.  CR or ``+`` is credit;
    DB, DR, parentheses or a minus debit; no mark credit."""
    text = F.trim(c)
    upper = F.upper(text)
    credit = upper.contains("CR") | text.contains("+")
    marked = upper.contains("DB") | upper.contains("DR")
    wrapped = text.startswith("(") & text.endswith(")")
    minus = text.startswith("-")
    bare = (
        F.when(credit, F.regexp_replace(text, r"CR|\+", ""))
        .when(marked, F.regexp_replace(text, "DB|DR", ""))
        .when(wrapped, F.regexp_replace(text, r"^[()]+|[()]+$", ""))
        .when(minus, F.regexp_replace(text, "^-+", ""))
        .otherwise(text)
    )
    return ~credit & (marked | wrapped | minus), bare


def sides_by_mark(c: Column) -> Column:
    def split(text: Column) -> Column:
        is_debit, bare = read_mark(text)
        return bound(bare, lambda b: bound(clean_amount(b), lambda amount: sides(is_debit, amount)))

    return bound(c, split)


def is_debit_flag(flag: Column) -> Column:
    """Whatever is no debit flag counts as credit."""
    return F.upper(F.trim(F.coalesce(flag, F.lit("")))).isin(DEBIT_FLAGS)


def is_debit_text(text: Column) -> Column:
    """Debit words win, and unclear text is credit."""
    return F.upper(F.coalesce(text, F.lit(""))).rlike("|".join(DEBIT_WORDS))


def sides_by_flag(flag: Column, amount: Column) -> Column:
    return sides(is_debit_flag(flag), amount)


def sides_by_words(text: Column, amount: Column) -> Column:
    return sides(is_debit_text(text), amount)


def sides_of_mutation(value: Column) -> Column:
    """Signed number: positive is credit, negative debit."""
    return sides(value < 0, F.abs(value).cast(MONEY))
