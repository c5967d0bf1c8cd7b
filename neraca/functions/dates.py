"""Dates written in the styles of Indonesian tax and bank documents."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from neraca.functions.money import bound

# Month names and short forms, and their numbers.
MONTHS = {
    "JAN": 1, "JANUARI": 1, "JANUARY": 1,
    "FEB": 2, "FEBRUARI": 2, "FEBRUARY": 2,
    "MAR": 3, "MARET": 3, "MARCH": 3,
    "APR": 4, "APRIL": 4,
    "MAY": 5, "MEI": 5,
    "JUN": 6, "JUNI": 6, "JUNE": 6,
    "JUL": 7, "JULI": 7, "JULY": 7,
    "AUG": 8, "AGUSTUS": 8, "AUGUST": 8, "AGT": 8, "AGU": 8,
    "SEP": 9, "SEPTEMBER": 9, "SEPT": 9,
    "OCT": 10, "OKTOBER": 10, "OCTOBER": 10, "OKT": 10,
    "NOV": 11, "NOVEMBER": 11,
    "DEC": 12, "DESEMBER": 12, "DECEMBER": 12, "DES": 12,
}
MONTH_NAMES = [
    "Januari", "Februari", "Maret", "April", "Mei", "Juni",
    "Juli", "Agustus", "September", "Oktober", "November", "Desember",
]
# Format lists, tried in order.
SHEET_FORMATS = ["d/M/yyyy", "yyyy-M-d", "d-M-yyyy", "d.M.yyyy"]
ENGINE_FORMATS = ["d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d M yyyy", "d/M/yy", "d-M-yy"]
STATEMENT_FORMATS = [
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "d MMM yyyy", "d MMMM yyyy", "d/M/yy", "d-M-yy",
]


def month_number(name: Column) -> Column:
    """Two-digit month of a name in either language; null when unknown."""
    pairs = [(name, f"{number:02d}") for name, number in MONTHS.items()]
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])
    return F.try_element_at(table, F.upper(name))


def month_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in MONTH_NAMES]), number - 1)


_SHAPES = {"d": r"\d{1,2}", "M": r"\d{1,2}", "yyyy": r"\d{4}", "yy": r"\d{2}", "MMM": "[A-Za-z]{3}", "MMMM": "[A-Za-z]{3,}"}


def _shape(fmt: str) -> str:
    """Regular expression of the texts a format can read."""
    parts = re.findall(r"[a-zA-Z]+|[^a-zA-Z]", fmt)
    return "^" + "".join(_SHAPES.get(p, re.escape(p)) for p in parts) + "$"


def parse_date(c: Column, formats: list[str]) -> Column:
    """First format that fits; two-digit years 69-99 belong to the 1900s.

    Texts are matched by shape before they are parsed, so unreadable ones cost no
    parser exception.
    """
    text = F.trim(c)

    def attempt(fmt: str) -> Column:
        value = F.initcap(text) if "MMM" in fmt else text
        day = F.try_to_date(value, fmt)
        if "yyyy" not in fmt:
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        return F.when(text.rlike(_shape(fmt)), day)

    return F.coalesce(*[attempt(f) for f in formats])


def _pad(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def _clock(text: Column, pattern: str, first: int) -> Column:
    parts = [F.regexp_extract(text, pattern, first + i) for i in range(3)]
    seconds = F.when(parts[2] == "", F.lit("00")).otherwise(parts[2])
    return F.concat_ws(":", _pad(parts[0]), _pad(parts[1]), _pad(seconds))


# Shapes of statement dates.
_DMY_TIME = r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2}):?(\d{2})?$"
_DMY = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
_DMY_SHORT = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
_DM = r"^(\d{1,2})[/-](\d{1,2})$"
_DMY_DASH = r"^(\d{1,2})-(\d{1,2})-(\d{2,4})$"
_ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
_ISO_TIME = r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{2}):?(\d{2})?$"
_ISO_T = r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{2}):?(\d{2})?"
_NAMED = r"^(\d{1,2})\s+([A-Z]+)\s+(\d{4})$"
_NAMED_SHORT = r"^(\d{1,2})\s+([A-Z]+)$"
_ENGLISH = r"^([A-Z]+)\s+(\d{1,2}),?\s+(\d{4})$"


def complete_date(c: Column, year: Column) -> Column:
    """``DD/MM/YYYY`` of a statement date; ``year`` fills in where it is missing.

    Two-digit years are 20xx; an unknown month name counts as January; text in no
    known shape is returned as it is.
    """
    text = F.trim(c)
    upper = F.upper(text)

    def part(pattern: str, n: int, source: Column = text) -> Column:
        return F.regexp_extract(source, pattern, n)

    def dmy(d: Column, m: Column, y: Column) -> Column:
        return F.concat_ws("/", _pad(d), _pad(m), y)

    def named(name: Column) -> Column:
        return F.coalesce(month_number(name), F.lit("01"))

    dash_year = part(_DMY_DASH, 3)
    dash_year = F.when(F.length(dash_year) == 2, F.concat(F.lit("20"), dash_year)).otherwise(dash_year)
    return (
        F.when(
            text.rlike(_DMY_TIME),
            F.concat_ws(" ", dmy(part(_DMY_TIME, 1), part(_DMY_TIME, 2), part(_DMY_TIME, 3)), _clock(text, _DMY_TIME, 4)),
        )
        .when(text.rlike(_DMY), dmy(part(_DMY, 1), part(_DMY, 2), part(_DMY, 3)))
        .when(text.rlike(_DMY_SHORT), dmy(part(_DMY_SHORT, 1), part(_DMY_SHORT, 2), F.concat(F.lit("20"), part(_DMY_SHORT, 3))))
        .when(text.rlike(_DM), dmy(part(_DM, 1), part(_DM, 2), year))
        .when(text.rlike(_DMY_DASH), dmy(part(_DMY_DASH, 1), part(_DMY_DASH, 2), dash_year))
        .when(text.rlike(_ISO), dmy(part(_ISO, 3), part(_ISO, 2), part(_ISO, 1)))
        .when(
            text.rlike(_ISO_TIME),
            F.concat_ws(" ", dmy(part(_ISO_TIME, 3), part(_ISO_TIME, 2), part(_ISO_TIME, 1)), _clock(text, _ISO_TIME, 4)),
        )
        .when(
            text.rlike(_ISO_T),
            F.concat_ws(" ", dmy(part(_ISO_T, 3), part(_ISO_T, 2), part(_ISO_T, 1)), _clock(text, _ISO_T, 4)),
        )
        .when(upper.rlike(_NAMED), dmy(part(_NAMED, 1, upper), named(part(_NAMED, 2, upper)), part(_NAMED, 3, upper)))
        .when(upper.rlike(_NAMED_SHORT), dmy(part(_NAMED_SHORT, 1, upper), named(part(_NAMED_SHORT, 2, upper)), year))
        .when(upper.rlike(_ENGLISH), dmy(part(_ENGLISH, 2, upper), named(part(_ENGLISH, 1, upper)), part(_ENGLISH, 3, upper)))
        .otherwise(text)
    )


def sort_key(c: Column) -> Column:
    """``struct(y, m, d)`` that sorts full dates first, then year-less, then the rest."""
    text = F.trim(c)
    upper = F.upper(text)
    named_any = r"^(\d{1,2})\s+([A-Z]+)(?:\s+(\d{4}))?$"

    def key(y: Column, m: Column, d: Column) -> Column:
        return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))

    def part(pattern: str, n: int, source: Column = text) -> Column:
        return F.nullif(F.regexp_extract(source, pattern, n), F.lit(""))

    last = key(F.lit(9999), F.lit(12), F.lit(31))
    month = F.coalesce(month_number(part(named_any, 2, upper)), F.lit("01"))
    return (
        F.when(text.rlike(_DMY), key(part(_DMY, 3), part(_DMY, 2), part(_DMY, 1)))
        .when(text.rlike(_DM), key(F.lit(9999), part(_DM, 2), part(_DM, 1)))
        .when(
            upper.rlike(named_any),
            key(F.coalesce(part(named_any, 3, upper), F.lit("9999")), month, part(named_any, 1, upper)),
        )
        .otherwise(last)
    )


def is_unsortable(key: Column) -> Column:
    """The date is in no known shape (or is the placeholder itself)."""
    return (key["y"] == 9999) & (key["m"] == 12) & (key["d"] == 31)


def long_date(c: Column) -> Column:
    """``DD Bulan YYYY``; two-digit years below 50 are 20xx.  Empty when unreadable."""
    return bound(F.trim(F.regexp_replace(F.trim(c), r"^[,.;]+|[,.;]+$", "")), _long_date)


def _long_date(text: Column) -> Column:
    # Shapes of a written date, tried in order, and where they hold year, month and day.
    named = r"(?i)(\d{1,2})\s+([A-Za-z]+)\s+(\d{2,4})"
    dmy = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
    dotted = r"^(\d{1,2})\.(\d{1,2})\.(\d{2,4})$"
    ymd = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"

    def spelled(p: Column) -> Column:
        y, m, d = p["y"], p["m"], p["d"]
        year = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
        valid = d.between(1, 31) & m.between(1, 12) & year.between(1900, 2100)
        return F.when(
            valid, F.concat_ws(" ", _pad(d.cast("string")), month_name(m), year.cast("string"))
        )

    def shown(pattern: str, *places: int) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, n) for n in places)
        m = month_number(m).cast("int") if pattern == named else m.try_cast("int")
        # Each shape is taken apart once, and only where it fits.
        parts = F.struct(y.try_cast("int").alias("y"), m.alias("m"), d.try_cast("int").alias("d"))
        return F.when(text.rlike(pattern), bound(parts, spelled))

    return F.coalesce(shown(named, 3, 2, 1), shown(dmy, 3, 2, 1), shown(dotted, 3, 2, 1), shown(ymd, 1, 2, 3), F.lit(""))


def invoice_date(value: Column, text: Column) -> Column:
    """Long date of ``value``, else of the first labelled, numeric or named date in
    ``text`` that can be read."""
    # Where a text has its date, tried in order.
    label = r"(?i)(?:Tanggal\s*(?:Faktur)?|Tgl\.?|Tanggal Invoice)\s*:?\s*([^\n]+)"
    numeric = r"(\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b)"
    named = r"(\b\d{1,2}\s+[A-Za-z]+\s+\d{2,4}\b)"
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (label, numeric, named)]
    candidates = F.concat(F.array(F.coalesce(value, F.lit(""))), *found)
    first = lambda seen, c: F.when(seen != "", seen).otherwise(long_date(c))
    return F.coalesce(F.aggregate(candidates, F.lit(""), first), F.lit(""))


def slash_date(c: Column) -> Column:
    """``DD/MM/YYYY`` of an exporter date; ``N/A`` when blank, else the text itself."""
    blank = F.coalesce(c, F.lit("")).isin("N/A", "", "None", "null")
    return F.when(blank, F.lit("N/A")).otherwise(bound(F.trim(c), _slash_date))


def _slash_date(text: Column) -> Column:
    # Formats and shapes of exported dates, tried in order.
    formats = ["d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d MMMM yyyy", "d MMM yyyy", "d-M-yy", "d/M/yy"]
    named = r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
    loose = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    day = F.regexp_extract(text, named, 1)
    month = month_number(F.regexp_extract(text, named, 2))
    named_date = F.when(
        text.rlike(named) & month.isNotNull() & day.try_cast("int").between(1, 31),
        F.concat_ws("/", _pad(day), month, F.regexp_extract(text, named, 3)),
    )
    loose_date = F.when(
        text.rlike(loose),
        F.concat_ws("/", *[_pad(F.regexp_extract(text, loose, n)) if n < 3 else F.regexp_extract(text, loose, n) for n in (1, 2, 3)]),
    )
    return F.coalesce(F.date_format(parse_date(text, formats), "dd/MM/yyyy"), named_date, loose_date, text)


# Date shapes of the row parser, tried in order.
_ROW_SHAPES = [
    (r"\b(\d{2})[/-](\d{2})[/-](\d{4})\b", "dmy"),
    (r"\b(\d{2})[/-](\d{2})[/-](\d{2})\b", "dmy2"),
    (r"\b(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\b", "named"),
    (r"\b(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b", "named"),
    (r"\b(\d{4})[/-](\d{2})[/-](\d{2})\b", "ymd"),
]


def row_date(c: Column) -> Column:
    """ISO text of the first date shape found in a cell; null when there is none."""
    text = F.trim(c)
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(_ROW_SHAPES):
        a, b, y = (F.regexp_extract(text, pattern, n) for n in (1, 2, 3))
        if kind == "dmy":
            iso = F.concat_ws("-", y, b, a)
        elif kind == "dmy2":
            iso = F.concat_ws("-", F.concat(F.lit("20"), y), b, a)
        elif kind == "ymd":
            iso = F.concat_ws("-", a, b, y)
        else:
            iso = F.concat_ws("-", y, F.coalesce(month_number(b), b), _pad(a))
        out = F.when(text.rlike(pattern), iso).otherwise(out)
    return out


def cimb_date(c: Column, layout: Column, year: Column) -> Column:
    """ISO text: layout 1 writes MM/DD/YY HH:MM, layout 2 DD/MM with ``year`` added."""
    text = F.trim(c)
    first = r"(\d{2})/(\d{2})/(\d{2})\s+(\d{2}):(\d{2})"
    second = r"(\d{2})/(\d{2})"

    def iso(pattern: str, y: Column, m: int, d: int) -> Column:
        return F.concat_ws("-", y, F.regexp_extract(text, pattern, m), F.regexp_extract(text, pattern, d))

    return (
        F.when(
            (layout == "format_1") & text.rlike(first),
            iso(first, F.concat(F.lit("20"), F.regexp_extract(text, first, 3)), 1, 2),
        )
        .when((layout == "format_2") & text.rlike(second), iso(second, year, 2, 1))
        .otherwise(row_date(text))
    )


def period_year(c: Column) -> Column:
    """First 20xx year of a period text; null when there is none."""
    return F.nullif(F.regexp_extract(c, r"\b(20\d{2})\b", 1), F.lit(""))
