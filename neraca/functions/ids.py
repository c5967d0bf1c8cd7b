"""Taxpayer ids, invoice serials and party names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Printed shapes of ids, and legal-form words dropped from names.
NPWP_IN_TEXT = r"\d{2}\.?\d{3}\.?\d{3}\.?\d-?\d{3}\.?\d{3}"
INVOICE_SERIAL = r"\d{3}\.\d{3}-\d{2}\.\d{8}"
LEGAL_FORMS = ["PT", "CV", "UD", "TBK", "LTD", "INC", "CORP", "LLC", "PERSERO"]


def normalize_npwp(c: Column) -> Column:
    """Digits of a taxpayer id: dots and dashes stripped, null becomes empty."""
    return F.trim(F.translate(F.coalesce(c.cast("string"), F.lit("")), ".-", ""))


def format_npwp(c: Column) -> Column:
    """``99.999.999.9-999.999`` when the value has 15 digits, else the trimmed input."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    shaped = F.regexp_replace(
        digits, r"^(\d{2})(\d{3})(\d{3})(\d)(\d{3})(\d{3})$", "$1.$2.$3.$4-$5.$6"
    )
    return F.when(F.length(digits) == 15, shaped).otherwise(F.trim(c))


def extract_npwp(value: Column, text: Column) -> Column:
    """First of ``value`` and the ids found in ``text`` that has 15 digits, formatted;
    empty when there is none."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(f"({NPWP_IN_TEXT})"), F.lit(1)), F.array().cast("array<string>"))
    candidates = F.concat(F.array(F.coalesce(value, F.lit(""))), found)
    full = F.filter(candidates, lambda c: F.length(F.regexp_replace(c, r"[^0-9]", "")) == 15)
    return F.coalesce(format_npwp(F.get(full, 0)), F.lit(""))


def extract_invoice_serial(value: Column, text: Column) -> Column:
    """``value`` without spaces when it is a serial, else the first serial in ``text``."""
    bare = F.replace(F.trim(F.coalesce(value, F.lit(""))), F.lit(" "), F.lit(""))
    return F.when(bare.rlike(f"^{INVOICE_SERIAL}$"), bare).otherwise(
        F.regexp_extract(F.coalesce(text, F.lit("")), INVOICE_SERIAL, 0)
    )


def normalize_vendor(c: Column) -> Column:
    """Upper case, legal forms and punctuation dropped, spaces squeezed."""
    words = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\b(" + "|".join(LEGAL_FORMS) + r")\b", "")
    kept = F.regexp_replace(words, r"[^A-Z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))
