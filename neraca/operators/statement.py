"""Bank statement rows in many table layouts, normalised by one job.

Input rows: ``doc_id, bank_code, page, table_idx, row_idx, cells``; row 0 of a table
is its header.  Layouts are data: one line per bank and table width, joined to the
rows, so a new bank is a new line and not new code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neraca.functions import dates, money, text

POSITIONS = [
    "date", "date2", "posting", "effective", "description", "description2", "type", "type2",
    "reference", "reference2", "debit", "credit", "amount", "flag", "balance", "branch", "teller",
    "account", "holder", "time", "user", "status", "bank_ref", "customer_no",
]

# Bank names, table widths (no ``high``: any more cells) and the cell of each field.  ``sign`` says how money
# in and out are told apart; ``strict`` layouts drop rows without a balance.
LAYOUTS = [
    dict(bank="BCA", name="Bank BCA", low=5, high=None, sign="mark", strict=True, style="long",
         date=0, description=1, branch=2, amount=3, balance=4),
    dict(bank="BCA_SYARIAH", name="BCA Syariah", low=14, high=14, sign="flag",
         date=1, date2=0, effective=0, time=2, type=3, description=4, description2=5, flag=6, amount=7,
         balance=8, reference=9, status=10, user=11, branch=13),
    dict(bank="BCA_SYARIAH", name="BCA Syariah", low=10, high=13, sign="flag",
         date=1, date2=0, effective=0, time=2, type=3, description=4, description2=5, flag=6, amount=7,
         balance=8, reference=9, branch=10),
    dict(bank="BCA_SYARIAH", name="BCA Syariah", low=9, high=9, sign="flag",
         date=0, type=1, description=2, flag=3, amount=4, balance=5, reference=6, branch=7, time=8),
    dict(bank="BNI_V1", name="Bank BNI", low=5, high=None, sign="columns", strict=True,
         date=0, description=1, debit=2, credit=3, balance=4),
    dict(bank="BNI_V2", name="Bank BNI", low=8, high=8, sign="flag",
         date=1, date2=0, posting=0, effective=1, branch=2, reference=3, description=4, amount=5, flag=6, balance=7),
    dict(bank="BNI_V2", name="Bank BNI", low=6, high=6, sign="flag",
         date=0, effective=0, description=1, amount=2, flag=3, balance=4, reference=5),
    dict(bank="BRI", name="Bank BRI", low=6, high=None, sign="columns", strict=True,
         date=0, description=1, teller=2, debit=3, credit=4, balance=5),
    dict(bank="BSI_SYARIAH", name="Bank Syariah Indonesia", low=7, high=7, sign="flag",
         reference=0, date=1, time=2, flag=3, amount=4, balance=5, description=6),
    dict(bank="BSI_SYARIAH", name="Bank Syariah Indonesia", low=6, high=6, sign="flag",
         date=0, time=1, flag=2, amount=3, balance=4, description=5),
    dict(bank="CIMB_NIAGA", name="CIMB Niaga", format="format_1", low=7, high=None, sign="columns", style="mdy_time",
         date=2, date2=1, posting=1, effective=2, reference=8, reference2=3, description=4, debit=5, credit=6, balance=7),
    dict(bank="CIMB_NIAGA", name="CIMB Niaga", format="format_2", low=6, high=None, sign="columns", style="day_month",
         date=0, date2=1, posting=0, effective=1, description=2, reference=3, debit=4, credit=5, balance=6),
    dict(bank="MANDIRI_V1", name="Bank Mandiri", low=6, high=None, sign="columns", strict=True,
         date=0, posting=0, description=1, reference=2, debit=3, credit=4, balance=5),
    dict(bank="MANDIRI_V2", name="Bank Mandiri", low=8, high=8, sign="words",
         holder=0, account=1, date=2, type=3, type2=4, description=5, amount=6, balance=7),
    dict(bank="MANDIRI_V2", name="Bank Mandiri", low=5, high=5, sign="words",
         date=0, type=1, description=2, amount=3, balance=4),
    dict(bank="MUFG", name="MUFG Bank", low=9, high=None, sign="columns",
         date=0, date2=1, posting=0, effective=1, debit=2, credit=3, balance=4, type=5, reference=6, bank_ref=7, description=8),
    dict(bank="MUFG", name="MUFG Bank", low=8, high=8, sign="columns",
         date=0, date2=1, posting=0, effective=1, debit=2, credit=3, balance=4, type=5, reference=6, description=7),
    dict(bank="MUFG", name="MUFG Bank", low=5, high=5, sign="columns",
         date=0, posting=0, debit=1, credit=2, balance=3, description=4),
    dict(bank="OCBC", name="OCBC Bank", low=6, high=None, sign="columns",
         date=0, date2=1, posting=0, effective=1, description=2, debit=3, credit=4, balance=5),
    dict(bank="PERMATA", name="Permata Bank", low=10, high=10, sign="columns",
         date=1, date2=0, posting=0, effective=1, type=2, reference=3, reference2=4, customer_no=5, description=6,
         debit=7, credit=8, balance=9),
    dict(bank="PERMATA", name="Permata Bank", low=7, high=7, sign="columns",
         date=0, effective=0, type=1, description=2, debit=3, credit=4, balance=5, reference=6),
]

# Words that give a statement's bank away; banks in order of precedence.
BANK_WORDS = {
    "BSI_SYARIAH": ["BANK SYARIAH INDONESIA", "BSI BANK SYARIAH", "BSI SYARIAH", "PT BSI", "PT. BSI", "TRX TIME", "TRXID", "TRX ID", "D/K"],
    "MANDIRI_V2": ["PT BANK MANDIRI", "BANK MANDIRI (PERSERO)", "KET. KODE TRANSAKSI", "JENIS TRANS", "NOMER REKENING"],
    "MANDIRI_V1": ["PT BANK MANDIRI", "BANK MANDIRI (PERSERO)", "POSTING DATE", "REMARK"],
    "BNI_V2": ["BANK NEGARA INDONESIA", "PT BANK BNI", "POSTING DATE", "EFFECTIVE DATE", "DB/CR", "JOURNAL"],
    "BNI_V1": ["BANK NEGARA INDONESIA", "PT BANK BNI", "TGL TRANS", "URAIAN", "DEBET", "KREDIT"],
    "CIMB_NIAGA": ["CIMB NIAGA", "PT BANK CIMB NIAGA", "POST DATE", "EFF DATE", "TRANSACTION REF NO", "TGL. TXN", "TXN. DATE", "TGL. VALUTA"],
    "BCA_SYARIAH": ["BCA SYARIAH", "PT BANK BCA SYARIAH", "TANGGAL EFEKTIF", "TANGGAL TRANSAKSI", "KODE TRANSAKSI", "KETERANGAN TAMBAHAN", "KODE CABANG"],
    "BCA": ["BANK CENTRAL ASIA", "PT BANK CENTRAL ASIA", "PT. BANK CENTRAL ASIA", "KETERANGAN", "CBG", "MUTASI"],
    "MUFG": ["MUFG BANK", "MITSUBISHI UFJ", "BOOKING DATE", "VALUE DATE", "CUSTOMER REFERENCE", "BANK REFERENCE"],
    "PERMATA": ["BANK PERMATA", "PERMATA BANK", "PT BANK PERMATA", "POST DATE", "EFF DATE", "TRANSACTION CODE"],
    "BRI": ["BANK RAKYAT INDONESIA", "PT BANK BRI", "PT. BANK BRI", "TANGGAL TRANSAKSI", "URAIAN TRANSAKSI", "TELLER"],
    "OCBC": ["OCBC BANK", "PT BANK OCBC", "OCBC NISP", "TGL TRANS", "TRANS DATE", "TGL VALUTA", "VALUE DATE"],
}
CIMB_FIRST = ["POST DATE", "EFF DATE", "TRANSACTION REF NO"]
CIMB_SECOND = ["TGL. TXN", "TXN. DATE", "TGL. VALUTA"]
LONG_DATES = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy"]


def layout_table(spark: SparkSession) -> DataFrame:
    """The layouts as a DataFrame; a fixed few dozen rows, so always small to broadcast."""
    names = ["bank", "name", "format", "low", "high", "sign", "strict", "style", *POSITIONS]
    schema = (
        "l_bank string, bank_name string, l_format string, low int, high int, sign string, strict boolean, style string, "
        + ", ".join(f"p_{p} int" for p in POSITIONS)
    )
    rows = [tuple(layout.get(n, False if n == "strict" else None) for n in names) for layout in LAYOUTS]
    return spark.createDataFrame(rows, schema)


def data_rows(cells: DataFrame) -> DataFrame:
    """Header rows and rows without any text dropped."""
    return cells.filter((F.col("row_idx") > 0) & F.exists("cells", lambda c: F.trim(c) != ""))


def cimb_formats(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, format`` of CIMB statements: two keyword hits in the text, else any hit
    in a header row, the first layout before the second."""

    def hits(c: Column, words: list[str]) -> Column:
        return sum((c.contains(w).cast("int") for w in words), F.lit(0))

    header = F.upper(F.array_join("cells", " "))
    headers = (
        cells.filter((F.col("row_idx") == 0) & (F.col("bank_code") == "CIMB_NIAGA"))
        .groupBy("doc_id")
        .agg(
            F.max(hits(header, CIMB_FIRST) > 0).alias("_h1"),
            F.max(hits(header, CIMB_SECOND) > 0).alias("_h2"),
        )
    )
    upper = F.upper(F.coalesce("text", F.lit("")))
    return headers.join(texts, "doc_id", "left").select(
        "doc_id",
        F.when(hits(upper, CIMB_FIRST) >= 2, "format_1")
        .when(hits(upper, CIMB_SECOND) >= 2, "format_2")
        .when(F.col("_h1"), "format_1")
        .when(F.col("_h2"), "format_2")
        .alias("format"),
    )


def _cell(field: str) -> Column:
    """Text picked for ``field``, see ``_picked``."""
    return F.col(f"t_{field}")


def _picked(field: str) -> Column:
    """Trimmed text of the layout's cell for ``field``; empty when it has none."""
    return F.coalesce(F.trim(F.get("cells", F.col(f"p_{field}"))), F.lit("")).alias(f"t_{field}")


def _statement_date(c: Column, year: Column) -> Column:
    style = F.col("style")
    stamp = r"(\d{2})/(\d{2})/(\d{2})\s+(\d{2}):(\d{2})"
    day_month = r"(\d{2})/(\d{2})(?:/(\d{2,4}))?"

    def part(pattern: str, n: int) -> Column:
        return F.regexp_extract(c, pattern, n)

    us = F.concat_ws("-", F.concat(F.lit("20"), part(stamp, 3)), part(stamp, 1), part(stamp, 2))
    written = part(day_month, 3)
    full_year = F.when(written == "", year).when(F.length(written) == 2, F.concat(F.lit("20"), written)).otherwise(written)
    short = F.concat_ws("-", full_year, part(day_month, 2), part(day_month, 1))
    own = F.when((style == "mdy_time") & c.rlike(stamp), us).when((style == "day_month") & c.rlike(day_month), short)
    # "long" statements write the year in full and last.
    readable = F.when((F.coalesce(style, F.lit("")) != "long") | c.rlike(r"\d{4}$"), c)
    return F.coalesce(F.try_to_date(own), dates.parse_date(readable, dates.STATEMENT_FORMATS))


def _labelled(label: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(label), c))


def normalize_statements(
    cells: DataFrame, formats: DataFrame | None = None, accounts: DataFrame | None = None, year: Column | None = None
) -> DataFrame:
    """Standard transactions of all statements.

    ``formats`` gives ``doc_id, format`` where a bank has several; ``accounts`` gives
    ``doc_id, account_number, account_holder``; ``year`` completes dates without one.
    Rows of unknown width, without a date, or (strict layouts) without a balance drop out.
    """
    rows = data_rows(cells)
    if formats is not None:
        rows = rows.join(formats, "doc_id", "left")
    else:
        rows = rows.withColumn("format", F.lit(None).cast("string"))
    if accounts is not None:
        rows = rows.join(accounts, "doc_id", "left")
    else:
        rows = rows.withColumn("account_number", F.lit("")).withColumn("account_holder", F.lit(""))
    width = F.size("cells")
    layouts = F.broadcast(layout_table(cells.sparkSession))
    fits = (
        (F.col("bank_code") == F.col("l_bank"))
        & (F.col("l_format").isNull() | (F.col("format") == F.col("l_format")))
        & (width >= F.col("low"))
        & (F.col("high").isNull() | (width <= F.col("high")))
    )
    year = F.lit(None).cast("string") if year is None else year
    marked_debit, bare = money.read_mark(_cell("amount"))
    words = F.concat_ws(" ", _cell("type"), _cell("type2"))
    is_debit = (
        F.when(F.col("sign") == "mark", marked_debit)
        .when(F.col("sign") == "flag", money.is_debit_flag(_cell("flag")))
        .when(F.col("sign") == "words", money.is_debit_text(words))
    )

    def either(a: Column, b: Column) -> Column:
        return F.when(a != "", a).otherwise(b)

    info = F.concat_ws(
        ", ",
        _labelled("Jam: ", F.when(F.col("l_bank") == "BCA_SYARIAH", _cell("time")).otherwise("")),
        _labelled("User: ", _cell("user")),
        _labelled("Status: ", _cell("status")),
        _labelled("Time: ", F.when(F.col("l_bank") == "BSI_SYARIAH", _cell("time")).otherwise("")),
        _labelled("Bank Ref: ", _cell("bank_ref")),
        _labelled("Customer No: ", _cell("customer_no")),
    )
    kind = F.regexp_replace(F.concat_ws(" - ", _cell("type"), F.when(F.col("l_bank") == "MANDIRI_V2", _cell("type2"))), r"^[ -]+|[ -]+$", "")
    carried = ["doc_id", "page", "table_idx", "row_idx", "l_bank", "bank_name", "sign", "strict", "style", "account_number", "account_holder"]
    first_is_posting = F.col("p_posting") == F.col("p_date")
    first_is_effective = F.col("p_effective") == F.col("p_date")
    # Pick texts, then parse each once, then put the fields together.
    texts = rows.join(layouts, fits).select(
        *carried,
        *[_picked(p) for p in POSITIONS if p not in ("posting", "effective")],
        F.when(F.col("p_posting").isNotNull(), F.when(first_is_posting, 1).otherwise(2)).alias("_posting"),
        F.when(F.col("p_effective").isNotNull(), F.when(first_is_effective, 1).otherwise(2)).alias("_effective"),
    )
    marked = texts.withColumns(
        {"_is_debit": is_debit, "_bare": F.when(F.col("sign") == "mark", bare).otherwise(_cell("amount"))}
    )
    parsed = marked.select(
        "*",
        _statement_date(_cell("date"), year).alias("_first"),
        _statement_date(_cell("date2"), year).alias("_second"),
        money.clean_amount(F.col("_bare")).alias("_amount"),
        money.clean_amount(_cell("debit")).alias("_debit"),
        money.clean_amount(_cell("credit")).alias("_credit"),
        money.clean_amount(_cell("balance")).alias("_balance"),
    )

    def which(column: str) -> Column:
        return F.when(F.col(column) == 1, F.col("_first")).when(F.col(column) == 2, F.col("_second"))

    zero = F.lit(0).cast(money.MONEY)
    fields = F.struct(
        "doc_id",
        "page",
        "table_idx",
        "row_idx",
        F.coalesce("_first", "_second").alias("transaction_date"),
        which("_posting").alias("posting_date"),
        which("_effective").alias("effective_date"),
        F.trim(F.concat_ws(" ", _cell("description"), _cell("description2"))).alias("description"),
        kind.alias("transaction_type"),
        either(_cell("reference"), _cell("reference2")).alias("reference_number"),
        F.when(F.col("_is_debit").isNull(), F.col("_debit")).when(F.col("_is_debit"), F.col("_amount")).otherwise(zero).alias("debit"),
        F.when(F.col("_is_debit").isNull(), F.col("_credit")).when(F.col("_is_debit"), zero).otherwise(F.col("_amount")).alias("credit"),
        F.col("_balance").alias("balance"),
        _cell("branch").alias("branch_code"),
        _cell("teller").alias("teller"),
        info.alias("additional_info"),
        "bank_name",
        either(_cell("account"), F.coalesce("account_number", F.lit(""))).alias("account_number"),
        either(_cell("holder"), F.coalesce("account_holder", F.lit(""))).alias("account_holder"),
    )
    usable = F.col("_first").isNotNull() | F.col("_second").isNotNull()
    usable = usable & ~(F.col("strict") & (_cell("balance") == ""))
    # Unusable rows leave through inline(): a filter here would be pushed below the
    # parsing and have every date parsed twice.
    return parsed.select(F.inline(F.when(usable, F.array(fields))))


# --- generic rows -------------------------------------------------------------------------------


def parse_rows(cells: DataFrame, formats: DataFrame | None = None, year: Column | None = None) -> DataFrame:
    """Rows of unknown banks by width (4, 5 or 6 columns) and the two CIMB layouts.

    Every row comes out; what cannot be read scores a low ``confidence``.
    """
    rows = data_rows(cells)
    rows = rows.join(formats, "doc_id", "left") if formats is not None else rows.withColumn("format", F.lit(None).cast("string"))
    year = F.lit(None).cast("string") if year is None else year
    n, layout = F.size("cells"), F.col("format")
    one, two = layout == "format_1", layout == "format_2"
    cimb = layout.isNotNull()
    # Cell of each field: CIMB layout 1, CIMB layout 2, other tables by width.
    cells_of = {
        "date": (1, 0, {3: 0, 4: 0, 5: 0, 6: 0}),
        "words": (4, 2, {3: 1, 4: 1, 5: 1, 6: 1}),
        "debit": (5, 4, {4: 2, 5: 2, 6: 2}),
        "credit": (6, 5, {5: 3, 6: 3}),
        "balance": (7, 6, {4: 3, 5: 4, 6: 4}),
        "reference": (8, 3, {6: 5}),
    }

    def picked(field: str) -> Column:
        first, second, by_width = cells_of[field]
        out = F.when(one, F.get("cells", F.lit(first))).when(two, F.get("cells", F.lit(second)))
        if field in ("date", "words"):
            return out.when(n >= 3, F.get("cells", F.lit(by_width[3])))
        for width, position in by_width.items():
            out = out.when(~cimb & (n == width), F.get("cells", F.lit(position)))
        return out

    zero = F.lit(0).cast(money.MONEY)
    texts = rows.select(
        "doc_id",
        "page",
        "table_idx",
        "row_idx",
        layout,
        F.when(one, n < 7).when(two, n < 5).otherwise(n < 3).alias("_broken"),
        (~cimb & (n == 4)).alias("_inferred"),
        F.array_join("cells", " ").alias("_all"),
        *[picked(f).alias(f"t_{f}") for f in cells_of],
    )
    parsed = texts.select(
        "*",
        dates.cimb_date(F.col("t_date"), F.col("format"), year).alias("_date"),
        text.clean_cell(F.col("t_words")).alias("_words"),
        *[money.extract_amount(F.col(f"t_{f}")).alias(f"_{f}") for f in ("debit", "credit", "balance")],
        text.clean_cell(F.col("t_reference")).alias("_reference"),
    )
    # A single signed amount column: negative is money out.
    out_of = F.coalesce(F.col("_debit") < 0, F.lit(False))
    debit = F.when(F.col("_inferred"), F.when(out_of, F.abs("_debit").cast(money.MONEY)).otherwise(zero)).otherwise(F.col("_debit"))
    credit = F.when(F.col("_inferred"), F.when(out_of, zero).otherwise(F.col("_debit"))).otherwise(F.col("_credit"))
    signed = parsed.withColumns({"_d": debit, "_c": credit})
    broken = F.col("_broken")
    score = text.row_completeness(F.col("_date"), F.col("_words"), F.col("_d"), F.col("_c"), F.col("_balance"))
    return signed.select(
        "doc_id",
        "page",
        "table_idx",
        "row_idx",
        F.when(~broken, F.col("_date")).alias("tanggal"),
        F.when(broken, F.col("_all")).otherwise(F.col("_words")).alias("keterangan"),
        F.when(broken, zero).otherwise(F.coalesce("_d", zero)).alias("debet"),
        F.when(broken, zero).otherwise(F.coalesce("_c", zero)).alias("kredit"),
        F.when(~broken, F.col("_balance")).alias("saldo"),
        F.when(broken, F.lit("")).otherwise(F.col("_reference")).alias("referensi"),
        F.when(broken, 0.0).otherwise(score).alias("confidence"),
    )


def confidence_bands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Parsed rows by confidence: above .90, .70 to .90, below .70, with shares."""
    c = F.col("confidence")
    total = F.count(F.lit(1))
    high, low = F.count_if(c > 0.90), F.count_if(c < 0.70)
    return rows.groupBy(*keys).agg(
        total.alias("total"),
        high.alias("high_confidence"),
        F.count_if(c.between(0.70, 0.90)).alias("medium_confidence"),
        low.alias("low_confidence"),
        (high.cast("double") / total * 100).alias("high_conf_percentage"),
        (low.cast("double") / total * 100).alias("low_conf_percentage"),
    )


# --- text without tables ----------------------------------------------------------------------------

# Shapes of transaction lines.
BCA_LINE = r"(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})\s+(.+?)\s+(\d{3})\s+([\d,.-]+(?:\.\d{2})?)\s+([\d,.-]+(?:\.\d{2})?)"
CIMB_LINE_1 = r"(\d{2}/\d{2}/\d{2}\s+\d{2}:\d{2}).*?(?:(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s+)?(?:(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s+)?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"
CIMB_LINE_2 = r"(\d{2}/\d{2})(?:/\d{2,4})?\s+(.*?)\s+(?:(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s+)?(?:(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s+)?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"


def lines_of(docs: DataFrame, column: str = "text") -> DataFrame:
    """One row per text line, numbered from 0."""
    return docs.select("doc_id", F.posexplode(F.split(column, "\n")).alias("line_no", "line"))


def bca_text_rows(docs: DataFrame) -> DataFrame:
    """Transactions in BCA statements that came without tables."""
    line = F.col("line")
    parts = [F.regexp_extract(line, BCA_LINE, i) for i in range(1, 6)]
    rows = lines_of(docs).filter(line.rlike(BCA_LINE))
    return (
        rows.select(
            "doc_id",
            "line_no",
            dates.parse_date(parts[0], LONG_DATES).alias("transaction_date"),
            F.trim(parts[1]).alias("description"),
            parts[2].alias("branch_code"),
            money.sides_by_mark(parts[3]).alias("s"),
            money.clean_amount(parts[4]).alias("balance"),
        )
        .filter(F.col("transaction_date").isNotNull())
        .select("doc_id", "line_no", "transaction_date", "description", "branch_code", "s.debit", "s.credit", "balance")
    )


# Line shapes of statements that came without tables.
COLUMNS_LINE = (
    r"(\d{1,2}[/.-]\d{1,2}(?:[/.-]\d{2,4})?)\s+(.+?)\s+([\d,.-]+(?:\.\d{2})?)\s+([\d,.-]+(?:\.\d{2})?)\s+([\d,.-]+(?:\.\d{2})?)"
)
FLAG_LINE = (
    r"(\d{1,2}[/.-]\d{1,2}(?:[/.-]\d{2,4})?)\s+(\w+)\s+(.+?)\s+([DC])\s+([\d,.-]+(?:\.\d{2})?)\s+([\d,.-]+(?:\.\d{2})?)"
)
# Banks whose lines have debit, credit and balance; the others have a code, a D/C flag, amount and balance.
COLUMNS_BANKS = ["BNI_V1", "BNI_V2", "BRI", "BSI_SYARIAH", "MANDIRI_V1", "MANDIRI_V2", "MUFG", "OCBC", "PERMATA"]
FLAG_BANKS = ["BCA_SYARIAH"]
BANK_NAMES = {layout["bank"]: layout["name"] for layout in LAYOUTS}


def bank_text_rows(docs: DataFrame, column: str = "text") -> DataFrame:
    """Transactions in texts of ``COLUMNS_BANKS`` and ``FLAG_BANKS``, by ``doc_id, bank_code``.

    Shapes are looked for in the whole text, as one may run over a line break.  Rows without a
    readable date drop out; ``place`` counts the shapes of a document from 0.
    """
    names = F.create_map(*[F.lit(x) for kv in BANK_NAMES.items() for x in kv])

    def found(pattern: str, banks: list[str], fields: list[str]) -> DataFrame:
        groups = [F.regexp_extract_all(column, F.lit(pattern), F.lit(n + 1)).alias(f) for n, f in enumerate(fields)]
        rows = docs.filter(F.col("bank_code").isin(banks)).select("doc_id", "bank_code", *groups)
        return rows.select("doc_id", "bank_code", F.posexplode(F.arrays_zip(*fields)).alias("place", "r"))

    def amount(name: str) -> Column:
        return money.clean_amount(F.col(f"r.{name}"))

    columns = found(COLUMNS_LINE, COLUMNS_BANKS, ["date", "words", "debit", "credit", "balance"])
    columns = columns.withColumns({"code": F.lit(""), "debit": amount("debit"), "credit": amount("credit")})
    flagged = found(FLAG_LINE, FLAG_BANKS, ["date", "code", "words", "flag", "amount", "balance"])
    sides = money.sides_by_flag(F.col("r.flag"), amount("amount"))
    flagged = flagged.withColumns({"code": F.col("r.code"), "debit": sides["debit"], "credit": sides["credit"]})
    out = None
    for rows in (columns, flagged):
        part = rows.select(
            "doc_id", "bank_code", F.element_at(names, F.col("bank_code")).alias("bank_name"), "place",
            dates.parse_date(F.col("r.date"), dates.STATEMENT_FORMATS).alias("transaction_date"),
            "code", F.trim("r.words").alias("description"), "debit", "credit", amount("balance").alias("balance"),
        )
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("transaction_date").isNotNull())


def cimb_text_format(docs: DataFrame) -> DataFrame:
    """Layout of a CIMB text by which line shape hits more often, at least twice."""
    line = F.col("line")
    hits = lines_of(docs).groupBy("doc_id").agg(
        F.count_if(line.rlike(CIMB_LINE_1)).alias("_one"), F.count_if(line.rlike(CIMB_LINE_2)).alias("_two")
    )
    one, two = F.col("_one"), F.col("_two")
    return hits.select(
        "doc_id", F.when((one > two) & (one >= 2), "format_1").when(two >= 2, "format_2").alias("format")
    )


def cimb_text_rows(docs: DataFrame, formats: DataFrame, year: Column, shortest: int = 0) -> DataFrame:
    """Transactions in CIMB texts; lines shorter than ``shortest`` characters are no rows."""
    line = F.trim("line")
    rows = lines_of(docs).join(formats, "doc_id").withColumn("line", line).filter(F.length("line") >= shortest)
    one, two = F.col("format") == "format_1", F.col("format") == "format_2"

    def part(n1: int | None, n2: int | None) -> Column:
        a = F.regexp_extract("line", CIMB_LINE_1, n1) if n1 else F.lit("")
        b = F.regexp_extract("line", CIMB_LINE_2, n2) if n2 else F.lit("")
        return F.when(one, a).otherwise(b)

    described = F.regexp_extract("line", r"\d{2}:\d{2}\s+(.*?)\s+\d{1,3}(?:,\d{3})*", 1)
    kept = rows.filter((one & F.col("line").rlike(CIMB_LINE_1)) | (two & F.col("line").rlike(CIMB_LINE_2)))
    return kept.select(
        "doc_id",
        "line_no",
        F.try_to_date(dates.cimb_date(part(1, 1), F.col("format"), year)).alias("transaction_date"),
        F.trim(F.when(one, described).otherwise(part(None, 2))).alias("description"),
        money.clean_amount(part(2, 3)).alias("debit"),
        money.clean_amount(part(3, 4)).alias("credit"),
        money.clean_amount(part(4, 5)).alias("balance"),
    ).filter(F.col("transaction_date").isNotNull())


# --- which bank ---------------------------------------------------------------------------------------


def bank_scores(docs: DataFrame, column: str = "text") -> DataFrame:
    """Keyword hits of every bank in every text, best share of its words first.

    The twelve banks are laid out and ordered per document in place, so texts are not
    shuffled; ``place`` counts from 1, earlier banks first on ties.
    """
    upper = docs.select("doc_id", F.upper(F.coalesce(column, F.lit(""))).alias("_text"))
    # Each word is looked for once: the scores below name the counted hits, not the searches.
    counts = [sum((F.col("_text").contains(w).cast("int") for w in words), F.lit(0)) for words in BANK_WORDS.values()]
    counted = upper.select("doc_id", *[hits.alias(f"_hits_{i}") for i, hits in enumerate(counts)])

    def score(code: str, priority: int, words: list[str]) -> Column:
        hits = F.col(f"_hits_{priority}")
        return F.struct(
            (-(hits.cast("double") / len(words) * 100)).alias("minus"),
            F.lit(priority).alias("priority"),
            F.lit(code).alias("bank_code"),
            hits.alias("keyword_matches"),
            F.lit(len(words)).alias("total_keywords"),
        )

    board = F.array(*[score(code, i, words) for i, (code, words) in enumerate(BANK_WORDS.items())])
    rows = counted.select("doc_id", F.posexplode(F.sort_array(board)).alias("_at", "_s"))
    return rows.select(
        "doc_id",
        (F.col("_at") + 1).alias("place"),
        "_s.bank_code",
        "_s.keyword_matches",
        "_s.total_keywords",
        F.abs("_s.minus").alias("match_percentage"),
        (F.col("_s.keyword_matches") > 0).alias("is_detected"),
    )


def detect_bank(docs: DataFrame, column: str = "text") -> DataFrame:
    """First bank, in order of precedence, with any word in the text; null when none."""
    upper = F.upper(F.coalesce(column, F.lit("")))
    found = None
    for code, words in BANK_WORDS.items():
        test = text.contains_any(upper, words)
        found = F.when(test, code) if found is None else found.when(test, code)
    return docs.select("doc_id", found.alias("bank_code"))


# Bank names looked for in a text, in order.
NAMED_BANKS = ["BCA", "Mandiri", "BNI", "BRI", "CIMB", "Permata", "BTN", "BSI", "Danamon"]


def text_metadata(docs: DataFrame, column: str = "text") -> DataFrame:
    """Bank name, account number and opening balance written in a statement's text."""
    c = F.col(column)
    bank = None
    for name in NAMED_BANKS:
        test = c.rlike(rf"(?i)\b{name}\b")
        bank = F.when(test, f"Bank {name}") if bank is None else bank.when(test, f"Bank {name}")
    # Where a text has the account, its holder and the opening balance.
    number = F.nullif(F.regexp_extract(c, r"\b\d{10,16}\b", 0), F.lit(""))
    labelled = F.regexp_extract(c, r"(?i)(?:REKENING|NO\s*REK|ACCOUNT)[:\s]*(\d{10,13})", 1)
    holder = F.regexp_extract(c, r"(?i)(?:NAMA|NAME|PEMILIK)[:\s]*([A-Z\s.&,]+?)(?:\n|REKENING|NO|ALAMAT)", 1)
    opening = money.extract_amount(F.regexp_extract(c, r"(?i)saldo[:\s]+([0-9.,]+)", 1))
    return docs.select(
        "doc_id",
        bank.otherwise("N/A").alias("bank_name"),
        F.coalesce(number, F.lit("N/A")).alias("account_number"),
        labelled.alias("labelled_account"),
        F.trim(holder).alias("account_holder"),
        F.coalesce(opening, F.lit(0).cast(money.MONEY)).alias("saldo_awal"),
    )
