"""Queries on statement layouts, generic rows, text fallback and bank detection.

The cells are rendered from known bank rows, so the twins state what must come back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from neraca.operators import statement
from neraca.plans.oracle import VIEWS
from neraca.plans.registry import query
from neraca.sources import rendered
from neraca.sources.views import Views

_NAMES = [
    "Bank BCA", "BCA Syariah", "BCA Syariah", "BCA Syariah", "Bank BNI", "Bank BNI", "Bank BNI", "Bank BRI",
    "Bank Syariah Indonesia", "Bank Syariah Indonesia", "CIMB Niaga", "CIMB Niaga", "Bank Mandiri", "Bank Mandiri",
    "Bank Mandiri", "MUFG Bank", "MUFG Bank", "MUFG Bank", "OCBC Bank", "Permata Bank", "Permata Bank",
]


def _of(values: dict[int, str], default: str) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


VIEWS.update(
    {
        "st_source": """
        SELECT row_idx, row_idx // 40 AS doc_id, (row_idx // 40) % 21 AS k, (row_idx % 40) // 10 + 1 AS page, row_idx % 10 + 1 AS row_no,
               tanggal AS d, (tanggal + 1)::DATE AS n, keterangan, debet, kredit, (debet + kredit + 1000000)::DECIMAL(18,2) AS saldo, account_number
        FROM fx_bank""",
        "st_standard": f"""
        SELECT doc_id, page, 0::BIGINT AS table_idx, row_no AS row_idx, k,
               {_of({5: 'n', 6: 'n', 10: 'make_date(2000 + year(n) % 100, month(n), day(n))', 11: "CASE WHEN row_idx % 2 = 0 THEN d ELSE make_date(2000, month(d), day(d)) END", 19: 'n', 20: 'n'}, 'd')} AS transaction_date,
               {_of({5: 'd', 10: 'make_date(2000 + year(d) % 100, month(d), day(d))', 11: "CASE WHEN row_idx % 2 = 0 THEN d ELSE make_date(2000, month(d), day(d)) END", 12: 'd', 15: 'd', 16: 'd', 17: 'd', 18: 'd', 19: 'd'}, 'NULL')} AS posting_date,
               {_of({1: 'n', 2: 'n', 5: 'n', 6: 'n', 10: 'make_date(2000 + year(n) % 100, month(n), day(n))', 11: 'n', 15: 'n', 16: 'n', 18: 'n', 19: 'n', 20: 'n'}, 'NULL')} AS effective_date,
               keterangan || CASE WHEN k = 1 THEN ' ekstra' ELSE '' END AS description,
               {_of({1: "'T01'", 2: "'T01'", 3: "'T01'", 13: "CASE WHEN debet > 0 THEN 'BIAYA TRX' ELSE 'SETOR TUNAI' END || ' - CAB'", 14: "CASE WHEN debet > 0 THEN 'BIAYA TRX' ELSE 'SETOR TUNAI' END", 15: "'TRX'", 16: "'TRX'", 19: "'TC'", 20: "'TC'"}, "''")} AS transaction_type,
               {_of({1: 'row_idx::VARCHAR', 2: 'row_idx::VARCHAR', 3: 'row_idx::VARCHAR', 5: 'row_idx::VARCHAR', 6: 'row_idx::VARCHAR', 8: 'row_idx::VARCHAR',
                     10: "CASE WHEN row_idx % 3 = 0 THEN 'CHQ' ELSE row_idx::VARCHAR END", 11: 'row_idx::VARCHAR', 12: 'row_idx::VARCHAR', 15: 'row_idx::VARCHAR', 16: 'row_idx::VARCHAR',
                     19: "CASE WHEN row_idx % 3 = 0 THEN 'CHQ7' ELSE row_idx::VARCHAR END", 20: 'row_idx::VARCHAR'}, "''")} AS reference_number,
               debet::DOUBLE AS debit, kredit::DOUBLE AS credit, saldo::DOUBLE AS balance,
               {_of({0: "'001'", 1: "'K01'", 2: "'K01'", 3: "'K01'", 5: "'B1'"}, "''")} AS branch_code,
               {_of({7: "'TL9'"}, "''")} AS teller,
               {_of({1: "'Jam: 10:15, User: u7, Status: OK'", 2: "'Jam: 10:15'", 3: "'Jam: 10:15'", 8: "'Time: 11:00'", 9: "'Time: 11:00'", 15: "'Bank Ref: BR5'", 19: "'Customer No: C55'"}, "''")} AS additional_info,
               {_NAMES}[k + 1] AS bank_name,
               CASE WHEN k = 13 THEN account_number ELSE '' END AS account_number, CASE WHEN k = 13 THEN 'PT MAJU' ELSE '' END AS account_holder
        FROM st_source""",
    }
)


def standard(v: Views):
    cells = rendered.statement_cells(v)
    formats = statement.cimb_formats(cells, rendered.statement_texts(v))
    return statement.normalize_statements(cells, formats, year=F.lit("2000"))


@query("x1_normalize_statements", "SELECT * EXCLUDE (k) FROM st_standard")
def x1_normalize_statements(v: Views):
    return standard(v)


_BANK_QUERIES = {
    "x2_bca": [0], "x3_bca_syariah": [1, 2, 3], "x4_bni_v1": [4], "x5_bni_v2": [5, 6], "x6_bri": [7], "x7_bsi_syariah": [8, 9],
    "x8_x9_cimb": [10, 11], "x11_mandiri_v1": [12], "x12_mandiri_v2": [13, 14], "x13_mufg": [15, 16, 17], "x14_ocbc": [18], "x15_permata": [19, 20],
}


def _bank_query(name: str, layouts: list[int]) -> None:
    bank = _NAMES[layouts[0]]
    listed = ", ".join(map(str, layouts))

    @query(
        name,
        f"""SELECT doc_id, count(*) AS rows, sum(debit::DECIMAL(18,2))::DOUBLE AS debit, sum(credit::DECIMAL(18,2))::DOUBLE AS credit,
                   min(transaction_date) AS first_day, max(transaction_date) AS last_day, count(DISTINCT additional_info) AS infos
            FROM st_standard WHERE k IN ({listed}) GROUP BY doc_id""",
    )
    def plan(v: Views):
        cells = rendered.statement_cells(v).filter(F.col("bank_code") == rendered._BANKS[layouts[0]])
        formats = statement.cimb_formats(cells, rendered.statement_texts(v))
        rows = statement.normalize_statements(cells, formats, year=F.lit("2000")).filter(F.col("bank_name") == bank)
        return rows.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("debit").alias("debit"),
            F.sum("credit").alias("credit"),
            F.min("transaction_date").alias("first_day"),
            F.max("transaction_date").alias("last_day"),
            F.countDistinct("additional_info").alias("infos"),
        )


for _name, _layouts in _BANK_QUERIES.items():
    _bank_query(_name, _layouts)


@query(
    "x10_cimb_format",
    "SELECT DISTINCT doc_id, CASE k WHEN 10 THEN 'format_1' ELSE 'format_2' END AS format FROM st_source WHERE k IN (10, 11) AND row_no = 1",
)
def x10_cimb_format(v: Views):
    return statement.cimb_formats(rendered.statement_cells(v), rendered.statement_texts(v))




@query(
    "x16_x17_generic_rows",
    """SELECT doc_id, page, 0::BIGINT AS table_idx, row_no AS row_idx, strftime(d, '%Y-%m-%d') AS tanggal, keterangan,
              debet::DOUBLE AS debet, kredit::DOUBLE AS kredit, saldo::DOUBLE AS saldo, CASE WHEN row_idx % 2 = 0 THEN '' ELSE 'REF-' || row_idx END AS referensi,
              0.25e0 + 0.15e0 + 0.3e0 + 0.3e0 AS confidence
       FROM st_source
       UNION ALL
       SELECT doc_id, page, 1, row_no, NULL, 'catatan ' || row_idx, 0, 0, NULL, '', 0e0 FROM st_source WHERE row_idx % 7 = 0
       UNION ALL
       SELECT doc_id, page, 2, row_no, strftime(d, '%Y-%m-%d'), keterangan, CASE WHEN debet > 0 THEN debet ELSE 0 END::DOUBLE,
              CASE WHEN debet > 0 THEN 0 ELSE kredit END::DOUBLE, saldo::DOUBLE, '', 0.25e0 + 0.15e0 + 0.3e0 + 0.3e0 FROM st_source WHERE row_idx % 3 = 0
       UNION ALL
       SELECT doc_id, page, 3, row_no, NULL, keterangan, 0, 0, NULL, '', 0e0 + 0.15e0 FROM st_source WHERE row_idx % 11 = 0""",
)
def x16_x17_generic_rows(v: Views):
    return statement.parse_rows(generic_cells(v))


def generic_cells(v: Views):
    """Tables of 5 or 6 columns, two-cell notes, 4-column tables and unknown widths."""
    s = rendered.statement_source(v)
    day = F.date_format("day", "dd/MM/yyyy")
    row, amount = F.col("row_idx"), rendered.id_amount

    def table(number: int, rows, cells):
        return rows.select(
            "doc_id", F.lit("GENERIC").alias("bank_code"), "page", F.lit(number).alias("table_idx"), F.col("row_no").alias("row_idx"), cells.alias("cells")
        )

    five = [day, F.concat(F.lit("  "), F.col("keterangan"), F.lit("!")), amount(F.col("debet")), amount(F.col("kredit")), amount(F.col("saldo"))]
    six = [*five, F.concat(F.lit("REF-"), row.cast("string"))]
    signed = F.when(F.col("debet") > 0, F.concat(F.lit("("), amount(F.col("debet")), F.lit(")"))).otherwise(amount(F.col("kredit")))
    blank = F.array(F.lit(""), F.lit("  "))
    return (
        table(0, s, F.when(row % 2 == 0, F.array(*five)).otherwise(F.array(*six)))
        .unionByName(table(1, s.filter("row_idx % 7 = 0"), F.array(F.lit("catatan"), row.cast("string"))))
        .unionByName(table(2, s.filter("row_idx % 3 = 0"), F.array(day, F.col("keterangan"), signed, amount(F.col("saldo")))))
        .unionByName(table(3, s.filter("row_idx % 11 = 0"), F.array(F.lit("?"), F.col("keterangan"), F.lit("9"))))
        .unionByName(table(4, s.filter("row_idx % 13 = 0"), blank))
    )


@query(
    "a11_confidence_bands",
    """SELECT doc_id, count(*) AS total, count(*) FILTER (c > 0.9e0) AS high_confidence, count(*) FILTER (c BETWEEN 0.7e0 AND 0.9e0) AS medium_confidence,
              count(*) FILTER (c < 0.7e0) AS low_confidence, count(*) FILTER (c > 0.9e0)::DOUBLE / count(*) * 100 AS high_conf_percentage,
              count(*) FILTER (c < 0.7e0)::DOUBLE / count(*) * 100 AS low_conf_percentage
       FROM (SELECT doc_id, 1e0 AS c FROM st_source UNION ALL SELECT doc_id, 0 FROM st_source WHERE row_idx % 7 = 0
             UNION ALL SELECT doc_id, 1 FROM st_source WHERE row_idx % 3 = 0 UNION ALL SELECT doc_id, 0.15e0 FROM st_source WHERE row_idx % 11 = 0)
       GROUP BY doc_id""",
)
def a11_confidence_bands(v: Views):
    return statement.confidence_bands(statement.parse_rows(generic_cells(v)), ["doc_id"])


@query(
    "j11_page_counts",
    """SELECT p.doc_id, p.page, count(c.row_no) AS transaction_count, count(c.row_no) > 0 AS has_data
       FROM (SELECT DISTINCT doc_id, page FROM st_source) p LEFT JOIN (SELECT *, CASE WHEN page = 2 THEN 1002 ELSE page END AS moved FROM st_source) c ON c.doc_id = p.doc_id AND c.moved = p.page GROUP BY 1, 2""",
)
def j11_page_counts(v: Views):
    from neraca.operators.documents import page_counts

    s = rendered.statement_source(v)
    # The rows of every second page belong to a page that isn't listed, so that page has no data.
    moved = s.withColumn("page", F.when(F.col("page") == 2, 1002).otherwise(F.col("page")))
    return page_counts(s.select("doc_id", "page").distinct(), moved)


@query(
    "s11_w11_absolute_pages",
    """SELECT doc_id, chunk, page, page + before AS page_number, 1::BIGINT AS tables FROM
       (SELECT DISTINCT doc_id // 10 AS doc_id, doc_id % 10 AS chunk, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS page FROM st_source)
       JOIN (SELECT doc_id, chunk, coalesce(sum(pages) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
             FROM (SELECT doc_id // 10 AS doc_id, doc_id % 10 AS chunk, count(DISTINCT page) AS pages FROM st_source GROUP BY 1, 2)) USING (doc_id, chunk)""",
)
def s11_w11_absolute_pages(v: Views):
    from neraca.operators.documents import absolute_pages, explode_tables

    rows = explode_tables(ocr_documents(v), ["doc_id", "chunk"])
    pages = rows.select("doc_id", "chunk", "page", "table_idx").distinct()
    sizes = pages.groupBy("doc_id", "chunk").agg(F.countDistinct("page").alias("pages"))
    return (
        absolute_pages(pages, sizes, ["doc_id"])
        .groupBy("doc_id", "chunk", "page", "page_number")
        .agg(F.count(F.lit(1)).alias("tables"))
    )


def ocr_documents(v: Views):
    """Nested pages, tables, rows and cells, one record per chunk of a document."""
    s = rendered.statement_source(v)
    row = F.struct(
        F.array(F.struct(F.date_format("day", "dd/MM/yyyy").alias("text")), F.struct(F.col("keterangan").alias("text"))).alias("cells")
    )
    pages = s.groupBy("doc_id", "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", row.alias("row")))), lambda r: r["row"]).alias("rows")
    )
    table = F.array(F.struct(F.col("rows")))
    return pages.groupBy((F.floor(F.col("doc_id") / 10)).alias("doc_id"), (F.col("doc_id") % 10).alias("chunk")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("page", table.alias("tables")))), lambda p: F.struct(p["tables"].alias("tables"))
        ).alias("pages")
    )


@query(
    "s11_table_rows",
    """SELECT doc_id // 10 AS doc_id, doc_id % 10 AS chunk, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS page, 0::BIGINT AS table_idx,
              row_number() OVER (PARTITION BY doc_id, page ORDER BY row_no) - 1 AS row_idx, strftime(d, '%d/%m/%Y') || '|' || keterangan AS cells FROM st_source""",
)
def s11_table_rows(v: Views):
    from neraca.operators.documents import explode_tables

    rows = explode_tables(ocr_documents(v), ["doc_id", "chunk"])
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query(
    "x18_bca_text",
    """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) AS line_no, d AS transaction_date, 'PEMBAYARAN INV-' || row_idx AS description, '001' AS branch_code,
              debet::DOUBLE AS debit, kredit::DOUBLE AS credit, saldo::DOUBLE AS balance FROM st_source""",
)
def x18_bca_text(v: Views):
    return statement.bca_text_rows(rendered.bca_texts(v))


# Fixed values, written out again: the twin doesn't take them from the operator.
_TEXT_BANKS = {
    "BCA_SYARIAH": "BCA Syariah", "BNI_V1": "Bank BNI", "BNI_V2": "Bank BNI", "BRI": "Bank BRI", "BSI_SYARIAH": "Bank Syariah Indonesia",
    "MANDIRI_V1": "Bank Mandiri", "MANDIRI_V2": "Bank Mandiri", "MUFG": "MUFG Bank", "OCBC": "OCBC Bank", "PERMATA": "Permata Bank",
}


def _bank_text_query(bank: str, name: str) -> None:
    flagged = bank == "BCA_SYARIAH"

    @query(
        f"x18_{bank.lower()}_text",
        f"""SELECT doc_id, '{name}' AS bank_name, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) - 1 AS place, d AS transaction_date,
                   '{"TRF" if flagged else ""}' AS code, 'PEMBAYARAN INV-' || row_idx AS description,
                   debet::DOUBLE AS debit, kredit::DOUBLE AS credit, saldo::DOUBLE AS balance FROM st_source""",
    )
    def plan(v: Views):
        return statement.bank_text_rows(rendered.bank_texts(v, bank, flagged)).drop("bank_code")


for _bank, _name in _TEXT_BANKS.items():
    _bank_text_query(_bank, _name)


@query(
    "x18_cimb_text",
    r"""SELECT doc_id, line_no, strptime(CASE WHEN doc_id % 2 = 0 THEN '20' || substr(line, 7, 2) || '-' || substr(line, 1, 2) || '-' || substr(line, 4, 2)
                 ELSE '2000-' || substr(line, 4, 2) || '-' || substr(line, 1, 2) END, '%Y-%m-%d')::DATE AS transaction_date,
              CASE WHEN doc_id % 2 = 0 THEN 'Transfer Masuk' ELSE 'Transfer Keluar' END AS description,
              (debet + 1)::DOUBLE AS debit, (kredit + 1)::DOUBLE AS credit, saldo::DOUBLE AS balance
       FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) AS line_no,
                    CASE WHEN doc_id % 2 = 0 THEN strftime(d, '%m/%d/%y') ELSE strftime(d, '%d/%m') END AS line FROM st_source)""",
)
def x18_cimb_text(v: Views):
    docs = rendered.cimb_texts(v)
    known = F.when(F.col("doc_id") % 2 == 0, "format_1").otherwise("format_2")
    return statement.cimb_text_rows(docs, docs.select("doc_id", known.alias("format")), F.lit("2000"))


@query(
    "x18_cimb_text_format",
    # A line of the first layout also has the shape of the second, so the first never wins.
    "SELECT doc_id, CASE WHEN count(*) >= 2 THEN 'format_2' END AS format FROM st_source GROUP BY doc_id",
)
def x18_cimb_text_format(v: Views):
    return statement.cimb_text_format(rendered.cimb_texts(v))


_ALL_WORDS = "[" + ", ".join(
    f"{{'bank_code': '{code}', 'words': {words}}}" for code, words in statement.BANK_WORDS.items()
) + "]"


@query(
    "a24_t7_bank_scores",
    f"""SELECT doc_id, b.bank_code AS bank_code, m AS keyword_matches, len(b.words) AS total_keywords, m::DOUBLE / len(b.words) * 100 AS match_percentage, m > 0 AS is_detected,
               row_number() OVER (PARTITION BY doc_id ORDER BY m::DOUBLE / len(b.words) * 100 DESC, p) AS place
        FROM (SELECT doc_id, p, b, len(list_filter(b.words, lambda w: contains(t, w))) AS m
              FROM (SELECT row_idx AS doc_id, upper(txt) AS t, unnest({_ALL_WORDS}) AS b, unnest(range(0, {len(statement.BANK_WORDS)})) AS p FROM fx_papers))""",
)
def a24_t7_bank_scores(v: Views):
    docs = rendered.papers(v).select(F.col("row_idx").alias("doc_id"), F.col("txt").alias("text"))
    return statement.bank_scores(docs)


@query(
    "f38_detect_bank",
    "SELECT row_idx AS doc_id, CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(upper(txt), '{w}')" for w in words) + f" THEN '{code}'"
        for code, words in statement.BANK_WORDS.items()
    )
    + " END AS bank_code FROM fx_papers",
)
def f38_detect_bank(v: Views):
    docs = rendered.papers(v).select(F.col("row_idx").alias("doc_id"), F.col("txt").alias("text"))
    return statement.detect_bank(docs)


@query(
    "f39_text_metadata",
    "SELECT row_idx AS doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(txt, '(?i)\\b{b}\\b') THEN 'Bank {b}'" for b in statement.NAMED_BANKS)
    + r""" ELSE 'N/A' END AS bank_name, coalesce(nullif(regexp_extract(txt, '\b\d{10,16}\b'), ''), 'N/A') AS account_number,
       regexp_extract(txt, '(?i)(?:REKENING|NO\s*REK|ACCOUNT)[:\s]*(\d{10,13})', 1) AS labelled_account,
       trim(regexp_extract(txt, '(?i)(?:NAMA|NAME|PEMILIK)[:\s]*([A-Z\s.&,]+?)(?:\n|REKENING|NO|ALAMAT)', 1)) AS account_holder,
       total::DOUBLE AS saldo_awal FROM fx_papers JOIN fx_invoice USING (row_idx)""",
)
def f39_text_metadata(v: Views):
    docs = rendered.papers(v).select(F.col("row_idx").alias("doc_id"), F.col("txt").alias("text"))
    return statement.text_metadata(docs)
