"""Queries on balance chains, chunk validation, row quality and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from neraca.functions import dates, text
from neraca.operators import ledger, ordered
from neraca.plans.oracle import VIEWS
from neraca.plans.registry import query
from neraca.plans.scalar_queries import COMPLETE_DATE, MISREAD, TITLE, _clean_description, _P, _x, _MONTH_MAP
from neraca.sources.views import Views

KEYS = ["account"]
ORDER = ["ts", "row_idx"]

VIEWS.update(
    {
        "lg_rows": """
        SELECT *, (row_number() OVER (PARTITION BY account ORDER BY ts, row_idx) - 1) // 50 AS chunk,
               (row_number() OVER (PARTITION BY account ORDER BY ts, row_idx) - 1) % 50 AS idx FROM fx_ledger""",
        "lg_starts": """
        SELECT account, chunk, coalesce(lag(saldo_end) OVER (PARTITION BY account ORDER BY chunk), 0) AS saldo_start, saldo_end
        FROM (SELECT account, chunk, arg_max(saldo, idx) AS saldo_end FROM lg_rows GROUP BY 1, 2)""",
        "lg_chain": """
        SELECT r.*, s.saldo_start, s.saldo_end,
               s.saldo_start + sum(kredit - debet) OVER (PARTITION BY account, chunk ORDER BY idx ROWS UNBOUNDED PRECEDING) AS expected
        FROM lg_rows r JOIN lg_starts s USING (account, chunk)""",
        "lg_checked": """
        SELECT *, abs(expected - saldo) > 0.01 AS off,
               (CASE WHEN coalesce(keterangan, '') = '' THEN 1 ELSE 0 END + CASE WHEN saldo = 0 THEN 1 ELSE 0 END) AS lacks FROM lg_chain""",
        "lg_chunks": """
        SELECT account, chunk, count(*) AS rows, any_value(saldo_start) AS saldo_start, any_value(saldo_end) AS saldo_end,
               arg_max(expected, idx) AS expected_end, count(*) FILTER (off) AS broken_rows, sum(lacks)::BIGINT AS missing_fields,
               coalesce(string_agg('Txn ' || idx || ': Expected saldo ' || expected::DECIMAL(28,2) || ', got ' || saldo::DECIMAL(28,2), '; ' ORDER BY idx) FILTER (off), '') AS error_message,
               NOT arg_max(off, idx) AS saldo_match, count(*) FILTER (off) = 0 AND sum(lacks) = 0 AS is_valid
        FROM lg_checked GROUP BY 1, 2""",
        "fx_statement": """
        SELECT account, row_idx,
               CASE WHEN row_idx % 23 = 0 THEN 'N/A' WHEN row_idx % 29 = 0 THEN '32 foo bar' WHEN row_idx % 11 = 0 THEN strftime(tanggal, '%d/%m')
                    ELSE strftime(tanggal, '%d/%m/%Y') END AS tanggal,
               CASE WHEN row_idx % 31 = 0 THEN '' ELSE keterangan END AS keterangan,
               CASE WHEN row_idx % 37 = 0 THEN '12.00' WHEN kredit = 0 THEN '-' ELSE kredit::VARCHAR END AS kredit,
               CASE WHEN row_idx % 41 = 0 THEN '' WHEN debet = 0 THEN '' ELSE debet::VARCHAR END AS debet,
               CASE WHEN row_idx % 43 = 0 THEN 'N/A' WHEN row_idx % 47 = 0 THEN 'saldo?' ELSE saldo::VARCHAR END AS saldo
        FROM fx_ledger""",
    }
)


def statement(v: Views):
    """Ledger rows as text, with missing and unreadable cells."""
    n = F.col("row_idx")
    return v.ledger.select(
        "account",
        "row_idx",
        F.when(n % 23 == 0, "N/A")
        .when(n % 29 == 0, "32 foo bar")
        .when(n % 11 == 0, F.date_format("tanggal", "dd/MM"))
        .otherwise(F.date_format("tanggal", "dd/MM/yyyy"))
        .alias("tanggal"),
        F.when(n % 31 == 0, "").otherwise(F.col("keterangan")).alias("keterangan"),
        F.when(n % 37 == 0, "12.00").when(F.col("kredit") == 0, "-").otherwise(F.col("kredit").cast("string")).alias("kredit"),
        F.when((n % 41 == 0) | (F.col("debet") == 0), "").otherwise(F.col("debet").cast("string")).alias("debet"),
        F.when(n % 43 == 0, "N/A").when(n % 47 == 0, "saldo?").otherwise(F.col("saldo").cast("string")).alias("saldo"),
    )


def chunked(v: Views):
    return ledger.chunk_rows(v.ledger, KEYS, ORDER)


def chunks(v: Views):
    return ledger.validate_chunks(chunked(v), KEYS)


@query(
    "w1_expected_chain",
    """SELECT account, row_idx, (100 + sum(kredit - debet) OVER (PARTITION BY account ORDER BY ts, row_idx ROWS UNBOUNDED PRECEDING))::DOUBLE AS expected
       FROM fx_ledger""",
)
def w1_expected_chain(v: Views):
    return ledger.expected_chain(v.ledger_rows, KEYS, ORDER, F.lit(100)).select("account", "row_idx", "expected")


@query(
    "w2_chunk_validation",
    """SELECT account, chunk, rows, saldo_start::DOUBLE AS saldo_start, saldo_end::DOUBLE AS saldo_end, expected_end::DOUBLE AS expected_end,
              broken_rows, missing_fields, error_message, saldo_match, is_valid, NOT is_valid AS needs_review FROM lg_chunks""",
)
def w2_chunk_validation(v: Views):
    return chunks(v)


@query(
    "w3_previous_balance",
    """SELECT account, row_idx, previous_saldo::DOUBLE AS previous_saldo, coalesce(abs(previous_saldo + kredit - debet - saldo) > 1, false) AS is_mismatch
       FROM (SELECT *, lag(saldo) OVER (PARTITION BY account ORDER BY ts, row_idx) AS previous_saldo FROM fx_ledger)""",
)
def w3_previous_balance(v: Views):
    return ledger.previous_balance_check(v.ledger, KEYS, ORDER).select(
        "account", "row_idx", "previous_saldo", "is_mismatch"
    )


@query("w4_chunks", "SELECT account, row_idx, chunk, idx AS index, saldo_start::DOUBLE AS saldo_start FROM lg_chain")
def w4_chunks(v: Views):
    return chunked(v).select("account", "row_idx", "chunk", "index", "saldo_start")


@query(
    "w5_inter_chunk",
    """SELECT account, chunk, coalesce(abs(saldo_start - lag(saldo_end) OVER (PARTITION BY account ORDER BY chunk)) <= 0.01, true) AS inter_chunk_valid
       FROM (SELECT account, chunk, arg_min(saldo - (kredit - debet), idx) AS saldo_start, arg_max(saldo, idx) AS saldo_end FROM lg_rows GROUP BY 1, 2)""",
)
def w5_inter_chunk(v: Views):
    return ledger.inter_chunk_check(ledger.reported_chunks(chunked(v), KEYS), KEYS).select("account", "chunk", "inter_chunk_valid")


@query(
    "w6_closing_offset",
    """SELECT account, c::DOUBLE AS calculated_end, a::DOUBLE AS actual_end, (a - c)::DOUBLE AS difference,
              CASE WHEN abs(a - c) > 0.01 THEN 'saldo_offset' END AS type
       FROM (SELECT account, sum(kredit - debet) AS c, arg_max(saldo, {'t': ts, 'r': row_idx}) AS a FROM fx_ledger GROUP BY 1)""",
)
def w6_closing_offset(v: Views):
    return ledger.closing_offset(v.ledger, KEYS, ORDER)


# Confidence of a ledger row: how sure its extraction was, by event value.
_CONFIDENCE = "CASE WHEN keterangan = 'error' THEN 0.70 WHEN debet + kredit < 20 THEN 0.85 ELSE 1.00 END"


def with_confidence(df):
    return df.withColumn(
        "confidence",
        F.when(F.col("keterangan") == "error", 0.70).when(F.col("debet") + F.col("kredit") < 20, 0.85).otherwise(1.0),
    )


@query(
    "w7_review_flags",
    f"""SELECT account, chunk, is_valid, NOT is_valid OR mean_confidence < 0.9e0 AS needs_review
        FROM lg_chunks JOIN (SELECT account, chunk, sum(({_CONFIDENCE})::DECIMAL(6,4))::DOUBLE / count(*) AS mean_confidence FROM lg_rows GROUP BY 1, 2)
        USING (account, chunk)""",
)
def w7_review_flags(v: Views):
    rows = with_confidence(chunked(v))
    mean = rows.groupBy("account", "chunk").agg(
        (F.sum(F.col("confidence").cast("decimal(6,4)")).cast("double") / F.count(F.lit(1))).alias("mean_confidence")
    )
    return ledger.review_flags(ledger.validate_chunks(rows.drop("confidence"), KEYS), mean, KEYS).select(
        "account", "chunk", "is_valid", "needs_review"
    )


@query(
    "a8_statement_summary",
    """SELECT account, count(*) AS transaction_count, sum(debet)::DOUBLE AS total_debit, sum(kredit)::DOUBLE AS total_credit,
              arg_min(saldo, {'t': ts, 'r': row_idx})::DOUBLE AS opening_balance, arg_max(saldo, {'t': ts, 'r': row_idx})::DOUBLE AS closing_balance
       FROM fx_ledger GROUP BY account""",
)
def a8_statement_summary(v: Views):
    return ledger.statement_summary(v.ledger, KEYS, ORDER)


@query(
    "a9_whole_unit_summary",
    """SELECT account, count(*) AS total_transaksi, trunc(sum(debet))::BIGINT::VARCHAR AS total_debet, trunc(sum(kredit))::BIGINT::VARCHAR AS total_kredit,
              trunc(sum(kredit - debet))::BIGINT::VARCHAR AS net_change FROM fx_ledger GROUP BY account""",
)
def a9_whole_unit_summary(v: Views):
    return ledger.whole_unit_summary(v.ledger_rows, KEYS)


@query(
    "a12_validation_stats",
    """SELECT count(*) AS total_chunks, count(*) FILTER (is_valid) AS passed, count(*) FILTER (NOT is_valid) AS failed,
              count(*) FILTER (NOT is_valid) AS needs_review, count(*) FILTER (is_valid)::DOUBLE / count(*) * 100 AS pass_rate,
              count(*) FILTER (NOT is_valid)::DOUBLE / count(*) * 100 AS review_rate FROM lg_chunks""",
)
def a12_validation_stats(v: Views):
    return ledger.validation_stats(chunks(v))


@query(
    "a13_overall_confidence",
    f"""SELECT account, mean_confidence, pass_share, mean_confidence * 0.6e0 + pass_share * 0.4e0 AS overall_confidence
        FROM (SELECT account, sum(({_CONFIDENCE})::DECIMAL(6,4))::DOUBLE / count(*) AS mean_confidence FROM fx_ledger GROUP BY 1)
        JOIN (SELECT account, count(*) FILTER (is_valid)::DOUBLE / count(*) AS pass_share FROM lg_chunks GROUP BY 1) USING (account)""",
)
def a13_overall_confidence(v: Views):
    return ledger.overall_confidence(with_confidence(v.ledger_rows), chunks(v), KEYS)


@query(
    "f34_missing_fields",
    """SELECT account, row_idx, array_to_string(list_filter([CASE WHEN tanggal = '' THEN 'tanggal' END, CASE WHEN keterangan = '' THEN 'keterangan' END,
              CASE WHEN debet = '' THEN 'debet' END], lambda x: x IS NOT NULL), ',') AS missing FROM fx_statement""",
)
def f34_missing_fields(v: Views):
    fields = {n: F.col(n) for n in ("tanggal", "keterangan", "debet")}
    return statement(v).select("account", "row_idx", F.array_join(text.missing_fields(fields), ",").alias("missing"))


@query(
    "f32_row_completeness",
    """SELECT account, row_idx, CASE WHEN tanggal <> '' THEN 0.25e0 ELSE 0e0 END + CASE WHEN keterangan <> '' THEN 0.15e0 ELSE 0e0 END
              + CASE WHEN d IS NOT NULL OR k IS NOT NULL THEN 0.3e0 ELSE 0e0 END + CASE WHEN s IS NOT NULL THEN 0.3e0 ELSE 0e0 END AS confidence
       FROM (SELECT *, try_cast(debet AS DECIMAL(18,2)) AS d, try_cast(kredit AS DECIMAL(18,2)) AS k, try_cast(saldo AS DECIMAL(18,2)) AS s FROM fx_statement)""",
)
def f32_row_completeness(v: Views):
    def number(name):
        return F.col(name).try_cast("decimal(18,2)")

    return statement(v).select(
        "account",
        "row_idx",
        text.row_completeness(F.col("tanggal"), F.col("keterangan"), number("debet"), number("kredit"), number("saldo")).alias("confidence"),
    )


_KEY = f"""CASE WHEN regexp_matches(t, '{_P['dmy']}') THEN {_x(_P['dmy'], 3)}::INTEGER * 10000 + {_x(_P['dmy'], 2)}::INTEGER * 100 + {_x(_P['dmy'], 1)}::INTEGER
  WHEN regexp_matches(t, '{_P['dm']}') THEN 99990000 + {_x(_P['dm'], 2)}::INTEGER * 100 + {_x(_P['dm'], 1)}::INTEGER
  WHEN regexp_matches(u, '{_P['any']}') THEN coalesce(try_cast(nullif({_x(_P['any'], 3, 'u')}, '') AS INTEGER), 9999) * 10000
       + coalesce({_MONTH_MAP}[{_x(_P['any'], 2, 'u')}], '01')::INTEGER * 100 + {_x(_P['any'], 1, 'u')}::INTEGER
  ELSE 99991231 END"""

VIEWS.update(
    {
        "st_keyed": f"""
        SELECT * EXCLUDE (t, u), {_KEY} AS pos, try_cast({MISREAD.format(c='saldo')} AS DECIMAL(18,2)) AS num
        FROM (SELECT *, trim(tanggal) AS t, upper(trim(tanggal)) AS u FROM fx_statement)""",
        "st_quality": f"""
        SELECT *, tanggal IN ('', 'N/A') AS c1, NOT tanggal IN ('', 'N/A') AND pos = 99991231 AS c2, saldo IN ('', 'N/A', '-') AS c3,
               NOT saldo IN ('', 'N/A', '-') AND coalesce(num < 0, false) AS c4, NOT saldo IN ('', 'N/A', '-') AND num IS NULL AS c5,
               hk AND hd AS c6, NOT hk AND NOT hd AS c7,
               coalesce(NOT saldo IN ('', 'N/A', '-') AND abs(prev + ka - da - num) > 1, false) AS c8, keterangan IN ('', 'N/A') AS c9
        FROM (SELECT *, lag(num) OVER (PARTITION BY account ORDER BY pos, row_idx) AS prev,
                     NOT kredit IN ('-', '', 'N/A', '0') AS hk, NOT debet IN ('-', '', 'N/A', '0') AS hd,
                     CASE WHEN kredit IN ('', '-', 'N/A') THEN 0 ELSE try_cast({MISREAD.format(c='kredit')} AS DECIMAL(18,2)) END AS ka,
                     CASE WHEN debet IN ('', '-', 'N/A') THEN 0 ELSE try_cast({MISREAD.format(c='debet')} AS DECIMAL(18,2)) END AS da
              FROM st_keyed)""",
        "st_scored": """
        SELECT *, greatest(0e0, least(1e0, 1e0 - CASE WHEN c1 THEN 0.3e0 ELSE 0e0 END - CASE WHEN c2 THEN 0.2e0 ELSE 0e0 END - CASE WHEN c3 THEN 0.2e0 ELSE 0e0 END
              - CASE WHEN c4 THEN 0.1e0 ELSE 0e0 END - CASE WHEN c5 THEN 0.2e0 ELSE 0e0 END - CASE WHEN c6 THEN 0.3e0 ELSE 0e0 END - CASE WHEN c7 THEN 0.2e0 ELSE 0e0 END
              - CASE WHEN c8 THEN 0.15e0 ELSE 0e0 END - CASE WHEN c9 THEN 0.05e0 ELSE 0e0 END)) AS score,
              array_to_string(list_filter([CASE WHEN c1 THEN 'missing_date' END, CASE WHEN c2 THEN 'invalid_date' END, CASE WHEN c3 THEN 'missing_saldo' END,
              CASE WHEN c4 THEN 'negative_saldo' END, CASE WHEN c5 THEN 'invalid_saldo_format' END, CASE WHEN c6 THEN 'both_kredit_debet' END,
              CASE WHEN c7 THEN 'no_mutation' END, CASE WHEN c8 THEN 'saldo_mismatch' END, CASE WHEN c9 THEN 'missing_description' END], lambda x: x IS NOT NULL), ',') AS issues
        FROM st_quality""",
    }
)
_LABEL = f"CASE WHEN score >= 0.8e0 THEN '{ledger.QUALITY_HIGH}' WHEN score >= 0.5e0 THEN '{ledger.QUALITY_MEDIUM}' ELSE '{ledger.QUALITY_LOW}' END"


@query("f33_row_quality", f"SELECT account, row_idx, score, issues, {_LABEL} AS label FROM st_scored")
def f33_row_quality(v: Views):
    return ledger.validate_rows(statement(v), KEYS).select(
        "account", "row_idx", "score", F.array_join("issues", ",").alias("issues"), "label"
    )


@query(
    "a10_quality_summary",
    f"""SELECT account, count(*) AS total_transactions, sum(k)::DOUBLE AS total_kredit, sum(d)::DOUBLE AS total_debet, (sum(k) - sum(d))::DOUBLE AS net_change,
              sum(score::DECIMAL(6,4))::DOUBLE / count(*) AS avg_quality, count(*) FILTER (score >= 0.8e0)::DOUBLE / count(*) * 100 AS high_quality_pct
       FROM (SELECT *, CASE WHEN hk THEN coalesce(ka, 0) ELSE 0 END AS k, CASE WHEN hd THEN coalesce(da, 0) ELSE 0 END AS d FROM st_scored) GROUP BY account""",
)
def a10_quality_summary(v: Views):
    return ledger.quality_summary(ledger.validate_rows(statement(v), KEYS), KEYS)


@query(
    "t1_date_order",
    "SELECT account, row_idx, row_number() OVER (PARTITION BY account ORDER BY pos, row_idx) AS place, pos FROM st_keyed",
)
def t1_date_order(v: Views):
    rows = statement(v).withColumn("pos", ledger.date_position(F.col("tanggal")))
    return ordered.rank_rows(rows, KEYS, ["pos", "row_idx"], "place").select(
        "account", "row_idx", "place", "pos"
    )


# Overlapping page chunks repeat rows of a statement: every row also appears in the next chunk when row_idx % 5 = 0.
_OVERLAP = """SELECT *, row_idx // 100 AS chunk FROM fx_statement UNION ALL
              SELECT *, row_idx // 100 + 1 FROM fx_statement WHERE row_idx % 5 = 0"""


def overlapping(v: Views):
    rows = statement(v)
    first = rows.withColumn("chunk", F.floor(F.col("row_idx") / 100))
    return first.unionByName(first.filter("row_idx % 5 = 0").withColumn("chunk", F.col("chunk") + 1))


@query(
    "u2_merge_chunks",
    """SELECT account, chunk, row_idx, tanggal, debet, kredit, saldo FROM (SELECT *, row_number() OVER
       (PARTITION BY account, tanggal, debet, kredit, saldo ORDER BY chunk, row_idx) AS rn FROM overlap_rows) WHERE rn = 1""",
    {"overlap_rows": _OVERLAP},
)
def u2_merge_chunks(v: Views):
    return ledger.merge_chunks(overlapping(v), KEYS, ["chunk", "row_idx"]).select(
        "account", "chunk", "row_idx", "tanggal", "debet", "kredit", "saldo"
    )


def _clean_or_zero(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN '0' ELSE {MISREAD.format(c=c)} END"


@query(
    "u3_drop_repeats",
    f"""SELECT account, chunk, row_idx, mark FROM (SELECT *, row_number() OVER (PARTITION BY account, mark ORDER BY chunk, row_idx) AS rn FROM
        (SELECT *, tanggal || '_' || {_clean_or_zero('kredit')} || '_' || {_clean_or_zero('debet')} || '_' || {_clean_or_zero('saldo')} AS mark FROM overlap_rows))
        WHERE rn = 1""",
    {"overlap_rows": _OVERLAP},
)
def u3_drop_repeats(v: Views):
    rows = ledger.drop_repeats(overlapping(v), KEYS, ["chunk", "row_idx"])
    mark = text.fingerprint(F.col("tanggal"), F.col("kredit"), F.col("debet"), F.col("saldo"))
    return rows.select("account", "chunk", "row_idx", mark.alias("mark"))


@query(
    "a26_opening_and_closing",
    """SELECT account, arg_min(saldo_start, chunk)::DOUBLE AS saldo_awal, arg_max(saldo_end, chunk)::DOUBLE AS saldo_akhir FROM lg_chunks GROUP BY account""",
)
def a26_opening_and_closing(v: Views):
    named = chunks(v).select("account", "chunk", F.col("saldo_start").alias("saldo_awal"), F.col("saldo_end").alias("saldo_akhir"))
    return ledger.opening_and_closing(named, KEYS)


@query(
    "a20_statement_year",
    """SELECT n % 50 AS batch, CASE WHEN max(c) IS NULL THEN '1999' ELSE arg_max(y, {'c': c, 'y': -y::INTEGER}) END AS tahun FROM
       (SELECT row_idx % 50 AS n, nullif(regexp_extract(regexp_extract(txt, 'Periode: ([^\\n]+)', 1), '\\b(20\\d{2})\\b', 1), '') AS y, count(*) AS c
        FROM fx_papers GROUP BY 1, 2) WHERE y IS NOT NULL GROUP BY 1""",
)
def a20_statement_year(v: Views):
    from neraca.operators.documents import statement_year
    from neraca.sources.rendered import papers

    period = F.regexp_extract("txt", r"Periode: ([^\n]+)", 1)
    docs = papers(v).select((F.col("row_idx") % 50).alias("batch"), period.alias("periode"))
    return statement_year(docs, ["batch"], "1999")


@query(
    "s16_bank_export",
    f"""SELECT account, row_idx, completed AS tanggal, CASE WHEN nk IS NULL THEN kredit_x WHEN nk = 0 THEN '-' ELSE 'Rp ' || translate(format('{{:,}}', nk), ',', '.') END AS nilai_masuk,
              label AS kualitas, CASE WHEN c = '' THEN '' ELSE title END AS keterangan
        FROM (SELECT *, {_LABEL} AS label, {TITLE.format(c="CASE WHEN c = '' THEN keterangan ELSE c END")} AS title
              FROM (SELECT account, row_idx, score, keterangan, {_clean_description('keterangan')} AS c, kredit AS kredit_x,
                           CASE WHEN kredit IN ('-', '') THEN 0 ELSE trunc(try_cast(replace(kredit, '.', '') AS DECIMAL(20,2)))::BIGINT END AS nk,
                           {COMPLETE_DATE} AS completed
                    FROM (SELECT *, trim(tanggal) AS t, upper(trim(tanggal)) AS u, '2024' AS yr FROM ex_scored)))""",
    {
        "ex_statement": f"SELECT * EXCLUDE (t, u, yr) REPLACE ({COMPLETE_DATE} AS tanggal) FROM (SELECT *, trim(tanggal) AS t, upper(trim(tanggal)) AS u, '2024' AS yr FROM fx_statement)",
        "ex_first": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY account, tanggal, {_clean_or_zero('kredit')}, {_clean_or_zero('debet')}, {_clean_or_zero('saldo')}
                        ORDER BY row_idx) AS rn FROM ex_statement) WHERE rn = 1""",
        "ex_keyed": VIEWS["st_keyed"].replace("fx_statement", "ex_first"),
        "ex_quality": VIEWS["st_quality"].replace("st_keyed", "ex_keyed"),
        "ex_scored": VIEWS["st_scored"].replace("st_quality", "ex_quality"),
    },
)
def s16_bank_export(v: Views):
    from neraca.plans.export import bank_export

    return bank_export(statement(v), KEYS, F.lit("2024")).select(
        "account", "row_idx", "tanggal", "nilai_masuk", "kualitas", "keterangan"
    )
