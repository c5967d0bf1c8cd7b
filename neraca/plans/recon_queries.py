"""Queries on splitting, matching and the reconciliation summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from neraca.functions import score
from neraca.functions.ids import normalize_vendor
from neraca.operators import match, split, summary
from neraca.plans import export
from neraca.plans.oracle import VIEWS
from neraca.plans.reconcile import reconcile
from neraca.plans.registry import query
from neraca.sources.views import Views

# --- shared SQL -----------------------------------------------------------------------

VIEWS.update(
    {
        "m_ac": """
        SELECT a.scope, a.npwp, a.row_idx AS a_idx, c.row_idx AS c_idx, 1e0 AS confidence
        FROM (SELECT npwp_penjual AS scope, npwp_pembeli AS npwp, row_idx,
                     row_number() OVER (PARTITION BY npwp_penjual, npwp_pembeli ORDER BY row_idx) AS rn
              FROM fx_invoice) a
        JOIN (SELECT npwp_dipotong AS scope, npwp_pemotong AS npwp, row_idx,
                     row_number() OVER (PARTITION BY npwp_dipotong, npwp_pemotong ORDER BY row_idx) AS rn
              FROM fx_withholding WHERE npwp_pemotong <> '') c USING (scope, npwp, rn)""",
        "cand_be": """
        SELECT *, date_score * 0.6e0 + amount_score * 0.4e0 AS confidence FROM (
          SELECT *, CASE WHEN gap <= 7 THEN 1e0 - gap / 7e0 ELSE 0e0 END AS date_score,
                 CASE WHEN pct <= 5 THEN 1e0 - pct / 5e0 ELSE 0e0 END AS amount_score
          FROM (SELECT b.npwp_pembeli AS scope, b.row_idx AS b_idx, e.row_idx AS e_idx,
                       abs(b.tanggal - e.tanggal)::BIGINT AS gap,
                       abs(b.total::DOUBLE - e.debet::DOUBLE) / abs(b.total::DOUBLE) * 100 AS pct
                FROM fx_invoice b JOIN fx_bank e ON e.account_number = b.npwp_pembeli
                WHERE b.total <> 0 AND e.debet <> 0 AND abs(b.tanggal - e.tanggal) <= 5))
        WHERE date_score * 0.6e0 + amount_score * 0.4e0 >= 0.5e0""",
        "be_lists": """
        SELECT scope, b_idx, row_number() OVER (PARTITION BY scope ORDER BY b_idx) AS n, cands
        FROM (SELECT scope, b_idx, list({'e': e_idx, 'c': confidence} ORDER BY confidence DESC, e_idx) AS cands
              FROM cand_be GROUP BY scope, b_idx)""",
        "be_walk": """
        SELECT DISTINCT scope, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS b_idx,
               NULL::BIGINT AS e_idx, NULL::DOUBLE AS confidence FROM be_lists
        UNION ALL
        SELECT scope, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.e) END, b_idx, pick.e, pick.c
        FROM (SELECT w.scope, l.n, w.used, l.b_idx,
                     list_filter(l.cands, lambda x: NOT list_contains(w.used, x.e))[1] AS pick
              FROM be_walk w JOIN be_lists l ON l.scope = w.scope AND l.n = w.n + 1)""",
        "m_be": """
        SELECT scope, b_idx, e_idx, confidence,
               CASE WHEN confidence >= 0.7e0 THEN 'auto' ELSE 'suggested' END AS match_type
        FROM be_walk WHERE e_idx IS NOT NULL""",
        "pair_ac": """
        SELECT *, (date_confidence + amount_confidence) / 2 AS confidence FROM (
          SELECT *, 1e0 - gap / 7e0 * 0.3e0 AS date_confidence, 1e0 - pct / 2e0 * 0.3e0 AS amount_confidence
          FROM (SELECT a.npwp_penjual AS scope, a.npwp_pembeli AS npwp, a.row_idx AS l_idx, c.row_idx AS r_idx,
                       abs(a.tanggal - c.tanggal)::BIGINT AS gap,
                       abs((a.dpp::DOUBLE - c.bruto::DOUBLE) / greatest(a.dpp::DOUBLE, c.bruto::DOUBLE)) * 100 AS pct
                FROM fx_invoice a JOIN fx_withholding c
                  ON c.npwp_dipotong = a.npwp_penjual AND c.npwp_pemotong = a.npwp_pembeli
                WHERE a.dpp <> 0 AND c.bruto <> 0)
          WHERE gap <= 7 AND pct <= 2)
        WHERE (date_confidence + amount_confidence) / 2 >= 0.7e0""",
        "pair_be": """
        SELECT *, (date_confidence + amount_confidence) / 2 AS confidence FROM (
          SELECT *, 1e0 - gap / 7e0 * 0.3e0 AS date_confidence, 1e0 - pct / 2e0 * 0.3e0 AS amount_confidence
          FROM (SELECT b.npwp_pembeli AS scope, b.row_idx AS l_idx, e.row_idx AS r_idx,
                       abs(b.tanggal - e.tanggal)::BIGINT AS gap,
                       abs((b.total::DOUBLE - e.debet::DOUBLE) / greatest(b.total::DOUBLE, e.debet::DOUBLE)) * 100 AS pct
                FROM fx_invoice b JOIN fx_bank e ON e.account_number = b.npwp_pembeli
                WHERE b.total <> 0 AND e.debet > 0)
          WHERE gap <= 7 AND pct <= 2)
        WHERE (date_confidence + amount_confidence) / 2 >= 0.7e0""",
    }
)

_COMPANY = """(SELECT npwp_penjual FROM fx_invoice GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


def sales(v: Views):
    return v.invoice.withColumn("scope", F.col("npwp_penjual"))


def purchases(v: Views):
    return v.invoice.withColumn("scope", F.col("npwp_pembeli"))


def slips(v: Views):
    return v.withholding.withColumn("scope", F.col("npwp_dipotong"))


def statements(v: Views):
    return v.bank.withColumn("scope", F.col("account_number"))


# --- company, split, duplicates ------------------------------------------------------------


@query(
    "a1_company_npwp",
    "SELECT npwp_penjual AS company_npwp, count(*) AS invoices FROM fx_invoice GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
)
def a1_company_npwp(v: Views):
    return split.company_npwp(v.invoice)


# Lines of an order by the same supplier stand for repeated uploads of one document.
_UPLOADS = """SELECT l_orderkey * 1000 + l_suppkey AS doc_no, l_orderkey AS batch,
                     l_linenumber * 1000000 + l_partkey AS row_idx, l_quantity AS quantity,
                     round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem"""


def uploads(v: Views):
    return v.table("lineitem").select(
        (F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("doc_no"),
        F.col("l_orderkey").alias("batch"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("row_idx"),
        F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )


@query(
    "a2_keep_first",
    """SELECT doc_no, batch, row_idx, quantity, cents FROM (SELECT *, row_number() OVER
       (PARTITION BY doc_no ORDER BY row_idx, quantity, cents) AS rn FROM uploads) WHERE rn = 1""",
    {"uploads": _UPLOADS},
)
def a2_keep_first(v: Views):
    return split.keep_first(uploads(v), ["doc_no"], ["row_idx", "quantity", "cents"])


@query(
    "a2_duplicate_report",
    """SELECT doc_no, row_idx, cents FROM (SELECT *, min(row_idx) OVER (PARTITION BY doc_no) AS f FROM uploads)
       WHERE row_idx > f""",
    {"uploads": _UPLOADS},
)
def a2_duplicate_report(v: Views):
    return split.repeated_rows(uploads(v), ["doc_no"]).select("doc_no", "row_idx", "cents")


@query(
    "p3_split_points",
    f"""SELECT row_idx, npwp_penjual = {_COMPANY} AS is_a, npwp_pembeli = {_COMPANY} AS is_b, total::DOUBLE AS total
        FROM fx_invoice WHERE npwp_penjual = {_COMPANY} OR npwp_pembeli = {_COMPANY}""",
)
def p3_split_points(v: Views):
    company = split.company_npwp(v.invoice).select("company_npwp").scalar()
    flagged = split.split_points(split.keep_first(v.invoice, ["nomor_faktur"]), company)
    return flagged.filter("is_a or is_b").select("row_idx", "is_a", "is_b", "total")


@query(
    "p3_split_all_companies",
    """SELECT scope, sum(a) AS point_a, sum(b) AS point_b FROM (
         SELECT npwp_penjual AS scope, 1 AS a, 0 AS b FROM fx_invoice
         UNION ALL SELECT npwp_pembeli, 0, 1 FROM fx_invoice
           WHERE npwp_pembeli IN (SELECT npwp_penjual FROM fx_invoice)) GROUP BY scope""".replace(
        "sum(a)", "sum(a)::BIGINT"
    ).replace("sum(b)", "sum(b)::BIGINT"),
)
def p3_split_all_companies(v: Views):
    companies = v.invoice.select(F.col("npwp_penjual").alias("company_npwp"))
    a, b = split.split_points_for(v.invoice, companies)
    tagged = a.select("scope", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select("scope", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return tagged.groupBy("scope").agg(F.sum("a").alias("point_a"), F.sum("b").alias("point_b"))


@query(
    "p4_split_single",
    f"""SELECT point, count(*) AS invoices, sum(total)::DOUBLE AS total FROM (
          SELECT total, CASE WHEN npwp_penjual = {_COMPANY} THEN 'A' WHEN npwp_pembeli = {_COMPANY} THEN 'B'
                 ELSE 'none' END AS point FROM fx_invoice) GROUP BY point""",
)
def p4_split_single(v: Views):
    company = split.company_npwp(v.invoice).select("company_npwp").scalar()
    return (
        split.split_single(v.invoice, company)
        .groupBy("point")
        .agg(F.count(F.lit(1)).alias("invoices"), F.sum("total").alias("total"))
    )


@query("p5_debit_rows", "SELECT row_idx, account_number, debet::DOUBLE AS debet FROM fx_bank WHERE debet > 0")
def p5_debit_rows(v: Views):
    return match.debit_rows(v.bank).select("row_idx", "account_number", "debet")


@query(
    "p6_eligible_rows",
    """SELECT 'b' AS side, row_idx, tanggal, total::DOUBLE AS amount FROM fx_invoice WHERE tanggal IS NOT NULL AND total <> 0
       UNION ALL SELECT 'e', row_idx, tanggal, debet::DOUBLE FROM fx_bank WHERE tanggal IS NOT NULL AND debet <> 0""",
)
def p6_eligible_rows(v: Views):
    b, e = match.payment_sides(purchases(v), statements(v), ["scope"])
    return b.select(F.lit("b").alias("side"), F.col("b_idx").alias("row_idx"), F.col("b_date").alias("tanggal"), F.col("b_amount").alias("amount")).unionByName(
        e.select(F.lit("e").alias("side"), F.col("e_idx").alias("row_idx"), F.col("e_date").alias("tanggal"), F.col("e_amount").alias("amount"))
    )


# --- matching -------------------------------------------------------------------------------


@query("j1_match_invoices_slips", "SELECT scope, npwp, a_idx, c_idx, confidence FROM m_ac")
def j1_match_invoices_slips(v: Views):
    return match.pair_by_key(sales(v), slips(v), "npwp_pembeli", "npwp_pemotong")


@query(
    "j2_payment_candidates",
    """SELECT scope, b_idx, e_idx, gap AS date_diff_days, date_score, amount_score, confidence,
              CASE WHEN confidence >= 0.7e0 THEN 'auto' ELSE 'suggested' END AS match_type FROM cand_be""",
)
def j2_payment_candidates(v: Views):
    return match.payment_candidates(purchases(v), statements(v)).select(
        "scope", "b_idx", "e_idx", "date_diff_days", "date_score", "amount_score", "confidence", "match_type"
    )


@query("j2_match_payments", "SELECT scope, b_idx, e_idx, confidence, match_type FROM m_be")
def j2_match_payments(v: Views):
    return match.match_payments(purchases(v), statements(v))


@query("j2_match_payments_in_bands", "SELECT scope, b_idx, e_idx, confidence, match_type FROM m_be")
def j2_match_payments_in_bands(v: Views):
    """The way large islands go, for every row."""
    return match.match_payments(purchases(v), statements(v), fold_pairs=0)


@query(
    "j2_match_payments_by_amount",
    """SELECT scope, b_idx, e_idx, confidence, CASE WHEN confidence >= 0.7e0 THEN 'auto' ELSE 'suggested' END AS match_type
       FROM amt_walk WHERE e_idx IS NOT NULL""",
    {
        "amt_lists": """
        SELECT scope, b_idx, row_number() OVER (PARTITION BY scope ORDER BY b_idx) AS n, cands
        FROM (SELECT scope, b_idx, list({'e': e_idx, 'c': confidence} ORDER BY confidence DESC, e_idx) AS cands
              FROM cand_be WHERE pct <= 5 GROUP BY scope, b_idx)""",
        "amt_walk": VIEWS["be_walk"].replace("be_lists", "amt_lists").replace("be_walk", "amt_walk"),
    },
)
def j2_match_payments_by_amount(v: Views):
    return match.match_payments(purchases(v), statements(v), require_amount=True)


@query(
    "j3_score_invoices_slips",
    """SELECT scope, l_idx, r_idx, date_confidence, amount_confidence, confidence,
              CASE WHEN confidence >= 0.95e0 THEN 'exact' ELSE 'fuzzy' END AS match_type FROM pair_ac""",
)
def j3_score_invoices_slips(v: Views):
    return match.score_invoices_and_slips(sales(v), slips(v)).select(
        "scope", "l_idx", "r_idx", "date_confidence", "amount_confidence", "confidence", "match_type"
    )


@query(
    "j4_score_invoices_payments",
    """SELECT scope, l_idx, r_idx, date_confidence, amount_confidence, confidence,
              CASE WHEN confidence >= 0.95e0 THEN 'exact' ELSE 'fuzzy' END AS match_type FROM pair_be""",
)
def j4_score_invoices_payments(v: Views):
    return match.score_invoices_and_payments(purchases(v), statements(v)).select(
        "scope", "l_idx", "r_idx", "date_confidence", "amount_confidence", "confidence", "match_type"
    )


def engine_inputs(v: Views):
    """Invoices named after the customer; bank rows of two thirds of them add a word to the name."""
    key = F.col("account_number").cast("long")
    names = v.table("customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 15, "0").alias("party"), F.col("c_name")
    )
    invoices = (
        v.invoice.join(names, F.col("npwp_pembeli") == F.col("party"))
        .select(F.col("npwp_pembeli").alias("scope"), "row_idx", "tanggal", F.col("total").alias("amount"), F.concat(F.lit("PT "), "c_name").alias("vendor_name"))
    )
    paid = F.greatest("debet", "kredit")
    bank = (
        v.bank.join(names, F.col("account_number") == F.col("party"))
        .select(F.col("account_number").alias("scope"), "row_idx", "tanggal", paid.alias("amount"), F.concat(F.upper("c_name"), F.when(key % 3 == 0, " Tbk.").otherwise(" Jaya")).alias("vendor_name"))
    )
    return invoices, bank


_ENGINE = {
    "en_scored": """
        SELECT *, date_confidence * 0.30e0 + amount_confidence * 0.50e0 + vendor_similarity * 0.20e0 AS confidence FROM (
          SELECT scope, b_idx, e_idx, greatest(1e0 - gap / 6e0, 0.5e0) AS date_confidence,
                 CASE WHEN x = y THEN 1e0 ELSE greatest(1e0 - share / 0.01e0 * 0.3e0, 0.7e0) END AS amount_confidence,
                 CASE WHEN scope::BIGINT % 3 = 0 THEN 1e0 ELSE 2e0 * n / (2 * n + 5) END AS vendor_similarity
          FROM (SELECT b.npwp_pembeli AS scope, b.row_idx AS b_idx, e.row_idx AS e_idx, abs(b.tanggal - e.tanggal)::BIGINT AS gap,
                       b.total::DOUBLE AS x, greatest(e.debet, e.kredit)::DOUBLE AS y, abs(x - y) / ((x + y) / 2) AS share,
                       length(replace(c_name, '#', '')) AS n
                FROM fx_invoice b JOIN fx_bank e ON e.account_number = b.npwp_pembeli
                JOIN customer ON lpad(c_custkey::VARCHAR, 15, '0') = b.npwp_pembeli)
          WHERE gap <= 3 AND x <> 0 AND y <> 0 AND share <= 0.01e0)""",
    "cand_en": """
        SELECT *, CASE WHEN confidence >= 0.95e0 THEN 'exact' WHEN confidence >= 0.85e0 THEN 'high' ELSE 'partial' END AS match_type
        FROM en_scored WHERE confidence >= 0.7e0""",
    "en_lists": """
        SELECT scope, b_idx, row_number() OVER (PARTITION BY scope ORDER BY b_idx) AS n, cands
        FROM (SELECT scope, b_idx, list({'e': e_idx, 'c': confidence} ORDER BY confidence DESC, e_idx) AS cands
              FROM cand_en GROUP BY scope, b_idx)""",
    "en_walk": VIEWS["be_walk"].replace("be_lists", "en_lists").replace("be_walk", "en_walk"),
}


@query(
    "j5_engine_candidates",
    "SELECT scope, b_idx, e_idx, date_confidence, amount_confidence, vendor_similarity, confidence, match_type FROM cand_en",
    _ENGINE,
)
def j5_engine_candidates(v: Views):
    return match.engine_candidates(*engine_inputs(v), keys=["scope"]).select(
        "scope",
        "b_idx", "e_idx", "date_confidence", "amount_confidence", "vendor_similarity", "confidence", "match_type"
    )


@query(
    "j5_engine_matches",
    """SELECT scope, b_idx, e_idx, confidence,
              CASE WHEN confidence >= 0.95e0 THEN 'exact' WHEN confidence >= 0.85e0 THEN 'high' ELSE 'partial' END AS match_type
       FROM en_walk WHERE e_idx IS NOT NULL""",
    _ENGINE,
)
def j5_engine_matches(v: Views):
    return match.engine_matches(*engine_inputs(v), keys=["scope"])


@query(
    "f6_name_similarity",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 ELSE 2e0 * n / (2 * n + 1 + m) END AS similarity
       FROM (SELECT c_custkey, length(replace(c_name, '#', '')) AS n, length(c_mktsegment) AS m FROM customer)""",
)
def f6_name_similarity(v: Views):
    other = (
        F.when(F.col("c_custkey") % 5 == 0, "PT.")
        .when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("cv "), F.lower("c_name")))
        .otherwise(F.concat("c_name", F.lit(" "), "c_mktsegment"))
    )
    names = v.table("customer").select("c_custkey", normalize_vendor(F.col("c_name")).alias("a"), normalize_vendor(other).alias("b"))
    return match.with_name_similarity(names, "a", "b", "similarity").select("c_custkey", "similarity")


_J6 = {
    "a": ("fx_invoice", "npwp_penjual", "m_ac", "a_idx"),
    "c": ("fx_withholding", "npwp_dipotong", "m_ac", "c_idx"),
    "b": ("fx_invoice", "npwp_pembeli", "m_be", "b_idx"),
    "e": ("fx_bank", "account_number", "m_be", "e_idx"),
}


def _unmatched_query(point: str) -> None:
    view, scope, matches, idx = _J6[point]

    @query(
        f"j6_unmatched_{point}",
        f"""SELECT {scope} AS scope, row_idx, tanggal FROM {view} x WHERE NOT EXISTS
            (SELECT 1 FROM {matches} m WHERE m.scope = x.{scope} AND m.{idx} = x.row_idx)""",
    )
    def plan(v: Views):
        side = {"a": sales, "b": purchases, "c": slips, "e": statements}[point](v)
        pairs = j1_match_invoices_slips(v) if matches == "m_ac" else j2_match_payments(v)
        return match.unmatched(side, pairs, idx).select("scope", "row_idx", "tanggal")


for _point in _J6:
    _unmatched_query(_point)


@query(
    "j12_write_back",
    """SELECT b.row_idx, b.npwp_pembeli AS scope, m.e_idx IS NOT NULL AS is_matched, m.e_idx AS matched_with,
              m.confidence AS match_confidence, m.match_type
       FROM fx_invoice b LEFT JOIN m_be m ON m.scope = b.npwp_pembeli AND m.b_idx = b.row_idx""",
)
def j12_write_back(v: Views):
    return match.write_back(purchases(v), j2_match_payments(v), "b_idx", "e_idx").select(
        "row_idx", "scope", "is_matched", "matched_with", "match_confidence", "match_type"
    )


@query(
    "w8_match_numbers",
    """SELECT scope, a_idx, 'match_a_c_' || row_number() OVER (PARTITION BY scope ORDER BY a_idx) AS match_id FROM m_ac""",
)
def w8_match_numbers(v: Views):
    return match.number_matches(j1_match_invoices_slips(v), "a_idx", "match_a_c").select("scope", "a_idx", "match_id")


@query(
    "w9_best_candidate",
    """SELECT scope, b_idx, e_idx, confidence FROM (SELECT *, row_number() OVER
       (PARTITION BY scope, b_idx ORDER BY confidence DESC, e_idx) AS rn FROM cand_be) WHERE rn = 1""",
)
def w9_best_candidate(v: Views):
    return match.best_payment(purchases(v), statements(v))


@query(
    "p17_match_details",
    """SELECT m.scope, m.b_idx, m.e_idx, b.nomor_faktur, b.tanggal, b.npwp_penjual AS npwp, b.total::DOUBLE AS amount, '-' AS nama_barang, '-' AS quantity,
              b.dpp::DOUBLE AS dpp, b.ppn::DOUBLE AS ppn, e.tanggal AS bank_date, e.debet::DOUBLE AS bank_amount, e.keterangan,
              c.gap AS date_diff_days, round(c.pct, 2) AS amount_diff_pct, round(c.date_score, 2) AS date_score, round(c.amount_score, 2) AS amount_score,
              round(m.confidence, 2) AS match_confidence
       FROM m_be m JOIN fx_invoice b ON b.row_idx = m.b_idx JOIN fx_bank e ON e.row_idx = m.e_idx
       JOIN cand_be c ON c.scope = m.scope AND c.b_idx = m.b_idx AND c.e_idx = m.e_idx""",
)
def p17_match_details(v: Views):
    return export.payment_match_details(j2_match_payments(v), purchases(v), statements(v))


@query(
    "p17_match_details_ac",
    """SELECT m.scope, m.a_idx, m.c_idx, a.nomor_faktur, a.tanggal AS tanggal_faktur, a.npwp_pembeli, '-' AS nama_barang, '-' AS quantity,
              a.dpp::DOUBLE AS dpp, a.ppn::DOUBLE AS ppn, a.total::DOUBLE AS amount, c.nomor_bukti_potong, c.tanggal AS tanggal_bukti, c.npwp_pemotong,
              c.bruto::DOUBLE AS bruto, c.pph::DOUBLE AS pph, 1e0 AS match_confidence
       FROM m_ac m JOIN fx_invoice a ON a.row_idx = m.a_idx JOIN fx_withholding c ON c.row_idx = m.c_idx""",
)
def p17_match_details_ac(v: Views):
    return export.slip_match_details(j1_match_invoices_slips(v), sales(v), slips(v))


# --- summaries ----------------------------------------------------------------------------------


@query(
    "a3_summary",
    """
    WITH facts AS (
      SELECT i.npwp_penjual AS scope, 1 AS a, 0 AS b, 0 AS c, 0 AS e, total AS sale, dpp AS sale_dpp, 0 AS buy, 0 AS buy_dpp,
             CASE WHEN m.a_idx IS NOT NULL THEN 1 ELSE 0 END AS auto, 0 AS sugg, CASE WHEN m.a_idx IS NOT NULL THEN 1 ELSE 0 END AS ma, 0 AS mb,
             CASE WHEN m.a_idx IS NOT NULL THEN total ELSE 0 END AS am, CASE WHEN m.a_idx IS NULL THEN total ELSE 0 END AS au,
             CASE WHEN m.a_idx IS NOT NULL THEN 1 ELSE 0 END::DECIMAL(5,2) AS conf
      FROM fx_invoice i LEFT JOIN m_ac m ON m.scope = i.npwp_penjual AND m.a_idx = i.row_idx
      UNION ALL
      SELECT i.npwp_pembeli, 0, 1, 0, 0, 0, 0, total, dpp,
             CASE WHEN match_type = 'auto' THEN 1 ELSE 0 END, CASE WHEN match_type = 'suggested' THEN 1 ELSE 0 END, 0,
             CASE WHEN match_type = 'auto' THEN 1 ELSE 0 END,
             CASE WHEN match_type = 'auto' THEN total ELSE 0 END, CASE WHEN match_type IS NULL THEN total ELSE 0 END,
             CASE WHEN match_type = 'auto' THEN round(confidence, 2) ELSE 0 END::DECIMAL(5,2)
      FROM fx_invoice i LEFT JOIN m_be m ON m.scope = i.npwp_pembeli AND m.b_idx = i.row_idx
      UNION ALL SELECT npwp_dipotong, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM fx_withholding
      UNION ALL SELECT account_number, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM fx_bank),
    sums AS (
      SELECT scope, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(e)::BIGINT AS e, sum(sale) AS sale, sum(sale_dpp) AS sale_dpp,
             sum(buy) AS buy, sum(buy_dpp) AS buy_dpp, sum(auto)::BIGINT AS auto, sum(sugg)::BIGINT AS sugg, sum(ma)::BIGINT AS ma, sum(mb)::BIGINT AS mb,
             sum(am) AS am, sum(au) AS au, sum(conf) AS conf FROM facts GROUP BY scope)
    SELECT scope, a AS point_a_count, b AS point_b_count, c AS point_c_count, e AS point_e_count,
           sale::DOUBLE AS total_penjualan, sale_dpp::DOUBLE AS total_penjualan_dpp, buy::DOUBLE AS total_pembelian,
           buy_dpp::DOUBLE AS total_pembelian_dpp, am::DOUBLE AS amount_matched, au::DOUBLE AS amount_unmatched,
           auto AS total_auto_matched, sugg AS total_suggested, a + b + c + e - 2 * (auto + sugg) AS total_unmatched,
           auto::DOUBLE / (a + b + c + e - auto - sugg)::DOUBLE * 100 AS match_rate,
           CASE WHEN c > 0 THEN ma::DOUBLE / greatest(a, 1)::DOUBLE * 100 ELSE 0e0 END AS match_rate_a_vs_c,
           CASE WHEN e > 0 THEN mb::DOUBLE / greatest(b, 1)::DOUBLE * 100 ELSE 0e0 END AS match_rate_b_vs_e,
           CASE WHEN auto = 0 THEN 0e0 ELSE conf::DOUBLE / auto::DOUBLE END AS avg_confidence,
           (sale_dpp - buy_dpp)::DOUBLE AS margin_idr,
           CASE WHEN sale_dpp > 0 THEN (sale_dpp - buy_dpp)::DOUBLE / sale_dpp::DOUBLE * 100 ELSE 0e0 END AS margin_pct
    FROM sums""",
)
def a3_summary(v: Views):
    return reconcile(v.invoice, v.withholding, v.bank).summary()


@query(
    "a4_margin",
    """SELECT scope, sum(s)::DOUBLE AS sales, sum(p)::DOUBLE AS purchases, (sum(s) - sum(p))::DOUBLE AS margin_idr,
              CASE WHEN sum(s) > 0 THEN (sum(s) - sum(p))::DOUBLE / sum(s)::DOUBLE * 100 ELSE 0e0 END AS margin_pct
       FROM (SELECT npwp_penjual AS scope, dpp AS s, 0 AS p FROM fx_invoice
             UNION ALL SELECT npwp_pembeli, 0, dpp FROM fx_invoice) GROUP BY scope""",
)
def a4_margin(v: Views):
    return summary.margin(sales(v), purchases(v))


@query(
    "a5_pair_summary",
    """
    WITH f AS (
      SELECT npwp_penjual AS scope, 'a' AS k FROM fx_invoice UNION ALL SELECT npwp_pembeli, 'b' FROM fx_invoice
      UNION ALL SELECT npwp_dipotong, 'c' FROM fx_withholding UNION ALL SELECT account_number, 'e' FROM fx_bank
      UNION ALL SELECT scope, 'ac' FROM pair_ac UNION ALL SELECT scope, 'be' FROM pair_be
      UNION ALL SELECT scope, 'ua' FROM (SELECT DISTINCT scope, l_idx FROM pair_ac)
      UNION ALL SELECT scope, 'uc' FROM (SELECT DISTINCT scope, r_idx FROM pair_ac)
      UNION ALL SELECT scope, 'ub' FROM (SELECT DISTINCT scope, l_idx FROM pair_be)
      UNION ALL SELECT scope, 'ue' FROM (SELECT DISTINCT scope, r_idx FROM pair_be)),
    s AS (SELECT scope, count(*) FILTER (k = 'a') AS a, count(*) FILTER (k = 'b') AS b, count(*) FILTER (k = 'c') AS c,
                 count(*) FILTER (k = 'e') AS e, count(*) FILTER (k = 'ac') AS ac, count(*) FILTER (k = 'be') AS be,
                 count(*) FILTER (k = 'ua') AS ua, count(*) FILTER (k = 'ub') AS ub, count(*) FILTER (k = 'uc') AS uc,
                 count(*) FILTER (k = 'ue') AS ue FROM f GROUP BY scope)
    SELECT scope, a AS point_a_count, b AS point_b_count, c AS point_c_count, e AS point_e_count,
           ac AS matches_a_vs_c, be AS matches_b_vs_e, ac + be AS total_matches,
           (ac + be)::DOUBLE / (a + b + c + e)::DOUBLE * 100 AS match_rate,
           a - ua AS unmatched_point_a, b - ub AS unmatched_point_b, c - uc AS unmatched_point_c, e - ue AS unmatched_point_e
    FROM s""",
)
def a5_pair_summary(v: Views):
    return summary.pair_summary(
        sales(v),
        purchases(v),
        slips(v),
        statements(v),
        match.score_invoices_and_slips(sales(v), slips(v)),
        match.score_invoices_and_payments(purchases(v), statements(v)),
    )


@query(
    "a6_engine_summary",
    """WITH hit AS (SELECT * FROM en_walk WHERE e_idx IS NOT NULL),
       rows AS (SELECT 'faktur_pajak' AS k, i.total AS amount, b_idx IS NOT NULL AS hit FROM fx_invoice i LEFT JOIN hit ON b_idx = i.row_idx AND scope = npwp_pembeli
                UNION ALL SELECT 'rekening_koran', greatest(debet, kredit), e_idx IS NOT NULL FROM fx_bank LEFT JOIN hit ON e_idx = row_idx AND scope = account_number
                UNION ALL SELECT 'pph23', pph, false FROM fx_withholding)
       SELECT count(*) FILTER (k = 'faktur_pajak') AS total_faktur, count(*) FILTER (k = 'rekening_koran') AS total_rekening,
              count(*) FILTER (k = 'pph23') AS total_pph, count(*) FILTER (k = 'faktur_pajak' AND hit) AS matched_count,
              count(*) FILTER (k = 'faktur_pajak' AND NOT hit) AS unmatched_faktur, count(*) FILTER (k = 'rekening_koran' AND NOT hit) AS unmatched_rekening,
              count(*) FILTER (k = 'pph23') AS unmatched_pph, count(*) FILTER (k = 'rekening_koran' AND NOT hit) AS belum_dilaporkan,
              coalesce(sum(amount) FILTER (k = 'faktur_pajak' AND hit), 0)::DOUBLE AS total_matched_amount,
              coalesce(sum(amount) FILTER (NOT hit), 0)::DOUBLE AS total_unmatched_amount,
              (count(*) FILTER (k = 'faktur_pajak' AND hit))::DOUBLE / (count(*) FILTER (k = 'faktur_pajak'))::DOUBLE * 100 / 100 AS match_rate FROM rows""",
    _ENGINE,
)
def a6_engine_summary(v: Views):
    invoices, bank = engine_inputs(v)
    matches = match.engine_matches(invoices, bank, keys=["scope"])
    used_b = matches.select(F.col("b_idx").alias("row_idx"), F.lit(True).alias("hit"))
    used_e = matches.select(F.col("e_idx").alias("row_idx"), F.lit(True).alias("hit"))
    slip_rows = v.withholding.select(F.lit("pph23").alias("source_type"), F.col("pph").alias("amount"), F.lit(False).alias("is_matched"))

    def tag(df, used, label):
        return df.join(used, "row_idx", "left").select(
            F.lit(label).alias("source_type"), "amount", F.coalesce("hit", F.lit(False)).alias("is_matched")
        )

    tagged = tag(invoices, used_b, "faktur_pajak").unionByName(tag(bank, used_e, "rekening_koran")).unionByName(slip_rows)
    return summary.engine_summary(tagged, matches)


@query(
    "f20_f21_score_curves",
    """SELECT l_orderkey * 1000 + l_suppkey AS id, gap,
              max(CASE WHEN gap <= 7 THEN 1e0 - gap / 7e0 ELSE 0e0 END) AS linear_date,
              max(CASE WHEN gap <= 7 THEN 1e0 - gap / 7e0 * 0.3e0 END) AS gated_date,
              max(CASE WHEN gap <= 3 THEN greatest(1e0 - gap / 6e0, 0.5e0) END) AS engine_date,
              max(CASE WHEN p <= 5 THEN 1e0 - p / 5e0 ELSE 0e0 END) AS linear_amount,
              max(CASE WHEN q <= 2 THEN 1e0 - q / 2e0 * 0.3e0 END) AS gated_amount,
              max(CASE WHEN x = y THEN 1e0 WHEN s <= 0.01e0 THEN greatest(1e0 - s / 0.01e0 * 0.3e0, 0.7e0) END) AS engine_amount
       FROM (SELECT *, abs(x - y) / abs(x) * 100 AS p, abs((x - y) / greatest(x, y)) * 100 AS q,
                    abs(x - y) / ((x + y) / 2) AS s
             FROM (SELECT l_orderkey, l_suppkey, abs(l_shipdate::DATE - o_orderdate::DATE)::BIGINT % 11 AS gap,
                          l_extendedprice AS x, l_extendedprice * (1 + l_discount / 2) AS y
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
       GROUP BY 1, 2""",
)
def f20_f21_score_curves(v: Views):
    joined = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    gap = score.day_gap(F.to_date("l_shipdate"), F.to_date("o_orderdate")) % 11
    x, y = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_discount") / 2)
    return joined.groupBy(
        (F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("id"), gap.alias("gap")
    ).agg(
        F.max(score.linear_date_score(gap)).alias("linear_date"),
        F.max(score.gated_date_score(gap)).alias("gated_date"),
        F.max(score.engine_date_score(gap)).alias("engine_date"),
        F.max(score.linear_amount_score(score.percent_of_base(x, y))).alias("linear_amount"),
        F.max(score.gated_amount_score(x, y)).alias("gated_amount"),
        F.max(score.engine_amount_score(x, y)).alias("engine_amount"),
    )
