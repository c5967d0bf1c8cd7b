"""Queries on users, batches, files, results and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from neraca.operators import activity
from neraca.plans.oracle import VIEWS
from neraca.plans.registry import query
from neraca.sources.views import Views

AS_OF = "2001-06-15 12:00:00"
_SQL_AS_OF = f"TIMESTAMP '{AS_OF}'"

VIEWS.update(
    {
        "fx_users": """
        SELECT c_custkey AS id, c_name AS username, c_custkey % 7 <> 0 AS is_active, c_custkey % 50 = 0 AS is_admin,
               TIMESTAMP '1995-01-01' + to_days((c_custkey % 2500)::INTEGER) AS created_at FROM customer""",
        "fx_results": """
        SELECT id, batch_id, CASE WHEN id % 11 = 0 THEN -id ELSE id END AS document_file_id, CASE WHEN id % 13 = 0 THEN NULL ELSE type END AS document_type,
               name AS original_filename, ((id % 100) / 100.0)::DECIMAL(5,2) AS confidence, created_at,
               CASE WHEN id % 7 = 0 THEN NULL ELSE (id % 50)::DECIMAL(18,2) END AS processing_time, 2.5::DECIMAL(18,2) AS ocr_processing_time FROM fx_files""",
    }
)


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def users(v: Views):
    key = F.col("c_custkey")
    start = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    return v.table("customer").select(
        key.alias("id"),
        F.col("c_name").alias("username"),
        (key % 7 != 0).alias("is_active"),
        (key % 50 == 0).alias("is_admin"),
        (start + F.make_dt_interval(days=(key % 2500).cast("int"))).alias("created_at"),
    )


def results(v: Views):
    n = F.col("id")
    return v.files.select(
        "id",
        "batch_id",
        F.when(n % 11 == 0, -n).otherwise(n).alias("document_file_id"),
        F.when(n % 13 != 0, F.col("type")).alias("document_type"),
        F.col("name").alias("original_filename"),
        ((n % 100) / 100).cast("decimal(5,2)").alias("confidence"),
        "created_at",
        F.when(n % 7 != 0, (n % 50).cast("decimal(18,2)")).alias("processing_time"),
        F.lit("2.5").cast("decimal(18,2)").alias("ocr_processing_time"),
    )


# --- filters ------------------------------------------------------------------------------------------


@query("p8_owned_by", "SELECT id, status FROM fx_batches WHERE user_id = 7 AND status = 'completed'")
def p8_owned_by(v: Views):
    return activity.owned_by(v.batches, 7, "completed").select("id", "status")


@query("p9_in_list", "SELECT id, priority FROM fx_batches WHERE priority IN ('1-URGENT', '5-LOW')")
def p9_in_list(v: Views):
    return activity.in_list(v.batches, "priority", "1-URGENT, ,5-LOW,").select("id", "priority")


@query("p10_search_documents", "SELECT id, name FROM fx_files WHERE (contains(lower(name), 'pph2') OR contains(lower(type), 'pph2')) AND type = 'pph23'")
def p10_search_documents(v: Views):
    return activity.search_documents(v.files, "PPh2", "pph23").select("id", "name")


@query("p11_search_batches", "SELECT id, status FROM fx_batches WHERE contains(id::VARCHAR, '12') AND status = 'partial'")
def p11_search_batches(v: Views):
    return activity.search_batches(v.batches, "12", "partial").select("id", "status")


@query("p12_recent", f"SELECT id, created_at::DATE AS day FROM fx_batches WHERE created_at >= {_SQL_AS_OF} - INTERVAL 7 DAYS")
def p12_recent(v: Views):
    return activity.recent(v.batches, "created_at", as_of()).select("id", F.to_date("created_at").alias("day"))


@query("p13_same_day", f"SELECT id, user_id FROM fx_batches WHERE created_at::DATE = {_SQL_AS_OF}::DATE")
def p13_same_day(v: Views):
    return activity.same_day(v.batches, "created_at", as_of()).select("id", "user_id")


@query("t2_page", "SELECT id, user_id, created_at::DATE AS day FROM fx_batches ORDER BY created_at DESC, id OFFSET 20 LIMIT 10")
def t2_page(v: Views):
    return activity.newest(v.batches, "created_at", 10, 20).select("id", "user_id", F.to_date("created_at").alias("day"))


@query("t2_deep_page", "SELECT id, user_id, created_at::DATE AS day FROM fx_batches ORDER BY created_at DESC, id OFFSET 1000 LIMIT 10")
def t2_deep_page(v: Views):
    """Page 100 of ten, found from its anchor."""
    anchors = activity.page_anchors(v.batches, "created_at", 10)
    first = anchors.filter("page = 100").select("time", "id").first()
    page = activity.page_from(v.batches, "created_at", 10, tuple(first)) if first else v.batches.limit(0)
    return page.select("id", "user_id", F.to_date("created_at").alias("day"))


@query("t3_five_recent", "SELECT id, status FROM fx_batches ORDER BY created_at DESC, id LIMIT 5")
def t3_five_recent(v: Views):
    return activity.newest(v.batches, "created_at", 5).select("id", "status")


@query(
    "t4_a17_type_shares",
    """SELECT coalesce(document_type, 'unknown') AS document_type, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE * 100 AS share
       FROM fx_results GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def t4_a17_type_shares(v: Views):
    return activity.type_shares(results(v), 5)


@query("a18_distinct_types", "SELECT count(DISTINCT document_type) AS types FROM fx_results")
def a18_distinct_types(v: Views):
    return results(v).agg(F.countDistinct("document_type").alias("types"))


@query(
    "t9_newest_per_type",
    """SELECT type, id FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id) AS rn FROM fx_files) WHERE rn <= 5""",
)
def t9_newest_per_type(v: Views):
    return activity.first_per_group(v.files, ["type"], [F.desc("created_at"), F.asc("id")], 5).select("type", "id")


@query(
    "t8_preview",
    """SELECT scope, a_idx, c_idx FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY a_idx) AS rn FROM m_ac) WHERE rn <= 10""",
)
def t8_preview(v: Views):
    from neraca.plans.recon_queries import j1_match_invoices_slips

    return activity.first_per_group(j1_match_invoices_slips(v), ["scope"], [F.asc("a_idx")], 10).select("scope", "a_idx", "c_idx")


@query(
    "w12_t6_last_messages",
    """SELECT session_id, turn, role, row_number() OVER (PARTITION BY session_id ORDER BY turn, role DESC) AS place
       FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, role) AS rn FROM fx_messages) WHERE rn <= 20""",
)
def w12_t6_last_messages(v: Views):
    return activity.last_messages(v.messages).select("session_id", "turn", "role", "place")


@query(
    "u7_upsert_new",
    """SELECT id, status, 'old' AS origin FROM fx_batches WHERE status = 'completed'
       UNION ALL SELECT id, 'fetched', 'new' FROM fx_batches WHERE status <> 'completed'""",
)
def u7_upsert_new(v: Views):
    existing = v.batches.filter("status = 'completed'").select("id", "status", F.lit("old").alias("origin"))
    fetched = v.batches.select("id", F.lit("fetched").alias("status"), F.lit("new").alias("origin"))
    return activity.upsert_new(existing, fetched)


# --- look-ups --------------------------------------------------------------------------------------------


@query("j7_results_of_users", "SELECT r.id, b.user_id, r.document_type FROM fx_results r JOIN fx_batches b ON b.id = r.batch_id")
def j7_results_of_users(v: Views):
    return activity.results_of_users(results(v), v.batches).select("id", "user_id", "document_type")


@query("j8_results_with_names", "SELECT r.id, coalesce(f.name, 'Unknown') AS filename FROM fx_results r LEFT JOIN fx_files f ON f.id = r.document_file_id")
def j8_results_with_names(v: Views):
    return activity.results_with_names(results(v), v.files).select("id", "filename")


@query(
    "j9_w10_users_with_activity",
    """SELECT u.id, username, is_active, count(b.id) AS total_batches, max(b.created_at)::DATE AS last_day
       FROM fx_users u LEFT JOIN fx_batches b ON b.user_id = u.id GROUP BY 1, 2, 3""",
)
def j9_w10_users_with_activity(v: Views):
    return activity.users_with_activity(users(v), v.batches).select(
        "id", "username", "is_active", "total_batches", F.to_date("last_activity").alias("last_day")
    )


@query(
    "j10_batches_with_files",
    """SELECT b.id, coalesce(n, 0) AS total_files, files FROM fx_batches b LEFT JOIN
       (SELECT batch_id, count(*) AS n, string_agg(name, ';' ORDER BY id) FILTER (rn <= 5) AS files FROM
          (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS rn FROM fx_files) GROUP BY 1) f ON f.batch_id = b.id""",
)
def j10_batches_with_files(v: Views):
    out = activity.batches_with_files(v.batches, v.files, shown=5)
    return out.select("id", "total_files", F.array_join(F.col("files.name"), ";").alias("files"))


# --- statistics -------------------------------------------------------------------------------------------


@query(
    "a14_admin_counters",
    f"""SELECT * FROM (SELECT count(*) AS users_total, count(*) FILTER (is_active) AS users_active, count(*) FILTER (NOT is_active) AS users_inactive,
            count(*) FILTER (is_admin) AS users_admins, count(*) FILTER (created_at >= {_SQL_AS_OF} - INTERVAL 7 DAYS) AS users_new FROM fx_users),
          (SELECT count(*) AS batches_total, count(*) FILTER (status = 'completed') AS batches_completed, count(*) FILTER (status = 'processing') AS batches_processing,
            count(*) FILTER (status = 'partial') AS batches_partial, count(*) FILTER (status IN ('failed', 'error')) AS batches_failed,
            count(*) FILTER (created_at >= {_SQL_AS_OF} - INTERVAL 7 DAYS) AS batches_this_week FROM fx_batches),
          (SELECT count(*) AS files_total FROM fx_files)""",
)
def a14_admin_counters(v: Views):
    return activity.admin_counters(users(v), v.batches, v.files, as_of())


@query(
    "a15_batch_progress",
    f"""SELECT id, coalesce(total, 0) AS total_files, coalesce(done, 0) AS processed_files, coalesce(bad, 0) AS failed_files, current_file,
               CASE WHEN coalesce(total, 0) = 0 THEN 0e0 ELSE done::DOUBLE / total::DOUBLE * 100 END AS progress,
               CASE WHEN status = 'processing' AND done > 0 THEN
                 floor((epoch({_SQL_AS_OF})::BIGINT - epoch(created_at)::BIGINT)::DOUBLE / done * (total - done))::BIGINT END AS eta_seconds
        FROM fx_batches LEFT JOIN (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS done,
            count(*) FILTER (status IN ('failed', 'error')) AS bad, arg_max(name, id) FILTER (status = 'processing') AS current_file FROM fx_files GROUP BY 1)
          ON batch_id = id""",
)
def a15_batch_progress(v: Views):
    return activity.batch_progress(v.batches, v.files, as_of()).select(
        "id", "total_files", "processed_files", "failed_files", "current_file", "progress", "eta_seconds"
    )


@query(
    "a16_final_status",
    """SELECT batch_id, processed, failed, CASE WHEN batch_id % 17 = 0 THEN 'cancelled' WHEN failed = 0 THEN 'completed' WHEN processed = 0 THEN 'failed' ELSE 'partial' END AS final_status
       FROM (SELECT batch_id, count(*) FILTER (status = 'completed') AS processed, count(*) FILTER (status IN ('failed', 'error')) AS failed FROM fx_files GROUP BY 1)""",
)
def a16_final_status(v: Views):
    cancelled = v.batches.filter("id % 17 = 0").select(F.col("id").alias("batch_id"))
    return activity.final_status(v.files, cancelled)


@query(
    "a17_user_dashboard",
    """SELECT b.user_id, b.n AS total_batches, completed, processing, failed, coalesce(docs, 0)::BIGINT AS total_documents, coalesce(top_type, 'N/A') AS top_type,
              completed::DOUBLE / b.n::DOUBLE * 100 AS success_rate, coalesce(secs::DOUBLE / docs, 0e0) AS mean_seconds
       FROM (SELECT user_id, count(*) AS n, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'processing') AS processing,
                    count(*) FILTER (status = 'error') AS failed FROM fx_batches GROUP BY 1) b
       LEFT JOIN (SELECT user_id, sum(n) AS docs, sum(s) AS secs, arg_min(t, {'n': -n, 't': t}) AS top_type FROM
            (SELECT user_id, coalesce(document_type, 'unknown') AS t, count(*) AS n, sum(coalesce(nullif(processing_time, 0), ocr_processing_time)) AS s
             FROM fx_results r JOIN fx_batches b ON b.id = r.batch_id GROUP BY 1, 2) GROUP BY 1) d USING (user_id)""",
)
def a17_user_dashboard(v: Views):
    return activity.user_dashboard(v.batches, results(v))


@query(
    "a19_point_counts",
    """SELECT p.project_id, count(*) FILTER (k = 'a') AS point_a_count, count(*) FILTER (k = 'b') AS point_b_count, count(*) FILTER (k = 'c') AS point_c_count, count(*) FILTER (k = 'e') AS point_e_count
       FROM (SELECT lpad(c_custkey::VARCHAR, 15, '0') AS project_id FROM customer) p LEFT JOIN
            (SELECT npwp_penjual AS project_id, 'a' AS k FROM fx_invoice UNION ALL SELECT npwp_pembeli, 'b' FROM fx_invoice
             UNION ALL SELECT npwp_dipotong, 'c' FROM fx_withholding UNION ALL SELECT account_number, 'e' FROM fx_bank) x USING (project_id) GROUP BY 1""",
)
def a19_point_counts(v: Views):
    from neraca.sources.views import party

    projects = v.table("customer").select(party(F.col("c_custkey")).alias("project_id"))
    return activity.point_counts(
        projects,
        v.invoice.select(F.col("npwp_penjual").alias("project_id")),
        v.invoice.select(F.col("npwp_pembeli").alias("project_id")),
        v.withholding.select(F.col("npwp_dipotong").alias("project_id")),
        v.bank.select(F.col("account_number").alias("project_id")),
    )


@query(
    "s19_summary_sheet",
    """SELECT document_type, original_filename, printf('%.1f', confidence::DOUBLE * 100) || '%' AS confidence, 'Completed' AS status FROM fx_results""",
)
def s19_summary_sheet(v: Views):
    return activity.summary_sheet(results(v))


@query(
    "s14_batch_layouts",
    """SELECT batch_id, count(DISTINCT lower(document_type)) AS types, CASE WHEN count(DISTINCT lower(document_type)) = 1 THEN min(lower(document_type)) ELSE 'mixed' END AS layout
       FROM fx_results GROUP BY 1""",
)
def s14_batch_layouts(v: Views):
    return activity.batch_layouts(results(v))
