"""DuckDB twins of the domain views, as common table expressions."""

from __future__ import annotations

import re

_TYPES = "['faktur_pajak','pph21','pph23','rekening_koran','invoice']"

VIEWS = {
    "fx_invoice": """
        SELECT o_orderkey AS row_idx, o_orderkey::VARCHAR AS nomor_faktur,
               o_orderdate::DATE AS tanggal,
               lpad(seller::VARCHAR, 15, '0') AS npwp_penjual,
               lpad(o_custkey::VARCHAR, 15, '0') AS npwp_pembeli,
               dpp, round(dpp * 0.11, 2)::DECIMAL(18,2) AS ppn,
               (dpp + round(dpp * 0.11, 2))::DECIMAL(18,2) AS total
        FROM (SELECT *, o_totalprice::DECIMAL(18,2) AS dpp FROM orders) o
        JOIN (SELECT l_orderkey, min(l_suppkey) AS seller FROM lineitem GROUP BY 1) l
          ON o_orderkey = l_orderkey""",
    "fx_withholding": """
        SELECT *, round(bruto * 0.02, 2)::DECIMAL(18,2) AS pph FROM (
          SELECT l_orderkey * 1000 + l_suppkey AS row_idx,
                 l_orderkey || '/' || l_suppkey AS nomor_bukti_potong,
                 CASE WHEN l_orderkey % 4 = 1 THEN o_orderdate::DATE + (l_orderkey % 9)::INTEGER ELSE shipped::DATE END::DATE AS tanggal,
                 lpad(l_suppkey::VARCHAR, 15, '0') AS npwp_dipotong,
                 CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE lpad(o_custkey::VARCHAR, 15, '0') END AS npwp_pemotong,
                 CASE WHEN l_orderkey % 4 = 1 THEN round(o_totalprice::DECIMAL(18,2)
                        * (1 + ((l_orderkey % 5) - 2)::DECIMAL(3,0) * 0.01)::DECIMAL(5,2), 2) ELSE gross END::DECIMAL(18,2) AS bruto
          FROM (SELECT l_orderkey, l_suppkey, min(l_shipdate) AS shipped,
                       sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,2) AS gross
                FROM lineitem GROUP BY 1, 2) l
          JOIN orders ON l_orderkey = o_orderkey)""",
    "fx_bank": """
        SELECT o_orderkey AS row_idx, lpad(o_custkey::VARCHAR, 15, '0') AS account_number,
               (o_orderdate::DATE + (o_orderkey % 9)::INTEGER)::DATE AS tanggal,
               'PEMBAYARAN FAKTUR ' || o_orderkey AS keterangan,
               CASE WHEN o_orderkey % 5 <> 0 THEN round((price + round(price * 0.11, 2)::DECIMAL(18,2))
                 * (1 + ((o_orderkey % 7) - 3)::DECIMAL(3,0) * 0.01)::DECIMAL(5,2), 2) ELSE 0 END::DECIMAL(18,2) AS debet,
               CASE WHEN o_orderkey % 5 = 0 THEN price ELSE 0 END::DECIMAL(18,2) AS kredit
        FROM (SELECT *, o_totalprice::DECIMAL(18,2) AS price FROM orders)""",
    "fx_ledger": """
        SELECT event_id AS row_idx, user_id AS account, ts, ts::DATE AS tanggal,
               event_type AS keterangan, debet, kredit,
               (sum(kredit - debet) OVER (PARTITION BY user_id ORDER BY ts, event_id
                  ROWS UNBOUNDED PRECEDING)
                + CASE WHEN event_id % 97 = 0 THEN 1000 ELSE 0 END)::DECIMAL(18,2) AS saldo
        FROM (SELECT *,
                CASE WHEN event_type IN ('purchase','error') THEN value::DECIMAL(18,2) ELSE 0 END::DECIMAL(18,2) AS debet,
                CASE WHEN event_type IN ('purchase','error') THEN 0 ELSE value::DECIMAL(18,2) END::DECIMAL(18,2) AS kredit
              FROM events)""",
    "fx_text": f"""
        SELECT doc_id, {_TYPES}[n + 1] AS document_type, text AS extracted_text,
               {_TYPES}[n + 1] || '_' || doc_id || '.pdf' AS original_filename
        FROM (SELECT *, regexp_extract(source, '([0-9]+)', 1)::INTEGER % 5 AS n FROM documents)""",
    "fx_batches": """
        SELECT o_orderkey AS id, o_custkey AS user_id,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing'
                    WHEN 'P' THEN 'partial' END AS status,
               o_orderdate AS created_at, o_orderpriority AS priority
        FROM orders""",
    "fx_files": f"""
        SELECT l_orderkey * 1000 + l_suppkey AS id, l_orderkey AS batch_id,
               {_TYPES}[(l_suppkey % 5) + 1] || '_' || l_suppkey || '.pdf' AS name,
               {_TYPES}[(l_suppkey % 5) + 1] AS type,
               CASE WHEN returned AND done THEN 'failed' WHEN done THEN 'completed'
                    ELSE 'processing' END AS status,
               created_at, md5(content::VARCHAR) AS file_hash
        FROM (SELECT l_orderkey, l_suppkey, bool_or(l_returnflag = 'R') AS returned,
                     bool_and(l_linestatus = 'F') AS done, max(l_shipdate) AS created_at,
                     max(l_partkey) AS content
              FROM lineitem GROUP BY 1, 2)""",
    "fx_messages": "SELECT conv_id AS session_id, turn, role, text AS content FROM conversations",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the views it names, dependencies first."""
    known = {**VIEWS, **(extra or {})}
    wanted: list[str] = []
    open_names: set[str] = set()

    def need(text: str) -> None:
        for name in known:
            if name not in wanted and name not in open_names and re.search(rf"\b{name}\b", text):
                open_names.add(name)
                need(known[name])
                wanted.append(name)

    need(sql)
    if not wanted:
        return sql
    parts = ",\n".join(f"{n} AS ({known[n]})" for n in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {parts},\n{body[5:]}"
    return f"WITH RECURSIVE {parts}\n{body}"
