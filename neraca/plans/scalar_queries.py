"""Queries on the parsers and classifiers, over texts rendered from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from neraca.functions import dates, ids, money, text
from neraca.plans.oracle import VIEWS
from neraca.plans.registry import query
from neraca.sources import rendered
from neraca.sources.views import Views

_MONTHS = "['Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober','November','Desember']"
# Written out again: the twin doesn't take the table from the parser.
_MONTH_MAP = (
    "MAP {'JAN': '01', 'JANUARI': '01', 'JANUARY': '01', 'FEB': '02', 'FEBRUARI': '02', 'FEBRUARY': '02', 'MAR': "
    "'03', 'MARET': '03', 'MARCH': '03', 'APR': '04', 'APRIL': '04', 'MAY': '05', 'MEI': '05', 'JUN': '06', 'JUNI': "
    "'06', 'JUNE': '06', 'JUL': '07', 'JULI': '07', 'JULY': '07', 'AUG': '08', 'AGUSTUS': '08', 'AUGUST': '08', "
    "'AGT': '08', 'AGU': '08', 'SEP': '09', 'SEPTEMBER': '09', 'SEPT': '09', 'OCT': '10', 'OKTOBER': '10', "
    "'OCTOBER': '10', 'OKT': '10', 'NOV': '11', 'NOVEMBER': '11', 'DEC': '12', 'DESEMBER': '12', 'DECEMBER': '12', "
    "'DES': '12'} "
)


def _id_amount(x: str, places: int = 2) -> str:
    return f"translate(format('{{:,.{places}f}}', ({x})::DOUBLE), ',.', '.,')"


def _us_amount(x: str, places: int = 2) -> str:
    return f"format('{{:,.{places}f}}', ({x})::DOUBLE)"


def _case(number: str, options: list[str]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


VIEWS.update(
    {
        "fx_amounts": f"""
        SELECT id, line, price, {_case('(id * 7 + line) % 12', [
            "'Rp ' || " + _id_amount('price'), _us_amount('price'), 'price::VARCHAR',
            "'(' || " + _id_amount('price') + " || ')'", _id_amount('floor(price)', 0), _us_amount('floor(price)', 0),
            "'-' || " + _us_amount('price'), "''", "'-'", "'N/A'", "'IDR ' || " + _us_amount('price'),
            "replace(quantity::VARCHAR, '.', ',')"])} AS txt
        FROM (SELECT l_orderkey AS id, l_linenumber AS line, l_quantity::DECIMAL(10,1) AS quantity,
                     l_extendedprice::DECIMAL(18,2) AS price FROM lineitem)""",
        "fx_dates": f"""
        SELECT id, day, {_case('id % 16', [
            "strftime(day, '%d/%m/%Y')", "strftime(day, '%d-%m-%Y')", "strftime(day, '%Y-%m-%d')", "strftime(day, '%d.%m.%Y')",
            "day(day) || '/' || month(day) || '/' || year(day)",
            "strftime(day, '%d') || ' ' || upper(substr(name, 1, 3))", "day(day) || ' ' || name || ' ' || year(day)",
            "strftime(day, '%d/%m/%y')", "strftime(day, '%d/%m')", "strftime(day, '%Y-%m-%d') || ' 08:15:30'",
            "strftime(day, '%Y-%m-%d') || 'T08:15'", "upper(strftime(day, '%B')) || ' ' || day(day) || ', ' || year(day)",
            "'tidak ada'", "''", "'Tgl ' || strftime(day, '%d/%m/%Y') || ' s/d'", "strftime(day, '%m/%d/%y') || ' 09:30'"])} AS txt
        FROM (SELECT o_orderkey AS id, o_orderdate::DATE AS day, {_MONTHS}[month(o_orderdate)] AS name FROM orders)""",
        "fx_descriptions": f"""
        SELECT o_orderkey AS id, trim(concat_ws(' ',
            {_case('o_orderkey % 7', ["'TRSF E-BANKING CR'", "'TRSF E-BANKING DB'", "'BI-FAST DB'", "'bi-fast cr'", "'BYR VIA E-BANKING'", "'KR OTOMATIS'", "''"])},
            {_case('o_orderkey % 3', ["lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '/FTSCY/WS' || lpad(o_custkey::VARCHAR, 5, '0')", "lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '/ADSCY/0000100'", "''"])},
            {_case('(o_orderkey // 3) % 3', ['price::VARCHAR', _us_amount('price'), "''"])},
            {_case('o_orderkey % 8', ["'TRUCKING UNICER S1232'", "'SETORAN TUNAI'", "'BIAYA ADM'", "'Pembayaran PAJAK'", "'GAJI karyawan'", "'tarik tunai ATM'", "'BUNGA'", "''"])})) AS txt,
            CASE WHEN o_orderkey % 2 = 0 THEN price ELSE 0 END::DECIMAL(18,2) AS debet,
            CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE price END::DECIMAL(18,2) AS kredit
        FROM (SELECT *, o_totalprice::DECIMAL(18,2) AS price FROM orders)""",
        "fx_papers": f"""
        SELECT row_idx, concat_ws(chr(10),
          'Nama Penjual: PT MITRA ' || substr(npwp_penjual, 12, 4),
          'Alamat: Jl. Merdeka No. ' || (row_idx % 90),
          'NPWP : ' || CASE WHEN row_idx % 3 = 0 THEN npwp_penjual ELSE
             regexp_replace(npwp_penjual, '^(\\d{{2}})(\\d{{3}})(\\d{{3}})(\\d)(\\d{{3}})(\\d{{3}})$', '\\1.\\2.\\3.\\4-\\5.\\6') END,
          'Nomor Faktur: 010.000-' || strftime(tanggal, '%y') || '.' || lpad(row_idx::VARCHAR, 8, '0'),
          'Tanggal Faktur: ' || day(tanggal) || ' ' || name || ' ' || year(tanggal),
          'Nama Barang Kena Pajak',
          'Busbar Proteksi ' || (row_idx % 7) || ' KV,',
          'Panel Listrik;',
          'Harga Jual: Rp ' || {_id_amount('dpp')},
          (row_idx % 9 + 1) || ' Jasa Instalasi Rp ' || {_id_amount('floor(dpp)', 0)},
          'PPN: Rp ' || {_id_amount('ppn')},
          'Total: Rp ' || {_id_amount('total')},
          'SETORAN CR Rp ' || {_id_amount('floor(dpp)', 0)},
          'BIAYA KELUAR ' || {_us_amount('floor(ppn)', 0)},
          'PO Number: PO-' || row_idx || '/' || year(tanggal),
          'Rekening ' || {_case('row_idx % 5', ["'BANK CENTRAL ASIA'", "'PT BANK MANDIRI'", "'BANK BNI'", "'CIMB NIAGA'", "'kas'"])} || ' NO REK: ' || lpad(row_idx::VARCHAR, 12, '7'),
          'Saldo: ' || {_id_amount('total')},
          'Periode: ' || name || ' ' || year(tanggal)) AS txt
        FROM (SELECT *, {_MONTHS}[month(tanggal)] AS name FROM fx_invoice)""",
    }
)

# --- amounts ------------------------------------------------------------------------------------

_MIXED = "CASE WHEN regexp_extract({b}, '([.,])[^.,]*$', 1) = ',' THEN replace(replace({b}, '.', ''), ',', '.') ELSE replace({b}, ',', '') END"
CLEAN_AMOUNT = (
    "coalesce(try_cast(list_transform([replace(trim(regexp_replace(coalesce({c}, ''), '[Rp$€£¥]', '', 'g')), ' ', '')], lambda b: "
    "CASE WHEN contains(b, ',') AND contains(b, '.') THEN " + _MIXED.format(b="b") + " "
    "WHEN regexp_matches(b, '^[^,]*,.{{0,2}}$') THEN replace(b, ',', '.') "
    "WHEN contains(b, ',') THEN replace(b, ',', '') "
    "WHEN contains(b, '.') AND NOT regexp_matches(b, '^[^.]*\\..{{0,2}}$') THEN replace(b, '.', '') ELSE b END)[1] AS DECIMAL(18,2)), 0)::DECIMAL(18,2)"
)
MISREAD = (
    "list_transform([trim(replace(replace({c}, 'Rp', ''), 'IDR', ''))], lambda b: "
    "list_transform([CASE WHEN contains(b, ',') AND regexp_extract(b, '([.,])[^.,]*$', 1) = '.' THEN string_split(b, '.')[1] ELSE b END], "
    "lambda w: CASE WHEN trim(replace(replace(w, '.', ''), ',', '')) <> '' THEN trim(replace(replace(w, '.', ''), ',', '')) ELSE w END)[1])[1]"
)


@query("f11_clean_amount", f"SELECT id, line, txt, {CLEAN_AMOUNT.format(c='txt')}::DOUBLE AS amount FROM fx_amounts")
def f11_clean_amount(v: Views):
    return rendered.amounts(v).select("id", "line", "txt", money.clean_amount(F.col("txt")).alias("amount"))


@query(
    "f12_extract_amount",
    f"""SELECT id, line, txt, CASE WHEN trim(txt) IN ('-','','N/A','n/a') THEN NULL
          WHEN neg THEN -amount ELSE amount END::DOUBLE AS amount
        FROM (SELECT *, try_cast(CASE WHEN contains(b, ',') AND contains(b, '.') THEN {_MIXED.format(b='b')}
                WHEN regexp_matches(b, '^[^,]*,[^,]{{2}}$') THEN replace(b, ',', '.')
                WHEN contains(b, ',') THEN replace(b, ',', '')
                WHEN regexp_matches(b, '\\..*\\.|^[^.]*\\.[^.]{{3}}$') THEN replace(b, '.', '') ELSE b END AS DECIMAL(18,2)) AS amount
              FROM (SELECT *, contains(txt, '(') AND contains(txt, ')') AS neg,
                           regexp_replace(txt, '[Rp\\s$€£¥()]', '', 'g') AS b FROM fx_amounts))""",
)
def f12_extract_amount(v: Views):
    return rendered.amounts(v).select("id", "line", "txt", money.extract_amount(F.col("txt")).alias("amount"))


@query(
    "f13_sheet_amount",
    """SELECT id, line, txt, coalesce(try_cast(trim(replace(replace(replace(replace(txt, 'Rp', ''), ' ', ''), '.', ''), ',', '.'))
         AS DECIMAL(18,2)), 0)::DOUBLE AS amount FROM fx_amounts""",
)
def f13_sheet_amount(v: Views):
    return rendered.amounts(v).select("id", "line", "txt", money.sheet_amount(F.col("txt")).alias("amount"))


@query(
    "f14_misread_amount",
    f"SELECT id, line, txt, CASE WHEN txt = '' THEN txt ELSE {MISREAD.format(c='txt')} END AS digits FROM fx_amounts",
)
def f14_misread_amount(v: Views):
    return rendered.amounts(v).select("id", "line", "txt", money.misread_amount(F.col("txt")).alias("digits"))


@query(
    "f15_quantity",
    """SELECT id, line, txt, q::DOUBLE AS quantity,
              CASE WHEN q IS NULL THEN '-' WHEN q = floor(q) THEN floor(q)::BIGINT::VARCHAR ELSE q::VARCHAR END AS label
       FROM (SELECT *, round(try_cast(regexp_replace(replace(txt, ',', '.'), '[^0-9.]', '', 'g') AS DECIMAL(18,4)), 2)::DECIMAL(18,2) AS q
             FROM fx_amounts)""",
)
def f15_quantity(v: Views):
    return rendered.amounts(v).select(
        "id", "line", "txt", money.parse_quantity(F.col("txt")).alias("quantity"), money.quantity_label(F.col("txt")).alias("label")
    )


@query(
    "f16_price",
    """SELECT id, line, txt, coalesce(trunc(try_cast(CASE WHEN contains(b, ',') AND contains(b, '.') THEN replace(replace(b, '.', ''), ',', '.')
                WHEN contains(b, ',') THEN replace(b, ',', '.')
                WHEN contains(b, '.') AND NOT regexp_matches(b, '^[^.]*\\.[^.]{2}$') THEN replace(b, '.', '') ELSE b END
              AS DECIMAL(20,4))), 0)::BIGINT AS price
       FROM (SELECT *, trim(replace(replace(trim(txt), 'Rp', ''), 'IDR', '')) AS b FROM fx_amounts)""",
)
def f16_price(v: Views):
    return rendered.amounts(v).select("id", "line", "txt", money.parse_price(F.col("txt")).alias("price"))


@query(
    "f17_format_rupiah",
    """SELECT id, line, CASE WHEN floor(price) = 0 THEN '-' ELSE 'Rp ' || translate(format('{:,}', floor(price)::BIGINT), ',', '.') END AS shown,
         CASE WHEN txt IN ('-','N/A','') OR b IN ('', '-') THEN '-' WHEN n IS NULL THEN txt WHEN n = 0 THEN '-'
              ELSE 'Rp ' || translate(format('{:,}', n), ',', '.') END AS shown_text
       FROM (SELECT *, trunc(try_cast(b AS DECIMAL(20,2)))::BIGINT AS n FROM
             (SELECT *, trim(replace(replace(replace(replace(txt, 'Rp', ''), 'IDR', ''), '.', ''), ',', '')) AS b FROM fx_amounts))""",
)
def f17_format_rupiah(v: Views):
    return rendered.amounts(v).select(
        "id",
        "line",
        money.format_rupiah(F.col("price")).alias("shown"),
        money.format_rupiah_text(F.col("txt")).alias("shown_text"),
    )


@query(
    "f18_f19_digits_and_labels",
    """SELECT row_idx, regexp_extract(txt, '(?i)(?:dpp|dasar pengenaan pajak|harga jual)\\s*:?\\s*(?:Rp\\.?\\s*)?([0-9.,]+)', 1) AS dpp,
              try_cast(nullif(regexp_replace(regexp_extract(txt, '(?i)(?:ppn|pajak pertambahan nilai)\\s*:?\\s*(?:Rp\\.?\\s*)?([0-9.,]+)', 1), '[^0-9]', '', 'g'), '') AS DECIMAL(38,0))::DOUBLE AS ppn,
              regexp_extract(txt, '(?i)(?:total|jumlah|grand total)\\s*:?\\s*(?:Rp\\.?\\s*)?([0-9.,]+)', 1) AS total
       FROM fx_papers""",
)
def f18_f19_digits_and_labels(v: Views):
    t = F.col("txt")
    return rendered.papers(v).select(
        "row_idx",
        money.labelled_amount(t, money.AMOUNT_LABELS["dpp"]).alias("dpp"),
        money.digits_amount(money.labelled_amount(t, money.AMOUNT_LABELS["ppn"])).alias("ppn"),
        money.labelled_amount(t, money.AMOUNT_LABELS["total"]).alias("total"),
    )


# --- debit and credit -----------------------------------------------------------------------------

_MARK = """CASE WHEN contains(upper(m), 'CR') OR contains(m, '+') THEN 'c' WHEN contains(upper(m), 'DB') OR contains(upper(m), 'DR') THEN 'd'
           WHEN starts_with(m, '(') AND ends_with(m, ')') THEN 'p' WHEN starts_with(m, '-') THEN 'm' ELSE 'x' END"""


@query(
    "f26_sides_by_mark",
    f"""SELECT id, line, m AS mutation, (CASE WHEN k IN ('d','p','m') THEN amount ELSE 0 END)::DOUBLE AS debit,
               (CASE WHEN k IN ('d','p','m') THEN 0 ELSE amount END)::DOUBLE AS credit
        FROM (SELECT *, {CLEAN_AMOUNT.format(c='b')} AS amount FROM (
          SELECT *, CASE k WHEN 'c' THEN regexp_replace(m, 'CR|\\+', '', 'g') WHEN 'd' THEN regexp_replace(m, 'DB|DR', '', 'g')
                           WHEN 'p' THEN trim(m, '()') WHEN 'm' THEN ltrim(m, '-') ELSE m END AS b
          FROM (SELECT *, {_MARK} AS k FROM (SELECT id, line, trim(txt || CASE id % 4 WHEN 1 THEN ' CR' WHEN 2 THEN ' DB' ELSE '' END) AS m FROM fx_amounts))))""",
)
def f26_sides_by_mark(v: Views):
    tail = F.when(F.col("id") % 4 == 1, " CR").when(F.col("id") % 4 == 2, " DB").otherwise("")
    rows = rendered.amounts(v).withColumn("mutation", F.trim(F.concat("txt", tail)))
    return rows.select("id", "line", "mutation", money.sides_by_mark(F.col("mutation")).alias("s")).select(
        "id", "line", "mutation", "s.debit", "s.credit"
    )


_FLAGS = ["D", "C", "db", "CR", "K", "Kredit", "DEBIT", "?"]


@query(
    "f27_sides_by_flag",
    f"""SELECT id, line, flag, (CASE WHEN upper(trim(flag)) IN ('D','DEBIT','DB','DR') THEN price ELSE 0 END)::DOUBLE AS debit,
              (CASE WHEN upper(trim(flag)) IN ('D','DEBIT','DB','DR') THEN 0 ELSE price END)::DOUBLE AS credit
       FROM (SELECT *, {_FLAGS}[id % 8 + 1] AS flag FROM fx_amounts)""",
)
def f27_sides_by_flag(v: Views):
    flag = F.get(F.array(*[F.lit(f) for f in _FLAGS]), (F.col("id") % 8).cast("int"))
    rows = rendered.amounts(v).withColumn("flag", flag)
    return rows.select("id", "line", "flag", money.sides_by_flag(flag, F.col("price")).alias("s")).select(
        "id", "line", "flag", "s.debit", "s.credit"
    )


@query(
    "f28_sides_by_words",
    f"""SELECT id, (CASE WHEN d THEN amount ELSE 0 END)::DOUBLE AS debit, (CASE WHEN d THEN 0 ELSE amount END)::DOUBLE AS credit
        FROM (SELECT id, debet + kredit AS amount, regexp_matches(upper(txt), '{"|".join(money.DEBIT_WORDS)}') AS d FROM fx_descriptions)""",
)
def f28_sides_by_words(v: Views):
    amount = (F.col("debet") + F.col("kredit")).cast("decimal(18,2)")
    rows = rendered.descriptions(v).select("id", money.sides_by_words(F.col("txt"), amount).alias("s"))
    return rows.select("id", "s.debit", "s.credit")


@query(
    "f30_sides_of_mutation",
    """SELECT row_idx, (CASE WHEN m < 0 THEN -m ELSE 0 END)::DOUBLE AS debit, (CASE WHEN m < 0 THEN 0 ELSE m END)::DOUBLE AS credit
       FROM (SELECT row_idx, kredit - debet AS m FROM fx_ledger)""",
)
def f30_sides_of_mutation(v: Views):
    value = (F.col("kredit") - F.col("debet")).cast("decimal(18,2)")
    return v.ledger_rows.select("row_idx", money.sides_of_mutation(value).alias("s")).select("row_idx", "s.debit", "s.credit")


# --- dates -------------------------------------------------------------------------------------------


def _strptime(formats: list[str]) -> str:
    def attempt(f: str) -> str:
        parsed = f"try_strptime(trim(txt), '{f}')"
        if "%Y" not in f:
            return parsed
        # A four-digit year is meant; DuckDB would read 01/01/00 as the year 0.
        return f"CASE WHEN regexp_matches(trim(txt), '(^|[^0-9])[0-9]{{4}}([^0-9]|$)') THEN {parsed} END"

    return "coalesce(" + ", ".join(attempt(f) for f in formats) + ")::DATE"


@query(
    "f7_parse_dates",
    f"""SELECT id, txt, {_strptime(['%d/%m/%Y', '%Y-%m-%d', '%d-%m-%Y', '%d.%m.%Y'])} AS sheet,
              {_strptime(['%d/%m/%Y', '%d-%m-%Y', '%Y-%m-%d', '%d %m %Y', '%d/%m/%y', '%d-%m-%y'])} AS engine,
              {_strptime(['%d/%m/%Y', '%d-%m-%Y', '%d.%m.%Y', '%Y-%m-%d', '%d %b %Y', '%d %B %Y', '%d/%m/%y', '%d-%m-%y'])} AS statement
       FROM fx_dates""",
)
def f7_parse_dates(v: Views):
    t = F.col("txt")
    return rendered.dates(v).select(
        "id",
        "txt",
        dates.parse_date(t, dates.SHEET_FORMATS).alias("sheet"),
        dates.parse_date(t, dates.ENGINE_FORMATS).alias("engine"),
        dates.parse_date(t, dates.STATEMENT_FORMATS).alias("statement"),
    )


def _x(pattern: str, n: int, source: str = "t") -> str:
    return f"regexp_extract({source}, '{pattern}', {n})"


def _dmy(pattern: str, d: int, m: int, y: str, source: str = "t", month: str | None = None) -> str:
    month = month or f"lpad({_x(pattern, m, source)}, 2, '0')"
    return f"lpad({_x(pattern, d, source)}, 2, '0') || '/' || {month} || '/' || {y}"


def _time(pattern: str, h: int) -> str:
    sec = _x(pattern, h + 2)
    return f"' ' || lpad({_x(pattern, h)}, 2, '0') || ':' || {_x(pattern, h + 1)} || ':' || CASE WHEN {sec} = '' THEN '00' ELSE lpad({sec}, 2, '0') END"


def _named(pattern: str, n: int) -> str:
    return f"coalesce({_MONTH_MAP}[{_x(pattern, n, 'u')}], '01')"


_P = {
    "dmyt": r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2}):?(\d{2})?$",
    "dmy": r"^(\d{1,2})/(\d{1,2})/(\d{4})$",
    "dmy2": r"^(\d{1,2})/(\d{1,2})/(\d{2})$",
    "dm": r"^(\d{1,2})[/-](\d{1,2})$",
    "dash": r"^(\d{1,2})-(\d{1,2})-(\d{2,4})$",
    "iso": r"^(\d{4})-(\d{1,2})-(\d{1,2})$",
    "isot": r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{2}):?(\d{2})?$",
    "isoT": r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{2}):?(\d{2})?",
    "named": r"^(\d{1,2})\s+([A-Z]+)\s+(\d{4})$",
    "short": r"^(\d{1,2})\s+([A-Z]+)$",
    "eng": r"^([A-Z]+)\s+(\d{1,2}),?\s+(\d{4})$",
    "any": r"^(\d{1,2})\s+([A-Z]+)(?:\s+(\d{4}))?$",
}
COMPLETE_DATE = f"""CASE WHEN regexp_matches(t, '{_P['dmyt']}') THEN {_dmy(_P['dmyt'], 1, 2, _x(_P['dmyt'], 3))} || {_time(_P['dmyt'], 4)}
  WHEN regexp_matches(t, '{_P['dmy']}') THEN {_dmy(_P['dmy'], 1, 2, _x(_P['dmy'], 3))}
  WHEN regexp_matches(t, '{_P['dmy2']}') THEN {_dmy(_P['dmy2'], 1, 2, "'20' || " + _x(_P['dmy2'], 3))}
  WHEN regexp_matches(t, '{_P['dm']}') THEN {_dmy(_P['dm'], 1, 2, 'yr')}
  WHEN regexp_matches(t, '{_P['dash']}') THEN {_dmy(_P['dash'], 1, 2, f"CASE WHEN length({_x(_P['dash'], 3)}) = 2 THEN '20' ELSE '' END || " + _x(_P['dash'], 3))}
  WHEN regexp_matches(t, '{_P['iso']}') THEN {_dmy(_P['iso'], 3, 2, _x(_P['iso'], 1))}
  WHEN regexp_matches(t, '{_P['isot']}') THEN {_dmy(_P['isot'], 3, 2, _x(_P['isot'], 1))} || {_time(_P['isot'], 4)}
  WHEN regexp_matches(t, '{_P['isoT']}') THEN {_dmy(_P['isoT'], 3, 2, _x(_P['isoT'], 1))} || {_time(_P['isoT'], 4)}
  WHEN regexp_matches(u, '{_P['named']}') THEN {_dmy(_P['named'], 1, 2, _x(_P['named'], 3, 'u'), 'u', _named(_P['named'], 2))}
  WHEN regexp_matches(u, '{_P['short']}') THEN {_dmy(_P['short'], 1, 2, 'yr', 'u', _named(_P['short'], 2))}
  WHEN regexp_matches(u, '{_P['eng']}') THEN {_dmy(_P['eng'], 2, 1, _x(_P['eng'], 3, 'u'), 'u', _named(_P['eng'], 1))}
  ELSE t END"""


@query(
    "f8_complete_date",
    f"SELECT id, txt, {COMPLETE_DATE} AS completed FROM (SELECT *, trim(txt) AS t, upper(trim(txt)) AS u, '2025' AS yr FROM fx_dates)",
)
def f8_complete_date(v: Views):
    return rendered.dates(v).select("id", "txt", dates.complete_date(F.col("txt"), F.lit("2025")).alias("completed"))


_LONG = {
    "named": r"(?i)(\d{1,2})\s+([A-Za-z]+)\s+(\d{2,4})",
    "dmy": r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$",
    "dot": r"^(\d{1,2})\.(\d{1,2})\.(\d{2,4})$",
    "ymd": r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$",
}


def _long(y: str, m: str, d: str) -> str:
    return f"{{'y': try_cast({y} AS INTEGER), 'm': try_cast({m} AS INTEGER), 'd': try_cast({d} AS INTEGER)}}"


@query(
    "f9_long_date",
    f"""SELECT id, txt, coalesce(list_filter(list_transform([
            {_long(_x(_LONG['named'], 3), f"{_MONTH_MAP}[upper({_x(_LONG['named'], 2)})]", _x(_LONG['named'], 1))},
            {_long(_x(_LONG['dmy'], 3), _x(_LONG['dmy'], 2), _x(_LONG['dmy'], 1))},
            {_long(_x(_LONG['dot'], 3), _x(_LONG['dot'], 2), _x(_LONG['dot'], 1))},
            {_long(_x(_LONG['ymd'], 1), _x(_LONG['ymd'], 2), _x(_LONG['ymd'], 3))}],
          lambda k: CASE WHEN k.d BETWEEN 1 AND 31 AND k.m BETWEEN 1 AND 12
             AND (k.y + CASE WHEN k.y < 50 THEN 2000 WHEN k.y < 100 THEN 1900 ELSE 0 END) BETWEEN 1900 AND 2100
           THEN lpad(k.d::VARCHAR, 2, '0') || ' ' || {_MONTHS}[k.m] || ' ' || (k.y + CASE WHEN k.y < 50 THEN 2000 WHEN k.y < 100 THEN 1900 ELSE 0 END) END),
          lambda s: s IS NOT NULL)[1], '') AS shown
        FROM (SELECT *, trim(trim(txt), ',.;') AS t FROM fx_dates)""",
)
def f9_long_date(v: Views):
    return rendered.dates(v).select("id", "txt", dates.long_date(F.col("txt")).alias("shown"))


_ROW = [
    (r"\b(\d{2})[/-](\d{2})[/-](\d{4})\b", "{3}-{2}-{1}"),
    (r"\b(\d{2})[/-](\d{2})[/-](\d{2})\b", "20{3}-{2}-{1}"),
    (r"\b(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\b", "named"),
    (r"\b(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b", "named"),
    (r"\b(\d{4})[/-](\d{2})[/-](\d{2})\b", "{1}-{2}-{3}"),
]


def _row_date(source: str) -> str:
    out = "CASE"
    for pattern, shape in _ROW:
        g = [f"regexp_extract({source}, '{pattern}', {n})" for n in (1, 2, 3)]
        if shape == "named":
            iso = f"{g[2]} || '-' || coalesce({_MONTH_MAP}[upper({g[1]})], {g[1]}) || '-' || lpad({g[0]}, 2, '0')"
        elif shape.startswith("20"):
            iso = f"'20' || {g[2]} || '-' || {g[1]} || '-' || {g[0]}"
        elif shape.startswith("{3}"):
            iso = f"{g[2]} || '-' || {g[1]} || '-' || {g[0]}"
        else:
            iso = f"{g[0]} || '-' || {g[1]} || '-' || {g[2]}"
        out += f" WHEN regexp_matches({source}, '{pattern}') THEN {iso}"
    return out + " END"


@query(
    "f10_row_date",
    f"""SELECT id, txt, {_row_date('trim(txt)')} AS iso,
          CASE WHEN regexp_matches(trim(txt), '(\\d{{2}})/(\\d{{2}})/(\\d{{2}})\\s+(\\d{{2}}):(\\d{{2}})')
               THEN '20' || {_x('(\\d{2})/(\\d{2})/(\\d{2})\\s+(\\d{2}):(\\d{2})', 3, 'txt')} || '-' || {_x('(\\d{2})/(\\d{2})/(\\d{2})\\s+(\\d{2}):(\\d{2})', 1, 'txt')} || '-' || {_x('(\\d{2})/(\\d{2})/(\\d{2})\\s+(\\d{2}):(\\d{2})', 2, 'txt')}
               ELSE {_row_date('trim(txt)')} END AS cimb_first,
          CASE WHEN regexp_matches(trim(txt), '(\\d{{2}})/(\\d{{2}})')
               THEN '2025-' || {_x('(\\d{2})/(\\d{2})', 2, 'txt')} || '-' || {_x('(\\d{2})/(\\d{2})', 1, 'txt')}
               ELSE {_row_date('trim(txt)')} END AS cimb_second
        FROM fx_dates""",
)
def f10_row_date(v: Views):
    t = F.col("txt")
    return rendered.dates(v).select(
        "id",
        "txt",
        dates.row_date(t).alias("iso"),
        dates.cimb_date(t, F.lit("format_1"), F.lit("2025")).alias("cimb_first"),
        dates.cimb_date(t, F.lit("format_2"), F.lit("2025")).alias("cimb_second"),
    )


@query(
    "f24_period_year",
    r"SELECT row_idx, nullif(regexp_extract(regexp_extract(txt, 'Periode: ([^\n]+)', 1), '\b(20\d{2})\b', 1), '') AS tahun FROM fx_papers",
)
def f24_period_year(v: Views):
    period = F.regexp_extract("txt", r"Periode: ([^\n]+)", 1)
    return rendered.papers(v).select("row_idx", dates.period_year(period).alias("tahun"))


# --- ids and names --------------------------------------------------------------------------------------


@query(
    "f1_f2_npwp",
    r"""SELECT row_idx, dotted, trim(translate(dotted, '.-', '')) AS bare,
               regexp_replace(bare15, '^(\d{2})(\d{3})(\d{3})(\d)(\d{3})(\d{3})$', '\1.\2.\3.\4-\5.\6') AS shaped, trim(short) AS short
        FROM (SELECT row_idx, npwp_penjual AS bare15, ' ' || row_idx || ' ' AS short,
                     regexp_replace(npwp_penjual, '^(\d{2})(\d{3})(\d{3})(\d)(\d{3})(\d{3})$', '\1.\2.\3.\4-\5.\6') AS dotted FROM fx_invoice)""",
)
def f1_f2_npwp(v: Views):
    seller = F.col("npwp_penjual")
    dotted = F.regexp_replace(seller, r"^(\d{2})(\d{3})(\d{3})(\d)(\d{3})(\d{3})$", "$1.$2.$3.$4-$5.$6")
    return v.invoice.select(
        "row_idx",
        dotted.alias("dotted"),
        ids.normalize_npwp(dotted).alias("bare"),
        ids.format_npwp(seller).alias("shaped"),
        ids.format_npwp(F.concat(F.lit(" "), F.col("row_idx").cast("string"), F.lit(" "))).alias("short"),
    )


@query(
    "f3_f4_ids_in_text",
    r"""SELECT row_idx, coalesce(regexp_replace(regexp_replace(list_filter(regexp_extract_all(txt, '\d{2}\.?\d{3}\.?\d{3}\.?\d-?\d{3}\.?\d{3}'),
                 lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) = 15)[1], '[^0-9]', '', 'g'),
                 '^(\d{2})(\d{3})(\d{3})(\d)(\d{3})(\d{3})$', '\1.\2.\3.\4-\5.\6'), '') AS npwp,
               regexp_extract(txt, '\d{3}\.\d{3}-\d{2}\.\d{8}') AS serial FROM fx_papers""",
)
def f3_f4_ids_in_text(v: Views):
    t = F.col("txt")
    return rendered.papers(v).select(
        "row_idx",
        ids.extract_npwp(F.lit(None).cast("string"), t).alias("npwp"),
        ids.extract_invoice_serial(F.lit(""), t).alias("serial"),
    )


@query(
    "f5_vendor_name",
    r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(nm),
              '\b(PT|CV|UD|TBK|LTD|INC|CORP|LLC|PERSERO)\b', '', 'g'), '[^A-Z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS vendor
       FROM (SELECT c_custkey, ['PT. ', 'cv ', '', 'UD  '][c_custkey % 4 + 1] || c_name || [' Tbk', ' (Persero)', ', Ltd.', ''][c_custkey % 4 + 1] AS nm FROM customer)""",
)
def f5_vendor_name(v: Views):
    k = (F.col("c_custkey") % 4).cast("int")
    head = F.get(F.array(*[F.lit(x) for x in ("PT. ", "cv ", "", "UD  ")]), k)
    tail = F.get(F.array(*[F.lit(x) for x in (" Tbk", " (Persero)", ", Ltd.", "")]), k)
    return v.table("customer").select("c_custkey", ids.normalize_vendor(F.concat(head, "c_name", tail)).alias("vendor"))


# --- descriptions and classes ---------------------------------------------------------------------------

TITLE = (
    "array_to_string(list_transform(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''), lambda w: "
    "CASE WHEN length(w) <= CASE WHEN regexp_matches(w, '\\d') THEN 4 ELSE 3 END THEN upper(w) ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ')"
)


def _clean_description(c: str) -> str:
    out = c
    for prefix in text.DESCRIPTION_PREFIXES:
        out = f"regexp_replace({out}, '^{prefix}\\s*', '', 'i')"
    for code in text.REFERENCE_CODES:
        out = f"regexp_replace({out}, '{code}', '', 'gi')"
    for amount in text.LOOSE_AMOUNTS:
        out = f"regexp_replace({out}, '{amount}', '', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("f22_title_case", f"SELECT id, {TITLE.format(c='txt')} AS title FROM fx_descriptions")
def f22_title_case(v: Views):
    return rendered.descriptions(v).select("id", text.title_case(F.col("txt")).alias("title"))


@query(
    "f23_clean_description",
    f"SELECT id, CASE WHEN c = '' THEN txt ELSE c END AS cleaned FROM (SELECT id, txt, {_clean_description('txt')} AS c FROM fx_descriptions)",
)
def f23_clean_description(v: Views):
    return rendered.descriptions(v).select("id", text.clean_description(F.col("txt")).alias("cleaned"))


def _rules(c: str, rules, default: str) -> str:
    out = "CASE"
    for words, label in rules:
        test = " OR ".join(f"contains({c}, '{w}')" for w in words)
        out += f" WHEN {test} THEN '{label}'"
    return out + f" ELSE {default} END"


@query(
    "f35_money_source_and_purpose",
    f"""SELECT id, CASE WHEN kredit > 0 THEN {_rules('upper(txt)', text.MONEY_SOURCES, "'Transfer Masuk'")} ELSE '' END AS sumber,
              CASE WHEN debet > 0 THEN {_rules('upper(txt)', text.MONEY_PURPOSES, "'Pembayaran'")} ELSE '' END AS tujuan FROM fx_descriptions""",
)
def f35_money_source_and_purpose(v: Views):
    t = F.col("txt")
    return rendered.descriptions(v).select(
        "id", text.money_source(t, F.col("kredit")).alias("sumber"), text.money_purpose(t, F.col("debet")).alias("tujuan")
    )


@query(
    "f29_type_from_filename",
    f"""SELECT id, name, {_rules('lower(name)', text.FILENAME_TYPES, "'faktur_pajak'")} AS document_type,
              {_rules('lower(name)', text.EXPORT_TYPES, "'unknown'")} AS export_type FROM fx_files""",
)
def f29_type_from_filename(v: Views):
    name = F.col("name")
    return v.files.select("id", "name", text.type_from_filename(name).alias("document_type"), text.export_type(name).alias("export_type"))


def _tiers(c: str, tiers, floor: float) -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {n} THEN {s}e0" for n, s in tiers) + f" ELSE {floor}e0 END"


def _bonus() -> str:
    out = "CASE"
    for kind, words in text.QUALITY_WORDS.items():
        hits = " + ".join(f"contains(head, '{w}')::INTEGER" for w in words)
        out += f" WHEN document_type = '{kind}' THEN least(({hits}) * 0.05e0, 0.15e0)"
    return out + " ELSE 0e0 END"


@query(
    "f31_text_quality",
    f"""SELECT doc_id, document_type, CASE WHEN n = 0 THEN 0e0 ELSE greatest(0.1e0, least(0.99e0,
            {_tiers('n', text.LENGTH_TIERS, 0.2)} * 0.5e0 + {_tiers('lines', text.LINE_TIERS, 0.3)} * 0.3e0 + {_bonus()} * 0.2e0)) END AS quality
        FROM (SELECT *, length(extracted_text) AS n, len(string_split(extracted_text, chr(10))) AS lines,
                     lower(extracted_text) AS head FROM fx_text)""",
)
def f31_text_quality(v: Views):
    return v.texts.select(
        "doc_id", "document_type", text.text_quality(F.col("extracted_text"), F.col("document_type")).alias("quality")
    )


@query(
    "f37_article",
    f"""SELECT c_custkey, raw, CASE WHEN raw = '' THEN 'Pasal 23' ELSE {_rules('lower(raw)', text.ARTICLE_WORDS, 'raw')} END AS jenis_pph
        FROM (SELECT c_custkey, ['PPh Pasal 23', 'ps.4 ayat 2', 'PPh 4(2)', 'pph23', 'Pasal 26', '', 'PS 23', c_mktsegment][c_custkey % 8 + 1] AS raw FROM customer)""",
)
def f37_article(v: Views):
    options = [F.lit(x) for x in ("PPh Pasal 23", "ps.4 ayat 2", "PPh 4(2)", "pph23", "Pasal 26", "", "PS 23")] + [F.col("c_mktsegment")]
    raw = F.get(F.array(*options), (F.col("c_custkey") % 8).cast("int"))
    return v.table("customer").select("c_custkey", raw.alias("raw"), text.article(raw).alias("jenis_pph"))


@query(
    "f44_company_and_address",
    r"""SELECT row_idx, trim(regexp_replace(array_to_string(CASE WHEN len(keep) > 0 THEN keep ELSE lines END, ' '), '\s+', ' ', 'g'), ' ,') AS company,
               trim(array_to_string(CASE WHEN list_position(flags, true) > 0 THEN lines[1:list_position(flags, true) - 1] ELSE lines END, ', '), ' ,') AS address
        FROM (SELECT row_idx, lines, list_filter(lines, lambda t: NOT regexp_matches(t, '(?i)^(alamat|npwp|nomor|kode|invoice)')) AS keep,
                     list_transform(lines, lambda t: regexp_matches(t, '(?i)^(npwp|nomor|no\.?|kode|invoice|nama)')) AS flags
              FROM (SELECT row_idx, list_filter(list_transform(string_split(substr(txt, position('Alamat' IN txt)), chr(10)), lambda t: trim(t, ' ,')), lambda t: t <> '') AS lines FROM fx_papers))""",
)
def f44_company_and_address(v: Views):
    block = F.expr("substring(txt, instr(txt, 'Alamat'))")
    return rendered.papers(v).select("row_idx", text.company_name(block).alias("company"), text.address(block).alias("address"))


@query(
    "f49_cleaners",
    r"""SELECT c_custkey, upper(regexp_replace(trim(raw), '[^\p{L}\p{N}_/-]', '', 'g')) AS number,
               regexp_replace(raw, '[^0-9]', '', 'g') AS digits,
               length(raw) >= 3 AND length(regexp_replace(raw, '[^\p{L}\p{N}]', '', 'g')) >= length(raw) * 0.7 AS is_name
        FROM (SELECT c_custkey, [c_name, 'No. ' || c_custkey || '/INV-' || c_nationkey, '-- ' || c_custkey || ' --'][c_custkey % 3 + 1] AS raw FROM customer)""",
)
def f49_cleaners(v: Views):
    key = F.col("c_custkey").cast("string")
    options = [
        F.col("c_name"),
        F.concat(F.lit("No. "), key, F.lit("/INV-"), F.col("c_nationkey").cast("string")),
        F.concat(F.lit("-- "), key, F.lit(" --")),
    ]
    raw = F.get(F.array(*options), (F.col("c_custkey") % 3).cast("int"))
    return v.table("customer").select(
        "c_custkey",
        text.clean_document_number(raw).alias("number"),
        F.regexp_replace(raw, r"[^0-9]", "").alias("digits"),
        text.is_person_name(raw).alias("is_name"),
    )


@query(
    "u6_distinct_parts",
    r"""SELECT session_id, turn, CASE WHEN len(parts) = 0 THEN 'N/A' ELSE array_to_string(parts, ', ') END AS parts
        FROM (SELECT session_id, turn, list_transform(list_filter(list_zip(k, range(1, len(k) + 1)), lambda z: list_position(k, z[1]) = z[2]), lambda z: z[1]) AS parts
              FROM (SELECT session_id, turn, list_filter(list_transform(regexp_split_to_array(content, '[,\r\n]'), lambda p: trim(p)),
                 lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(alamat|npwp|nomor|no invoice|invoice|kode|nama\s+barang|nama\s*(penjual|pembeli|pt|cv))')) AS k FROM fx_messages))""",
)
def u6_distinct_parts(v: Views):
    return v.messages.select("session_id", "turn", text.distinct_parts(F.col("content")).alias("parts"))
