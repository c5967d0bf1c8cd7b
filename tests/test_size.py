"""What large tables need: inputs derived once, texts searched once, no more rows than can match."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from neraca.functions.text import export_type
from neraca.operators import match, statement
from neraca.sources import readers


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def _invoices(spark, rows):
    return spark.createDataFrame([(*r[:3], Decimal(r[3])) for r in rows], "scope string, row_idx long, tanggal date, total decimal(18,2)")


def _payments(spark, rows):
    return spark.createDataFrame([(*r[:3], Decimal(r[3])) for r in rows], "scope string, row_idx long, tanggal date, debet decimal(18,2)")


def test_invoices_ask_on_paid_days_only(spark, monkeypatch):
    kept = []

    def counting(df, *more):
        kept.append(original(df, *more))
        return kept[-1]

    original = match.cut_lineage
    monkeypatch.setattr(match, "cut_lineage", counting)
    b = _invoices(spark, [("x", n, _day(n % 40), 100 + n) for n in range(80)] + [(None, 500, _day(3), 100)])
    e = _payments(spark, [("x", 1, _day(10), 101), ("x", 2, _day(200), 5), (None, 3, _day(4), 100), ("y", 4, _day(10), 100)])
    found = {tuple(r) for r in match.best_payment(b, e).collect()}
    # 22 invoices lie within five days of a payment of x, one of nobody's; four payments and four days' firsts.
    assert kept[0].count() == 23 + 4 + 4
    plain = {tuple(r) for r in match.best_candidate(match.payment_candidates(b, e)).collect()}
    assert plain and {r for r in found if r[0] is not None} == plain
    assert {r[:3] for r in found if r[0] is None} == {(None, 500, 3)}


def test_best_payment_far_and_near_days(spark):
    b = _invoices(spark, [("x", 1, _day(0), 100), ("x", 2, _day(16), 100), ("x", 3, _day(11), 100), ("x", 4, _day(30), 100)])
    e = _payments(spark, [("x", 7, _day(5), 100), ("x", 8, _day(6), 100), ("x", 9, _day(12), 400)])
    rows = {r.b_idx: r.e_idx for r in match.best_payment(b, e).collect()}
    plain = {r.b_idx: r.e_idx for r in match.best_candidate(match.payment_candidates(b, e)).collect()}
    assert rows == plain and rows[1] == 7 and rows[3] in (8, 9) and 4 not in rows


def test_pairs_by_key_read_what_was_written(spark):
    a = spark.range(20).select(F.lit("x").alias("scope"), F.col("id").alias("row_idx"), (F.col("id") % 3).cast("string").alias("p"))
    c = spark.range(9).select(F.lit("x").alias("scope"), F.col("id").alias("row_idx"), (F.col("id") % 3).cast("string").alias("q"))
    pairs = match.pair_by_key(a, c, "p", "q")
    assert "Range" not in _optimized(pairs)
    assert pairs.count() == 9
    numbered = match.number_matches(a, "row_idx", "m")
    assert "Range" not in _optimized(numbered)
    assert {r.match_id for r in numbered.collect()} == {f"m_{n}" for n in range(1, 21)}


def test_bank_words_are_looked_for_once(spark):
    docs = spark.createDataFrame([(1, "pt bank mandiri\nPOSTING DATE"), (2, None)], "doc_id long, text string")
    scores = statement.bank_scores(docs)
    assert _optimized(scores).count("Contains(") == sum(map(len, statement.BANK_WORDS.values()))
    first = scores.filter("place = 1").orderBy("doc_id").collect()
    assert [(r.bank_code, r.keyword_matches, r.is_detected) for r in first] == [("MANDIRI_V1", 2, True), ("BSI_SYARIAH", 0, False)]


def test_export_type_writes_its_name_once(spark):
    files = spark.range(6).select(F.concat(F.lit("/e/"), F.when(F.col("id") < 5, F.concat(F.lit("Rek_"), F.col("id").cast("string"))).otherwise("~Rek")).alias("path"), F.lit(1).alias("length"), F.lit(1).alias("modificationTime"))
    listed = readers.catalogue_of(files, "rekening_koran")
    assert _optimized(listed).count("lower(") <= 2
    assert listed.count() == 5
    kinds = spark.createDataFrame([("BATCH x",), (None,), ("",)], "n string").select(export_type(F.col("n")).alias("k")).collect()
    assert [r.k for r in kinds] == ["batch", "unknown", "unknown"]


def test_sheet_cells_are_written_once(spark):
    cells = F.array(*[F.format_number(F.col("id") * (n + 2), 2) for n in range(7)])
    rows = spark.range(10, 30).select(F.lit(1).alias("file"), F.col("id").alias("row_idx"), F.when(F.col("id") == 12, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(cells).alias("cells"))
    head = spark.range(1).select(F.lit(1).alias("file"), F.lit(2).cast("long").alias("row_idx"), F.array(*[F.lit(x) for x in "ABCDE"]).alias("cells"))
    body = readers.bank_rows(readers.body_rows(rows.unionByName(head)))
    # Once for the rows, once where headers are looked for.
    assert _optimized(body).count("format_number") <= 14
    assert {r.row_number for r in body.collect()} == set(range(10, 30)) - {12}
