"""What must not grow faster than its rows: expressions are evaluated once, repeated rows are not broadcast."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from neraca.functions import dates, text
from neraca.operators import documents, match


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "use, mark, most",
    [
        (dates.long_date, "[,.;]+$", 1),
        (dates.slash_date, "trim(txt", 2),
        (lambda c: dates.invoice_date(F.lit(""), c), "[,.;]+$", 1),
        (documents.item_block, "split(txt", 1),
        (text.company_name, "split(txt", 1),
        (text.address, "split(txt", 1),
    ],
)
def test_a_text_is_taken_apart_once(spark, use, mark, most):
    found = _plan(spark.range(1).select(F.col("id").cast("string").alias("txt")).repartition(2).select(use(F.col("txt")).alias("out")))
    assert 0 < found.replace("txt#", "txt").count(mark) <= most


def test_odd_texts_keep_their_results(spark):
    rows = [(None,), ("",), (" ;; ",), ("5 Mei 24,",), ("31/12/99",), ("1.2.2024",), ("2024-13-01",), ("40 Mei 2024",), ("12 Foo 2024",), ("01/02/2024.",)]
    df = spark.createDataFrame(rows, "txt string")
    got = [r[0] for r in df.select(dates.long_date(F.col("txt"))).collect()]
    assert got == ["", "", "", "05 Mei 2024", "31 Desember 1999", "01 Februari 2024", "", "", "", "01 Februari 2024"]
    got = [r[0] for r in df.select(dates.slash_date(F.col("txt"))).collect()]
    assert got[:3] == ["N/A", "N/A", ";;"] and got[4:6] == ["31/12/1999", "1.2.2024"]
    blocks = [None, "", "x", "Nama Barang", "NAMA BARANG\n\nRp 5\nA;\n12\nA\nB,\n\nC", "nama barang\nDPP: 1\nKabel\nTotal\nLampu"]
    df = spark.createDataFrame([(b,) for b in blocks], "txt string")
    assert [r[0] for r in df.select(documents.item_block(F.col("txt"))).collect()] == ["N/A", "N/A", "N/A", "N/A", "A, B", "Kabel"]
    addresses = [None, "", "Jl. A,\r\n\tKota ,\nNPWP 1\nB", "NPWP 1"]
    df = spark.createDataFrame([(a,) for a in addresses], "txt string")
    assert [r[0] for r in df.select(text.address(F.col("txt"))).collect()] == [None, "", "Jl. A, Kota", ""]
    assert [r[0] for r in df.select(text.company_name(F.col("txt"))).collect()] == [None, "", "Jl. A Kota B", "NPWP 1"]


def _rows(spark, rng, n, amount):
    day = datetime.date(2024, 1, 1)
    made = [("s", i, day + datetime.timedelta(rng.randrange(40)) if i % 17 else None, rng.choice([100.0, 101.9, 102.0, 98.0, 0.0, -100.0, 250.0])) for i in range(n)]
    return made, spark.createDataFrame(made, f"scope string, row_idx long, tanggal date, {amount} double")


def test_near_pairs_are_all_pairs_once(spark):
    rng = random.Random(4)
    (a, left), (b, right) = _rows(spark, rng, 120, "total"), _rows(spark, rng, 150, "debet")
    got = sorted(tuple(r) for r in match.score_invoices_and_payments(left, right).select("l_idx", "r_idx").collect())
    want = []
    for _, i, d, x in a:
        for _, j, e, y in b:
            if d and e and x and y > 0 and abs((d - e).days) <= 7 and abs((x - y) / max(x, y)) * 100 <= 2:
                gap, pct = abs((d - e).days), abs((x - y) / max(x, y)) * 100
                if (1 - gap / 7 * 0.3 + 1 - pct / 2 * 0.3) / 2 >= 0.7 - 1e-12:
                    want.append((i, j))
    assert got == sorted(want) and got


def test_repeated_rows_are_not_broadcast(spark):
    _, left = _rows(spark, random.Random(1), 20, "total")
    _, right = _rows(spark, random.Random(2), 20, "debet")
    found = match.score_invoices_and_payments(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in found and "SortMergeJoin" in found
