"""Known answers for the parsers."""

from pyspark.sql import functions as F

from neraca.functions import dates, ids, money, text


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["out"] for r in df.select("i", fn(F.col("c")).alias("out")).orderBy("i").collect()]


def test_clean_amount(spark):
    got = column(spark, ["Rp 1.000.000,50", "1,000,000.50", "1000,5", "1.000", "1,000", "12.5", "", None, "abc", "-7"], money.clean_amount)
    assert [float(x) for x in got] == [1000000.5, 1000000.5, 1000.5, 1000, 1000, 12.5, 0, 0, 0, -7]


def test_extract_amount(spark):
    got = column(spark, ["Rp 1.000.000,00", "1,000,000.00", "1.000.000", "(1.000.000)", "-", "N/A", "x", None, "12,34", "12,345"], money.extract_amount)
    assert [None if x is None else float(x) for x in got] == [1e6, 1e6, 1e6, -1e6, None, None, None, None, 12.34, 12345]


def test_misread_amount(spark):
    got = column(spark, ["953,628,332.69", "Rp 1.000,00", "", "IDR 12", "-"], money.misread_amount)
    assert got == ["953628332", "100000", "", "12", "-"]


def test_signs(spark):
    df = spark.createDataFrame([("1,000,000.00",), ("(1,000,000.00)",), ("-1,000,000.00",), ("1,000,000.00 CR",), ("1,000,000.00 DB",)], "c string")
    got = [(float(r["s"]["debit"]), float(r["s"]["credit"])) for r in df.select(money.sides_by_mark(F.col("c")).alias("s")).collect()]
    assert got == [(0, 1e6), (1e6, 0), (1e6, 0), (0, 1e6), (1e6, 0)]


def test_rupiah(spark):
    assert column(spark, [1234567.89, 0.0, None], money.format_rupiah, "double") == ["Rp 1.234.567", "-", "-"]
    assert column(spark, ["1.234.567", "-", "N/A", "abc"], money.format_rupiah_text) == ["Rp 1.234.567", "-", "-", "abc"]


def test_complete_date(spark):
    given = ["01/01", "15/03", "01 JAN", "15 agustus 2025", "15/08/25", "01/01/2025", "1/3", "2025-08-15", "August 15, 2025", "2025-08-15T07:05", "x"]
    want = ["01/01/2025", "15/03/2025", "01/01/2025", "15/08/2025", "15/08/2025", "01/01/2025", "01/03/2025", "15/08/2025", "15/08/2025", "15/08/2025 07:05:00", "x"]
    assert column(spark, given, lambda c: dates.complete_date(c, F.lit("2025"))) == want


def test_parse_date(spark):
    got = column(spark, ["31/12/21", "31-12-70", "2021-12-31", "31 12 2021", "31/02/2021", "", None, "1/2/2024"], lambda c: dates.parse_date(c, dates.ENGINE_FORMATS))
    assert [str(x) if x else None for x in got] == ["2021-12-31", "1970-12-31", "2021-12-31", "2021-12-31", None, None, None, "2024-02-01"]


def test_long_date(spark):
    assert column(spark, ["12 Oktober 2025", "01-02-49", "01-02-50", "2024/3/4", "40/01/2024"], dates.long_date) == [
        "12 Oktober 2025", "01 Februari 2049", "01 Februari 1950", "04 Maret 2024", "",
    ]


def test_sort_key(spark):
    got = column(spark, ["01/02/2025", "03/04", "5 MEI", "5 mei 2020", "?", None], dates.sort_key)
    assert [tuple(x) for x in got] == [(2025, 2, 1), (9999, 4, 3), (9999, 5, 5), (2020, 5, 5), (9999, 12, 31), (9999, 12, 31)]


def test_row_date(spark):
    assert column(spark, ["01/02/2024", "01-02-24", "5 Jan 2024", "7 Agustus 2024", "2024-03-04", "-"], dates.row_date) == [
        "2024-02-01", "2024-02-01", "2024-01-05", "2024-08-07", "2024-03-04", None,
    ]


def test_descriptions(spark):
    assert column(spark, ["TRUCKING UNICER S1232"], text.title_case) == ["Trucking Unicer S1232"]
    given = ["TRSF E-BANKING CR 0107/FTSCY/WS95051 8800000.00 PT MAJU", "bi-fast db 1407/ADSCY/0000100", "KR OTOMATIS 1,350,000.00 Toko"]
    assert column(spark, given, text.clean_description) == ["PT MAJU", "bi-fast db 1407/ADSCY/0000100", "Toko"]


def test_ids(spark):
    assert column(spark, ["02.345.678.9-012.000", None, " 7 "], ids.normalize_npwp) == ["023456789012000", "", "7"]
    assert column(spark, ["023456789012000", " 12 "], ids.format_npwp) == ["02.345.678.9-012.000", "12"]
    assert column(spark, ["PT. Maju  Jaya, Tbk", "(CV) A-B", None], ids.normalize_vendor) == ["MAJU JAYA", "AB", ""]


def test_classes(spark):
    assert column(spark, ["Rek_BCA.xlsx", "PPh21_x", "batch_1", "tagihan"], text.type_from_filename) == ["faktur_pajak", "pph21", "faktur_pajak", "invoice"]
    assert column(spark, ["Rek_BCA.xlsx", "PPh21_x", "batch_fp", "x"], text.export_type) == ["rekening_koran", "pph21", "batch", "unknown"]
    assert column(spark, ["ps.4 ayat 2", "PPh 23", "", "Pasal 26"], text.article) == ["Pasal 4 ayat 2", "Pasal 23", "Pasal 23", "Pasal 26"]
