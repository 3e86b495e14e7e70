"""Text, date and amount functions on literal values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from worksight.functions import amounts as A
from worksight.functions import dates as D
from worksight.functions import parsing as P
from worksight.functions import text as T


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


D1 = lambda *x: dt.date(*x)
CASES = {
    "base_tender": (T.base_tender, {"A/WORK_INDENT1/CALL-3": "A/WORK_INDENT1", " x ": "x", None: ""}),
    "call_number": (T.call_number, {"A/CALL-3": 3, "A": 1, None: 1}),
    "norm": (T.norm, {"Improvments to DRIAN, 4th Main": "improvements to drain 4th main", None: "", "--": ""}),
    "content_words": (T.content_words, {"Improvement of road at 5th Block, 2024 and 12 parks": ["5th", "block", "12", "parks"], None: []}),
    "name_words": (T.name_words, {"M/s Balaji Constructions Balaji 99": ["balaji"], None: []}),
    "norm_name": (T.norm_name, {"M/s. Sri Balaji & Co. (1)": "balaji", "Mr K C Sridhar": "k c sridhar", None: ""}),
    "work_types": (T.work_types, {"Asphalting of roads and RCC drains": ["drain", "road"], "x": [], None: []}),
    "place_keys": (T.place_keys, {"5th Block 17th G Main and 3rd cross": ["block5", "cross3", "main17g"], "6th block": ["block6"], "x": []}),
    "ward_numbers": (T.ward_numbers, {"ward No 147 North, 148 East and 173 in package 12": ["147", "148", "173"], "Ward no.174 (Old No.151) x": ["151", "174"], "x": []}),
    "title_case": (T.title_case, {"st. john's 5TH": "St. John'S 5Th"}),
    "locations": (lambda c: T.extract_locations(c, r"\d+(?:st|nd|rd|th)\s*block|ews|hosur road", ("ews",)), {"at 5TH  block, EWS and 5th block, hosur ROAD": ["5th Block", "EWS", "Hosur Road"], "x": []}),
    "rate_code": (T.rate_code, {"as per KSRRB - 500.12 x": "KSRRB 500.12", "KRB M 7": "KSRB M7", "none": None}),
    "number_tokens": (T.number_tokens, {"1,23,456.78 m2 x3 5.": ["1,23,456.78", "5"]}),
    "html_unescape": (T.html_unescape, {"a &amp; b &#39;c&#x27; &eacute;": "a & b 'c' é", None: None}),
    "url_base_name": (T.url_base_name, {"https://x/y/a%20b.pdf": "a b.pdf", "https://x/%ZZ": "%ZZ"}),
    "english_words": (T.english_words, {"The total of the work": 5, "xq zz": 0, None: 0}),
    "long_words": (T.long_words, {"four words here abc": 3, None: 0}),
    "status_class": (T.status_class, {"Completed (final bill)": "done", "Running bill only": "active", "Tender under evaluation": "pending", None: "unknown"}),
    "day_text": (T.day_text, {"2024-01-05": "05 Jan 2024", "yes": "yes", "": None}),
    "document_date": (D.document_date, {"31.12.2020": D1(2020, 12, 31), "4/11/19": D1(2019, 11, 4), "31-09-2015": None, "1/1/2031": None, "x": None}),
    "order_date": (D.order_date, {"31 / 12 / 2020 and": D1(2020, 12, 31), "4.11.19": D1(2019, 11, 4), "30.02.2020": None, "1-1-2034": D1(2034, 1, 1)}),
    "record_date": (D.record_date, {"24-Jan-2024<br/> 13:52:05": D1(2024, 1, 24), "2024-01-24": D1(2024, 1, 24), "24-01-2024": D1(2024, 1, 24), "24/01/2024": D1(2024, 1, 24), "01-Jan-1900": None, "": None, None: None}),
    "collector_date": (D.collector_date, {"01-Jul-2025": "2025-07-01", "2025-07-01": "2025-07-01", "bad": "", None: ""}),
    "iso_date": (D.iso_date, {"2024-02-30": None, "2024-02-29T10": D1(2024, 2, 29), None: None}),
    "number": (A.number, {"1,23,456.78": 123456.78, "123,456.78": 123456.78, "78348,6418": 78348.6418, "2832.00": 2832.0, "x": None, "nan": None, None: None}),
    "unit": (A.unit, {"Sqm": "sqm", "Sq.m": "sqm", "m²": "sqm", "M2": "sqm", "Cum.": "cum", "cu.m": "cum", "m³": "cum", "RMT": "m", "Rm": "m", "metre": "m", "Running metre": "m", "Kms": "km", "Nos": "nos", "No.": "nos", "each": "nos", "L.S": "ls", "Kg": "kg", "banana": None, "": None}),
    "masked": (P.publishable, {"mail a.b@c.org or 080-22221188, +91 9876543210 x": "mail [e-mail removed] or [phone removed], [phone removed] x", "9876543210.": "9876543210.", "https://x.org/9876543210?m=a@b.cc ok": "https://x.org/9876543210?m=a@b.cc ok", "md5 9876543210": "md5 9876543210", "": "", None: None}),
}


@pytest.mark.parametrize("name", CASES)
def test_values(spark, name):
    f, cases = CASES[name]
    assert values(spark, list(cases), f) == list(cases.values())


def test_person_and_firm(spark):
    got = values(spark, ["Annavari Prakash( SRI BALAJI CONSTRUCTIONS )", "K Rao (1)", None], T.person_and_firm)
    assert [tuple(x) for x in got] == [("annavari prakash", "balaji constructions"), ("k rao", None), ("", None)]


def test_equivalent_wards(spark):
    assert values(spark, ["ward 151 x"], lambda c: T.ward_numbers(c, [("151", "174", "186"), ("173", "175")])) == [["151", "174", "186"]]


def test_amounts_shown(spark):
    rows = [None, 1_234_567.0, 543_990_000_0.0, 99_999.5, 0.0, 150_000.0]
    assert values(spark, rows, T.rupees, "double") == [None, "₹12.35 L", "₹543.99 Cr", "₹100,000", "₹0", "₹1.50 L"]
    assert values(spark, rows, T.rupees_in_case, "double")[:2] == ["unknown", "₹12.3 L"]
    assert values(spark, rows, T.rupees_in_chart, "double")[:3] == ["₹0", "₹12 L", "₹544.0 Cr"]
    assert values(spark, rows, T.rupees_in_full, "double") == [None, "₹12,34,567", "₹5,43,99,00,000", "₹1,00,000", "₹0", "₹1,50,000"]
    assert values(spark, [1200.0, 1.5, 0.25, 10.0], T.quantity, "double") == ["1,200", "1.5", "0.25", "10"]


def test_fact_text(spark):
    rows = [("contract_value", "150000"), ("awarded_date", "2024-01-05"), ("period_days", "180"), ("period_days", "30"), ("paid_vs_contract", "1.254"), ("tender_calls", "1"), ("tender_calls", "3"), ("status", "x"), ("status", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, v string")
    got = [r.t for r in df.select("i", T.fact_text(F.col("f"), F.col("v"), ["contract_value"], ["awarded_date"]).alias("t")).orderBy("i").collect()]
    assert got == ["₹1.50 L", "05 Jan 2024", "180 days (~6 months)", "30 days", "125%", "1 (first call)", "3 calls", "x", None]


def test_periods(spark):
    texts = ["Period of Completion : 180 days", "time for completion 6 (Six) Months including", "Defects liability period 365 days", "Completion period\nNote: 90 days; stipulated period twelve months", "period of completion 3 days", None]
    got = values(spark, texts, D.completion_period)
    assert [x and (x.days, x.text) for x in got] == [(180, "180 days"), (180, "6 (Six) Months"), None, (360, "twelve months"), None, None]


def test_windows_of_dates(spark):
    df = spark.createDataFrame([(D1(2015, 4, 1), D1(2016, 5, 15))], "a date, b date")
    row = df.select(D.quarters(F.col("a"), F.col("b")).alias("q"), D.quarter_end(F.lit("2016-05-15").cast("date")).alias("e"), D.whole_units(F.col("a"), F.col("b"), 30).alias("m"), D.add_days(F.col("a"), F.lit(180)).alias("d")).first()
    assert len(row.q) == 5 and row.q[0].begin == D1(2015, 4, 1) and row.q[-1].end == D1(2016, 5, 15)
    assert all(b.begin == a.end + dt.timedelta(1) for a, b in zip(row.q, row.q[1:])) and row.e == D1(2016, 6, 30)
    assert row.m == math.floor(-410 / 30) and row.d == D1(2015, 9, 28)


def test_units_convert(spark):
    rows = [(1.2, "km", "m"), (500.0, "m", "km"), (10.0, "sqm", "sqm"), (10.0, "sqm", "cum"), (None, "m", "m"), (1.0, None, "m")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v double, a string, b string")
    got = [r.x for r in df.select("i", A.convert(F.col("v"), F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == [pytest.approx(1200), pytest.approx(0.5), 10, None, None, None]
    ok = [r.x for r in df.select("i", A.units_agree(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert ok == [True, True, True, False, True, True]


def test_priced_rows(spark):
    rows = [["1", "12.50", "200.00", "2500.00"], ["5", "870", "870"], ["12.5", "200.25", "250312"], ["1250", "200.00", "2500.00"], ["2", "3", "6"], [], None]
    got = values(spark, rows, A.find_priced_row, "array<string>")
    assert [tuple(x) for x in got] == [(12.5, 200.0, 2500.0, "arithmetic"), (None,) * 4, (12.5, 200.25, 2503.12, "decimal restored"), (12.5, 200.0, 2500.0, "decimal restored"), (None,) * 4, (None,) * 4, (None,) * 4]
    df = spark.createDataFrame([(["10", "20.00", "200.00", "30", "600.00"], 20.0, 200.0), (["1"], 2.0, 3.0)], "t array<string>, r double, a double")
    assert [r.q for r in df.select(A.up_to_date_quantity("t", "r", "a").alias("q")).collect()] == [30.0, None]


def test_rows_turned_round(spark):
    df = spark.createDataFrame([(200.0, 200.0, 12.5), (200.0, 12.5, 200.0)], "p double, q double, r double")
    got = [tuple(x.o) for x in df.select(A.oriented(F.col("p"), F.col("q"), F.col("r")).alias("o")).collect()]
    assert got == [(12.5, 200.0, True), (12.5, 200.0, False)]


def test_tiles(spark):
    lat, lon, z = 12.93, 77.62, 17
    want = (int((lon + 180) / 360 * 2**z), int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**z))
    assert tuple(spark.range(1).select(A.tile(F.lit(lat), F.lit(lon), z).alias("t")).first().t) == want
