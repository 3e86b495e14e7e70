"""Scope, classes and entities on literal records."""

import json

import pytest
from pyspark.sql import functions as F

from worksight.operators import entities as E
from worksight.operators import scope as S

AREA = dict(area_name="Greenfield", slug="greenfield", locality_regex=r"green\s*field", exclude_regex=r"greenfield\s*valley|\bg-?7\b", not_city_regex="grama panchayat|rural",
            ward_maps={"198": ["151"], "225": ["174"], "243": ["186"]}, ward_equivalents=[["151", "174", "186"]], unused=1)


@pytest.fixture(scope="module")
def area(tmp_path_factory):
    at = tmp_path_factory.mktemp("area") / "greenfield.json"
    at.write_text(json.dumps(AREA))
    return S.load_area(str(at))


def test_scope(spark, area):
    rows = [("Asphalting", "198", "151", None, True), ("Asphalting", "225", "0174", None, True), ("Asphalting", "243", "186", None, True), ("Asphalting", "243", "151", None, False),
            ("Asphalting", "198", None, "151-19-000072", True), ("Asphalting", "225", None, "174-25-000072", False), ("Drains at 7th block, Greenfield in ward No.147", None, None, None, True),
            ("Primary drains in Greenfield Valley package 3", None, None, None, False), ("Toilet in Green field Grama Panchayath", None, None, None, False),
            ("From Greenfield Valley to Greenfield town", None, None, None, True), (None, None, None, None, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, r string, w string, j string, want boolean")
    got = df.select("i", "want", S.scope_reason(area, *map(F.col, "trwj")).alias("y")).orderBy("i").collect()
    assert [r.y is not None for r in got] == [r.want for r in got]
    assert got[0].y == "Booked to Greenfield ward (151 under the 198-ward map)"
    assert got[6].y == 'Work description names Greenfield: "…Drains at 7th block, Greenfield in ward No.147…"'


def test_classes(spark):
    cases = {
        "Arranging temporary illumination to Ganesha immersion": None, "Providing Project Management Consultancy services for flyover": None,
        "Renovation of toilets, modular kitchen, wardrobe in Qtrs No.403": None, "Improvements to roads, drains and footpath in 8th block": "Roads, drains & footpaths (combined)",
        "Construction of RCC box drain in ward 186": "Drains & storm-water", "Filling of potholes in Sub Division": "Roads", "Construction of Elevated corridor ... flyover": "Junctions, flyovers & grade separators",
        "Roads and storm water drain": "Drains & storm-water", "xyz": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r.c for r in df.select("i", S.classify(F.col("t")).alias("c")).orderBy("i").collect()] == list(cases.values())


def test_grid_rows(spark, area):
    rows = [("Work at Greenfield", "100", "20", "100-20-000001"), ("Work in ward No.151 Greenfield", "151", "20", "151-20-000001"), ("Road", "151", "20", "151-20-000002"), ("ward No.151 Riverside road", "151", "20", "151-20-000003"),
            ("Road", "151", "23", "151-23-000001"), ("Road", "320", "20", "320-20-000001"), ("ward no 174 and others", "174", "25", "174-25-000001"), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, description string, ward_prefix string, job_year string, job_number string")
    got = S.grid_scope(df, area).orderBy("i").collect()
    assert [r.scope_basis for r in got] == ["description", "description", "ward_prefix", "ward_conflict", None, None, "ward_prefix", None]
    assert [r.regime for r in got] == ["198", "198", "198", "198", "243", "dept", "225", None] and got[3].scope_reason is None


def test_a_bad_pattern_fails_at_once():
    with pytest.raises(Exception):
        S.Area("x", "x", "(", {})


def test_entities(spark):
    bills = [("SRI VINAYAKA ELECTR", "024046", "9000000002"), ("M/s Sri Vinayaka Electricals", None, "9000000002"), ("Sri Durga Enterprises", None, "9000000001"), ("A K Enterprises", None, "9000000001"),
             ("SREEDHARA.K.C", "022360", None), ("BALAJI CONSTRUCTIONS", None, None), ("vijayalakshmi associ", None, None), ("Vijayalakshmi Associates", None, None), (None, "1", None),
             ("AGENT ONE", "000001", "9000000009"), ("AGENT ONE B", "000002", "9000000009"), ("AGENT ONE C", "000003", "9000000009"), ("OLD NAME", "000007", None), ("NEW NAME", "000007", None)]
    tenders = [("K C SREEDHARA", 1384, [("K C SREEDHARA",)]), ("UMESH KUMAR K( BALAJI CONSTRUCTIONS )", 1, []), ("Annavari Prakash( SRI BALAJI CONSTRUCTIONS )", 2, []), (None, None, [("Lone Bidder",)])]
    b = spark.createDataFrame(bills, "contractor string, contractor_code string, phone string")
    t = spark.createDataFrame(tenders, "contractor string, supplier_id int, bidders array<struct<name string>>")
    entities, of, ambiguous = E.resolve(b, t)
    ents, e = {r.entity: r for r in entities.collect()}, {r["name"]: r.entity for r in of.collect()}
    assert e["SRI VINAYAKA ELECTR"] == e["M/s Sri Vinayaka Electricals"] and e["Sri Durga Enterprises"] != e["A K Enterprises"]
    assert e["SREEDHARA.K.C"] == e["K C SREEDHARA"] and e["vijayalakshmi associ"] == e["Vijayalakshmi Associates"]
    assert len({e[n] for n in ("BALAJI CONSTRUCTIONS", "UMESH KUMAR K( BALAJI CONSTRUCTIONS )", "Annavari Prakash( SRI BALAJI CONSTRUCTIONS )")}) == 3 and ambiguous.count() == 2
    assert len({e[n] for n in ("AGENT ONE", "AGENT ONE B", "AGENT ONE C")}) == 3
    s = ents[e["SREEDHARA.K.C"]]
    assert s.basis == "inferred" and s.ids == ["portal:1384", "register:022360"] and s.systems == ["bills", "portal"] and s.entity == "C0001" and s.rules == {"cross_system_name": 1}
    assert ents[e["OLD NAME"]].basis == "confirmed" and ents[e["Lone Bidder"]].basis == "confirmed" and ents[e["OLD NAME"]].rules == {"register_code": 1}
    linked = spark.createDataFrame([("UMESH KUMAR K( BALAJI CONSTRUCTIONS )", "Balaji Constructions")], "contractor string, payee string")
    e = {r["name"]: r.entity for r in E.resolve(b, t, linked)[1].collect()}
    assert e["BALAJI CONSTRUCTIONS"] == e["UMESH KUMAR K( BALAJI CONSTRUCTIONS )"] != e["Annavari Prakash( SRI BALAJI CONSTRUCTIONS )"]


def test_ratios(spark):
    from difflib import SequenceMatcher

    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", ""), ("road works " * 30, "works road " * 30), (None, "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", E.sequence_ratio("a", "b").alias("r"), E.quick_ratio(F.col("a"), F.col("b")).alias("q")).orderBy("i").collect()
    assert [r.r for r in got[:-1]] == [SequenceMatcher(None, *p).ratio() for p in pairs[:-1]] and got[-1].r == 0
    assert [r.q for r in got[:-1]] == [pytest.approx(SequenceMatcher(None, *p).quick_ratio()) for p in pairs[:-1]]


def test_texts_of_no_category_are_told_by_one_pattern(spark):
    import re

    words = [w for _, p in S.CATEGORIES for w in S._alternatives(p)]
    shown = [re.sub(r"\\b|(?<= )\?", "", w).replace(" ?", " ").upper() for w in words]
    pattern = S.any_of(tuple(p for _, p in S.CATEGORIES))
    assert all(re.search(pattern, f"x {w} y") for w in shown) and not re.search(pattern, "nothing of it: sw, dra, ltd")
    assert len(re.findall(r"(?<!\\)\|", re.sub(r"\(\?:[^()]*\)", "", pattern))) < 30 < len(words)  # tried at each letter
