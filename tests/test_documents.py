"""Mined values, extension orders, priced rows and sheets' totals of literal pages; items matched; cases scored."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from worksight.operators import cases as C
from worksight.operators import dataset_signals as S
from worksight.operators import documents as D

ORDER = """No: EE (PC-9)/WO/ 03/2023-24 Date: 15.11.2023
Ref: 1. This office Tender Notification No.EE/PC-9/TEND/01/2022-23 dated:28.02.2023.
3. Letter of Acceptance No. EE/PC-9/PR/41/2023-24 Dtd: 22.09.2023
4. Contract Agreement No: EE/PC-9/AGG/03/2023-24 Dtd:15.11.2023
for a tender Price of Rupees. 176,11,00,000/- (Rupees One Hundred and Seventy Six Crores)
4. Time of Completion 15 Months
5 Date of Commencement of Worle 15.11.2023
6. Date of Completion 14.02.2025
Lat 12.93412 Long 77.62245"""
SCHEDULE = """SCHEDULE - B
1 Removing BS Slab of drain and Stacking Sqm 2832.00 50.11 Fifty and Eleven 141911.52
2 Refixing Stone Slabs of drains and Pointing in C.M(1:3) Sqm 2548.80 | 70.04 Seventy 178517.95 |
KSRRB 300-1. Earthwork excavation for desilting of drains
3 upto 0.5 m, excavated surface leveled and sides neatly Cum. 805.20 | 189.22 Eighty Nine 152359.94 |
4 a row the scanner mangled Cum 193.0 — 151987.50
"""
SHEET = """MEASUREMENT SHEET
KSRRB 500-7. Providing and applying tack coat on the prepared black topped surfaces
Chainage Breadth Average Quantity
0 30 1 30 9.25 9.70 9.48 284.25
Quantity Paid In First Bill = 5070.10 Sqm
Quantity Paid In This Bill = 5838.89 Sqm
Total Quantity 10908.99 Sqm
"""


def pages(spark, *texts, **more):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, page int, text string").withColumns({k: F.lit(v) for k, v in more.items()})


def test_patterns(spark):
    got = {}
    for r in D.mine(pages(spark, ORDER, None, "", "period of completion 3 days; Date of completion 31-09-2015; tender premium : 5.5 % below; time extension granted"), box=(12.7, 13.25, 77.35, 77.85)).collect():
        got.setdefault((r.page, r.field), r)
    v = lambda k: got[0, k]
    assert v("contract_value").number == 1761100000 and v("period").number == 450 and v("commencement_date").date == dt.date(2023, 11, 15) and v("date_of_completion").date == dt.date(2025, 2, 14)
    assert (v("loa_ref").value, v("loa_ref").date) == ("EE/PC-9/PR/41/2023-24", dt.date(2023, 9, 22)) and v("agreement_ref").date == v("work_order_ref").date == dt.date(2023, 11, 15)
    assert (v("gps").lat, v("gps").lon) == (12.93412, 77.62245) and v("tender_ref").value.endswith("EE/PC-9/TEND/01/2022-23")
    assert {k[1] for k in got if k[0] == 3} == {"tender_premium", "time_extension"} and got[3, "tender_premium"].number == -5.5 and got[3, "time_extension"].value == "true"
    assert not D.mine(pages(spark, ORDER), box=(0, 1, 0, 1)).filter("field = 'gps'").count()


def test_extensions(spark):
    texts = ["The extension of time is accorded\n| from 31/12/2020 to 31/12/2021 (365 days) with a nominal fine of Rs 1.09 crore considering", "extension of time from 31/02/2020 to 99/99/2021", "time is extended up to 4.11.19 only", None]
    got = D.extension_orders(pages(spark, *texts)).orderBy("page").collect()
    assert [(r.page, r.start, r.until, r.days) for r in got] == [(0, dt.date(2020, 12, 31), dt.date(2021, 12, 31), 365), (2, None, dt.date(2019, 11, 4), None)] and got[0].fine == pytest.approx(1.09e7)


def test_schedules_and_sheets(spark):
    got = D.priced_rows(pages(spark, SCHEDULE, kind="schedule_b")).orderBy("line").collect()
    assert [(r.unit, r.quantity, r.rate, r.amount, r.check, r.confidence) for r in got] == [("sqm", 2832.0, 50.11, 141911.52, "arithmetic", "high"), ("sqm", 2548.8, 70.04, 178517.95, "arithmetic", "high"), ("cum", 805.2, 189.22, 152359.94, "arithmetic", "high")]
    assert [r.code for r in got] == [None, None, "KSRRB 300-1"] and "Removing BS Slab" not in got[1].description and "Earthwork" in got[2].description and got[0].to_date_quantity is None
    assert D.priced_rows(pages(spark, SHEET, kind="measurement")).count() == 0
    t = D.sheet_totals(pages(spark, SHEET, "Dimensions 1 2 3", None)).collect()
    assert [(r.previous, r.this_bill, r.total, r.unit, r.consistent, r.code) for r in t] == [(5070.10, 5838.89, 10908.99, "sqm", True, "KSRRB 500-7")]
    kinds = spark.createDataFrame([("Chainage x", "M.B."), ("Rate and Amount", "M.B."), ("x", "Bill Form"), ("x", "Schedule B"), (None, "Estimates")], "t string, k string")
    assert [r.p for r in kinds.select(D.page_kind(F.col("t"), F.col("k")).alias("p")).collect()] == ["measurement", "abstract", "abstract", "schedule_b", "estimate"]
    names = spark.createDataFrame([("Tack coat",), ("Earth work",), ("zzz",), (None,)], "d string")
    assert [r.c for r in names.select(D.item_category(F.col("d")).alias("c")).collect()] == ["Bituminous surfacing", "Earthwork & excavation", "Other", "Other"]


def test_kinds_of_documents(spark):
    rows = [("work slip 1", "M.B.", True), ("mb", "M.B.", True), ("mb", "M.B.", False), ("x", "Work Order", False), ("x", "Supplementary Schedule B", False), (None, None, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, k string, f boolean").orderBy("i")
    assert [r.d for r in df.select(D.document_kind(F.col("n"), F.col("k"), F.col("f")).alias("d")).collect()] == ["variation", "final_bill", None, "work order", "variation", None]
    kinds = spark.createDataFrame([("Site Photo",), ("DPR photo",), ("EOT",), ("Letter",), (None,)], "k string")
    assert [r.w for r in kinds.select(D.wanted(F.col("k")).alias("w")).collect()] == [True, False, True, False, False]


def test_prices_of_orders(spark):
    df = spark.createDataFrame([("j", "at Tender Price of Rs. 3,50,81,648/- and Tender Price of Rs. 3,50,81,648/-; contract price Rs 9,999"), ("j", None), ("k", "total value of the work is Rs.\n1,00,000.50")], "job string, text string")
    assert sorted(map(tuple, D.work_order_values(df).collect())) == [("j", 35081648.0), ("k", 100000.5)]


def test_items_are_matched(spark):
    plan = [("j", 1, "KSRRB 500", "sqm", 50.0, "providing tack coat on surface"), ("j", 2, None, "cum", 200.0, "earthwork excavation in soil"), ("j", 3, None, "cum", 333.0, "granite slab laying"), ("j", 4, None, "cum", 333.5, "hume pipe laying")]
    billed = [("j", 1, "KSRRB 500", "sqm", 10.0, 55.0, "x"), ("j", 2, None, "cum", 9.0, 200.5, "earthwork in soil excavation"), ("j", 3, "KSRRB 500", "cum", 10.0, 50.0, "tack coat"), ("j", 4, "KSRRB 500", "sqm", 10.0, 90.0, "tack coat"), ("j", 5, "KSRRB 500", "sqm", 50.0, 12.5, "tack"), ("j", 6, None, None, 4.0, 300.0, "hume pipe laying"), ("k", 1, None, None, 1.0, 1.0, "a")]
    p = spark.createDataFrame(plan, "job string, item int, code string, unit string, rate double, description string")
    b = spark.createDataFrame(billed, "job string, row int, code string, unit string, quantity double, rate double, description string")
    got = {(r.job, r.row): (r.item, r.match, r.swapped, r.quantity) for r in D.match_items(p, b).collect()}
    assert got == {("j", 1): (1, "code", False, 10.0), ("j", 2): (2, "rate", False, 9.0), ("j", 5): (1, "code", True, 12.5), ("j", 6): (4, "description", False, 4.0)}
    rows = spark.createDataFrame([(100.0, 200.0, 197.0, "low"), (100.0, 200.0, 150.0, "low"), (100.0, 200.0, 100.0, "high"), (100.0, 200.0, 100.0, "medium"), (100.0, 200.0, None, None)], "p double, b double, e double, c string")
    assert [r.s for r in rows.select(D.reconciled(*(F.col(c) for c in "pbec")).alias("s")).collect()] == ["explained", "partially_explained", "contradicted", None, None]


def codes(df):
    return sorted((r.work, r.code, r.severity, r.confidence, r.measure) for r in df.collect())


def test_signals_across_works(spark):
    works = spark.createDataFrame([(f"w{i}", "C1" if i < 2 else "C2" if i < 8 else None, 100.0 if i < 2 else 1.0, None) for i in range(9)], "work string, entity string, payments_gross double, contract_value double")
    entities = spark.createDataFrame([("C1", "confirmed"), ("C2", "inferred"), ("C3", "confirmed")], "entity string, basis string")
    found, per = S.concentration(works, entities)
    assert {(r.work, r.confidence) for r in found.collect()} == {("w0", "confirmed"), ("w1", "confirmed"), *((f"w{i}", "inferred") for i in range(2, 8))} and {r.entity: r.projects for r in per.collect()} == {"C1": 2, "C2": 6}
    tenders = [(f"T{i}", [("C1", "L1"), ("C3", "L2"), ("C2", "L3")] if i < 3 else [("C1", "L1")]) for i in range(5)] + [("T9", [("C1", "L2"), ("C3", "L1"), (None, "L3")])]
    t = spark.createDataFrame(tenders, "tender string, bidders array<struct<entity string, rank string>>")
    of = spark.createDataFrame([("w0", "T0"), ("w4", "T4"), ("w9", "T9")], "work string, tender string")
    got = codes(S.bidder_signals(t, of, entities))
    assert ("w9", "frequent_co_bidders", "notice", "confirmed", 4.0) in got and ("w0", "frequent_co_bidders", "info", "inferred", 3.0) in got and ("w4", "repeat_single_bid_winner", "notice", "confirmed", 2.0) in got and len(got) == 5
    pair = S.co_bidding(t).filter("a = 'C1' AND b = 'C3'").first()
    assert (pair.tenders, pair.a_wins, pair.b_wins, pair.list) == (4, 3, 1, ["T0", "T1", "T2", "T9"]) and {r.entity: (r.bids, r.wins, r.single_wins) for r in S.bid_counts(t).collect()}["C1"] == (6, 5, 2)


def test_names_photos_and_files(spark):
    t = spark.createDataFrame([("w", "T", True, [("RAMESH KUMAR( X )",), ("kumar",), ("Ramesh( Y )",), ("abc",)]), ("v", "U", False, [("one",)])], "work string, tender string, sure boolean, bidders array<struct<name string>>")
    assert codes(S.name_overlaps(t)) == [("w", "bidder_name_overlap", "info", "confirmed", 1.0), ("w", "bidder_name_overlap", "info", "confirmed", 2.0)][:len(codes(S.name_overlaps(t)))] and S.name_overlaps(t).count() == 1
    p = spark.createDataFrame([("w", 12.93, 77.62, 0), ("w", 12.0, 77.0, 1), ("w", 11.0, 77.0, 2), ("v", None, None, 0)], "work string, lat double, lon double, position int")
    assert codes(S.photos_outside(p, 12.9, 12.97, 77.59, 77.66)) == [("w", "photo_gps_outside_area", "notice", "inferred", 1.0)]
    f = [("a", "m1", "Photo", "x.jpg", 9000), ("b", "m1", "Site photo", "y.jpg", 9000), ("a", "m2", "Work Order", "z", 9000), ("c", "m2", "Photo", "z", 9000), ("a", "m3", "Photo", "empty.jpg", 90_000), ("b", "m3", "Photo", "blank", 90_000), ("a", "m4", "Photo", "p", 10), ("c", "m4", "Photo", "q", 10), ("a", "m5", "Photo", "p", 9999), ("a", "m5", "Photo", "p", 9999), ("a", None, "Photo", "p", 1), ("b", None, "Photo", "p", 1)]
    files = spark.createDataFrame(f, "work string, md5 string, type string, name string, bytes long")
    got = codes(S.reused_files(files))
    assert [(g[0], g[1]) for g in got] == [("a", "document_reused"), ("a", "photo_reused"), ("a", "placeholder_reused"), ("a", "placeholder_reused"), ("b", "photo_reused"), ("b", "placeholder_reused"), ("c", "document_reused"), ("c", "placeholder_reused")]
    pairs = spark.createDataFrame([("a", "b", 0.9)], "a string, b string, similarity double")
    assert [(r.work, r.related) for r in S.related(pairs).orderBy("work").collect()] == [("a", ["b"]), ("b", ["a"])]


def test_measurement_books(spark):
    kind = "job string, bill string, bill_type string, paid boolean, files array<struct<name string, type string, listing string>>"
    rows = [("a", "1", "Final", True, [("nil.pdf", "M.B.", "bill_files"), ("x", "Letter", "wo_files")]), ("b", "2", "Final", True, [("mb1.pdf", "M.B.", "bill_files")]), ("c", "3", "Final", True, [("measurement 1", "Other", "bill_files")]), ("d", "4", "Final", True, [("y", "Letter", "wo_files")]), ("e", "5", "Running", True, [("y", "Letter", "bill_files")]), ("f", "6", "Final", False, [("y", "Letter", "bill_files")])]
    books = S.measurement_books(spark.createDataFrame(rows, kind))
    assert codes(S.final_without_book(books)) == [("a", "final_bill_without_mb", "notice", "confirmed", 1.0)] and books.filter("job = 'a'").first().mb_placeholders == ["nil.pdf"]


def test_quantity_signals(spark):
    J = "job string, plan_value double, plan_basis string, contract double, paid double, has_final boolean, all_read boolean, n_variations int, n_supplementary int, n_bill_documents int, readable boolean"
    I = "job string, estimated_quantity double, estimated_amount double, compared_quantity double, compared_basis string, matches array<struct<match string, scoped boolean>>"  # noqa: E741
    jobs = [("a", 1e6, S.SCHEDULE_B, 1e6, 5e5, True, True, 0, 0, 1, True), ("b", 1e6, "estimate", 1e6, 2e7, False, True, 1, 0, 3, False), ("c", None, "estimate", None, 1e8, True, True, 0, 0, 0, False)]
    code, words = [("code", True)], [("description", True)]
    items = [("a", 100.0, 2e5, 74.0, "bill abstract", code), ("a", 100.0, 2e5, 76.0, "bill abstract", code), ("a", 100.0, 2e5, 126.0, "bill abstract", code), ("a", 100.0, 2e5, 124.0, "bill abstract", code), ("a", 100.0, 2e5, 126.0, "bill abstract", words), ("a", 100.0, 9e4, 1.0, "bill abstract", code), ("a", 100.0, 2e5, None, None, []),
             ("b", 100.0, 2e5, 74.0, "bill abstract", code), ("b", 100.0, 2e5, 74.0, S.MB_TOTAL, []), ("b", 100.0, 2e5, 200.0, "bill form total up to date", code), *[("b", 10.0, 1.0, 10.0, "bill abstract", code)] * 3]
    extras = [("a", 2e5), ("a", 9e4), ("b", 2e5)]
    got = {(r.work, r.code): r.measure for r in S.quantity_signals(spark.createDataFrame(jobs, J), spark.createDataFrame(items, I), spark.createDataFrame(extras, "job string, amount double")).collect()}
    assert got == {("a", "qty_measured_below_plan"): 1, ("a", "qty_billed_above_plan"): 1, ("a", "qty_above_plan_no_variation"): 1, ("a", "qty_major_item_not_billed"): 1, ("a", "qty_billed_item_not_in_plan"): 1, ("b", "qty_measured_below_plan"): 1, ("b", "qty_billed_above_plan"): 1, ("b", "qty_identical_to_plan"): 3, ("b", "qty_unreadable_mb"): 3}


def test_cases(spark):
    issues = spark.createDataFrame([("A", "x", "unexplained_in_public_record", "high", 1e8, 12, 400), ("A", "y", "explained", "high", 1e9, 0, None), ("B", "z", "explained", "low", 1e5, None, None)], "case string, type string, status string, confidence string, value_at_issue double, documentation_gap int, timeline_days int")
    got = {r["case"]: r for r in C.ranked(C.scored(issues, spark.createDataFrame([("A", 3)], "case string, n_sources int"))).collect()}
    a = got["A"]
    assert (a.primary_issue, a.financial_materiality, a.documentation_gap, a.timeline_deviation, a.independent_sources, a.unresolved, a.rank) == ("x", 25.0, 10.0, 5.5, 6.0, 20.0, 1) and a.case_score == 91.5
    assert not got["B"].retained and got["B"]["rank"] is None and got["B"].case_score == 5
    m = C.merged(spark.createDataFrame([("A", "k", "J1", 5.0), ("B", "k", "J2", 9.0), ("C", None, "J3", 1.0), ("D", None, "J4", 1.0)], "case string, contract string, job string, paid double"))
    assert {r["case"]: r.merged_jobs for r in m.collect()} == {"B": ["J1"], "C": [], "D": []}
    e = spark.createDataFrame([(["api", "doc"], []), (["doc"], ["a", "b"]), (["api"], []), (["doc"], ["a"]), (["doc"], [])], "k array<string>, v array<string>")
    assert [r.c for r in e.select(C.evidence_confidence(F.col("k"), F.col("v")).alias("c")).collect()] == ["high", "high", "medium", "medium", "low"]
    w = spark.createDataFrame([("A", 200.0, 100.0, None), ("B", 200.0, 100.0, 170.0), ("C", 200.0, 100.0, None)], "case string, paid double, contract_value double, sanctioned double")
    o = spark.createDataFrame([("A", 100.0), ("A", 70.0), ("C", 190.0)], "case string, value double")
    assert {r["case"]: (r.status, r.value_at_issue) for r in C.paid_over_contract(w, o).collect()} == {"A": ("explained", 0.0), "B": ("explained", 0.0), "C": ("unexplained_in_public_record", 100.0)}
    d = lambda *x: dt.date(*x)
    late = spark.createDataFrame([("A", d(2020, 1, 1), None, None, 5.0), ("B", d(2020, 1, 1), d(2026, 9, 1), None, 5.0), ("C", d(2020, 1, 1), None, "yes", 5.0)], "case string, due date, extended date, final_bill string, gross double")
    assert [r["case"] for r in C.past_completion(late, "2026-10-07").collect()] == ["A"]
    fines = spark.createDataFrame([("A", 3e5, 1e6), ("B", 1e5, 1e6), ("C", 3e5, 1e8)], "case string, fine double, gross double")
    assert [r["case"] for r in C.significant_fines(fines).collect()] == ["A"]
    items = spark.createDataFrame([(j, float(q), 2.0) for j, n in (("a", 6), ("b", 5), ("c", 1)) for q in range(n)], "job string, quantity double, rate double")
    assert {(r.a, r.b): (r.shared, r.strong) for r in C.shared_items(items).collect()} == {("a", "b"): (5, True), ("a", "c"): (1, False), ("b", "c"): (1, False)}


def test_places_and_groups_of_matches(spark):
    import re

    text = "Actual date of completion: 1.2.2020\nno: date of completion 3.4.2021, DATE OF COMPLETION - 5.6.22. time of completion 3 months; Tender premium 4.5 % Above"
    for name, pattern, kind in D.PATTERNS:
        n = 2 if kind in D._PAIRS else 1
        for t in (text, "ab 151-22-000004 Lat 12.9716 N Long 77.5946, No: EE/1/WO/ 7  Date: 1.2.2020"):
            (row,) = spark.createDataFrame([(t,)], "t string").select(D.matches(F.col("t"), f"(?i){pattern}", n).alias("m"), D.holds(F.lower("t"), pattern).alias("h")).collect()
            want = [(m.group(0), *(m.group(k) or "" for k in range(1, n + 1)), m.start()) for m in re.finditer(f"(?i){pattern}", t)]
            assert [tuple(x) for x in row.m] == want and (row.h or not want), name
    absent = spark.createDataFrame([("none",)], "t string").select(*(D.holds(F.lower("t"), p).alias(f"c{i}") for i, (_, p, _) in enumerate(D.PATTERNS))).first()
    assert list(absent).count(False) > 12  # most rules aren't tried on a text without their words
