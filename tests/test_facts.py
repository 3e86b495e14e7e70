"""The fact catalogue on literal works: bills alone, linked and exact tenders, plans, direct records, documents and photos."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from worksight.operators import facts as K

D = dt.date
WORKS = "work string, title string, locations array<string>, wards array<string>, job_number string"
BILLS = "work string, contractor string, gross double, nett double, dedupe_key string, payment_date date, br_date date, wo_date date, wo_no string, start_date date, end_date date, bill_type string, source_id string, source_row int"
LINKS = "work string, base string, source string, exact boolean, score double, via string, tender_number string, call int, published_date date, status string, status_text string, ecv double, provisional_amount double, period_days int, period_text string, contractor string, contract_value double, negotiated_value double, awarded_date date, bidders array<struct<name string>>"
RECORDS = "work string, bill_id string, bill_type string, paid boolean, in_records boolean, level string, gross double, br_date date, rtgs_date date, release_pct double, deductions map<string,double>, approvals array<struct<date date, remarks string>>, files array<struct<name string, type string, placeholder boolean>>, position int"
DOCUMENTS = "work string, field string, value string, number double, date date, doc_type string, page int, snippet string, position int"
PHOTOS = "work string, placeholder boolean, lat double, lon double, taken date, scanned boolean"


def row(schema, **kw):
    names = [c.split()[0] for c in schema.split(", ") if " " in c and not c.startswith(("remarks", "type", "placeholder boolean>"))]
    return tuple(kw.get(n) for n in names)


def bill(work="w", **kw):
    d = dict(work=work, gross=10.0, nett=9.0, dedupe_key="BR", source_id="S01", source_row=1) | kw
    return tuple(d.get(c.split()[0]) for c in BILLS.split(", "))


def tender(work="w", **kw):
    d = dict(work=work, base="T1", source="portal", exact=False, score=0.9, via="Linked by matching", tender_number="T1", call=1, published_date=D(2019, 6, 1), status="AWARDED", status_text="Awarded", ecv=100.0, period_days=180, period_text="6 months", contractor="RAVI K( RAVI )", contract_value=95.0, awarded_date=D(2019, 7, 1), bidders=[]) | kw
    return tuple(d.get(c.split()[0]) for c in LINKS.split(", "))


def base(spark, bills=(), links=(), works=("w",), **kw):
    w = spark.createDataFrame([(x, f"Drains {x}", ["6th Block"] if x == "w" else [], ["151 (198-ward map)"] if x == "w" else [], f"J-{x}") for x in works], WORKS)
    return K.base_facts(w, spark.createDataFrame(list(bills), BILLS), spark.createDataFrame(list(links), LINKS), **kw)


def facts_of(df):
    out = {}
    for r in df.collect():
        assert (r.work, r.field) not in out
        out[r.work, r.field] = r
    return out


def test_status_and_confidence(spark):
    bills = [bill("w", bill_type="Running"), bill("v", bill_type="Running"), bill("v", bill_type="Second and Final", end_date=D(2020, 1, 1), br_date=D(2020, 2, 1), source_row=2), bill("u", dedupe_key="ROW")]
    f = facts_of(base(spark, bills, works=["w", "v", "u", "t"]))
    assert f["w", "status"].value == K.RUNNING and f["w", "status"].confidence == "inferred"
    assert f["w", "completion_date"].confidence == f["w", "contract_value"].confidence == "unknown" and f["w", "payments_gross"].confidence == "confirmed"
    assert f["v", "status"].value == K.FINAL and f["v", "completion_date"].value == "2020-01-01" and f["v", "final_bill"].value == "2020-02-01" and float(f["v", "payments_gross"].value) == 20 and f["v", "n_bills"].value == "2"
    assert f["u", "payments_gross"].confidence == "inferred" and f["u", "status"].value == K.PAID
    assert f["t", "payments_gross"].value is None and ("t", "status") not in f and f["w", "ward"].value == "151 (198-ward map)" and ("u", "ward") not in f
    assert f["w", "location"].value == "6th Block" and f["u", "location"].confidence == "unknown" and f["w", "description"].value == "Drains w"


def test_linked_facts_are_inferred_and_exact_ones_confirmed(spark):
    bills = [bill(contractor="RAVI K", wo_date=D(2019, 8, 1), payment_date=D(2019, 10, 1), start_date=D(2019, 8, 9)), bill(contractor="OTHER", gross=3.0, source_row=2)]
    links = [tender(call=1), tender(call=2, contract_value=96.0, bidders=[("A",), ("B",)], provisional_amount=7.0), tender(base="T2", source="tender-list", contract_value=1.0), tender("v", exact=True, via=None), tender("x", exact=True, status="UNDER_EVALUATION", contractor=None, contract_value=None, awarded_date=None),
             tender("w", base="P", source="plan-programme", ecv=44.0, status_text="approved")]
    est = spark.createDataFrame([("J-v", 120.0, "r1")], "job_number string, estimate double, ref string")
    sanc = spark.createDataFrame([("J-x", 130.0, "2019-20", "o", "r2")], "job_number string, ecv double, fy string, office string, ref string")
    f = facts_of(base(spark, bills, links, works=["w", "v", "x"], estimates=est, sanctions=sanc))
    got = lambda k, w="w": (f[w, k].value, f[w, k].confidence)
    assert got("contract_value") == ("96.0", "inferred") and f["w", "contract_value"].via == "Linked by matching" and got("expected_completion") == ("2020-01-28", "inferred")
    assert got("contractor") == ("RAVI K", "confirmed") and "also billed: OTHER" in f["w", "contractor"].explanation and got("tender_calls") == ("2", "inferred") and got("bidders") == ("2", "inferred")
    assert got("tender_published") == ("2019-06-01", "inferred") and got("provisional_amount") == ("7.0", "inferred") and got("estimated_cost") == ("100.0", "inferred") and got("work_order_date") == ("2019-08-01", "confirmed")
    assert got("paid_vs_contract") == ("0.135", "inferred") and got("planned_amount") == ("44.0", "inferred") and got("plan_status") == ("approved", "inferred") and got("start_date") == ("2019-08-09", "confirmed")
    assert got("first_payment") == got("last_payment") == ("2019-10-01", "confirmed") and got("awarded_date") == ("2019-07-01", "inferred") and got("period_days") == ("180", "inferred")
    assert got("contract_value", "v") == ("95.0", "confirmed") and got("status", "v") == ("Tender awarded", "confirmed") and got("estimated_cost", "v") == ("120.0", "confirmed")
    assert got("status", "x")[0] == "Tender under evaluation" and f["x", "contract_value"].explanation == "Tender not yet awarded" and got("sanctioned", "x") == ("FY 2019-20", "confirmed") and got("estimated_cost", "x") == ("130.0", "confirmed")
    life = {r.work: (r.lifecycle, r.stages.asDict()) for r in K.lifecycle(base(spark, bills, links, works=["w", "v", "x"]), spark.createDataFrame(bills, BILLS)).collect()}
    assert life["w"][0] == 3 and life["v"][1]["outcome"] and not life["x"][1]["awarded"]


def records(spark, rows):
    base = dict(work="w", paid=True, in_records=True, deductions={}, approvals=[], files=[])
    names = ["work", "bill_id", "bill_type", "paid", "in_records", "level", "gross", "br_date", "rtgs_date", "release_pct", "deductions", "approvals", "files", "position"]
    return spark.createDataFrame([tuple((base | {"position": i, "bill_id": f"b{i}"} | r).get(n) for n in names) for i, r in enumerate(rows)], RECORDS)


def test_records_documents_and_photos(spark):
    facts = base(spark, [bill(gross=200.0)], works=["w", "v"])
    rec = records(spark, [
        {"bill_type": "Running", "br_date": D(2020, 1, 1), "rtgs_date": D(2020, 1, 31), "release_pct": 50.0, "deductions": {"fine": 1200.0, "it": 5.0}, "approvals": [(D(2020, 1, 2), "A long remark by an official on this bill"), (None, "short")], "files": [("mb.pdf", "M.B.", False), ("x.pdf", "Letter", False)]},
        {"bill_type": "Final", "br_date": D(2020, 5, 1), "rtgs_date": D(2020, 8, 1), "files": [("mb.pdf", "M.B.", False), ("mb2.pdf", "M.B.", True)]}, {"bill_type": "Running", "paid": False, "in_records": False, "level": "AEE", "gross": 7000.0},
        {"work": "v", "bill_type": "Final", "paid": False, "in_records": False, "level": "EE", "gross": 10.0},
    ])
    doc = lambda i, field, value=None, number=None, date=None, kind="Work Order", snippet="": ("w", field, value, number, date, kind, 1, snippet, i)
    docs = spark.createDataFrame([doc(0, "contract_value", number=10.0), doc(1, "contract_value", number=900.0, kind="PMC order"), doc(2, "contract_value", number=150.0, kind="Letter"), doc(3, "contract_value", number=140.0), doc(4, "work_order_ref", "WO/1", date=D(2019, 11, 15)), doc(5, "agreement_ref", "AG/1"), doc(6, "loa_ref", "LOA/1"), doc(7, "period", number=450.0),
                                  doc(8, "commencement_date", date=D(2019, 11, 20)), doc(9, "completion_due", date=D(2021, 2, 14)), doc(10, "completed_on", date=D(2021, 1, 1)), doc(11, "completed_on", date=D(2022, 1, 1))], DOCUMENTS)
    photos = spark.createDataFrame([("w", False, 12.0, 77.0, D(2020, 2, 1), False), ("w", False, 14.0, 79.0, D(2020, 3, 1), False), ("w", False, None, None, D(1999, 1, 1), True), ("w", True, 1.0, 1.0, None, False)], PHOTOS)
    f = facts_of(K.with_records(facts, rec, docs, photos))
    v = {k[1]: r.value for k, r in f.items() if k[0] == "w"}
    assert v["contract_value"] == "140.0" and f["w", "contract_value"].confidence == "inferred" and v["paid_vs_contract"] == "1.429" and v["work_order_ref"] == "WO/1 dated 2019-11-15" and v["agreement_ref"] == "AG/1 dated ?" and v["loa_ref"] == "LOA/1 dated ?"
    assert v["work_order_date"] == "2019-11-15" and v["period_days"] == "450" and v["commencement_date"] == "2019-11-20" and v["completion_due"] == v["expected_completion"] == "2021-02-14" and v["completed_on_certificate"] == "2021-01-01"
    assert v["bill_types"] == "1 running, 1 final paid/registered; 1 unpaid" and v["work_documents"] == "M.B ×2 (1 placeholder)" and v["final_bill"] == "2020-05-01" and v["status"] == K.FINAL and v["pending_bills"] == "1 bill(s) not paid (₹7,000); at: AEE ×1"
    assert v["partial_release"] == "1 bill(s) released partly (50%)" and v["penalties_deductions"] == "fine ₹1,200" and v["bill_to_payment_days"] == "92" and v["approval_notes"] == "1 remark(s); e.g. 2020-01-02: “A long remark by an official on this bill”"
    assert v["placeholder_photos"].startswith("1 ") and v["site_photos"] == "3 site photo(s) attached (before / during / after as labelled); 2 with GPS printed on the image; camera dates 2020-02-01 – 2020-03-01" and v["photo_location"] == "13.00000, 78.00000"
    assert f["v", "status"].value == "Final bill submitted, not yet paid" and ("v", "bill_types") not in f
    agreed = facts_of(K.with_records(base(spark, [bill(gross=200.0)], [tender(contract_value=140.1)]), rec, docs, photos))
    assert (agreed["w", "contract_value"].value, agreed["w", "contract_value"].confidence) == ("140.0", "confirmed")
    kept = facts_of(K.with_records(base(spark, [bill(gross=200.0)], [tender(contract_value=300.0)]), rec, docs, photos))
    assert kept["w", "contract_value"].value == "300.0"


def test_other_layers(spark):
    facts = base(spark, [bill()])
    bills = spark.createDataFrame([("w", "C1", 5.0), ("w", "C2", 9.0), ("w", None, 99.0)], "work string, entity string, gross double")
    tenders = spark.createDataFrame([("w", "C1", 1), ("v", "C1", 1)], "work string, entity string, position int")
    entities = spark.createDataFrame([("C1", "A", ["register:1"], ["B"], "confirmed"), ("C2", "Z", [], [], "inferred")], "entity string, name string, ids array<string>, aliases array<string>, basis string")
    f = facts_of(K.with_entities(facts, bills, tenders, entities))
    assert (f["w", "contractor_identity"].value, f["w", "contractor_identity"].confidence) == ("C2 · Z", "inferred") and "different entity" in f["w", "contractor_identity"].explanation and f["v", "contractor_identity"].value == "C1 · A"
    orders = spark.createDataFrame([("w", None, D(2020, 12, 31), 90, None), ("w", None, D(2021, 3, 31), None, 5.0)], "work string, start date, until date, days int, fine double")
    f = facts_of(K.with_extensions(facts, orders))
    assert f["w", "extended_completion"].value == "2021-03-31" and f["w", "time_extensions"].value == "2 order(s): to 2020-12-31 (90 days); to 2021-03-31"
    items = spark.createDataFrame([("w", "Schedule B", 5.0, "bill abstract", -30.0), ("w", "Schedule B", 7.0, "MB measurement total", 12.4), ("w", "Schedule B", None, None, None), ("v", "estimate", None, None, None)], "work string, plan_basis string, compared_quantity double, compared_basis string, variance_pct double")
    f = facts_of(K.with_quantities(facts, items))
    assert f["w", "quantity_check"].value == "2 of 3 planned items compared (Schedule B vs MB totals / bill abstracts); median quantity difference +12%" and f["v", "quantity_check"].value.startswith("1 planned items read")
    seen = spark.createDataFrame([("w", "visible_change", "New surface.", D(2019, 1, 1), D(2021, 1, 1))], "work string, verdict string, observation string, before date, after date")
    f = facts_of(K.with_imagery(facts, seen))
    assert f["w", "imagery"].value.startswith("Change") and "2019-01-01 → 2021-01-01" in f["w", "imagery"].explanation


def test_selection(spark):
    d = lambda y: D(y, 1, 1)
    rows = [("a", 6e5, None, None, True, True, d(2010)), ("b", 4e5, None, None, True, True, d(2023)), ("c", None, 7e5, None, True, False, d(2023)), ("d", None, None, 9e5, False, True, d(2012)), ("e", 8e5, 1.0, None, True, False, None)]
    df = spark.createDataFrame(rows, "work string, payments_gross double, contract_value double, estimated_cost double, has_bills boolean, has_tender boolean, last_payment date").withColumns({c: F.lit(None).cast("date") for c in ("first_date", "tender_published", "awarded_date", "last_bill")})
    assert {r.work: r.bucket for r in K.selected(df).collect()} == {"a": "deep", "c": "recent", "d": "older", "e": "older"}
    assert [r.work for r in K.selected(df, most=3).collect()] == ["a", "c", "d"]
