"""The payment grid, direct records and tenders, on literal files."""

import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from worksight.operators.scope import Area
from worksight.sources import direct as D
from worksight.sources import grid as G
from worksight.sources import tenders as T

AREA = Area("Greenfield", "greenfield", r"green\s*field", {"198": ["151"], "225": ["174"], "243": ["186"]}, not_city_regex="rural")


def row(bill, job, text, rtgs="Rtgs - 000021 / 21-May-2020", amount="1444028", br="000094", who="A. Rao<br/>9000000001"):
    refs = f"BR - {br} / 09-Aug-2018<br/>CBR - 009072 / 17-Mar-2020<br/>{rtgs}"
    return dict(slno="1", id=bill, wodetails=f"<a href=\"#\" onclick=\"vssFillData({bill},'{job}');\">{job}</a><br/>{text}", contractor=who, brnumber=refs, amount=amount, nett="1403704", deduction="40324")


GROUND = "Improvements to ground in Greenfield in ward no 151"


@pytest.fixture()
def rows(spark, tmp_path):
    first = [row("1", "151-17-000082", GROUND), row("2", "151-18-000004", "Asphalting of roads in ward no 151"), row("3", "186-23-000001", "Development of roads in ward No.186 Riverside"),
             row("4", "160-19-000010", "Asphalting of roads in Hilltop 4th block"), row("5", "186-23-000002", "Footpath works in Green field 6th block")]
    second = [row("1", "151-17-000082", GROUND, rtgs="Rtgs - 000099 / 02-Jul-2020"), row("6", "151-17-000082", GROUND, amount="500000", br="000120"), row("7", "bad", "x", rtgs="Rtgs -  / ", br="", who=None)]
    for a, b, rs in (("2020-04-01", "2020-06-30", first), ("2020-07-01", "2020-09-30", second)):
        (tmp_path / f"{a}.json").write_text(json.dumps({"from": a, "to": b, "url": "u", "complete": True, "rows": rs}))
    (tmp_path / "broken.json").write_text('{"from": ')
    return G.grid_rows(G.read_windows(spark, str(tmp_path)))


def test_grid_rows(rows):
    got = {(r.bill_id, r.window): r for r in rows.collect()}
    assert len(got) == 8
    r = got["1", "2020-04-01..2020-06-30"]
    assert (r.job_number, r.ward_prefix, r.job_year, r.description, r.contractor) == ("151-17-000082", "151", "17", GROUND, "A. Rao")
    assert (r.br_no, r.br_date, r.cbr_no, r.cbr_date, r.rtgs_no, r.rtgs_date) == ("000094", date(2018, 8, 9), "009072", date(2020, 3, 17), "000021", date(2020, 5, 21))
    assert (r.gross, r.nett, r.deduction) == (Decimal("1444028.00"), Decimal("1403704.00"), Decimal("40324.00"))
    r = got["7", "2020-07-01..2020-09-30"]  # a blank number is none, whatever other reference follows
    assert (r.job_number, r.br_no, r.rtgs_no, r.rtgs_date, r.contractor) == (None, None, None, None, None)


def test_area_bills(spark, rows):
    got = {r.bill_id: r for r in G.area_bills(rows, AREA).collect()}
    assert {k: r.scope_basis for k, r in got.items()} == {"1": "description", "2": "ward_prefix", "5": "description", "6": "description"}
    assert got["1"].payment_dates == [date(2020, 5, 21), date(2020, 7, 2)] and got["1"].rtgs_no == "000021"
    bills = {r.ifms_id: r for r in G.as_bills(G.area_bills(rows, AREA)).collect()}
    assert (bills["1"].payment_ref, bills["1"].payment_date, bills["1"].payment_status) == ("RTGS 000021", date(2020, 5, 21), "Paid (RTGS)")
    assert G.area_bills(rows.limit(0), AREA).count() == 0


def test_discovery_and_denominators(spark, rows):
    known = spark.createDataFrame([("151-17-000082", "1", "RTGS 1", date(2020, 5, 1)), ("151-01-000001", "99", "RTGS 2", date(2020, 5, 1)), (None, None, None, None)], "job_number string, ifms_id string, payment_ref string, payment_date date")
    works = spark.createDataFrame([("a", ["151-17-000082"]), ("b", None)], "slug string, job_numbers array<string>")
    details = spark.createDataFrame([("6", "South", "Final")], "bill_id string, office string, bill_type string")
    got = {r.bill_id: r for r in G.discovery(G.area_bills(rows, AREA), known, works, details).collect()}
    assert {k: (r.known_job, r.known_bill, r.slug, r.office) for k, r in got.items()} == {"1": (True, True, "a", None), "2": (False, False, None, None), "5": (False, False, None, None), "6": (True, False, "a", "South")}
    assert got["1"].payment_dates == "2020-05-21,2020-07-02"
    paid = spark.createDataFrame([("1", "5"), ("98", "5"), ("2", "")], "bill_id string, rtgs string")
    n = G.denominators(rows, known, paid, "2015-05-01").first()
    assert (n.grid_rows, n.grid_bills, n.first_payment) == (8, 7, date(2020, 5, 21))
    assert (n.export_bills, n.export_bills_in_grid, n.known_jobs, n.known_jobs_in_grid, n.direct_bills, n.direct_bills_in_grid) == (2, 1, 2, 1, 2, 1)


def test_direct_bill(spark, tmp_path):
    rec = dict(work_bill_id="632783", details=dict(billtype="Second and Final", gross="100.00", deduction="5.00", nett="95.00", dbrnumber="000051", dbrdate="2024-01-24", rtgs="003252", rtgsdate="06-Mar-2024", releaseper="75", contractormobile1=None),
               deductions=dict(fine="2.00", others3="1.00", it="2.00", gst="7", md="0"), approvals=[dict(date="12-Jun-2024<br/> 18:09:53", name="a<br/> b", remarks="Approved<br/> balance 25% paid <br/>", systemtype="13")],
               wo_files=[dict(rFileName="WO-7 WORK ORDER.pdf", rFileType="Work Order", raddl=""), dict(rFileName="")], bill_files=[], details_url="https://x/y")
    (tmp_path / "632783.json").write_text(json.dumps(rec))
    (tmp_path / "2.json").write_text(json.dumps(dict(work_bill_id="2", details=[], deductions=None)))
    (tmp_path / "3.json").write_text("oops")
    got = {r.wbid: r for r in D.direct_bills(D.read_records(spark, str(tmp_path)), "https://x").collect()}
    assert set(got) == {"2", "632783"}
    r = got["632783"]
    assert (r.bill_type, r.br_date, r.rtgs_date, r.release_pct, r.deductions, r.paid) == ("Second and Final", date(2024, 1, 24), date(2024, 3, 6), 75.0, {"fine": 2.0, "withheld": 1.0, "it": 2.0}, True)
    assert [tuple(a) for a in r.approvals] == [(date(2024, 6, 12), "a /  b", "Approved — balance 25% paid", "13")]
    assert [tuple(f) for f in r.wo_files] == [("WO-7 WORK ORDER.pdf", "Work Order", "https://x/Files/WO-7%20WORK%20ORDER.pdf")] and r.bill_files == []
    assert (got["2"].gross, got["2"].deductions, got["2"].approvals, got["2"].paid) == (None, {}, [], False)


BILLS = "bill long, job_number string, ifms_id string, br_no string, br_date date, gross decimal(18,2), bill_type string, payment_date date, description string, contractor string"
DIRECT = "wbid string, job_number string, br_no string, br_date date, gross decimal(18,2), paid boolean, bill_type string, rtgs string, rtgs_date date, description string, deduction decimal(18,2), nett decimal(18,2), url string"


def bills(spark, *rows):
    return spark.createDataFrame([(i, "j", ident, no, day, gross and Decimal(gross), None, None, text, None) for i, (ident, no, day, gross, text) in enumerate(rows)], BILLS)


def direct(spark, *rows):
    return spark.createDataFrame([(w, "j", no, day, gross and Decimal(gross), paid, "Final", "7" if paid else None, date(2024, 3, 6) if paid else None, text, None, None, "u") for w, no, day, gross, paid, text in rows], DIRECT)


def test_matching_of_direct_bills(spark):
    day, other = date(2024, 1, 1), date(2024, 1, 2)
    ours = bills(spark, ("a", None, None, 10, "x"), (None, "0051", day, 20, "x"), (None, "52", None, 20, "x"), (None, None, None, 30, "x"), (None, None, None, "30.5", "x"), (None, None, None, 31, "x"))
    rows = [("a", "0051", day, 99, True, "x"), ("b", "51", day, 5, True, "x"), ("c", "52", other, 6, False, "x"), ("d", "51", other, 30, True, "x"), ("e", None, None, "30.9", True, "x"),
            ("f", None, None, 50, True, "x"), ("g", "60", day, 51, True, "x"), ("h", "060", day, 51, False, "x"), ("i", "61", day, 52, False, "x"), ("k", None, None, None, False, "x"), ("l", None, None, "30.2", True, "x"), ("m", None, None, 30, True, "x")]
    matched = D.match_bills(direct(spark, *rows), ours)
    got = {r.wbid: (r.bill, r.basis, r.state) for r in matched.collect()}
    assert got == {"a": (0, "id", "matched"), "b": (1, "bill_number", "matched"), "c": (2, "bill_number", "matched"), "d": (3, "amount", "matched"), "e": (4, "amount", "matched"), "f": (None, None, "new"), "g": (None, None, "new"),
                   "h": (None, None, "repeat"), "i": (None, None, "pending"), "k": (None, None, "pending"), "l": (5, "amount", "matched"), "m": (None, None, "new")}
    out = {r.direct_id: r for r in D.enriched(ours, matched).collect()}
    assert len(out) == 9 and (out["a"].bill_type, out["a"].payment_date, out["a"].gross) == ("Final", date(2024, 3, 6), Decimal("10.00"))
    assert (out["f"].payment_ref, out["f"].kind, out["f"].bill) == ("RTGS 7", "direct", None)


def test_bills_of_other_works_under_one_number(spark):
    ours = bills(spark, ("a", None, None, 10, "Laying of pipes in third street"))
    rows = [(w, None, None, 1, True, t) for w, t in (("a", "quite another"), ("b", None), ("c", "Laying of a pipe in third street"), ("d", "Drain in Greenfield"), ("e", "Painting the town hall"))]
    assert {r.wbid: r.same_job for r in D.same_job(direct(spark, *rows), ours, AREA).collect()} == {"a": True, "b": True, "c": True, "d": True, "e": False}


def test_places_attachments_and_deductions(spark, tmp_path):
    (tmp_path / "151-22-000004.json").write_text(json.dumps([{"wbid": 1}, {"wbid": ""}]))
    lists = D.read_job_lists(spark, str(tmp_path))
    assert [tuple(r) for r in lists.collect()] == [("1", "151-22-000004")]
    d = spark.createDataFrame([("1",), ("a",), ("z",)], "wbid string")
    assert {(r.wbid, r.job_number) for r in D.placed(d, lists, bills(spark, ("a", None, None, 1, "x"))).collect()} == {("1", "151-22-000004"), ("a", "j")}
    file = "array<struct<name:string,type:string,url:string>>"
    held = spark.createDataFrame([("j", "1", {"it": 1.5}, [("f", "t", "u")], None, True), ("j", "2", {"it": -1.5, "fine": 2.0}, [("f", "t2", "u")], [("g", "t", "u")], True), ("j", "3", {}, [("h", "t", "u")], [], False)],
                                 f"job_number string, wbid string, deductions map<string,double>, wo_files {file}, bill_files {file}, same_job boolean")
    assert {(r.name, r.wbid, r.level, r.type) for r in D.attachments(held).collect()} == {("f", "1", "work_order", "t"), ("g", "2", "bill", "t")}
    assert [tuple(r) for r in D.deduction_totals(held).collect()] == [("j", "fine", 2.0)]


def test_notices(spark, tmp_path):
    search = dict(nitId=77, tenderNumber="A/1/CALL-2", title="Drains in  Greenfield", status="X", publishedDate="01-04-2021", ecv="5")
    full = dict(tenderSchedule=dict(ecv="1,000"), tenderAwardDatesDTO=dict(awardedDates=1617235200000, listOfBidderDonePBGDTO=[dict(name="G")]))
    (tmp_path / "77.json").write_text(json.dumps(dict(search=search, full=full, selected_bid=dict(bidValue="900", negotiatedValue="0"), files=[dict(fileName="a.pdf")])))
    (tmp_path / "78.json").write_text(json.dumps(dict(search=dict(search, nitId=78, title="Hilltop"))))
    (tmp_path / "79.json").write_text("{")
    raw = T.read_notices(spark, str(tmp_path))
    assert raw.count() == 2
    (r,) = T.with_enrichment(T.load_notices(raw, AREA, "https://p"), spark.createDataFrame([("77", 1, "none", "a", "u"), ("77", 2, "Period of completion: 6 (Six) Months", "b", "u2")], "nit_id string, at int, text string, file string, url string")).collect()
    assert (r.base, r.call, r.description, r.ecv, r.contract_value, r.negotiated_value, r.contractor, r.awarded_date, r.files) == ("A/1", 2, "Drains in Greenfield", Decimal("1000.00"), Decimal("900.00"), Decimal("0.00"), "G", date(2021, 4, 1), ["a.pdf"])
    assert r.scope_reason.startswith("Tender title names Greenfield") and r.category == "Drains & storm-water" and r.url == "https://p/77/works-tender-full-view"
    assert r.period_days in (180, None)


def test_lists(spark, tmp_path):
    head = "Tender Title,Tender Number,Category,Sub-Category,Department-Location,Published Date,Last Date,Tender Value in Rs\n"
    body = "Road &amp; drain in Greenfield,T/1,Works,Civil,South,01-04-2015,02-05-2015,\"1,000\"\nRoad in ward no. 151,T/2/CALL-3,WORKS,,,,,\nRoad in ward no 1510,T/3,WORKS,,,,,\nDesk in Greenfield,T/4,GOODS,,,,,\nRoad rural ward no 151,T/5,WORKS,,,,,\n"
    (tmp_path / "a b.csv").write_text(head + body)
    (tmp_path / "list.tsv").write_text("a b.csv\thttps://x/a\nmissing.csv\thttps://x/m\nno address\n")
    cells, urls = T.read_lists(spark, str(tmp_path / "list.tsv"), str(tmp_path / "a b.csv"))
    got = {r.tender_number: r for r in T.load_lists(cells, urls, AREA).collect()}
    assert set(got) == {"T/1", "T/2/CALL-3"}
    assert (got["T/1"].description, got["T/1"].ecv, got["T/1"].url, got["T/1"].row, got["T/1"].published_date) == ("Road & drain in Greenfield", Decimal("1000.00"), "https://x/a", 1, date(2015, 4, 1))
    assert (got["T/2/CALL-3"].base, got["T/2/CALL-3"].call, got["T/2/CALL-3"].scope_reason) == ("T/2", 3, "Tender title names ward 151 (Greenfield on the 198-ward map)")
    assert T.load_tenders(T.load_lists(cells, urls, AREA), T.load_lists(cells, urls, AREA).withColumn("extra", F.lit(1))).count() == 4
