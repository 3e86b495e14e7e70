"""The build over a small cache: what comes out, that a second run is equal, and that a failing one changes nothing."""

import json

import pytest
from pyspark.sql import functions as F

from worksight import build as B
from worksight.operators import scope as S
from worksight.operators.publication import Leak, published
from worksight.sources import plans as L

AREA = S.Area("Greenfield", "greenfield", r"green\s*field", {"198": ["151"], "243": ["186"]})
HEAD = "Ward,Job Number,Name of Work,Contractor,Bill Type,BR Number,BR Date,CBR Number,CBR Date,Payment,Gross,Nett,Order Number,Order Date\n"


def bill(job, name, contractor, kind, br, day, gross, order="01-Jan-2021"):
    return f'151,{job},"{name}",{contractor},{kind},{br},{day},C{br},{day},Paid,"{gross}","{gross}",WO1,{order}\n'


def cache(spark, folder, extra=""):
    road, drain = "Improvements to road at 4th block Greenfield", "Construction of drain at 7th cross Greenfield"
    rows = bill("151-21-000001", road, "012345 RAVI BUILDERS 9876543210", "Running", "11", "26-Apr-2022", "6,00,000") + bill("151-21-000001", road, "012345 RAVI BUILDERS", "Second and Final", "12", "26-May-2022", "4,00,000")
    rows += bill("151-21-000002", drain, "SMALL FIRM", "Running", "13", "26-Apr-2022", "9,00,000") + bill("151-21-000003", "Ganesh festival arrangements Greenfield", "X", "Running", "14", "26-Apr-2022", "9,00,000")
    rows += bill("151-21-000004", "Road repair Greenfield", "TINY", "Running", "15", "26-Apr-2022", "1,000") + extra
    (folder / "a.csv").write_text(HEAD + rows)
    (folder / "b.csv").write_text(HEAD + bill("151-21-000001", road, "RAVI BUILDERS", "Running", "0011", "26-Apr-2022", "6,00,000"))  # the same bill in another export
    (folder / "codes.csv").write_text("Job_Code,Amount in Rs.,Date\n151-21-000001,7,00,000,01/02/2021\n".replace("7,00,000", '"7,00,000"'))
    manifest = [{"file": "a.csv", "kind": "public_view", "name": "A", "page": "p", "url": "u/a", "regime": "198"}, {"file": "b.csv", "kind": "public_view", "name": "B", "page": "p", "url": "u/b", "regime": "198"}, {"file": "codes.csv", "kind": "job_codes", "name": "Codes", "page": "p", "url": "u/c", "regime": "198"}]
    (folder / "manifest.json").write_text(json.dumps(manifest))
    notice = lambda n, title, cost: {"search": {"nitId": n, "tenderNumber": f"GF/2021/WORK/{n}", "title": title, "description": title, "deptName": "D", "locationName": "O", "status": "AWARDED", "statusText": "Awarded", "publishedDate": "01-12-2020", "ecv": cost}, "selected_bid": {"supplierName": "RAVI BUILDERS", "supplierId": "7", "bidValue": cost, "negotiatedValue": cost}}
    (folder / "notices").mkdir()
    for n, title, cost in (("1", road, "800000"), ("2", "Construction of school building at Greenfield", "9000000")):
        (folder / "notices" / f"{n}.json").write_text(json.dumps(notice(n, title, cost)))
    files = spark.createDataFrame([("s.pdf", "sanction", "S", "u", None, None, False), ("p.pdf", "pow", "P", "u", None, None, False)], L.FILE)
    texts = [("s.pdf", 0, "FIN YEAR 20-21\n1 South NHL Layout Greenfield\n151-21-000002\nConstruction of drain\n950000.00 / EE South"), ("p.pdf", 0, "1 NHL Layout 186 Construction of drain at 7th cross Greenfield 9.50 Work Order Issued")]
    return B.Cache(f"file://{folder}/manifest.json", AREA, f"file://{folder}/notices", None, files, spark.createDataFrame(texts, "file string, page int, text string"), L.Place(AREA, constituency="N\\s*H\\s*L Layout"), {"public_view": "portal"})


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder, at = tmp_path_factory.mktemp("cache"), f"file://{tmp_path_factory.mktemp('out')}"
    c = cache(spark, folder)
    return c, at, B.build(spark, c, at, "2026-10-07", "2026-03-31")


def rows(spark, at, table):
    df = published(spark, at, table)
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_what_is_published(spark, built):
    _, at, _ = built
    projects = {r.work: r for r in published(spark, at, "projects").collect()}
    assert set(projects) == {"job:151-21-000001", "job:151-21-000002", "tender:GF/2021/WORK/2"}
    road, school = projects["job:151-21-000001"], projects["tender:GF/2021/WORK/2"]
    assert (road.payments_gross, road.estimated_cost, road.contract_value, road.n_bills, road.bucket, road.slug, road.category) == (1000000.0, 700000.0, 800000.0, 2, "deep", "151-21-000001", "Roads") and road.tender_numbers == ["GF/2021/WORK/1"]
    assert (school.n_bills, school.link_confidence, school.contract_value) == (0, "exact", 9000000.0)
    facts = {(r.work, r.field): r for r in published(spark, at, "facts").collect()}
    assert facts["job:151-21-000002", "estimated_cost"].value == "950000.0" and facts["job:151-21-000001", "status"].value.startswith("Completed")
    assert facts["job:151-21-000001", "contractor_identity"].value.startswith("C") and facts["job:151-21-000002", "sanctioned"].value == "FY 2020-21"
    assert {r.work for r in published(spark, at, "signals").collect()} <= set(projects)
    records = published(spark, at, "records").collect()
    assert sum(r.record_type == "bill" for r in records) == 3 and {r.record_type for r in records} >= {"bill", "tender"} and all("9876543210" not in str(r) for r in records)
    flags = {r.project_id: r for r in published(spark, at, "project_flags").collect()}
    assert flags["job:151-21-000001"].has_bills and flags["job:151-21-000001"].has_completion and flags["tender:GF/2021/WORK/2"].has_contract
    stats = json.loads(published(spark, at, "stats").first().stats)
    assert stats["bills_in_scope"] == 6 and stats["bills"] == 5 and stats["works_with_bills"] == 3 and stats["projects"] == 3 and stats["sources"] == 3
    sources = {r.id: r for r in published(spark, at, "sources").collect()}
    assert [(sources[i].name, sources[i].original_portal) for i in ("S01", "S03")] == [("A", "portal"), ("Codes", None)]


def test_again_and_failing(spark, built, tmp_path, monkeypatch):
    c, at, version = built
    before = {t: rows(spark, at, t) for t in ("projects", "facts", "records", "signals", "links", "contractors", "project_flags", "stats")}
    again = B.build(spark, c, at, "2026-10-07", "2026-03-31")
    assert again != version and {t: rows(spark, at, t) for t in before} == before
    monkeypatch.setattr(B, "SCRUBBED", {})
    monkeypatch.setattr(B, "tables", lambda *x: {"records": spark.createDataFrame([("call 9876543210",)], "description string")})
    with pytest.raises(Leak):
        B.build(spark, c, at, "2026-10-07", "2026-03-31")
    assert rows(spark, at, "records") == before["records"]


def test_bills_are_told_apart(spark):
    kind = "kind string, source_id string, source_row int, job_number string, ifms_id string, br_no string, br_date date, gross decimal(18,2), deduction decimal(18,2), nett decimal(18,2)"
    row = lambda k, s, n, job, gross, br=None, ifms=None, nett=None: (k, s, n, job, ifms, br, None, gross, None, nett)
    data = [row("public_view", "S1", 1, "j", 5, "7"), row("work_details", "S2", 1, "j", 5, "007"), row("work_details", "S2", 2, "j", 5, None, "x"), row("work_details", "S3", 3, "j", 6, None, "x"), row("department", "S4", 1, "j", 5), row("department", "S4", 2, "k", 5), row("department", "S4", 3, "k", 5), row("department", "S4", 4, "k", None), row("department", "S4", 5, "k", None), row("department", "S4", 6, "k", 5, None, None, 4)]
    df = spark.createDataFrame([tuple(__import__("decimal").Decimal(x) if i in (7, 9) and x is not None else x for i, x in enumerate(r)) for r in data], kind).withColumn("br_date", F.when(F.col("br_no").isNotNull(), F.lit("2020-01-01").cast("date")))
    got = sorted((r.source_id, r.source_row, r.dedupe_key) for r in B.deduplicated(df).collect())
    assert got == [("S1", 1, "BR"), ("S2", 2, "IFMS"), ("S4", 2, "ROW"), ("S4", 4, "ROW"), ("S4", 5, "ROW"), ("S4", 6, "ROW")]
