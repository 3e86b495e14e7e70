"""Plan documents by literal texts and, for rows that run over lines, pages and chunks, by a plain form."""

import random

import pytest

from worksight.operators import scope as S
from worksight.sources import plans as L

AREA = S.Area("Greenfield", "greenfield", r"green\s*field", {"198": ["151"], "243": ["186"]})
PLACE = L.Place(
    AREA, zone="South", constituency=r"N\s*H\s*L Layout", wards=("14[78]", "151", "17[36]"), own_ward="151", own_ward_as_read=r"(?i)\b15[1l]\b", noticed=r"(?i)green\s*field|\b15[1l]\b",
    notice_number=r"No\.?\s*E\.?E\.?\s*/?\s*\(?NHL\)?\s*/\s*e-proc\s*/\s*(\d+)\s*/\s*(\d{4}-\d{2})", notice_layout="EE(NHL)/e-proc/%s/%s", programme="POW 2022-23", grant="the grant",
)
SANCTION = """WARD WORKS LIST FIN YEAR 16-17
1 South N H L Layout Greenfield
151-17-000001
Improvements to roads
in 4th block
2400000.00 / EE South / P1771 / Roads
2 South NHL Layout Other Ward
148-17-000002
Construction of drain
500000.00 / EE West"""
POW = ["""POW SOUTH
SL No Work
1 NHL Layout 186 Asphalting of roads
in 3rd cross 45.50 Work Order
Issued
2 NHL Layout 186 Providing drain""", """Page 2
12 34
at 2nd main 1200.25 Yet to Start and more to be said of it
3 NHL Layout 148 Park elsewhere 10.00 Yet to Start
4 NHL Layout 186 Garden work 10.00 Sleeping
5 NHL Layout 186 Garden work 10.00 Works Completed ok"""]
NOTICE = """No. EE/(NHL)/e-proc/02/2018-19 Dated
1 151 Improvements to drain at 1st cross 24.50 60,000/- (SC) 90 Days
2 147 Road at Elsewhere 10.00 30 Days
3 Asphalting of roads at Green field 5th main 12.75 45 0ays
short 15l 20 Days"""
GRANT = """Construction of
1 151 footpath near the 5,50 extra
school compound
2 199 nothing 10.00
| 3 148 road in Greenfield 7.25"""


@pytest.fixture(scope="module")
def found(spark):
    kinds = {"s.pdf": "sanction", "p.pdf": "pow", "n.pdf": "notice", "g.pdf": "grant", "x.pdf": "unknown", "e.pdf": "pow", "h.xlsx": "hort"}
    files = spark.createDataFrame([(f, k, f.upper(), f"https://archive/{f}", None, None, k in ("notice", "grant")) for f, k in kinds.items()], L.FILE)
    texts = [("s.pdf", 0, SANCTION), ("p.pdf", 1, POW[1]), ("p.pdf", 0, POW[0]), ("n.pdf", 0, NOTICE), ("g.pdf", 0, GRANT), ("x.pdf", 0, POW[0]), ("e.pdf", 0, None), ("e.pdf", 1, "")]
    cells = [("h.xlsx", 1, ["Sl", "Zone", "Ward", "Group", "Park"]), ("h.xlsx", 2, ["1", "S", "151.0", "Park group", "A park", "5", "1,00,000", "90000", "024046 SOME FIRM, town"]), ("h.xlsx", 3, [None, None, None, None, "B park"]), ("h.xlsx", 4, ["2", "S", "12", "Parks", "C park", "", "10", "9", None])]
    rows = L.plan_rows(files, spark.createDataFrame(texts, "file string, page int, text string").repartition(4), PLACE, spark.createDataFrame(cells, "file string, n int, cells array<string>"))
    return {(r.kind, r.row if r.row is not None else r.base): r for r in rows.collect()}


def test_sanctioned_works(found):
    r = found["sanction", 1]
    assert (r.job_number, r.description, r.ward, r.ward_name, r.ecv, r.office, r.budget_head, r.fy) == ("151-17-000001", "Improvements to roads in 4th block", "151", "Greenfield", 2400000.0, "EE South", "P1771 / Roads", "2016-17")
    assert r.base == r.tender_number == "s.pdf#1" and r.source == "WB-SANCTION" and ("sanction", 2) not in found and r.url == "https://archive/s.pdf"


def test_programme_over_lines_and_pages(found):
    assert (found["pow", 1].description, found["pow", 1].ecv, found["pow", 1].plan_status) == ("Asphalting of roads in 3rd cross", 4550000.0, "Work Order Issued")
    r = found["pow", 2]
    assert (r.description, r.ecv, r.status_text) == ("Providing drain at 2nd main and more to be said of it", 120025000.0, "Yet to Start (POW 2022-23)")
    assert found["pow", 5].description == "Garden work" and {k for k in found if k[0] == "pow"} == {("pow", 1), ("pow", 2), ("pow", 5)}


def test_notices_between_periods(found):
    a, b = found["notice", "EE(NHL)/e-proc/02/2018-19#1"], found["notice", "EE(NHL)/e-proc/02/2018-19#2"]
    assert (a.ward, a.ecv, a.period_days, a.period_text, a.ocr) == ("151", 2450000.0, 90, "90 Days", True) and a.description.endswith("Improvements to drain at 1st cross")
    assert (b.ward, b.ecv, b.period_text) == (None, 1275000.0, "45 0ays") and "Asphalting of roads at Green field 5th main" in b.description
    assert len([k for k in found if k[0] == "notice"]) == 2


def test_grants_with_the_lines_around(found):
    r = found["grant", 1]
    assert (r.description, r.ward, r.ecv) == ("Construction of footpath near the school compound", "151", 550000.0)
    assert found["grant", 3].scope_reason.startswith("Work description names Greenfield") and ("grant", 2) not in found


def test_groups_of_a_sheet(found):
    r = found["hort", 2]
    assert (r.description, r.ward, r.ecv, r.contract_value, r.contractor) == ("Park group (A park, B park)", "151", 100000.0, 90000.0, "SOME FIRM") and ("hort", 4) not in found


def test_records_and_neighbours_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 5)
    r = random.Random(4)
    texts = [(f"f{i % 3}", i // 3, "\n".join(r.choice(["7 North Side 123 begins", "and goes on", "", "Page 9", "tail"]) for _ in range(r.randint(0, 23)))) for i in range(9)]
    lines = L.lines_of(spark.createDataFrame(texts, "file string, page int, text string"))
    want_records, want_near = [], []
    for f in sorted({f for f, *_ in texts}):
        own, record = [x for _, p, t in sorted(t for t in texts if t[0] == f) for x in t.split("\n")], None
        for i, x in enumerate(own):
            want_near.append((f, x, own[i - 1] if i else "", own[i + 1] if i + 1 < len(own) else ""))
            if x.startswith("7"):
                record = [x]
                want_records.append((f, record))
            elif record and x and x != "Page 9":
                record.append(x)
    got = L._records(lines, r"^\s*\d{1,3}\s+[A-Z][A-Za-z .]+?\s+\d{3}\s", " ", L.LAYOUT).collect()
    assert sorted(map(tuple, got)) == sorted((f, " ".join(x)) for f, x in want_records)
    assert sorted((x.file, x.line, x.before, x.after) for x in L.with_neighbours(lines).collect()) == sorted(want_near)


def test_ocr_texts_are_preferred(spark, tmp_path):
    for name, text in (("a.pdf.txt", "native"), ("a.pdf.ocr.txt", "read\nagain"), ("b.pdf.txt", "plain")):
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, L.read_texts(spark, str(tmp_path)).collect())) == [("a.pdf", 0, "read\nagain", True), ("b.pdf", 0, "plain", False)]


def test_no_files_give_no_rows(spark):
    none = L.plan_rows(spark.createDataFrame([], L.FILE), spark.createDataFrame([], "file string, page int, text string"), PLACE)
    assert none.collect() == []


def test_sanctioned_works_past_the_millionth_job(spark):
    text = "1 South Hill Side Greenfield\n151-22-1000004\nRoad\n100.00 / EE / P1\n2 South Hill Side Greenfield\n151-22-00004\nDrain\n100.00 / EE / P1"
    got = L.sanctioned(spark.createDataFrame([("s", 1, text)], "file string, page int, text string"), L.Place(AREA, constituency="Hill Side")).collect()
    assert [(r.row, r.job_number, r.ward) for r in got] == [(1, "151-22-1000004", "151")]
