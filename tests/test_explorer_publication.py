"""The explorer's filters, orders and pages against plain Python, and publishing with its check."""

import json

import pytest
from pyspark.sql import functions as F

from worksight.operators import explorer as X
from worksight.operators import publication as P

PROJECTS = "id int, slug string, title string, search_text string, category string, status string, department string, link_confidence string, lifecycle int, last_activity string, first_date string, tender_published string, payments_gross double, contract_value double, estimated_cost double, n_bills int, tender_numbers string, job_numbers string, signal_level string, n_signals int, stages string"


@pytest.fixture(scope="module")
def tables(spark):
    p = []
    for i in range(120):
        stages = json.dumps({s: (i + k) % 3 == 0 for k, s in enumerate(X.STAGES)})
        p.append((i, f"w-{i}", f"Road {i}", f"road work{i % 7} drain{i % 5}", ["Roads", "Drains", None][i % 3], ["Running", "Completed"][i % 2], "D", ["exact", "medium"][i % 2], i % 7, f"20{10 + i % 15}-01-01" if i % 11 else None,
                  f"20{10 + i % 9}-02-01" if i % 4 else None, "2015-01-01", float(i * 1000) if i % 6 else None, float(i % 50) * 900 if i % 5 else None, 500.0 * i, i % 3, "T" if i % 2 else "", f"J{i},J{i + 1000}", [None, "info", "notice", "attention"][i % 4], i % 9, stages))
    signals = [(i, c, s) for i in range(120) for c, s in (("single_bidder", "notice"), ("year_end_payment", "info")) if (i + len(c)) % 5 == 0]
    facts = [(i, "contract_value", "1" if i % 3 else None) for i in range(120)] + [(i, "site_photos", "0 photos" if i % 2 else "3 photos") for i in range(0, 120, 4)] + [(5, "final_bill", "yes"), (6, "work_order_date", "2019-08-01")]
    return {
        "projects": spark.createDataFrame(p, PROJECTS), "signals": spark.createDataFrame(signals, "project_id int, code string, severity string"),
        "facts": spark.createDataFrame(facts, "project_id int, field string, value string"), "items": spark.createDataFrame([(3,), (3,), (9,)], "project_id int"),
        "cases": spark.createDataFrame([("C1", 3, 1, 2, 50.0, "open"), ("C2", 4, 0, None, 70.0, "explained"), ("C3", 9, 1, 1, 20.0, "open")], "case_id string, project_id int, retained int, rank int, case_score double, status string"),
        "rows": p,
    }


def test_filters(tables):
    flags = X.project_flags(tables["projects"], tables["facts"], tables["items"], tables["signals"], tables["cases"])
    ids = lambda **kw: sorted(r.id for r in X.search(tables["projects"], tables["signals"], flags, **kw).collect())
    rows = tables["rows"]
    assert ids() == list(range(120)) and ids(depth="x") == list(range(120)) and ids(flags=["drop"]) == list(range(120))
    assert ids(q="WORK3 drain1") == [r[0] for r in rows if "work3" in r[3] and "drain1" in r[3]]
    assert ids(category="Roads", status="Running", link="exact", depth="3") == [r[0] for r in rows if r[4] == "Roads" and r[5] == "Running" and r[7] == "exact" and r[8] >= 3]
    with_signal = {r.project_id for r in tables["signals"].collect() if r.code == "single_bidder"}
    assert ids(signal="single_bidder") == sorted(with_signal) and ids(flags=["has_signals", "has_contract"]) == sorted(i for i in with_signal if i % 3)
    assert ids(flags=["has_case"]) == [3, 9] and ids(flags=["has_photos"]) == [i for i in range(0, 120, 4)] and ids(flags=["has_completion"]) == [5] and ids(flags=["has_quantities", "has_case"]) == [3, 9]


def test_orders_and_pages(tables):
    rows, low = tables["rows"], ""
    level = {None: 0, "info": 1, "notice": 2, "attention": 3}
    keys = {
        "recent": lambda r: (r[9] or low,), "value": lambda r: (max(r[12] or 0, r[13] or 0, r[14] or 0),), "paid": lambda r: (r[12] or 0,), "depth": lambda r: (r[8], r[9] or low), "signals": lambda r: (level[r[18]], r[19]),
    }
    for name, key in {**keys, "other": keys["recent"]}.items():
        want = [r[0] for r in sorted(sorted(rows, key=lambda r: r[0]), key=key, reverse=False)]
        want = [r[0] for r in sorted(rows, key=lambda r: tuple([*key(r)]), reverse=True)]
        got = [r.id for n in (1, 2, 3) for r in X.page(tables["projects"], name, n).collect()]
        by = {r[0]: key(r) for r in rows}
        assert [by[i] for i in got] == [by[i] for i in want] and sorted(got) == list(range(120))
        assert all(a < b for a, b in zip(got, got[1:]) if by[a] == by[b])
    assert [r.id for r in X.page(tables["projects"], "oldest", 1, 3).collect()] == [r[0] for r in sorted(rows, key=lambda r: (r[10] or r[11], r[0]))][:3]


def test_facets_and_summary(tables):
    rows = tables["rows"]
    got = {(r.facet, r.value): r.n for r in X.facets(tables["projects"], tables["signals"]).collect()}
    assert got["category", None] == 40 and got["status", "Running"] == 60 and got["dept", "D"] == 120 and got["signal", "single_bidder"] == 24 and got["link", "exact"] == 60
    s = X.summary(tables["projects"]).first()
    assert s.n_full == sum(r[8] == 6 for r in rows) and s.paid == sum(r[12] or 0 for r in rows) and s.n_linked == sum(bool(r[15] and r[16]) for r in rows) and s.n_flagged == 60
    funnel = {r.stage: r.n for r in X.stage_counts(tables["projects"]).collect()}
    assert funnel == {s: sum(json.loads(r[20])[s] for r in rows) for s in X.STAGES}


def test_pages_of_works(spark, tables):
    records = spark.createDataFrame(
        [(6, "bill", "S1", None, None, "Ravi", 100.0, None, None, None, "u1", "Running", "2019-10-01", "2019-09-01", None, None, "C1", "J6", "7"), (6, "bill", "S1", None, None, "Ravi", 300.0, None, None, None, "u2", "Final", None, "2020-09-01", None, None, "C1", "J6", "8"),
         (6, "tender", "S2", "exact", "T1", "Ravi", 95.0, 150000.0, "2019-07-01", "b", "u3", None, None, None, None, "2019-06-01", None, None, None), (7, "bill", "S9", None, None, "", 5.0, None, None, None, "u4", None, None, None, "2018-01-01", None, None, "J7", None)],
        "project_id int, record_type string, source_id string, link string, tender_number string, contractor string, gross double, ecv double, awarded_date string, bid_url string, source_url string, bill_type string, payment_date string, br_date string, wo_date string, start_date string, contractor_entity string, job_number string, br_no string",
    )
    sources = spark.createDataFrame([("S1", "A"), ("S2", "B"), ("S3", "C")], "id string, name string")
    contractors = spark.createDataFrame([("C1", "RAVI K", 2, 0, 400.0), ("C2", "X", 0, 0, 1.0), ("C3", "Y", 0, 3, 9.0)], "entity string, name string, projects int, bids int, amount double")
    events = [(r.date, r.label, r.kind) for r in X.timeline(tables["facts"], records).filter("project_id = 6").orderBy("date", "place").collect()]
    assert events == [("2019-06-01", "Tender T1 published — estimate ₹1.50 L", "tender"), ("2019-07-01", "Awarded to Ravi for ₹95", "award"), ("2019-08-01", "Work order issued", "milestone"), ("2019-10-01", "Running bill ₹100 paid", "bill"), ("2020-09-01", "Final bill ₹300 registered", "final")]
    assert [(r.x, r.y) for r in X.cumulative_points(records).orderBy("date").collect()] == [(0.0, 30.5), (100.0, 2.0)]
    links = spark.createDataFrame([], "project_id int, status string, score double")
    page = X.project_page("w-6", tables["projects"], tables["facts"], records, sources, links, tables["signals"])
    assert [r.source_name for r in page["records"].collect()] == ["B", "A", "A"] and page["project"].count() == 1 and "search_text" not in page["project"].columns
    assert X.project_page("../x", tables["projects"], tables["facts"], records, sources, links, tables["signals"])["project"].count() == 0
    assert [(r.name, r.paid, r.bills, r.works) for r in X.payees(records, contractors).collect()] == [("RAVI K", 100.0, 1, 1)]
    assert {r.id: (r.n_projects, r.n_records) for r in X.source_usage(sources, records).collect()} == {"S1": (1, 2), "S2": (1, 1), "S3": (0, 0)}
    h = X.headline(tables["projects"], records, tables["cases"], sources).first()
    assert (h.projects, h.paid_bills, h.cases, h.reviewed, h.sources, h["first"]) == (120, 1, 2, 3, 3, "2019-10-01")
    assert [r.case_id for r in X.case_list(tables["cases"], tables["projects"]).collect()] == ["C3", "C1"] and [r.case_id for r in X.case_list(tables["cases"], tables["projects"], False).collect()] == ["C3", "C1", "C2"]
    assert [r.entity for r in X.top_contractors(contractors).collect()] == ["C1", "C3"]
    s = X.story(tables["projects"], records, contractors)
    assert s["biggest"].count() == 8 and [tuple(r) for r in s["years"].collect()] == [("2019", 100.0, 1)]
    new = spark.createDataFrame([("C2", "J9", "open"), ("C4", "J1003", "open")], "case_id string, job_number string, status string")
    old = tables["cases"].withColumn("job_number", F.lit("J3"))
    assert {r.case_id: (r.project_id, r.status) for r in X.case_upsert(old, new, tables["projects"]).collect()} == {"C1": (3, "open"), "C3": (3, "open"), "C2": (9, "open"), "C4": (3, "open")}


def test_snapshot_changes(spark):
    schema = {"projects": "id int, slug string, status string", "records": "record_type string, job_number string, br_no string, br_date string, gross double, payment_date string", "signals": "project_id int, code string", "facts": "project_id int, field string, value string", "cases": "case_id string, retained int, status string"}
    make = lambda **kw: {k: spark.createDataFrame(kw.get(k, []), s) for k, s in schema.items()}
    old = make(projects=[(1, "a", "Running"), (2, "b", "x")], records=[("bill", "J", "1", "2020-01-01", 10.0, None)], signals=[(1, "s1")], cases=[("C1", 1, "unexplained")])
    new = make(projects=[(1, "a", "Completed"), (3, "c", "x")], records=[("bill", "J", "1", "2020-01-01", 10.2, "2021-01-01"), ("bill", "J", "2", "2020-02-01", 5.0, None), ("bill", "J", "3", "2020-02-01", 6.0, "2021-01-01")], signals=[(1, "s2")], facts=[(1, "final_bill", "yes")], cases=[("C1", 0, "explained")])
    got = sorted((r.kind, r.key) for r in X.snapshot_changes(old, new).collect())
    assert got == [("bill_new", "J|2|2020-02-01|5"), ("bill_new", "J|3|2020-02-01|6"), ("bill_paid", "J|1|2020-01-01|10"), ("case", "C1"), ("final_bill", "a"), ("project_added", "c"), ("project_dropped", "b"), ("signal_gone", "a s1"), ("signal_new", "a s2"), ("status", "a")]


def test_json_is_scrubbed_but_for_addresses(spark):
    cell = json.dumps({"note": "call 9876543210 now", "url": "https://x/9876543210", "list": ["a@b.cc", 5, {"document": "080-22221188"}], "other": "080-22221188 é"})
    df = spark.createDataFrame([(cell,), ("plain a@b.cc",), ("{broken 9876543210 x",), (None,)], "c string")
    got = [r.c for r in P.scrub_columns(df).collect()]
    assert json.loads(got[0]) == {"note": "call [phone removed] now", "url": "https://x/9876543210", "list": ["[e-mail removed]", 5, {"document": "080-22221188"}], "other": "[phone removed] é"}
    assert got[1:] == ["plain [e-mail removed]", "{broken [phone removed] x", None]


def test_publishing(spark, tmp_path):
    path = str(tmp_path / "public")
    t = spark.createDataFrame([(1, "mail a@b.cc", ["9876543210 x", None]), (2, "fine https://x.org/a@b.cc", [])], "id int, note string, tags array<string>")
    first = P.publish(spark, {"facts": t}, path)
    assert [(r.note, r.tags) for r in P.published(spark, path, "facts").orderBy("id").collect()] == [("mail [e-mail removed]", ["[phone removed] x", None]), ("fine https://x.org/a@b.cc", [])]
    with pytest.raises(P.Leak):
        P.publish(spark, {"facts": t}, path, {"facts": ["note"]})  # tags are left as they are
    assert sorted(x.name for x in (tmp_path / "public").iterdir() if not x.name.startswith(".")) == sorted(["CURRENT", first])
    second = P.publish(spark, {"facts": t.limit(0)}, path)
    assert second != first and P.published(spark, path, "facts").count() == 0
    m = P.export_dataset({"facts": P.scrub_columns(t)}, str(tmp_path / "set")).collect()
    assert sum(r.rows for r in m) == 2 and all(len(r.sha256) == 64 for r in m)


def test_contacts_are_cut_out(spark):
    df = spark.createDataFrame([(1, ("x", "9"), [("e", "y")], {"phone": "1", "k": "v"}, "m")], "id int, s struct<name:string,mobile:string>, l array<struct<email:string,n:string>>, d map<string,string>, Phone string")
    out = P.redact(df)
    assert out.columns == ["id", "s", "l", "d"] and out.first().asDict(True) == {"id": 1, "s": {"name": "x"}, "l": [{"n": "y"}], "d": {"k": "v"}}
    got = spark.createDataFrame([("A B<br/>9876543210",), ("C<br/>D",), (None,)], "c string").select(P.without_phone(F.col("c")).alias("c")).collect()
    assert [r.c for r in got] == ["A B", "C D", ""]
