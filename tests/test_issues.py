"""Issues and cases by literal records."""

import pytest

from worksight.operators import issues as I

ITEMS = "job string, item int, description string, unit string, estimated_quantity double, estimated_rate double, estimated_amount double, compared_quantity double, compared_basis string, from_final_bill boolean, bills array<struct<bill: string, quantity: double, match: string, swapped: boolean>>"
SLIPS = "job string, rate double, unit string, executed_qty double, confidence string, file string, page int, line int, raw string"
DOCS = "job string, file string, kind string, url string, status string, rows int"
FINALS = "job string, rate double, quantity double, to_date_quantity double, file string, page int, line int, raw string"
PAGES = "job string, file string, page int, text string"


def item(job, n=1, plan=2.0, billed=4.0, rate=235000.0, unit="nos", match="rate", basis="bill form total up to date", final=False):
    return (job, n, "Rowing machine", unit, plan, rate, plan * rate, billed, basis, final, [("655880", billed, match, False)] if match else [])


def slip(job, executed, confidence="high", rate=235000.0, unit="nos"):
    return (job, rate, unit, executed, confidence, f"{job}.pdf", 11, 0, "row")


def above(spark, items, slips=(), docs=(), pages=()):
    rows = I.quantities_above_plan(spark.createDataFrame(items, ITEMS), spark.createDataFrame(list(slips), SLIPS), spark.createDataFrame(list(pages), PAGES), spark.createDataFrame(list(docs), DOCS))
    return {(r["case"], r["item"]): r for r in rows.collect()}


def test_quantities_above_plan(spark):
    items = [item(j) for j in "abcdefg"] + [item("h", match="description"), item("i", rate=1000.0), item("k", billed=2.4), item("l", match=None), item("f", 2), item("m", basis="bill abstracts (sum of read bills)"), item("n", plan=2.0)]
    slips = [slip("a", 5.0), slip("b", 3.0), slip("c", 2.0), slip("d", 2.0, "medium"), slip("e", 5.0, unit="cum"), slip("f", 5.0, rate=99.0)]
    docs = [(j, f"{j}.pdf", "variation", "u", "read", r) for j, r in zip("abcdef", (1, 1, 1, 1, 0, 1))] + [("g", "x", "work order", "u", "read", 0), ("n", "n.pdf", "variation", "u", "read", 0)]
    got = above(spark, items, slips, docs, [("n", "n.pdf", 3, "total 1175000.00 excess 705000.00")])
    state = {k[0]: r.status for k, r in got.items()}
    assert state == {"a": "explained", "b": "partially_explained", "c": "unexplained_in_public_record", "d": "insufficient_evidence", "e": "insufficient_evidence", "f": "insufficient_evidence", "g": "unexplained_in_public_record", "m": "unexplained_in_public_record", "n": "explained"}
    a, g, n = got["a", 1], got["g", 1], got["n", 1]
    assert (a.executed_qty, a.confidence, a.value_at_issue, a.documentation_gap) == (5.0, "high", 470000.0, 0) and [e.label for e in a.evidence] == ["Work bill 655880", "Work slip / comparative statement a.pdf", "Variation document a.pdf (read)"]
    assert g.documentation_gap == 5 and got["m", 1].confidence == "low" and (n.executed_qty, n.evidence[1].page) == (5.0, 3)


def test_an_illegible_row_is_set_aside_by_its_siblings(spark):
    got = above(spark, [item("a"), item("a", 2, rate=300000.0), item("b", 1)], [slip("a", 5.0)], [(j, f"{j}.pdf", "variation", "u", "read", 1) for j in "ab"])
    assert (got["a", 2].status, got["a", 2].confidence, got["b", 1].confidence) == ("insufficient_evidence", "low", "high") and "1 sibling" in got["a", 2].reason and got["a", 1].confidence == "high"


def identical(spark, items, slips=(), finals=()):
    rows = I.identical_quantities(spark.createDataFrame(items, ITEMS), spark.createDataFrame(list(slips), SLIPS), spark.createDataFrame(list(finals), FINALS))
    return {r["case"]: r for r in rows.collect()}


def test_identical_quantities(spark):
    same = lambda job, n, final=False: [item(job, k, plan=10.0 + k, billed=10.0 + k, rate=1000.0 * (k + 1), final=final) for k in range(n)]
    items = same("two", 2) + same("running", 3) + same("final", 3, True) + same("slips", 3) + same("artefact", 3) + same("reduced", 4) + same("closed", 3)
    slips = [slip("slips", 10.0 + k, rate=1000.0 * (k + 1)) for k in range(3)] + [slip("artefact", 8.0, rate=1000.0), slip("reduced", 8.0, rate=1000.0)] + [slip("final", 8.0, rate=1000.0)]
    finals = [("closed", 1000.0, 3.0, None, "f", 1, 0, "10.00 3.00 1000.00"), ("closed", 2000.0, 5.0, 11.0, "f", 1, 1, "x"), ("closed", 3000.0, 5.0, None, "f", 1, 2, "5.00 9.00")]
    got = identical(spark, items, slips, finals)
    assert set(got) == {"running", "final", "slips", "artefact", "reduced", "closed"}
    assert [(got[k].status, got[k].confidence, got[k].n_identical, got[k].n_confirmed) for k in ("running", "final", "slips", "reduced")] == [("insufficient_evidence", "low", 3, 0), ("insufficient_evidence", "high", 3, 3), ("insufficient_evidence", "high", 3, 3), ("insufficient_evidence", "low", 3, 0)]
    a = got["artefact"]
    assert (a.status, a.confidence, a.value_at_issue, a.n_identical) == ("artefact", "high", 0.0, 2) and "10 tendered → 8 executed" in a.reason and a.evidence[0].url == "artefact.pdf"
    assert (got["closed"].status, got["closed"].n_identical) == ("artefact", 2) and "10 tendered → 13 executed" in got["closed"].reason


def test_final_bills_without_a_book(spark):
    kind = "job string, final_bills array<string>, mb_real long, bill_level_files boolean, mb_filed_elsewhere array<string>"
    rows = [("a", ["701476"], 0, False, []), ("b", ["1"], 0, True, []), ("c", ["1"], 0, True, ["mb.pdf"]), ("d", ["1"], 2, True, []), ("e", [], 0, True, []), ("f", ["1"], None, None, None)]
    got = {r["case"]: (r.status, r.confidence, r.documentation_gap) for r in I.final_bills_without_book(spark.createDataFrame(rows, kind), spark.createDataFrame([("a", 5.0)], "job string, payments_gross double")).collect()}
    assert got == {"a": ("artefact", "low", 0), "b": ("unexplained_in_public_record", "high", 10), "c": ("explained", "high", 0), "f": ("artefact", "low", 0)}


def test_shared_documents(spark):
    shared = [("a", "https://x/Files/WB-CC--1-NOT%20APPLICABLE.pdf", "z"), ("b", "https://x/Files/WO-6--2-Agre%2001.jpg", "c"), ("b", "https://x/Files/nil.pdf", "y"), ("d", "https://x/plan.pdf", "b"), ("d", "https://x/plan.pdf", "c")]
    contracts = [("b", "https://x/Files/WO-6--2-Agre 01.jpg", 75039723.0), ("b", "https://x/other", 9e9), ("d", "https://x/unrelated", 9e9)]
    items = [(j, float(q), 2.0) for j, n in (("d", 6), ("c", 6), ("b", 9)) for q in range(n)]
    paid = [("b", 5.79e7), ("c", 1.69e7), ("d", 4e6)]
    got = {r["case"]: r for r in I.reused_documents(spark.createDataFrame(shared, "job string, url string, other string"), spark.createDataFrame(contracts, "job string, url string, value double"), spark.createDataFrame(items, "job string, quantity double, rate double"), spark.createDataFrame(paid, "job string, payments_gross double")).collect()}
    assert (got["a"].status, got["a"].confidence) == ("artefact", "low") and "placeholder" in got["a"].reason
    assert (got["b"].status, got["b"].others) == ("explained", ["c"]) and "one contract booked under several job codes" in got["b"].reason
    assert (got["d"].status, got["d"].strong, got["d"].value_at_issue, got["d"].documentation_gap) == ("insufficient_evidence", True, 4e6, 5)


@pytest.fixture(scope="module")
def cases(spark):
    kind = f"case string, type string, status string, confidence string, value_at_issue double, documentation_gap int, timeline_days int, reason string, evidence {I.EVIDENCE}"
    ev = lambda *kinds: [(k, "l", None, None, None) for k in kinds]
    rows = [("a", "x", "explained", "high", 1e8, 9, None, "why", ev("api")), ("a", "y", "insufficient_evidence", "high", 1e6, 1, 365, None, ev("document")), ("b", "x", "explained", "high", 1e8, 0, None, "why", ev("api")), ("c", "x", "unexplained_in_public_record", "low", 1e8, 0, None, "low", []), ("d", "x", "unexplained_in_public_record", "medium", 1e7, 0, None, None, ev("api"))]
    return I.assembled(spark.createDataFrame(rows, kind))


def test_cases_live_by_their_open_issues(cases):
    got = {r["case"]: r for r in cases.collect()}
    a = got["a"]
    assert (a.primary_issue, a.retained, a.documentation_gap, a.timeline_deviation, a.independent_sources) == ("y", True, 1.0, 5.0, 4.0) and [(r.type, r.outcome, r.reason) for r in a.resolved] == [("x", "explained", "why")]
    assert [(got[k].retained, got[k].status) for k in "bcd"] == [(False, "set aside"), (False, "set aside"), (True, "unexplained_in_public_record")] and got["c"].resolved[0].outcome == "low confidence" and got["b"].why_not_retained.startswith("every issue")


def test_cases_of_one_contract_are_merged(spark, cases):
    reuse = [("a", "document_reuse", "insufficient_evidence", ["d", "b", "q"], True), ("d", "document_reuse", "insufficient_evidence", ["a"], True), ("c", "document_reuse", "artefact", ["a"], True)]
    paid = spark.createDataFrame([("a", 5.0), ("d", 9.0), ("b", 1.0)], "job string, payments_gross double")
    got = {r["case"]: r for r in I.merged(cases, spark.createDataFrame(reuse, "case string, type string, status string, others array<string>, strong boolean"), paid).collect()}
    assert (got["a"].retained, got["a"].merged_into, got["d"].related, got["d"].retained) == (False, "d", ["a"], True) and got["b"].merged_into is None


def test_merging_goes_by_case(spark):
    """b takes in c before a, which comes first, takes in b; a case that was taken in takes none."""
    rows = spark.createDataFrame([(c, True, None) for c in "abcd"], "case string, retained boolean, why_not_retained string")
    reuse = spark.createDataFrame([("a", "insufficient_evidence", ["b"], True), ("b", "insufficient_evidence", ["a", "c"], True), ("c", "insufficient_evidence", ["b", "d"], True), ("d", "insufficient_evidence", ["c"], True)], "case string, status string, others array<string>, strong boolean")
    paid = spark.createDataFrame([("a", 9.0), ("b", 8.0), ("c", 7.0), ("d", 7.0)], "job string, payments_gross double")
    got = {r["case"]: r.merged_into for r in I.merged(rows, reuse, paid).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": "c"}
