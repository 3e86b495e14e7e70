"""Statement rows by literal lines; multiples of a rate and priced rows against plain forms."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from worksight.functions import amounts as A
from worksight.operators import work_slips as W


def read(spark, *texts):
    return W.statement_rows(spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, page int, text string")).orderBy("page", "line").collect()


def test_savings_and_restored_points(spark):
    (r,) = read(spark, "Sqm | 5354.95 157.30 842333.64 730.20 730.20 157.30 114860.46 114860.46 727473.18")
    assert (r.tender_qty, r.rate, r.executed_qty, r.savings, r.confidence, r.unit) == (5354.95, 157.3, 730.2, 727473.18, "high", "sqm") and W.SAVED in r.checks
    (r,) = read(spark, "Cum 100.00 50.00 5000.00 30.00 50.00 1500.00 350000")
    assert r.savings == 3500.0 and r.checks[-1] == W.SAVED + W.RESTORED and r.confidence == "high"


def test_total_executed_not_partial_columns(spark):
    (r,) = read(spark, "each 2,00 235000,00 470000.00 3.00 235000.00 705000.00 2.00 235000.00 470000.00 5.00 1175000.00 3.00 705000.00")
    assert (r.tender_qty, r.executed_qty, r.excess, r.confidence) == (2.0, 5.0, 705000.0, "high")


def test_parts_at_125_percent(spark):
    (r,) = read(spark, "Cum 100.00 50.00 5000.00 140.00 125.00 50.00 6250.00 15.00 55.00 825.00 7075.00 2075.00")
    assert (r.executed_qty, r.actual_amount, r.excess, r.checks[1]) == (140.0, 7075.0, 2075.0, W.SPLIT)


def test_nothing_executed_and_unreadable_quantities(spark):
    (r,) = read(spark, "Cum 100.00 50.00 5000.00 0.00 0.00 5000.00")
    assert (r.executed_qty, r.savings, r.checks[1]) == (0.0, 5000.0, W.NOTHING)
    (r,) = read(spark, "Cum 100.00 50.00 5000.00 x 7500.00 2500.00")
    assert (r.executed_qty, r.excess, r.checks[1], r.confidence) == (150.0, 2500.0, W.DERIVED, "medium")


def test_rows_without_arithmetic(spark):
    assert read(spark, "Rupees two lakh only 12 34 56", "each 3.00 258000.00 774000.00 300.00 258000.00 77400000.00", "", None, "1.00 " * 200) == []


def test_context_stays_between_rows(spark):
    text = "KSRRB 500-7 tack coat\nSqm 100.00 50.00 5000.00 60.00 50.00 3000.00 2000.00\nnext item of work\nCum 10.00 500.00 5000.00 12.00 500.00 6000.00 1000.00"
    a, b = read(spark, text)
    assert (a.code, a.line, b.code, b.unit) == ("KSRRB 500-7", 1, None, "cum") and b.description.startswith("next item of work") and "tack" not in b.description


def test_headings(spark):
    text = "Agreement Amount = 138213434.00\nWorkslip Cost (Excess) [= __|28755136.98\nSanctioned Estimate Amount: Rs. 10,00,000.00\nTender Premium: Above 4.99%"
    got = {r.field: r for r in W.headings(spark.createDataFrame([("f", 12, text), ("f", 13, "Agreement amount 5"), ("f", 14, None)], "file string, page int, text string")).collect()}
    assert (got["agreement_amount"].number, got["work_slip_excess"].number, got["sanctioned_estimate"].number) == (138213434.0, 28755136.98, 1000000.0)
    assert (got["tender_premium"].value, got["tender_premium"].number, got["agreement_amount"].page) == ("Above 4.99%", None, 12)


def test_documents_of_a_job(spark):
    kind = "job string, bill string, position int, file string, type string, url string, final_bill boolean"
    rows = [("j", "1", 0, "ws.pdf", "Other", "u1", False), ("j", "2", 0, "work slip.pdf", "Other", "u2", False), ("j", "3", 0, "work slip.pdf", "Other", "u3", True), ("j", "3", 1, "mb.pdf", "M.B.", "u4", True), ("j", "2", 1, "mb.pdf", "M.B.", "u4", False), ("j", "3", 2, "blank.pdf", "M.B.", "u", True), ("j", "1", 1, "x", "Letter", "u", False), ("k", "9", 0, "order", "Work Order", "u", False)]
    docs = W.case_documents(spark.createDataFrame(rows, kind))
    assert {(r.job, r.file): (r.kind, r.bills) for r in docs.collect()} == {("j", "ws.pdf"): ("variation", ["1"]), ("j", "work slip.pdf"): ("variation", ["2", "3"]), ("j", "mb.pdf"): ("final_bill", ["3"]), ("k", "order"): ("work order", ["9"])}
    slip = "Sqm 100.00 50.00 5000.00 60.00 50.00 3000.00 2000.00\nAgreement Amount = 5000.00"
    pages = spark.createDataFrame([("ws.pdf", 0, slip), ("work slip.pdf", 0, slip), ("mb.pdf", 0, "Rate Amount\nSqm 60.00 50.00 3000.00")], "file string, page int, text string")
    got = W.case_evidence(docs, pages)
    assert {(r.file, r.status, r.rows) for r in got["documents"].collect()} == {("ws.pdf", "read", 1), ("work slip.pdf", "read", 1), ("mb.pdf", "read", 1), ("order", "not downloaded", None)}
    assert [(r.job, r.file, r.executed_qty) for r in got["statement_rows"].collect()] == [("j", "work slip.pdf", 60.0)] and [(r.job, r.quantity) for r in got["final_rows"].collect()] == [("j", 60.0)]
    assert [(r.job, r.field, r.number) for r in got["headings"].collect()] == [("j", "agreement_amount", 5000.0)]


def test_multiples_as_in_the_nested_form(spark):
    r = random.Random(8)
    items = [("j", i, float(r.randint(1, 9)), float(r.choice([2500, 1200.5, 235000, 77]))) for i in range(25)] + [("k", 0, 2.0, 2500.0), ("j", 98, 2.5, 100.0), ("j", 99, 0.0, 5.0)]
    pages = []
    for n in range(40):
        lines = []
        for _ in range(r.randint(0, 4)):
            q, rate = r.choice(items)[2:]
            e = r.randint(1, 6)
            values = [round((q + e) * rate, 2), round(e * rate, 2), r.randint(1, 10**6), rate][: r.randint(1, 4)]
            r.shuffle(values)
            lines.append("row " + " ".join(f"{v:.2f}" for v in values))
        pages.append(("j", f"f{n % 3}", n, "\n".join(lines)))
    want = {}
    for job, item, q, rate in items:
        for j, f, n, text in sorted(pages, key=lambda p: (p[1], p[2])):
            for k, line in enumerate(text.split("\n")):
                v = [float(x) for x in re.findall(r"\d+\.\d+", line)]
                times = sorted(x / rate for x in v if x > rate and abs(x / rate - round(x / rate)) < 1e-6)
                hits = [(t, e) for t in times for e in times if t > e and abs(t - e - q) < 1e-6 and t > q]
                if j == job and q and hits and (job, item) not in want:
                    want[job, item] = (f, n, k, hits[0][0], hits[0][1])
    got = W.amount_multiples(spark.createDataFrame(items, "job string, item int, quantity double, rate double"), spark.createDataFrame(pages, "job string, file string, page int, text string"))
    assert {(x.job, x.item): (x.file, x.page, x.line, x.executed_qty, x.excess_qty) for x in got.collect()} == want and len(want) > 10


def plain_priced(tokens):
    value = lambda t: float(t.replace(",", ".")) if re.fullmatch(r"\d+,\d{1,2}", t) else float(t)
    digits = lambda x, n: f"{x:.{n}f}".replace(".", "").lstrip("0")
    near, fair = lambda p, a: a > 0 and abs(p - a) <= max(2, 0.005 * a), lambda q, r, a: a >= 50 and q >= 0.01 and r >= 0.5 and not ((q <= 1 or r <= 1) and a < 1000)
    triples = [t for t in itertools.combinations(tokens, 3) if all(map(value, t))]
    for t in triples:
        q, r, a = map(value, t)
        if sum("." in x for x in t) >= 2 and near(q * r, a) and a >= max(q, r, 1) and fair(q, r, a):
            return q, r, a, "arithmetic"
    for t in triples:
        q, r, a = map(value, t)
        bare = [not set(x) & {".", ","} for x in t]
        if bare[2] and ("." in t[0] or "." in t[1]) and q * r >= 1 and fair(q, r, q * r):
            for n in (2, 3, 4):
                if digits(q * r, n) == t[2].lstrip("0"):
                    return q, r, round(q * r, n), "decimal restored"
        if bare[0] and "." in t[1] and "." in t[2] and fair(a / r, r, a):
            for n in (2, 3):
                if digits(a / r, n) == t[0].lstrip("0") and near(round(a / r, n) * r, a):
                    return round(a / r, n), r, a, "decimal restored"
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_priced_rows_as_in_the_plain_form(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(600):
        q, rate = round(r.uniform(0.1, 900), 2), round(r.uniform(0.3, 500), 2)
        a = [f"{q:.2f}", f"{rate:.2f}", f"{q * rate:.2f}"]
        at = r.randrange(4)
        if at < 3:
            a[at] = a[at].replace(".", r.choice(["", "", ",", "."]))
        for _ in range(r.randint(0, 3)):
            a.insert(r.randrange(len(a) + 1), r.choice(["1", "0", "2.50", f"{r.uniform(0, 1000):.2f}", str(r.randint(0, 9999))]))
        rows.append((i, a))
    rows += [(600, []), (601, None), (602, ["1.00", "2.00"])]
    got = {x.i: tuple(x.y) for x in spark.createDataFrame(rows, "i int, t array<string>").select("i", A.find_priced_row(F.col("t")).alias("y")).collect()}
    want = {i: plain_priced(t or []) or (None,) * 4 for i, t in rows}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {} and sum(w[0] is not None for w in want.values()) > 200


def test_search_goes_to_workers_by_value(spark):
    """The search names no module that holds functions of Spark, which can't be sent once they were used."""
    import worksight
    from pyspark import cloudpickle
    from worksight.functions import amounts

    spark.range(1).select(amounts.find_priced_row(F.array(F.lit("2.00"), F.lit("50.00"), F.lit("100.00")))).collect()
    cloudpickle.register_pickle_by_value(worksight)
    try:
        assert cloudpickle.dumps(W._statement_rows.func)
    finally:
        cloudpickle.unregister_pickle_by_value(worksight)
