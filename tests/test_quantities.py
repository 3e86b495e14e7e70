"""Planned against billed: literal jobs, and random ones against a plain form that goes bill by bill."""

import random
from collections import defaultdict

import pytest

from worksight.operators import dataset_signals as S
from worksight.operators import quantities as Q

PLAN = "job string, position int, type string, code string, unit string, quantity double, rate double, amount double, description string"
BILLS = "job string, bill string, bill_type string, gross double, date date, paid boolean"
ROWS = "job string, bill string, position int, code string, unit string, quantity double, rate double, amount double, description string, to_date_quantity double"
TOTALS = "job string, code string, unit string, total double"


def analysed(spark, plan=(), bills=(), rows=(), totals=()):
    make = lambda data, kind: spark.createDataFrame(list(data), kind).repartition(3)
    return Q.planned_against_billed(make(plan, PLAN), make(bills, BILLS), make(rows, ROWS), make(totals, TOTALS))


def test_a_job_with_running_and_final_bills(spark):
    plan = [("j", 1, "Schedule B", "KSRRB 500", "sqm", 100.0, 50.0, 5000.0, "tack coat"), ("j", 2, "Schedule B", "KSRRB 501", "m", 40.0, 200.0, 8000.0, "kerb"), ("j", 3, "Schedule B", "KSRRB 500", "sqm", 100.0, 50.0, 5000.0, "the same again"),
            ("j", 4, "Estimates", "KSRRB 9", "cum", 1.0, 1.0, 1.0, "estimate only"), ("j", 5, "Supplementary Schedule B", "KSRRB 7", "cum", 1.0, 5.0, 5.0, "extra"), ("e", 1, "Estimates", None, "nos", 3.0, 10.0, 30.0, "lamp pole")]
    bills = [("j", "b2", "Second and Final", 8000.0, None, True), ("j", "b1", "First", 3000.0, None, True)]
    rows = [("j", "b1", 1, "KSRRB 500", "sqm", 60.0, 50.0, 3000.0, "tack coat", None), ("j", "b2", 2, "KSRRB 500", "sqm", 60.1, 50.0, 3005.0, "tack coat", 120.0), ("j", "b2", 3, "KSRRB 501", "km", 0.01, 210.0, 2000.0, "kerb", None), ("j", "b2", 4, None, "nos", 1.0, 999.0, 999.0, "statue of somebody", None), ("j", "b2", 5, "KSRRB 500", "sqm", 55.0, 50.0, 2750.0, "tack coat", 115.0)]
    a = analysed(spark, plan, bills, rows, [("j", "KSRRB 501", "m", 12.0), ("j", "KSRRB 501", "km", 0.011), ("j", "KSRRB 501", "sqm", 99.0), ("j", None, "m", 5.0)])
    items = {(r.job, r.item): r for r in a.items.collect()}
    assert sorted(items) == [("e", 1), ("j", 1), ("j", 2)]
    tack, kerb, lamp = items["j", 1], items["j", 2], items["e", 1]
    assert [(b.bill, b.quantity, b.match) for b in tack.bills] == [("b1", 60.0, "code"), ("b2", 55.0, "code")] and [(b.bill, b.quantity) for b in tack.repeated] == [("b2", 60.1)]
    assert (tack.billed_quantity, tack.compared_basis, tack.from_final_bill, tack.variance_pct) == (115.0, Q.UP_TO_DATE, True, 15.0)
    assert (kerb.billed_quantity, kerb.measured_quantity, kerb.compared_quantity, kerb.compared_basis, kerb.from_final_bill) == (10.0, 12.0, 12.0, Q.MEASURED, None)
    assert (lamp.plan_basis, lamp.compared_quantity, lamp.bills) == ("Estimates", None, None)
    assert [(r.job, r.description, r.category) for r in a.unplanned.collect()] == [("j", "statue of somebody", "Other")]
    jobs = {r.job: r for r in a.jobs.collect()}
    assert (jobs["j"].plan_basis, jobs["j"].plan_items, jobs["j"].supplementary_items, jobs["j"].plan_value, jobs["j"].paid_gross, jobs["j"].has_final) == ("Schedule B (contract BOQ)", 2, 1, 13000.0, 11000.0, True)
    assert (jobs["e"].plan_basis, jobs["e"].all_read, jobs["e"].has_final) == ("Estimate", False, False)


def test_cumulative_bills_take_the_place_of_earlier_ones(spark):
    bills = [("j", str(i), "Running", 1000.0, None, True) for i in range(3)]
    plan = [("j", 1, "Schedule B", "K 1", "sqm", 10.0, 100.0, 1000.0, "x")]
    rows = [("j", "0", 0, "K 1", "sqm", 9.0, 100.0, 900.0, "x", None), ("j", "1", 1, "K 1", "sqm", 19.5, 100.0, 1950.0, "x", None), ("j", "2", 2, "K 1", "sqm", 8.0, 100.0, 800.0, "x", None)]
    a = analysed(spark, plan, bills, rows)
    assert [(r.bill, r.scope, r.counted) for r in a.bills.orderBy("n").collect()] == [("0", "this bill", False), ("1", "cumulative", True), ("2", "this bill", True)]
    assert (a.items.first().billed_quantity, a.jobs.first().billed_value_read, a.jobs.first().all_read) == (27.5, 2750.0, True)


def test_nothing(spark):
    a = analysed(spark)
    assert a.items.collect() == a.jobs.collect() == a.bills.collect() == a.unplanned.collect() == []
    assert analysed(spark, bills=[("j", "1", None, None, None, None)]).jobs.first().paid_gross == 0


def plain(plan, bills, rows):
    """By code alone, which is unique in a plan: quantities by job and code, going bill by bill."""
    out, per_job = {}, defaultdict(list)
    for b in bills:
        per_job[b[0]].append(b)
    for job, own in per_job.items():
        own.sort(key=lambda b: (b[4] is None, b[4], b[1]) if b[4] else (True, 0, b[1]))
        seen, by_bill = set(), defaultdict(list)
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: r[2]):
            if (key := (r[3], round(r[5], 2), round(r[6], 2))) not in seen:
                seen.add(key)
                by_bill[r[1]].append(r)
        so_far, scopes = 0, []
        for b in own:
            so_far, s = so_far + b[3], sum(r[7] for r in by_bill[b[1]])
            scopes.append("this" if s and 0.6 <= s / b[3] <= 1.35 else "all" if s and so_far > b[3] and 0.6 <= s / so_far <= 1.35 else None)
        first = max((i for i, s in enumerate(scopes) if s == "all"), default=0)
        items = {p[3]: {"billed": None, "to_date": None, "bills": []} for p in plan if p[0] == job}
        for b in own[first:]:
            for r in by_bill[b[1]]:
                w = items.get(r[3])
                if w is None or any(x != b[1] and abs(q - r[5]) <= 0.005 * r[5] for x, q in w["bills"]):
                    continue
                w["to_date"] = r[9] if r[9] is not None else w["to_date"]
                w["billed"] = round((w["billed"] or 0) + r[5], 3)
                w["bills"].append((b[1], r[5]))
        for code, w in items.items():
            got = w["to_date"] if w["to_date"] is not None and w["to_date"] >= w["billed"] - 0.01 else w["billed"]
            out[job, code] = (got, w["bills"])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_jobs_as_in_the_plain_form(spark, seed):
    r = random.Random(seed)
    plan = [(f"j{j}", i, "Schedule B", f"K {i}", "sqm", 100.0, 50.0 + i, 100 * (50.0 + i), "item") for j in range(12) for i in range(4)]
    bills = [(f"j{j}", f"b{k}", "Running", float(r.choice([2000, 5000, 9000])), None, True) for j in range(12) for k in range(4)]
    rows, n = [], 0
    for j in range(12):
        for k in range(4):
            for _ in range(r.randint(0, 3)):
                i, q = r.randrange(5), float(r.choice([10, 20, 30, 30.1, 40, 60]))
                rate = 50.0 + i
                rows.append((f"j{j}", f"b{k}", n, f"K {i}", "sqm", q, rate, q * rate, "item", r.choice([None, None, q, q + 25])))
                n += 1
    got = {(x.job, x.code): (x.compared_quantity, [(b.bill, b.quantity) for b in x.bills or []]) for x in analysed(spark, plan, bills, [r if r[3] != "K 4" else (*r[:8], "other work entirely", r[9]) for r in rows]).items.collect()}
    assert got == plain(plan, bills, rows)


def test_signals_of_an_analysis(spark):
    plan = [("j", i, "Schedule B", f"K {i}", "sqm", 100.0, 5000.0, 5e5, "item") for i in range(2)]
    rows = [("j", "b", 0, "K 0", "sqm", 70.0, 5000.0, 3.5e5, "item", None), ("j", "b", 1, "K 1", "sqm", 130.0, 5001.0, 6.5e5, "item", None), ("j", "b", 2, "K 7", "cum", 3.0, 90000.0, 2.7e5, "extra", None)]
    a = analysed(spark, plan, [("j", "b", "Final", 1.2e6, None, True)], rows)
    works = spark.createDataFrame([("j", 1e6, 1e6, 0, 1, True)], "job string, contract double, paid double, n_variations int, n_bill_documents int, readable boolean")
    got = {r.code: r.measure for r in S.quantity_signals(*Q.signal_inputs(a, works)).collect()}
    assert got == {"qty_measured_below_plan": 1, "qty_billed_above_plan": 1, "qty_above_plan_no_variation": 1, "qty_billed_item_not_in_plan": 1}
