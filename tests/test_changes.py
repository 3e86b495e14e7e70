"""Differences of two builds, on literal tables."""

import pytest

from worksight.operators import changes as C


def build(spark, projects, bills, signals=(), finals=(), cases=None):
    out = {
        "projects": spark.createDataFrame(projects, "slug string, title string, status string, payments_gross double"),
        "bills": spark.createDataFrame(bills, "slug string, job_number string, bill_type string, gross double, br_no string, br_date string, payment_date string, contractor string"),
        "signals": spark.createDataFrame(list(signals), "slug string, code string"),
        "finals": spark.createDataFrame(list(finals), "slug string, value string"),
    }
    if cases is not None:
        out["cases"] = spark.createDataFrame(cases, "case_id string, retained boolean, status string")
    return out


@pytest.fixture()
def two(spark):
    job, new = "151-20-000001", "174-26-000001"
    a = build(spark, [(job, "Roads", "Running bill only", 1e7)], [(job, job, "Running", 1e7, "1", "2025-01-01", None, "A")], [(job, "slow_payment")], cases=[("K1", True, "needs papers")])
    b = build(spark, [(job, "Roads", "Completed (final bill)", 3e7), (new, "New drain", "Running bill only", 5e6)],
              [(job, job, "Running", 1e7, "1", "2025-01-01", "2025-02-01", "A"), (job, job, "Final", 2e7, "2", "2026-09-01", "2026-09-20", "A"), (new, new, "Running", 5e6, "1", "2026-09-10", None, "B")],
              [(new, "slow_payment")], [(job, "2026-09-01"), (None, "x")], [("K1", False, "set aside"), ("K2", True, "open")])
    return a, b


def test_changes(two):
    got = sorted((r.kind, r.key, r.note) for r in C.changes(*two).collect())
    job, new = "151-20-000001", "174-26-000001"
    assert got == [
        ("case", "K1", "open → set aside"), ("case", "K2", "new candidate"), ("final_bill", job, "Roads"), ("new_bill", job, "Final, paid 2026-09-20 to A"), ("new_bill", new, "Running, not yet paid to B"),
        ("newly_paid", job, "Running, paid 2025-02-01 to A"), ("project_added", new, "New drain"), ("signal_added", new, "slow_payment"), ("signal_gone", job, "slow_payment"), ("status", job, None),
    ]
    back = sorted((r.kind, r.key) for r in C.changes(two[1], two[0]).collect())
    assert ("project_dropped", new) in back and ("case", "K2") in back and not any(k in ("new_bill", "newly_paid", "final_bill") for k, _ in back)


def test_report(two):
    text = C.report(*two, "2026-11-01")
    assert text.startswith("## Data refresh 2026-11-01\n\n- Projects: 1 → 2; ") and "New bills: 2; bills newly paid: 1" in text and "- Signals: +1 / −1; case changes: 2" in text
    assert "- K1: open → set aside (needs papers → set aside)" in text and text.index("151-20-000001: ₹2.00 Cr") < text.index("174-26-000001: ₹50.0 L")
    assert "No changes." in C.report(two[0], two[0], "2026-11-01")


def test_long_kinds_are_counted_in_full(spark):
    a = build(spark, [("p", "t", None, None)], [])
    b = build(spark, [(f"p{i:02}", "t", None, None) for i in range(45)], [(f"p{i:02}", "j", None, float(i), str(i), None, None, None) for i in range(20)])
    text = C.report(a, b, "d")
    assert "- … and 5 more" in text and "New bills: 20" in text and text.count("bill, not yet paid") == 15
