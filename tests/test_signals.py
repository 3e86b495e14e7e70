from datetime import date

from worksight.operators.signals import project_signals

BILLS = "project_id int, bill_type string, br_date date, payment_date date, end_date date, gross double, deduction double"
FACTS = "project_id int, field string, value string, confidence string"


def run(spark, facts, bills):
    out = project_signals(spark.createDataFrame(facts, FACTS), spark.createDataFrame(bills, BILLS), "2026-10-05", "2026-03-31").collect()
    return {(r.project_id, r.code): (r.severity, r.confidence) for r in out}


def test_ratios_and_confidence(spark):
    fact = lambda p, **k: [(p, f, v, "inferred" if f == "contract_value" else "confirmed") for f, v in k.items()]
    got = run(spark, fact(1, paid_vs_contract="1.7", contract_value="100", payments_gross="170") + fact(2, payments_gross="130", estimated_cost="100") + fact(3, paid_vs_contract="1.2", contract_value="100") + fact(4, tender_calls="2") + fact(5, tender_calls="5", bidders="1"), [])
    assert got == {(1, "paid_over_contract"): ("attention", "inferred"), (2, "paid_over_estimate"): ("notice", "confirmed"), (4, "recalled_tender"): ("info", "confirmed"), (5, "recalled_tender"): ("attention", "confirmed"), (5, "single_bidder"): ("notice", "confirmed")}


def test_time_rules(spark):
    facts = [(1, "work_order_date", "2015-01-01", "confirmed"), (1, "last_payment", "2019-01-01", "confirmed"), (2, "work_order_date", "2020-01-01", "confirmed"), (2, "last_payment", "2021-06-01", "confirmed"), (2, "period_days", "100", "inferred"), (3, "completion_due", "2025-01-01", "confirmed"), (3, "extended_completion", "2026-03-01", "confirmed")]
    got = run(spark, facts, [])
    assert got == {(1, "long_running"): ("notice", "confirmed"), (2, "over_stipulated_period"): ("notice", "inferred")}


def test_bill_rules(spark):
    d = date(2020, 3, 20)
    bills = [(1, "Running", date(2020, 5, 1), d, None, 5e5, 2e5), (1, "Final", date(2020, 4, 1), d, None, 5e5, None), (1, None, None, d, date(2017, 1, 1), 5e5, 0.0), (2, None, None, None, None, None, None)]
    got = run(spark, [(1, "payments_gross", "1500000", "confirmed"), (1, "bad", None, None)], bills)
    assert set(got) == {(1, c) for c in ("year_end_payment", "payment_burst", "bills_after_final", "large_deduction", "late_payment")}


def test_nothing(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(None, None, None, None), (1, "paid_vs_contract", "n/a", "confirmed")], []) == {}
