"""Signals of a work from its facts and bills: one row per work and code, each with the measure that set it off.

Facts: project_id, field, value (text), confidence. Bills: project_id, bill_type, br_date, payment_date, end_date, gross, deduction.
Award and estimate are compared only where the facts award_tender and estimate_tender name the same tender.
A work without bills, a missing or unreadable fact and NULL amounts set nothing off; a field given twice counts once, with the
greatest confidence rank last. A work has a few dozen facts, so the map of them is small; bills are reduced to sums before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.tables import exploded

# Thresholds of the rules.
OVER_CONTRACT, FAR_OVER_CONTRACT, OVER_ESTIMATE = 1.25, 1.6, 1.25
FRONT_LOADED_SHARE, FRONT_LOADED_TIME = 0.75, 0.4
SPAN_FACTOR, SPAN_EXTRA_DAYS, LONG_DAYS = 2, 180, 1095
OVERDUE_DAYS, NO_BILL_DAYS, STALE_DAYS = 90, 180, 1095
ABOVE_ESTIMATE, DEEP_DISCOUNT = 0.10, -0.25
EARLY_DAYS, YEAR_END_LEAST, YEAR_END_SHARE = 30, 1_000_000, 0.5
SLOW_DAYS, BURST, LARGE_DEDUCTION, LATE_LEAST, LATE_DAYS = 365, 3, 0.3, 100_000, 730
RUNNING_ONLY = "Running bill only (no final bill found)"

CONFIDENCE = ("confirmed", "inferred", "unknown")
#: Facts that are read as numbers and as days.
NUMBERS = ("paid_vs_contract", "payments_gross", "contract_value", "estimated_cost", "period_days", "tender_calls", "bidders", "placeholder_photos", "partial_release", "bill_to_payment_days")
DAYS = ("work_order_date", "awarded_date", "first_payment", "last_payment", "commencement_date", "start_date", "completion_date", "extended_completion", "expected_completion", "completion_due")


def facts_map(facts: DataFrame) -> DataFrame:
    """project_id and a map from field to (value, confidence)."""
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.coalesce("confidence", F.lit("unknown")))
    one = facts.filter("field IS NOT NULL").groupBy("project_id", "field").agg(F.min_by(F.struct("value", "confidence"), F.struct(rank, "value")).alias("f"))
    return one.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "f"))).alias("facts"))


def _read(rows: DataFrame) -> DataFrame:
    """Rows with number_ and day_ columns: each fact is read once, however many rules and measures ask for it."""
    text = lambda k: F.nullif(F.try_element_at("facts", F.lit(k))["value"], F.lit(""))
    numbers = {f"number_{k}": F.nullif(text(k).try_cast("double"), F.lit(0.0)) for k in NUMBERS}
    return rows.withColumns(numbers | {f"day_{k}": F.try_to_date(F.substring(text(k), 1, 10), "yyyy-MM-dd") for k in DAYS})


def bill_sums(bills: DataFrame) -> DataFrame:
    """What the rules need from the bills of a work, one row each."""
    final = F.coalesce(F.lower("bill_type").contains("final"), F.lit(False))
    b = bills.withColumn("final", final).withColumn("registered", F.coalesce("br_date", "payment_date"))
    late = F.datediff("payment_date", "end_date")
    year_end = (F.month("payment_date") == 3) & (F.dayofmonth("payment_date") >= 15)
    large = F.when(F.col("deduction") > LARGE_DEDUCTION * F.col("gross"), F.col("deduction"))
    # a work's bills are sorted once, by the day of payment; windows spill where one has very many
    of_work = Window.partitionBy("project_id")
    b = b.withColumns({"same_day": F.when(F.col("payment_date").isNotNull(), F.count("*").over(Window.partitionBy("project_id", "payment_date"))), "final_date": F.min(F.when(F.col("final"), F.coalesce("registered", F.lit("9999-12-31").cast("date")))).over(of_work)})
    after = ~F.col("final") & (F.col("br_date") > F.col("final_date"))
    return b.groupBy("project_id").agg(
        F.count("*").alias("n_bills"), F.sum(F.when(F.col("payment_date").isNotNull(), F.col("gross"))).cast("double").alias("dated"), F.sum(F.when(year_end, F.col("gross"))).cast("double").alias("march"),
        F.max(F.when(F.col("gross") != 0, large)).cast("double").alias("large"), F.max(late).alias("latest"), F.min("payment_date").alias("first_paid"),
        F.coalesce(F.bool_or(F.col("bill_type").isNotNull() & (F.col("bill_type") != "")), F.lit(False)).alias("typed"), F.max("same_day").alias("burst"), F.sum(F.when(after, 1)).alias("after_final"),
    )


def project_signals(facts: DataFrame, bills: DataFrame, today: str, data_end: str) -> DataFrame:
    """project_id, code, severity, confidence, measure. facts: rows as above, or one row a work with the map that facts_map makes of them."""
    held = facts if "facts" in facts.columns else facts_map(facts)
    rows = _read(held).join(bill_sums(bills), "project_id", "full")
    got = lambda k: F.try_element_at("facts", F.lit(k))
    text = lambda k: F.nullif(got(k)["value"], F.lit(""))
    number = lambda k: F.col(f"number_{k}")
    day = lambda k: F.col(f"day_{k}")
    days = lambda a, b: F.datediff(a, b).cast("double")

    def confidence(*fields: str) -> Column:
        rank = lambda k: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CONFIDENCE)), got(k)["confidence"]), F.lit(0)), F.lit(3))
        return F.element_at(F.array(*map(F.lit, CONFIDENCE)), (rank(fields[0]) if len(fields) == 1 else F.greatest(*map(rank, fields))).cast("int"))

    sure, guess = F.lit("confirmed"), F.lit("inferred")
    ratio, paid, contract, estimate, period, calls = map(number, ("paid_vs_contract", "payments_gross", "contract_value", "estimated_cost", "period_days", "tender_calls"))
    award, last = F.coalesce(day("work_order_date"), day("awarded_date")), day("last_payment")
    start = F.coalesce(day("commencement_date"), day("work_order_date"), day("start_date"), day("awarded_date"))
    span, extended = days(F.coalesce(day("completion_date"), last), start), day("extended_completion")
    allowed = F.when((period > 0) & (days(extended, start) > period), days(extended, start)).otherwise(period)
    over_period = F.coalesce((span > SPAN_FACTOR * allowed) & (span - allowed > SPAN_EXTRA_DAYS), F.lit(False))
    overdue = days(F.lit(data_end).cast("date"), day("expected_completion"))
    no_final, billed = text("final_bill").isNull(), F.coalesce(F.col("n_bills") > 0, F.lit(False))
    past = F.coalesce(no_final & F.col("typed") & (overdue > OVERDUE_DAYS), F.lit(False))
    due = F.when(day("completion_due").isNotNull(), F.greatest(day("completion_due"), extended))
    versus = contract / estimate - 1
    over_contract = F.coalesce(ratio > OVER_CONTRACT, F.lit(False))
    same_tender = F.coalesce(text("award_tender") == text("estimate_tender"), F.lit(False))

    rules = [
        ("paid_over_contract", F.when(ratio > FAR_OVER_CONTRACT, "attention").otherwise("notice"), over_contract, confidence("contract_value", "payments_gross"), ratio),
        ("paid_over_estimate", "notice", ~over_contract & contract.isNull() & (paid > OVER_ESTIMATE * estimate), confidence("estimated_cost", "payments_gross"), paid / estimate),
        ("front_loaded_payment", "notice", (ratio >= FRONT_LOADED_SHARE) & day("first_payment").isNotNull() & (days(last, award) >= 0) & (days(last, award) < FRONT_LOADED_TIME * period), confidence("paid_vs_contract", "period_days"), days(last, award)),
        ("over_stipulated_period", "notice", (span > 0) & over_period, confidence("period_days"), span),
        ("long_running", "notice", ~over_period & (span > LONG_DAYS), sure, span),
        ("past_expected_completion", "notice", past, guess, overdue),
        ("no_bills_after_expected_completion", "info", ~past & ~billed & text("awarded_date").isNotNull() & (overdue > NO_BILL_DAYS), guess, overdue),
        ("stale_running", "notice", billed & no_final & (text("status") == RUNNING_ONLY) & (days(F.lit(today).cast("date"), F.coalesce(last, F.col("first_paid"))) > STALE_DAYS), guess, days(F.lit(today).cast("date"), F.coalesce(last, F.col("first_paid")))),
        ("recalled_tender", F.when(calls >= 5, "attention").when(calls >= 3, "notice").otherwise("info"), calls >= 2, confidence("tender_calls"), calls),
        ("single_bidder", "notice", number("bidders") == 1, confidence("bidders"), number("bidders")),
        ("award_above_estimate", "notice", same_tender & (versus > ABOVE_ESTIMATE), confidence("contract_value", "estimated_cost"), versus),
        ("deep_discount", "info", same_tender & (versus < DEEP_DISCOUNT), confidence("contract_value", "estimated_cost"), versus),
        ("paid_before_award", "notice", day("awarded_date").isNotNull() & (days(F.col("first_paid"), day("awarded_date")) < -EARLY_DAYS), confidence("awarded_date"), days(F.col("first_paid"), day("awarded_date"))),
        ("year_end_payment", "info", (F.col("dated") >= YEAR_END_LEAST) & (F.col("march") >= YEAR_END_SHARE * F.col("dated")), sure, F.col("march") / F.col("dated")),
        ("past_stipulated_completion", "notice", no_final & (days(F.lit(data_end).cast("date"), due) > OVERDUE_DAYS), confidence("completion_due"), days(F.lit(data_end).cast("date"), due)),
        ("fine_levied", "info", text("penalties_deductions").contains("fine"), sure, F.lit(None).cast("double")),
        ("placeholder_photos", "notice", text("placeholder_photos").isNotNull(), sure, number("placeholder_photos")),
        ("partial_release", "info", text("partial_release").isNotNull(), sure, number("partial_release")),
        ("slow_payment", "info", number("bill_to_payment_days") > SLOW_DAYS, sure, number("bill_to_payment_days")),
        ("payment_burst", "info", F.col("burst") >= BURST, sure, F.col("burst").cast("double")),
        ("bills_after_final", "notice", F.col("after_final") > 0, sure, F.col("after_final").cast("double")),
        ("large_deduction", "info", F.col("large").isNotNull(), sure, F.col("large")),
        ("late_payment", "info", (paid >= LATE_LEAST) & (F.col("latest") > LATE_DAYS), sure, F.col("latest").cast("double")),
    ]
    hits = [F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), sureness.alias("confidence"), measure.alias("measure"))) for code, severity, when, sureness, measure in rules]
    return exploded(rows, "project_id", hits)
