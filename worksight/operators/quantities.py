"""Planned against billed: the items of jobs' schedules with what their bills and measurement sheets say was executed.

Of each job the priced rows of its planning documents are the plan (a schedule's rows if there are any, else an estimate's), the priced rows
of its bills are assigned to planned items, and items take up the rows bill by bill. A bill whose abstract is worth about its gross is read; one that is
worth about all bills so far is cumulative, and takes the place of those before it. Sums are only called complete if every paid bill was read.

Everything is by job: windows order a job's bills, a job's billed rows meet its planned items in a join, and an item's rows, which are as many as
its bills have, are folded in their order. Rows and bills of unknown jobs and null numbers are kept but match nothing. Repeated rows (code,
quantity and rate, rounded) count once a job and side; ties go to the earlier row. Empty tables give empty results; other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.functions import amounts as A
from worksight.operators import documents as D
from worksight.tables import spread

SCHEDULE, SUPPLEMENT = "Schedule B", "Supplementary Schedule B"
#: Shares of a bill's gross that its abstract may have, how near two quantities of one row are, and names of what is compared.
COVERED, SAME_ROW = (0.6, 1.35), 0.005
MEASURED, UP_TO_DATE, SUMMED = "MB measurement total", "bill form total up to date", "bill abstracts (sum of read bills)"
BASES = {SCHEDULE: "Schedule B (contract BOQ)"}


@dataclass
class Analysis:
    #: A row for each planned item: plan, billed, measured and compared quantities, the bills behind them, variance.
    items: DataFrame
    #: A row for each job: values and what is complete.
    jobs: DataFrame
    #: A row for each bill: abstract's value, coverage and scope.
    bills: DataFrame
    #: Billed rows that no planned item fits.
    unplanned: DataFrame


def _once(rows: DataFrame) -> DataFrame:
    """Rows of a job with the same code, quantity and rate: the first of them."""
    key = F.struct(F.coalesce("code", F.lit("")), F.round("quantity", 2), F.round("rate", 2))
    others = [c for c in rows.columns if c != "job"]
    return rows.groupBy("job", key.alias("__key")).agg(F.min_by(F.struct(*others), "position").alias("x")).select("job", "x.*")


def planned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planned items of jobs, numbered in order; and by job how many supplementary rows there are.

    rows: job, position, type, code, unit, quantity, rate, amount, description.
    """
    rows = _once(rows).withColumn("supplement", F.col("type") == SUPPLEMENT)
    job = Window.partitionBy("job")
    main = rows.filter("NOT supplement").withColumn("scheduled", F.max((F.col("type") == SCHEDULE).cast("int")).over(job))
    main = main.filter((F.col("scheduled") == 0) | (F.col("type") == SCHEDULE)).withColumn("item", F.row_number().over(job.orderBy("position")))
    return main.drop("scheduled", "supplement"), rows.filter("supplement").groupBy("job").agg(F.count("*").alias("supplementary_items"))


def read_bills(bills: DataFrame, rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """bills with n (their order in the job), abstract_value, coverage, scope ("this bill", "cumulative" or NULL), and counted: whether rows of it count.

    bills: job, bill, bill_type, gross, date, paid. rows: job, bill, amount. Bills before the last cumulative one are part of it.
    """
    order = Window.partitionBy("job").orderBy(F.asc_nulls_last("date"), "bill")
    value = rows.groupBy("job", "bill").agg(F.sum("amount").alias("value"))
    gross = F.coalesce("gross", F.lit(0.0))
    x = spread(spread(bills, tasks, "job", "bill").join(spread(value, tasks, "job", "bill"), ["job", "bill"], "left"), tasks, "job").withColumns({"n": F.row_number().over(order), "so_far": F.sum(gross).over(order)})
    share, of_all = F.try_divide("value", gross), F.try_divide("value", "so_far")
    known = (F.col("value") != 0) & (gross != 0)
    scope = F.when(known & share.between(*COVERED), "this bill").when(known & (F.col("so_far") > gross) & of_all.between(*COVERED), "cumulative")
    x = x.withColumns({"abstract_value": F.when(F.col("value") != 0, F.round("value", 2)), "coverage": F.when(known, F.round(share, 3)), "scope": scope, "final": F.coalesce(F.contains(F.lower("bill_type"), F.lit("final")), F.lit(False))})
    last = F.max(F.when(F.col("scope") == "cumulative", F.col("n"))).over(Window.partitionBy("job"))
    return x.withColumn("last_cumulative", last).withColumn("counted", F.col("last_cumulative").isNull() | (F.col("n") >= F.col("last_cumulative"))).drop("value", "so_far")


def _taken(rows: Column) -> Column:
    """Folds an item's billed rows, in order: a row whose quantity another bill has already is a repeat; the rest are added up."""
    kind = "struct<billed: double, amount: double, rate: double, to_date: double, bills: array<struct<bill: string, quantity: double, match: string, swapped: boolean>>, repeated: array<struct<bill: string, quantity: double>>>"
    start = F.expr(f"CAST(NULL AS {kind})")
    empty = F.struct(F.lit(None).cast("double").alias("billed"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("double").alias("to_date"), F.array().cast("array<struct<bill: string, quantity: double, match: string, swapped: boolean>>").alias("bills"), F.array().cast("array<struct<bill: string, quantity: double>>").alias("repeated"))

    def step(held: Column, r: Column) -> Column:
        held = F.coalesce(held, empty)
        again = F.exists(held["bills"], lambda b: (b["bill"] != r["bill"]) & (F.abs(b["quantity"] - r["quantity"]) <= SAME_ROW * F.greatest(r["quantity"], F.lit(1e-9))))
        own = F.struct(r["bill"].alias("bill"), r["quantity"].alias("quantity"), r["match"].alias("match"), r["swapped"].alias("swapped"))
        more = F.struct(
            F.round(F.coalesce(held["billed"], F.lit(0.0)) + r["quantity"], 3).alias("billed"), F.round(F.coalesce(held["amount"], F.lit(0.0)) + r["amount"], 2).alias("amount"), r["rate"].alias("rate"),
            F.coalesce(F.round(r["to_date"], 3), held["to_date"]).alias("to_date"), F.concat(held["bills"], F.array(own)).alias("bills"), held["repeated"].alias("repeated"),
        )
        seen = held.withField("repeated", F.concat(held["repeated"], F.array(F.struct(r["bill"].alias("bill"), r["quantity"].alias("quantity")))))
        return F.when(again, seen).otherwise(more).cast(kind)

    return F.aggregate(rows, start, step)


def planned_against_billed(plan_rows: DataFrame, bills: DataFrame, bill_rows: DataFrame, totals: DataFrame, tasks: int | None = None) -> Analysis:
    """The analysis of all jobs that have bills or a plan.

    tasks: over how many its joins are dealt, for rows that come dealt by job over as many, which groups and windows of a job then use;
    without it they are as many as the session says, whatever the size of the input.

    plan_rows: see planned(). bills: see read_bills(). bill_rows: job, bill, position, code, unit, quantity, rate, amount, description,
    to_date_quantity. totals: job, code, unit, total, of measurement sheets.
    """
    plan, supplements = planned(plan_rows)
    rows = _once(bill_rows)
    read = read_bills(bills, rows, tasks)
    of_bill, of_row, of_item = (lambda df, c=c: spread(df, tasks, "job", c) for c in ("bill", "row", "item"))
    order = read.select("job", "bill", "n", "counted", F.col("final").alias("final_bill"))
    used = of_bill(rows).join(of_bill(order), ["job", "bill"]).filter("counted").withColumn("row", F.struct("n", "position"))
    found = D.match_items(plan.select("job", "item", "code", "unit", "rate", "description"), used.select("job", "row", "code", "unit", "quantity", "rate", "description"), tasks)
    found = found.select("job", "row", "item", "match", "swapped", F.col("quantity").alias("own_quantity"), F.col("rate").alias("own_rate"))
    joined = of_row(used).join(of_row(found), ["job", "row"], "left")
    joined = of_item(joined).join(of_item(plan.select("job", "item", F.col("unit").alias("plan_unit"))), ["job", "item"], "left")
    in_plan = lambda q: F.when(F.col("unit").isNotNull() & F.col("plan_unit").isNotNull(), A.convert(q, F.col("unit"), F.col("plan_unit"))).otherwise(q)
    joined = joined.withColumns({"q": in_plan(F.col("own_quantity")), "to_date": in_plan(F.col("to_date_quantity"))})
    none = F.col("item").isNull() | F.col("q").isNull()
    unplanned = joined.filter(none).select("job", "bill", "position", "code", "unit", "quantity", "rate", "amount", "description", D.item_category(F.col("description")).alias("category"))
    taken = joined.filter(~none).groupBy("job", "item").agg(F.array_sort(F.collect_list(F.struct("row", "bill", F.col("q").alias("quantity"), F.col("own_rate").alias("rate"), "amount", "to_date", "match", "swapped"))).alias("rows"))
    taken = taken.select("job", "item", _taken(F.col("rows")).alias("t"))
    taken = taken.select("job", "item", "t.billed", F.col("t.amount").alias("billed_amount"), F.col("t.rate").alias("billed_rate"), "t.to_date", "t.bills", "t.repeated")

    sheets = totals.filter("total IS NOT NULL AND code IS NOT NULL").select("job", "code", F.col("unit").alias("sheet_unit"), "total")
    measured = plan.select("job", "item", "code", F.col("unit").alias("plan_unit"))
    measured = spread(measured, tasks, "job", "code").join(spread(sheets, tasks, "job", "code"), ["job", "code"])
    total = F.when(F.col("sheet_unit").isNotNull() & F.col("plan_unit").isNotNull(), A.convert(F.col("total"), F.col("sheet_unit"), F.col("plan_unit"))).otherwise(F.col("total"))
    measured = of_item(measured).groupBy("job", "item").agg(F.round(F.max(total), 3).alias("measured_quantity"))

    x = of_item(plan).join(taken, ["job", "item"], "left").join(measured, ["job", "item"], "left")
    dated = F.col("to_date").isNotNull() & (F.col("billed").isNull() | (F.col("to_date") >= F.col("billed") - 0.01))
    x = x.withColumns({"billed_quantity": F.when(dated, F.col("to_date")).otherwise(F.col("billed")), "last_bill": F.try_element_at("bills", F.lit(-1))["bill"]})
    got = F.coalesce("measured_quantity", "billed_quantity")
    basis = F.when(F.col("measured_quantity").isNotNull(), MEASURED).when(dated, UP_TO_DATE).when(got.isNotNull(), SUMMED)
    finals = order.select("job", F.col("bill").alias("last_bill"), "final_bill")
    x = spread(x, tasks, "job", "last_bill").join(spread(finals, tasks, "job", "last_bill"), ["job", "last_bill"], "left")
    gap = F.when(F.col("quantity") != 0, F.round((got - F.col("quantity")) / F.col("quantity") * 100, 1))
    items = x.select(
        "job", "item", "description", D.item_category(F.col("description")).alias("category"), "code", "unit", F.col("quantity").alias("estimated_quantity"), F.col("rate").alias("estimated_rate"),
        F.col("amount").alias("estimated_amount"), F.col("type").alias("plan_basis"), "billed_quantity", "billed_amount", "billed_rate", "measured_quantity", "bills", "repeated",
        got.alias("compared_quantity"), basis.alias("compared_basis"), F.when(F.col("measured_quantity").isNull(), F.coalesce("final_bill", F.lit(False))).alias("from_final_bill"), gap.alias("variance_pct"),
    )

    per_plan = plan.groupBy("job").agg(F.min("type").alias("type"), F.count("*").alias("plan_items"), F.round(F.sum("amount"), 2).alias("plan_value"))
    paid = F.coalesce("paid", F.lit(False))
    used_value = F.when((F.col("n") == F.col("last_cumulative")) | (paid & (F.col("scope") == "this bill") & (F.col("last_cumulative").isNull() | (F.col("n") > F.col("last_cumulative")))), F.coalesce("abstract_value", F.lit(0.0))).otherwise(0.0)
    per_bill = read.groupBy("job").agg(
        F.coalesce(F.bool_and(F.when(paid, F.col("scope").isNotNull())), F.lit(False)).alias("all_read"), F.bool_or(paid & F.col("final")).alias("has_final"),
        F.round(F.sum(F.when(paid, F.coalesce("gross", F.lit(0.0))).otherwise(0.0)), 2).alias("paid_gross"), F.round(F.sum(used_value), 2).alias("billed_value_read"),
    )
    jobs = per_plan.join(per_bill, "job", "full").join(supplements, "job", "full")
    basis_of = F.when(F.col("type") == SCHEDULE, BASES[SCHEDULE]).when(F.col("type").isNotNull(), "Estimate")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    jobs = jobs.select("job", basis_of.alias("plan_basis"), zero("plan_items"), zero("supplementary_items"), F.coalesce("plan_value", F.lit(0.0)).alias("plan_value"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("all_read", "has_final")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("paid_gross", "billed_value_read")))
    return Analysis(items, jobs, read, unplanned)


def signal_inputs(found: Analysis, works: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, items and unplanned rows as dataset_signals.quantity_signals takes them. works: job, contract, paid, n_variations, n_bill_documents, readable."""
    scopes = found.bills.filter("scope IS NOT NULL").groupBy("job").agg(F.collect_set("bill").alias("scoped"))
    items = found.items.join(scopes, "job", "left")
    matches = F.transform(F.coalesce("bills", F.array().cast("array<struct<bill: string, quantity: double, match: string, swapped: boolean>>")), lambda b: F.struct(b["match"].alias("match"), F.coalesce(F.array_contains("scoped", b["bill"]), F.lit(False)).alias("scoped")))
    items = items.select("job", "estimated_quantity", "estimated_amount", "compared_quantity", "compared_basis", matches.alias("matches"))
    jobs = found.jobs.select("job", "plan_value", "plan_basis", "has_final", "all_read", F.col("supplementary_items").alias("n_supplementary")).join(works, "job")
    return jobs, items, found.unplanned.select("job", "amount")
