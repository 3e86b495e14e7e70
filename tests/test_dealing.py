from pyspark.sql import functions as F

from worksight import catalog
from worksight.sources import grid


def test_names_in_one_file_are_dealt_out(spark, tmp_path):
    n = 5_000 * (spark.sparkContext.defaultParallelism + 1)
    spark.range(n).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    out = catalog.QUERIES["text_forms"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == n // 5_000
    assert out.select("k").distinct().count() == n


def _plan(spark, tmp_path, query):
    spark.range(2).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit(1000.0).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    return catalog.QUERIES[query](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_category_is_found_once_a_row(spark, tmp_path):
    assert _plan(spark, tmp_path, "archived_programme_rows").count("rajyotsava") == 1


def test_grants_words_are_cleaned_once_a_row(spark, tmp_path):
    assert _plan(spark, tmp_path, "grant_list_rows").count(";@#:]") == 1


def test_partitions_of_pairs_grow_with_the_lines(spark, tmp_path):
    n = 250_000 * spark.sparkContext.defaultParallelism + 4
    spark.range(n).select(F.floor(F.col("id") / 4).alias("l_orderkey"), (F.col("id") % 4).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.QUERIES["co_bidding_pairs"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism + 1
    assert {tuple(x) for x in out.collect()} == {(a, b, n // 4) for a in range(4) for b in range(a + 1, 4)}


def test_partitions_of_curves_grow_with_the_lines(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    line = spark.range(250_000 * cores + 4).select(
        F.floor(F.col("id") / 4).alias("l_orderkey"), F.lit(1).cast("long").alias("l_suppkey"), (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"), F.lit(100.0).alias("l_extendedprice"), F.lit("1997-01-01").cast("timestamp").alias("l_shipdate")
    )
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.QUERIES["payment_curves"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == cores + 1
    assert out.count() == 250_000 * cores + 4


def test_tasks_of_planned_items_grow_with_the_jobs(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(5_000 * cores + 1).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    plan = catalog.QUERIES["planned_against_billed_items"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and all(f", {cores + 1})" in x for x in exchanges)


def test_a_grid_cell_is_read_once_for_all_its_references(spark):
    plan = grid.grid_rows(spark.createDataFrame([], grid.WINDOW))._jdf.queryExecution().analyzed().toString()
    assert plan.count(".brnumber") == 1


def test_exploded_finds_each_struct_once(spark):
    from pyspark.sql import functions as F

    from worksight.operators import facts as O
    from worksight.tables import exploded

    df = spark.createDataFrame([(1, 5), (2, None), (None, 7)], "k long, x long")
    one = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("name"), c.alias("value")))
    out = exploded(df, "k", [one("a", F.col("x")), one("b", F.col("x") + 1), one("c", F.col("k"))])
    assert sorted(out.collect(), key=str) == sorted([(1, "a", 5), (1, "b", 6), (1, "c", 1), (2, "c", 2), (None, "a", 7), (None, "b", 8)], key=str)
    plan = exploded(df.repartition(2), "k", [one("a", F.col("x"))])._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(__each" in plan and "filter(" not in plan and "lambda" not in plan  # explode(array(...)) and array_compact interpret what they are given
    works = spark.createDataFrame([(1, "Road", [], [], "j")], "work long, title string, locations array<string>, wards array<string>, job_number string")
    bills = spark.createDataFrame([], "work long, contractor string, gross double, nett double, dedupe_key string, payment_date date, br_date date, wo_date date, wo_no string, start_date date, end_date date, bill_type string, source_id string, source_row int")
    links = spark.createDataFrame([], "work long, base string, source string, exact boolean, score double, via string, tender_number string, call int, published_date date, status string, status_text string, ecv double, provisional_amount double, period_days int, period_text string, contractor string, contract_value double, negotiated_value double, awarded_date date, bidders array<struct<name string>>")
    every = O.base_facts(works, bills, links).collect()
    assert sorted(O.base_facts(works, bills, links, fields=("payments_gross", "description", "n_bills")).collect(), key=str) == sorted((r for r in every if r.field in ("payments_gross", "description")), key=str)
    assert len(every) > 2


def test_signals_of_facts_in_rows_and_in_a_map(spark):
    from worksight.operators import signals as S

    told = {"paid_vs_contract": "1.7", "payments_gross": "17", "contract_value": "10", "work_order_date": "2020-01-01", "last_payment": "2024-01-01"}
    facts = spark.createDataFrame([(1, k, v, "confirmed") for k, v in told.items()], "project_id long, field string, value string, confidence string")
    days = ["2020-05-01"] * 3 + ["2020-07-01", "2020-08-01", None]
    bills = spark.createDataFrame([(k, "Final bill" if x == "2020-07-01" else "Running bill", x, x, None, 2.0, 1.0) for k in (1, 2) for x in days], "project_id long, bill_type string, br_date string, payment_date string, end_date string, gross double, deduction double")
    bills = bills.selectExpr("project_id", "bill_type", "date(br_date) br_date", "date(payment_date) payment_date", "date(end_date) end_date", "cast(gross as decimal(18,2)) gross", "deduction")
    by_rows, by_map = (S.project_signals(f, bills, "2026-10-05", "2026-03-31") for f in (facts, S.facts_map(facts)))
    got = {(r.project_id, r.code): r.measure for r in by_rows.collect()}
    assert got == {(r.project_id, r.code): r.measure for r in by_map.collect()}
    assert got[1, "payment_burst"] == got[2, "payment_burst"] == 3 and got[1, "bills_after_final"] == 1 and got[1, "paid_over_contract"] == 1.7 and (1, "long_running") in got
    assert S.bill_sums(bills)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # a work's bills are read once


def test_bills_of_both_builds_are_grouped_once(spark):
    from worksight.operators import changes as C

    P, B, S = "slug string, title string, status string, payments_gross double", "slug string, job_number string, bill_type string, gross double, br_no string, br_date string, payment_date string, contractor string", "slug string, code string"
    bill = lambda job, paid, gross=5.0: ("w", job, "bill", gross, "1", "2020-01-01", paid, None)
    side = lambda rows: {"projects": spark.createDataFrame([], P), "bills": spark.createDataFrame(rows, B), "signals": spark.createDataFrame([], S), "finals": spark.createDataFrame([], "slug string, value string")}
    old = side([bill("a", None), bill(None, None), bill("b", "2020-02-01"), bill("gone", None)])
    new = side([bill("a", "2020-03-01"), bill("a", None), bill(None, "2020-04-01", 5.2), bill("b", "2020-02-01"), bill("c", None), bill("c", "2020-05-01")])
    found = C.changes(old, new)
    assert sorted((r.kind, r.now, r.amount) for r in found.collect()) == [("new_bill", "2020-05-01", 5.0), ("newly_paid", "2020-03-01", 5.0), ("newly_paid", "2020-04-01", 5.2)]
    plan = C.changes({k: v.repartition(2) for k, v in old.items()}, {k: v.repartition(2) for k, v in new.items()})._jdf.queryExecution().optimizedPlan().toString()
    assert "job_number" in plan and not any("Join" in x and "bill" in x for x in plan.splitlines())
