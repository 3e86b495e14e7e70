"""Names, dates and registers in the forms that sources have, rendered from the driver's tables, and rules of read quantities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from worksight.functions import dates as D
from worksight.functions import parsing as P
from worksight.functions import text as T
from worksight.operators import dataset_signals as S
from worksight.operators import entities as E
from worksight.operators import issues as I
from worksight.operators import scope
from worksight.operators.facts import base_facts
from worksight.registry import Registry
from worksight.sources import plans as L
from worksight.sources import registers as G
from worksight.storage import shared_folder
from worksight.tables import dealt, table

R = Registry()
AREA = scope.Area("Greenfield", "greenfield", r"green\s*field", {"198": ["151"], "243": ["186"]})


@R.query(
    """WITH x AS (SELECT c_custkey AS k, c_name AS n, c_custkey % 20 + 1 AS a, c_custkey % 7 AS b FROM customer)
SELECT k, lower(replace(n, '#', ' ')) || ' builders' AS name, 'improvements-of-' || lower(replace(n, '#', '-')) || '-road' AS slug, n || ' Sons' AS payee, CASE WHEN b > 0 THEN '00000' || b END AS code,
  'GF/2021/' || k AS base, CASE WHEN b > 0 THEN b ELSE 1 END::INT AS call, array_to_string(list_sort(list_distinct(['block' || a, 'main' || (b + 2) || 'c', 'cross' || a])), ',') AS places, 'ravi ' || k AS person, CASE WHEN b > 3 THEN 'green ' || k || ' works' END AS firm FROM x"""
)
def text_forms(spark, d):
    """Names of payees, persons and firms, tenders' numbers, places and addresses, out of the text around them."""
    k, n = F.col("c_custkey"), F.col("c_name")
    a, b = k % 20 + 1, k % 7
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    display = F.when(b > 3, c("Mr. Ravi ", k, "( M/s Green ", k, " Works Pvt Ltd )")).otherwise(c("Sri Ravi ", k, " (", b, ")"))
    customers = table(spark, d, "customer")
    customers = dealt(customers.select("c_custkey", "c_name"), customers.count(), 5_000, "c_custkey")  # a name takes long to read, and many fit in one file
    x = customers.select(k.alias("k"), c("M/s. Sri ", n, " & Builders Co. Ltd (", b, ")").alias("firm"), c("  Improvements of: ", n, "--road!").alias("title"), c("00000", b, " ", n, "  Sons 9876543210").alias("payee"), c("GF/2021/", k, F.when(b > 0, c("/CALL-", b)).otherwise("")).alias("tender"), c("Work at ", a, "th Block, ", b + 2, "th C Main and ", a, "th cross").alias("place"), display.alias("display"))
    both = T.person_and_firm(F.col("display"))
    return x.select("k", T.norm_name(F.col("firm")).alias("name"), P.slugify(F.col("title")).alias("slug"), P.contractor(F.col("payee")).alias("payee"), P.contractor_code(F.col("payee")).alias("code"), T.base_tender(F.col("tender")).alias("base"), T.call_number(F.col("tender")).alias("call"), F.array_join(T.place_keys(F.col("place")), ",").alias("places"), both["person"].alias("person"), both["firm"].alias("firm"))


@R.query(
    """WITH x AS (SELECT o_orderkey AS k, (o_orderdate + INTERVAL 20 YEAR)::DATE AS d, o_custkey % 500 AS n FROM orders)
SELECT k, d::VARCHAR AS record, CASE WHEN k % 3 < 2 THEN d::VARCHAR ELSE '' END AS collected, d::VARCHAR AS iso, (d + n::INT)::VARCHAR AS later, floor(n / 30.0)::INT AS months, (year(d) - CASE WHEN month(d) >= 4 THEN 0 ELSE 1 END)::INT AS fiscal, d::VARCHAR AS epoch,
  (n * 0 + date_diff('month', date_trunc('month', d), date_trunc('month', d + n::INT)) // 3 + 1)::INT AS n_quarters, CASE WHEN n % 40 BETWEEN 7 AND 1460 THEN (n % 40)::INT END AS period FROM x"""
)
def date_forms(spark, d):
    """Dates as records, collectors and portals give them, and spans of days, quarters and periods of completion."""
    k, day, n = F.col("o_orderkey"), F.add_months(F.to_date("o_orderdate"), 240), (F.col("o_custkey") % 500).cast("int")
    shown = lambda f: F.date_format(day, f)
    record = F.concat(F.when(k % 4 == 0, shown("yyyy-MM-dd")).when(k % 4 == 1, shown("dd-MMM-yyyy")).when(k % 4 == 2, shown("d-M-yyyy")).otherwise(shown("d/M/yyyy")), F.lit("<br/> 18:09:53"))
    collected = F.when(k % 3 == 0, shown("yyyy-MM-dd")).when(k % 3 == 1, shown("dd-MMM-yyyy")).otherwise("soon")
    text = F.format_string("Bid validity 90 days. Period of  completion for the work: %d (some) calendar days. Defects liability 400 days", n % 40)
    later = D.add_days(day, n)
    return table(spark, d, "orders").select(
        k.alias("k"), D.record_date(record).cast("string").alias("record"), D.collector_date(collected).alias("collected"), D.iso_date(F.concat(shown("yyyy-MM-dd"), F.lit("T10:00"))).cast("string").alias("iso"), later.cast("string").alias("later"), D.whole_units(later, day, 30).alias("months"),
        P.fiscal_year(day).alias("fiscal"), P.epoch_ms_date((F.unix_date(day).cast("long") * 86_400_000).cast("string")).cast("string").alias("epoch"), F.size(D.quarters(day, later)).alias("n_quarters"), D.completion_period(text)["days"].alias("period"),
    )


@R.query(
    """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 6 AS g, printf('151-%02d-%06d', o_orderkey % 30, o_orderkey) AS job, (o_orderdate + INTERVAL 20 YEAR)::DATE AS d, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS amount FROM orders)
SELECT ['public_view', 'work_details', 'department', 'bill_register', 'job_codes', 'scheme_payments'][g + 1] AS kind, job AS job_number, CASE WHEN g <> 4 THEN 'Work, "' || k || '"' END AS description, amount, CASE WHEN g IN (0, 1, 5) THEN d::VARCHAR END AS br_date,
  CASE WHEN g IN (1, 3) THEN d::VARCHAR END AS payment_date, CASE WHEN g IN (1, 3) THEN 'Paid (RTGS)' END AS payment_status FROM x"""
)
def register_rows(spark, d):
    """Bills of five kinds of register and estimates of a sixth, written as CSV and read again by kind."""
    k = F.col("o_orderkey")
    day, amount, text = F.add_months(F.to_date("o_orderdate"), 240), F.col("o_totalprice").cast("decimal(18,2)"), F.concat(F.lit('Work, "'), k, F.lit('"'))
    named, job = F.date_format(day, "dd-MMM-yyyy"), F.format_string("151-%02d-%06d", k % 30, k)
    lakh = F.format_string("%.7f", amount.cast("double") / 100_000)
    shapes = {
        "public_view": {"Ward": F.lit("151, K"), "Job Number": job, "Name of Work": text, "BR Date": named, "Gross": F.format_number(amount, 2)},
        "work_details": {"ID": k, "WODetails": F.concat(job, F.lit("</a> "), text), "BRNumber": F.concat(F.lit("BR-"), k, F.lit("/"), named, F.lit(" Rtgs-9/"), named), "Amount": amount},
        "department": {"Job Number": job, "Work Order Details": text, "Ward": F.lit("151"), "Contractor": F.lit("A B"), "Work Order Number": k, "Work Order Date": named, "Total Amount in Rs": amount, "Deduction in Rs": F.lit("0"), "Net Payment in Rs": amount},
        "bill_register": {"Job_Code": job, "Job_Description": text, "RTGS_No": k, "RTGS_Date": F.date_format(day, "dd/MM/yyyy"), "Gross_ Amount In Lakhs": lakh},
        "job_codes": {"Job_Code": job, "Amount in Rs.": amount, "Date": named},
        "scheme_payments": {"Job Code": job, "Name of work": text, "BR": F.concat(k, F.lit("/"), F.date_format(day, "dd-MMM-"), F.lit("\n"), F.date_format(day, "yyyy")), "RTGS": F.lit(""), "Gross": amount},
    }
    at, orders, paths = f"{shared_folder(spark)}/registers-{uuid.uuid4().hex}", table(spark, d, "orders"), {}
    for g, (kind, shape) in enumerate(shapes.items()):
        paths[kind] = f"{at}/{kind}"
        orders.filter(k % 6 == g).select(*(c.cast("string").alias(name) for name, c in shape.items())).write.option("header", True).option("escape", '"').csv(paths[kind])
    bills, estimates = G.load_registers(spark, paths)
    text = lambda c: F.col(c).cast("string").alias(c)
    none = F.lit(None).cast("string")
    out = bills.select("kind", "job_number", "description", F.col("gross").cast("double").alias("amount"), text("br_date"), text("payment_date"), "payment_status")
    return out.unionByName(estimates.select(F.lit("job_codes").alias("kind"), "job_number", none.alias("description"), F.col("estimate").cast("double").alias("amount"), none.alias("br_date"), none.alias("payment_date"), none.alias("payment_status")))


def _files(spark, texts, kind):
    none = F.lit(None)
    return texts.select("file").distinct().select("file", F.lit(kind).alias("kind"), none.cast("string").alias("title"), none.cast("string").alias("url"), none.cast("date").alias("published_date"), none.cast("string").alias("fy"), F.lit(True).alias("ocr"))


@R.query(
    """SELECT 's' || o_orderkey % 40 AS file, o_orderkey::INT AS row, printf('151-%02d-%06d', o_orderkey % 30, o_orderkey) AS job_number, 'Improvements to road and drain ' || o_orderkey AS description, round(o_totalprice, 2) AS ecv, 'EE South' AS office, 'P' || o_custkey || ' / Roads' AS budget_head, '20' || (10 + o_orderkey % 40) || '-' || (11 + o_orderkey % 40) AS fy FROM orders"""
)
def sanction_list_rows(spark, d):
    """Ward lists of sanctioned works: entries over five lines, with the year in a heading of each list."""
    k = F.col("o_orderkey")
    text = F.concat(F.format_string("%d South Hill Side Greenfield\n151-%02d-%06d\nImprovements to road\n  and drain %d\n", k, k % 30, k, k), F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit("")), F.format_string(" / EE South / P%d / Roads", F.col("o_custkey")))
    texts = table(spark, d, "orders").select(F.concat(F.lit("s"), k % 40).alias("file"), (k + 1).cast("int").alias("page"), text.alias("text"))
    number = F.substring("file", 2, 9).cast("int")
    texts = texts.unionByName(texts.select("file").distinct().select("file", F.lit(0).alias("page"), F.format_string("LIST FIN YEAR %d-%d", 10 + number, 11 + number).alias("text")))
    rows = L.plan_rows(_files(spark, texts, "sanction"), texts, L.Place(AREA, constituency="Hill Side"))
    return rows.select("file", "row", "job_number", "description", "ecv", "office", "budget_head", "fy")


@R.query(
    """SELECT 'g' || o_orderkey % 30 AS file, (o_orderkey % 900 + 1)::INT AS row, 'Construction of drain ' || o_orderkey || ' beside the road near school ' || o_orderkey AS description, CASE WHEN o_orderkey % 2 = 0 THEN '151' ELSE '148' END AS ward, round((o_custkey % 90 + 10.25) * 1e5, 2) AS ecv FROM orders WHERE o_orderkey % 2 = 0"""
)
def grant_list_rows(spark, d):
    """Grant lists: one line in three has number, ward and amount, and its neighbours the rest of the words; only the area's ward counts."""
    k = F.col("o_orderkey")
    text = F.format_string("Construction of drain %d\n| %d %s beside the road %d,25 x\nnear school %d", k, k % 900 + 1, F.when(k % 2 == 0, "151").otherwise("148"), F.col("o_custkey") % 90 + 10, k)
    texts = table(spark, d, "orders").select(F.concat(F.lit("g"), k % 30).alias("file"), k.cast("int").alias("page"), text.alias("text"))
    rows = L.plan_rows(_files(spark, texts, "grant"), texts, L.Place(AREA, wards=("14[78]", "151")))
    return rows.select("file", "row", "description", "ward", "ecv")


@R.query(
    """WITH i AS (SELECT o_custkey AS job, o_orderkey AS k, 100e0 AS plan, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 60e0 + o_orderkey % 90 END AS got, CASE WHEN o_orderkey % 11 = 0 THEN 5e4 ELSE 2e5 END AS amount, CASE o_orderkey % 3 WHEN 0 THEN 'MB measurement total' WHEN 1 THEN 'bill form total up to date' ELSE 'bill abstract' END AS basis,
  o_orderkey % 5 > 0 AS exact, o_orderkey % 4 > 0 AS scoped FROM orders),
j AS (SELECT c_custkey AS job, c_custkey % 2 = 0 AS complete, c_custkey % 3 = 0 AS varied FROM customer),
x AS (SELECT *, got IS NOT NULL AND amount >= 1e5 AS large, basis LIKE 'MB%' AS mb FROM i JOIN j USING (job)),
n AS (SELECT job, count(*) FILTER (large AND got / plan < 0.75 AND (mb OR complete)) AS below, count(*) FILTER (large AND got / plan > 1.25 AND (mb OR basis LIKE 'bill form%' OR scoped) AND (mb OR exact)) AS above,
  count(*) FILTER (large AND got / plan > 1.25 AND (mb OR basis LIKE 'bill form%' OR scoped) AND (mb OR exact) AND NOT varied) AS unvaried, count(*) FILTER (got IS NOT NULL AND exact AND abs(got - plan) <= 0.0005 * plan + 0.011) AS same, count(*) FILTER (complete AND got IS NULL AND amount >= 1e5) AS missing FROM x GROUP BY job)
SELECT job::VARCHAR AS work, code, CASE WHEN code = 'qty_identical_to_plan' THEN 'info' ELSE 'notice' END AS severity, n::DOUBLE AS measure FROM (SELECT job, 'qty_measured_below_plan' AS code, below AS n FROM n UNION ALL SELECT job, 'qty_billed_above_plan', above FROM n UNION ALL SELECT job, 'qty_above_plan_no_variation', unvaried FROM n
  UNION ALL SELECT job, 'qty_identical_to_plan', CASE WHEN same >= 3 THEN same ELSE 0 END FROM n UNION ALL SELECT job, 'qty_major_item_not_billed', missing FROM n) WHERE n > 0
UNION ALL SELECT job::VARCHAR, 'qty_billed_item_not_in_plan', 'notice', count(*)::DOUBLE FROM i JOIN customer ON c_custkey = job WHERE k % 6 = 0 AND c_custkey % 4 > 0 GROUP BY job
UNION ALL SELECT c_custkey::VARCHAR, 'qty_unreadable_mb', 'info', 2e0 FROM customer WHERE c_custkey % 5 = 0"""
)
def quantity_signal_rules(spark, d):
    """The seven signals of read quantities; customers are jobs, their orders the items."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    jobs = table(spark, d, "customer").select(
        c.alias("job"), F.lit(1e6).alias("plan_value"), F.when(c % 4 > 0, S.SCHEDULE_B).otherwise("Estimate").alias("plan_basis"), F.lit(1e6).alias("contract"), F.when(c % 5 == 0, 2e7).otherwise(1e6).alias("paid"), (c % 2 == 0).alias("has_final"), F.lit(True).alias("all_read"),
        F.when(c % 3 == 0, 1).otherwise(0).alias("n_variations"), F.lit(0).alias("n_supplementary"), F.lit(2).alias("n_bill_documents"), F.lit(False).alias("readable"),
    )
    basis = F.when(k % 3 == 0, S.MB_TOTAL).when(k % 3 == 1, "bill form total up to date").otherwise("bill abstract")
    match = F.struct(F.when(k % 5 > 0, "code").otherwise("description").alias("match"), (k % 4 > 0).alias("scoped"))
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.lit(100.0).alias("estimated_quantity"), F.when(k % 11 == 0, 5e4).otherwise(2e5).alias("estimated_amount"), F.when(k % 7 > 0, 60.0 + k % 90).alias("compared_quantity"), basis.alias("compared_basis"), F.array(match).alias("matches"))
    extras = table(spark, d, "orders").filter(k % 6 == 0).select(F.col("o_custkey").alias("job"), F.lit(2e5).alias("amount"))
    return S.quantity_signals(jobs, items, extras).select("work", "code", "severity", "measure")


@R.query(
    """WITH m AS (SELECT DISTINCT o_orderkey % 60 AS n, CASE WHEN o_orderkey // 60 % 2 = 0 THEN 'M/s ' ELSE '' END || 'Firm' || chr((65 + o_orderkey % 60 % 26)::INT) || o_orderkey % 60 AS name FROM orders)
SELECT name, min(name) OVER (PARTITION BY CASE WHEN n % 4 = 0 THEN 'c' || n % 10 ELSE 'n' || n END) AS first_name FROM m"""
)
def payee_entities(spark, d):
    """Payees as one by a register's code or by a name that is the same without its title; names of a fourth of all orders have codes that chain them."""
    k = F.col("o_orderkey")
    n = k % 60
    name = F.concat(F.when(F.floor(k / 60) % 2 == 0, "M/s ").otherwise(""), F.lit("Firm"), F.char(65 + n % 26), n.cast("string"))
    bills = table(spark, d, "orders").select(name.alias("contractor"), F.when(k % 4 == 0, F.format_string("%06d", k % 50 + 1)).alias("contractor_code"), F.lit(None).cast("string").alias("phone"))
    tenders = spark.createDataFrame([], "contractor string, supplier_id string, bidders array<struct<name string>>")  # the portal's side is held by tests
    mentions = E.resolve(bills, tenders)[1]
    first = mentions.groupBy("entity").agg(F.min("name").alias("first_name"))
    return mentions.join(first, "entity").select("name", "first_name")


@R.query(
    """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'inferred' END AS sure, (o_orderdate + INTERVAL 20 YEAR)::DATE AS d, round(o_totalprice) AS v, o_custkey % 400 AS n, o_orderstatus = 'F' AS won FROM orders)
SELECT k AS work, 'estimated_cost' AS field, (v + 5e0)::VARCHAR AS value, sure AS confidence FROM x UNION ALL SELECT k, 'tender_published', d::VARCHAR, sure FROM x UNION ALL SELECT k, 'tender_calls', CASE WHEN n % 3 = 0 THEN '2' ELSE '1' END, sure FROM x
UNION ALL SELECT k, 'period_days', CASE WHEN n > 0 THEN n::VARCHAR END, CASE WHEN n > 0 THEN sure ELSE 'unknown' END FROM x UNION ALL SELECT k, 'contractor', CASE WHEN won THEN 'Firm ' || n END, CASE WHEN won THEN sure ELSE 'unknown' END FROM x
UNION ALL SELECT k, 'contract_value', CASE WHEN won THEN v::DOUBLE::VARCHAR END, CASE WHEN won THEN sure ELSE 'unknown' END FROM x UNION ALL SELECT k, 'awarded_date', (d + 60)::VARCHAR, sure FROM x WHERE won UNION ALL SELECT k, 'bidders', (n % 4)::VARCHAR, sure FROM x WHERE n % 4 > 0
UNION ALL SELECT k, 'status', CASE WHEN won THEN 'Tender awarded' ELSE 'Tender under evaluation' END, sure FROM x UNION ALL SELECT k, 'expected_completion', CASE WHEN won AND n > 0 THEN (d + 60 + n::INT)::VARCHAR END, CASE WHEN won AND n > 0 THEN 'inferred' ELSE 'unknown' END FROM x"""
)
def facts_of_tenders(spark, d):
    """Facts of works from the tenders that were linked to them, exact or guessed, over one or two calls."""
    orders, n, none = table(spark, d, "orders"), F.col("o_custkey") % 400, F.lit(None)
    day, won = F.add_months(F.to_date("o_orderdate"), 240), F.col("o_orderstatus") == "F"
    lists = F.array().cast("array<string>")
    works = orders.select(F.col("o_orderkey").alias("work"), F.lit("Road").alias("title"), lists.alias("locations"), lists.alias("wards"), F.col("o_orderkey").cast("string").alias("job_number"))
    calls = orders.withColumn("call", F.explode(F.when(n % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    bidders = F.slice(F.array(*(F.struct(F.lit(x).alias("name")) for x in "abc")), F.lit(1), (n % 4).cast("int"))
    v = F.round("o_totalprice")
    links = calls.select(
        F.col("o_orderkey").alias("work"), F.concat(F.lit("T"), "o_orderkey").alias("base"), F.lit("portal").alias("source"), (F.col("o_orderkey") % 2 == 0).alias("exact"), F.lit(0.9).alias("score"), F.lit("by words").alias("via"), F.concat(F.lit("T"), "o_orderkey").alias("tender_number"), "call",
        F.date_add(day, 10 * (F.col("call") - 1)).alias("published_date"), F.when(won, "AWARDED").otherwise("UNDER_EVALUATION").alias("status"), none.cast("string").alias("status_text"), (v + 5.0).alias("ecv"), none.cast("double").alias("provisional_amount"),
        F.when(n > 0, n).cast("int").alias("period_days"), F.lit("so long").alias("period_text"), F.when(won, F.concat(F.lit("Firm "), n)).alias("contractor"), F.when(won, v).alias("contract_value"), none.cast("double").alias("negotiated_value"), F.when(won, F.date_add(day, 60)).alias("awarded_date"), bidders.alias("bidders"),
    )
    bills = spark.createDataFrame([], "work long, contractor string, gross double, nett double, dedupe_key string, payment_date date, br_date date, wo_date date, wo_no string, start_date date, end_date date, bill_type string, source_id string, source_row int")
    wanted = ("estimated_cost", "tender_published", "tender_calls", "period_days", "contractor", "contract_value", "awarded_date", "bidders", "status", "expected_completion")
    return base_facts(works, bills, links, fields=wanted).select("work", "field", "value", "confidence")


@R.query(
    """WITH i AS (SELECT o_custkey AS job, o_orderkey AS item, 2e0 + o_orderkey % 5 AS got, 1e5 * (1 + o_orderkey % 8) AS rate, o_orderkey % 2 = 0 AS dated FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0),
s AS (SELECT o_custkey AS job, 1e5 * (1 + o_orderkey % 8) AS rate, 1e0 + o_orderkey % 6 AS executed, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'medium' END AS sure, 'f' || o_orderkey AS file FROM orders WHERE o_orderkey % 3 = 0),
b AS (SELECT i.job, item, executed, sure FROM i JOIN s ON i.job = s.job AND abs(s.rate - i.rate) <= 0.005 * i.rate QUALIFY row_number() OVER (PARTITION BY i.job, item ORDER BY executed DESC, file DESC) = 1),
x AS (SELECT i.*, executed, sure, CASE WHEN executed >= 0.98 * got THEN 'explained' WHEN executed > 2.04 THEN 'partially_explained' WHEN sure = 'high' THEN 'unexplained_in_public_record' WHEN i.job % 4 IN (1, 2) THEN 'insufficient_evidence' ELSE 'unexplained_in_public_record' END AS status FROM i LEFT JOIN b ON i.job = b.job AND i.item = b.item)
SELECT job AS "case", item, status, CASE WHEN status = 'insufficient_evidence' AND bool_or(status = 'explained') OVER (PARTITION BY job) THEN 'low' WHEN dated THEN 'high' ELSE 'low' END AS confidence, executed AS executed_qty, round((got - 2) * rate) AS value_at_issue, CASE WHEN job % 4 = 0 THEN 5 ELSE 0 END AS documentation_gap FROM x"""
)
def issues_above_plan(spark, d):
    """Items billed above plan, against the statements of their job and then against each other; customers are jobs."""
    k, job = F.col("o_orderkey"), F.col("o_custkey").alias("job")
    rate = (100_000.0 * (1 + k % 8)).cast("double")
    orders = table(spark, d, "orders")
    bill = F.array(F.struct(F.lit("b").alias("bill"), F.lit(1.0).alias("quantity"), F.when(k % 7 > 0, "code").otherwise("description").alias("match"), F.lit(False).alias("swapped")))
    items = orders.select(job, k.alias("item"), F.lit("x").alias("description"), F.lit("nos").alias("unit"), F.lit(2.0).alias("estimated_quantity"), rate.alias("estimated_rate"), (2 * rate).alias("estimated_amount"), (2.0 + k % 5).alias("compared_quantity"), F.when(k % 2 == 0, "bill form total up to date").otherwise("bill abstracts (sum of read bills)").alias("compared_basis"), bill.alias("bills"))
    slips = orders.filter(k % 3 == 0).select(job, rate.alias("rate"), F.lit(None).cast("string").alias("unit"), (1.0 + k % 6).alias("executed_qty"), F.when(k % 2 == 0, "high").otherwise("medium").alias("confidence"), F.concat(F.lit("f"), k).alias("file"), F.lit(1).alias("page"), F.lit(0).alias("line"), F.lit("row").alias("raw"))
    c = F.col("c_custkey")
    docs = table(spark, d, "customer").filter(c % 4 > 0).select(c.alias("job"), F.concat(F.lit("d"), c).alias("file"), F.lit("variation").alias("kind"), F.lit("u").alias("url"), F.when(c % 4 < 3, "read").otherwise("not downloaded").alias("status"), F.lit(1).alias("rows"))
    found = I.quantities_above_plan(items, slips, spark.createDataFrame([], "job long, file string, page int, text string"), docs)  # statements' pages are held by tests
    return found.select("case", "item", "status", "confidence", "executed_qty", "value_at_issue", "documentation_gap")


QUERIES, ORACLE_SQL = R.queries, R.sql
