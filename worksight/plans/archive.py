"""Queries over documents rendered as lines from the driver's tables, with SQL that reads the same lines in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from worksight import build
from worksight.operators import documents as D
from worksight.operators import matching as M
from worksight.operators import quantities as Q
from worksight.operators import scope as S
from worksight.operators import work_slips as W
from worksight.registry import Registry
from worksight.sources import plans as L
from worksight.tables import spread, table

R = Registry()
AREA = S.Area("Greenfield", "greenfield", r"green\s*field", {"198": ["151"], "243": ["186"]})

#: An order is an entry of one of fifty programmes, over two lines of two pages with a page's heading between them; the state is cut off the line.
_LINES = """SELECT 'f' || o_orderkey % 50 AS file, o_orderkey * 4 + i AS page, CASE i
  WHEN 0 THEN (o_orderkey % 900 + 1) || ' Hill Side ' || (CASE WHEN o_orderkey % 3 = 0 THEN 186 ELSE 147 END) || ' Works for ' || lower(o_orderpriority) || CASE WHEN o_orderkey % 5 = 0 THEN ' roads of Greenfield' ELSE ' drains' END
  WHEN 1 THEN 'Page ' || o_orderkey
  ELSE '  and more   ' || ({price}) || ' ' || CASE WHEN o_orderkey % 7 = 0 THEN 'Yet to Start and all that is said of it' WHEN o_orderkey % 7 < 5 THEN 'Work Order Issued' ELSE 'Lost' END END AS text
FROM {orders} {each}"""


@R.query(
    f"""WITH lines AS ({_LINES.format(price="printf('%.2f', o_totalprice / 1000)", orders="orders", each=", range(3) AS g(i)")}),
marked AS (SELECT *, regexp_matches(text, '^\\s*\\d{{1,3}}\\s+[A-Z][A-Za-z .]+?\\s+\\d{{3}}\\s') AS s FROM lines),
counted AS (SELECT *, sum(s::INT) OVER (PARTITION BY file ORDER BY page) AS r FROM marked),
entries AS (SELECT file, r, string_agg(trim(text), ' ' ORDER BY page) AS t FROM counted WHERE r > 0 AND (s OR NOT regexp_matches(trim(text), '{L.LAYOUT}')) GROUP BY file, r),
read AS (SELECT file, regexp_extract(t, '^(\\d{{1,3}})\\s+Hill Side\\s+(\\d{{3}})\\s+(.+?)\\s+(\\d{{1,4}}\\.\\d{{2}})\\s+({L.STATES})\\b(.*)$', ['no', 'ward', 'about', 'amount', 'state', 'tail']) AS x FROM entries),
rows AS (SELECT file, x.no::INT AS row, x.ward AS ward, trim(regexp_replace(CASE WHEN length(x.tail) > 10 THEN x.about || ' ' || x.tail ELSE x.about END, '\\s+', ' ', 'g')) AS description, round(x.amount::DOUBLE * 1e5, 2) AS ecv, x.state AS plan_status FROM read WHERE x.no <> '')
SELECT file, row, ward, description, ecv, plan_status, file || '#' || row AS base, CASE WHEN description LIKE '%road%' THEN 'Roads' ELSE 'Drains & storm-water' END AS category FROM rows WHERE ward = '186' OR description LIKE '%Greenfield%'"""
)
def archived_programme_rows(spark, d):
    """Entries of programmes of works, put together again from their lines."""
    table(spark, d, "orders").createOrReplaceTempView("archive_orders")
    texts = spark.sql(_LINES.format(price="replace(format_number(o_totalprice / 1000, 2), ',', '')", orders="archive_orders", each="LATERAL VIEW explode(sequence(0, 2)) g AS i"))
    files = texts.select("file").distinct().select("file", F.lit("pow").alias("kind"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("date").alias("published_date"), F.lit("2022-23").alias("fy"), F.lit(False).alias("ocr"))
    rows = L.plan_rows(files, texts, L.Place(AREA, constituency="Hill Side"))
    return rows.select("file", "row", "ward", "description", "ecv", "plan_status", "base", "category")


@R.query(
    """WITH x AS (SELECT o_orderkey AS work, o_custkey % 90 + 20.25 AS q, floor(o_totalprice / 970) + 1003.04 AS rate, o_custkey % 90 * (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0.5 END) + 11.75 AS e FROM orders),
y AS (SELECT *, round(q * rate, 2) AS amount, round(e * rate, 2) AS actual FROM x)
SELECT work, q::DOUBLE AS tender_qty, round(rate, 2) AS rate, amount AS tender_amount, e::DOUBLE AS executed_qty, actual AS actual_amount, CASE WHEN actual > amount THEN round(actual - amount, 2) END AS excess, CASE WHEN actual < amount THEN round(amount - actual, 2) END AS savings, 'sqm' AS unit FROM y WHERE abs(actual - amount) > 3 AND e < 20 * q"""
)
def statement_rows_of_lines(spark, d):
    """Comparative statements of orders: their numbers are found again behind a number that belongs to none, though no column says what it is."""
    q = F.col("o_custkey") % 90
    x = table(spark, d, "orders").select("o_orderkey", (q + 20.25).alias("q"), (F.floor(F.col("o_totalprice") / 970) + 1003.04).cast("double").alias("rate"), (q * F.when(F.col("o_orderstatus") == "F", 2.0).otherwise(0.5) + 11.75).alias("e"))
    x = x.withColumns({"amount": F.round(F.col("q") * F.col("rate"), 2), "actual": F.round(F.col("e") * F.col("rate"), 2)}).filter(F.abs(F.col("actual") - F.col("amount")) > 3)
    shown = [F.format_string("%.2f", F.col(c)) for c in ("q", "rate", "amount", "e", "rate", "actual")] + [F.format_string("%.2f", F.abs(F.col("amount") - F.col("actual")))]
    text = F.concat(F.lit("work of item\n"), F.concat_ws(" ", F.lit("Sq.m |"), F.lit("99999999"), *shown))
    rows = W.statement_rows(x.select(F.col("o_orderkey").alias("file"), F.lit(1).alias("page"), text.alias("text")))
    return rows.select(F.col("file").alias("work"), "tender_qty", F.round("rate", 2).alias("rate"), "tender_amount", "executed_qty", "actual_amount", "excess", "savings", "unit")


@R.query(
    """WITH items AS (SELECT o_custkey AS job, o_orderkey AS item, o_orderkey % 6 + 1.0 AS q, (100 + o_orderkey % 7 * 25)::DOUBLE AS rate FROM orders),
pages AS (SELECT o_custkey AS job, o_orderkey AS page, o_orderkey % 50 AS n, [n * 25.0, (n + o_orderkey % 9) * 125.0, n * 125.0, (n % 5 + 1) * 100.0] AS v FROM orders),
numbers AS (SELECT job, page, unnest(v)::DOUBLE AS x FROM pages),
hits AS (SELECT i.job, i.item, a.page, a.x / rate AS t, b.x / rate AS e FROM items i JOIN numbers a ON a.job = i.job AND a.x > rate AND abs(a.x / rate - round(a.x / rate)) < 1e-6 JOIN numbers b ON b.job = a.job AND b.page = a.page AND b.x > rate AND abs(b.x / rate - round(b.x / rate)) < 1e-6 AND abs(a.x / rate - b.x / rate - q) < 1e-6 AND a.x / rate > q)
SELECT job, item, page, t AS executed_qty, e AS excess_qty FROM hits QUALIFY row_number() OVER (PARTITION BY job, item ORDER BY page, t, e) = 1"""
)
def executed_by_multiples(spark, d):
    """Amounts of a customer's pages that are whole multiples of an item's rate, the planned amount apart; the SQL compares all pairs of a page."""
    orders, n = table(spark, d, "orders"), F.col("o_orderkey") % 50
    items = orders.select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 6 + 1.0).alias("quantity"), (100 + F.col("o_orderkey") % 7 * 25).cast("double").alias("rate"))
    numbers = [n * 25.0, (n + F.col("o_orderkey") % 9) * 125.0, n * 125.0, (n % 5 + 1) * 100.0]
    pages = orders.select(F.col("o_custkey").alias("job"), F.lit("f").alias("file"), F.col("o_orderkey").alias("page"), F.concat_ws(" | ", *(F.format_string("%.2f", x) for x in numbers)).alias("text"))
    return W.amount_multiples(items, pages).select("job", "item", "page", "executed_qty", "excess_qty")


#: A customer is a job with three planned items and three bills of a row each; quantities, a bill's gross and sheets' totals vary with its key.
_JOBS = """WITH plan AS (SELECT c_custkey AS k, i, 100e0 + c_custkey % 50 + i AS q, 50e0 + 40 * i AS rate FROM customer {items}),
billed AS (SELECT k, b, i, rate, q, (round(q * (0.3e0 + 0.1e0 * ((k + b + i) % 2)), 2) + 0.01e0 * b) * (CASE WHEN k % 7 = 0 AND b = 2 THEN 3 ELSE 1 END) AS x, CASE WHEN (k + i + b) % 3 = 0 THEN round(q * 0.95e0, 2) END AS to_date FROM plan {bills}),
gross AS (SELECT k, b, sum(x * rate) * (CASE WHEN k % 5 = 0 AND b = 1 THEN 2.5e0 WHEN k % 7 = 0 AND b = 2 THEN 1e0 / 3 ELSE 1e0 END) AS gross FROM billed GROUP BY k, b)"""


@R.query(
    _JOBS.format(items=", range(3) AS g(i)", bills=", range(3) AS h(b)")
    + """, read AS (SELECT k, b, value, gross, sum(gross) OVER (PARTITION BY k ORDER BY b) AS so_far FROM gross JOIN (SELECT k, b, sum(x * rate) AS value FROM billed GROUP BY ALL) USING (k, b)),
scoped AS (SELECT *, CASE WHEN value / gross BETWEEN 0.6 AND 1.35 THEN 'this' WHEN so_far > gross AND value / so_far BETWEEN 0.6 AND 1.35 THEN 'all' END AS scope FROM read),
used AS (SELECT k, b, coalesce(max(b) FILTER (scope = 'all') OVER (PARTITION BY k), 0) AS first FROM scoped),
own AS (SELECT x.* FROM billed x JOIN used USING (k, b) WHERE b >= first),
once AS (SELECT * FROM own a WHERE NOT EXISTS (FROM own e WHERE e.k = a.k AND e.i = a.i AND e.b < a.b AND abs(e.x - a.x) <= 0.005 * a.x)),
taken AS (SELECT k, i, round(sum(x), 3) AS billed, arg_max(to_date, b) FILTER (to_date IS NOT NULL) AS to_date, count(*) AS n FROM once GROUP BY k, i),
compared AS (SELECT p.k AS job, p.i + 1 AS item, p.q, n, CASE WHEN to_date >= billed - 0.01 THEN to_date ELSE billed END AS billed, to_date >= billed - 0.01 AS dated, CASE WHEN p.k % 4 = 0 AND p.i = 1 THEN round(p.q * 1.1e0, 3) END AS measured FROM plan p LEFT JOIN taken t ON t.k = p.k AND t.i = p.i)
SELECT job, item::INT AS item, billed AS billed_quantity, measured AS measured_quantity, coalesce(measured, billed) AS compared_quantity, CASE WHEN measured IS NOT NULL THEN 'MB measurement total' WHEN dated THEN 'bill form total up to date' ELSE 'bill abstracts (sum of read bills)' END AS compared_basis, n::INT AS n_bills, round((coalesce(measured, billed) - q) / q * 100, 1) AS variance_pct FROM compared"""
)
def planned_against_billed_items(spark, d):
    """Planned items of jobs against their bills: cumulative bills, repeated rows, columns up to date and measured totals."""
    n = -(-table(spark, d, "customer").count() // 5_000)  # a job has nine billed rows
    tasks = n if n > spark.sparkContext.defaultParallelism else None
    spread(table(spark, d, "customer").select("c_custkey"), tasks, "c_custkey").createOrReplaceTempView("archive_customer")
    text = _JOBS.replace("FROM customer", "FROM archive_customer").format(items="LATERAL VIEW explode(sequence(0, 2)) g AS i", bills="LATERAL VIEW explode(sequence(0, 2)) h AS b")
    read = lambda what: spark.sql(f"{text} SELECT * FROM {what}")
    code, words, none = F.concat(F.lit("SR "), F.col("i") + 1), F.element_at(F.array(*map(F.lit, ("tack coat", "kerb stones", "granite slabs"))), F.col("i") + 1), F.lit(None)
    plan = read("plan").select(F.col("k").alias("job"), F.col("i").alias("position"), F.lit(Q.SCHEDULE).alias("type"), code.alias("code"), F.lit("sqm").alias("unit"), F.col("q").alias("quantity"), "rate", (F.col("q") * F.col("rate")).alias("amount"), words.alias("description"))
    rows = read("billed").select(F.col("k").alias("job"), F.col("b").cast("string").alias("bill"), (F.col("b") * 3 + F.col("i")).alias("position"), code.alias("code"), F.lit("sqm").alias("unit"), F.col("x").alias("quantity"), "rate", (F.col("x") * F.col("rate")).alias("amount"), words.alias("description"), F.col("to_date").alias("to_date_quantity"))
    bills = read("gross").select(F.col("k").alias("job"), F.col("b").cast("string").alias("bill"), F.lit("Running").alias("bill_type"), "gross", none.cast("date").alias("date"), F.lit(True).alias("paid"))
    totals = read("plan").filter("k % 4 = 0 AND i = 1").select(F.col("k").alias("job"), code.alias("code"), F.lit("sqm").alias("unit"), F.round(F.col("q") * 1.1, 3).alias("total"))
    items = Q.planned_against_billed(plan, bills, rows, totals, tasks).items
    return items.select("job", "item", "billed_quantity", "measured_quantity", "compared_quantity", "compared_basis", F.size("bills").alias("n_bills"), "variance_pct")


@R.query(
    f"""WITH letters AS (SELECT string_split('{M.LETTERS}', '') AS cs),
l AS (SELECT p_partkey AS a, lower(p_name || ' ' || p_type || ' ' || replace(p_brand, '#', ' ')) AS t FROM part), r AS (SELECT s_suppkey AS b, lower(replace(s_name, '#', ' ')) AS t FROM supplier),
lc AS (SELECT t, list_transform(cs, lambda c: length(t) - length(replace(t, c, ''))) AS n FROM (SELECT DISTINCT t FROM l), letters), rc AS (SELECT t, list_transform(cs, lambda c: length(t) - length(replace(t, c, ''))) AS n FROM (SELECT DISTINCT t FROM r), letters),
near AS (SELECT lc.t AS lt, rc.t AS rt FROM lc, rc WHERE 2.0 * list_sum(list_transform(range(1, 38), lambda i: least(lc.n[i], rc.n[i]))) / (length(lc.t) + length(rc.t)) >= 0.3)
SELECT a, b FROM near JOIN l ON l.t = lt JOIN r ON r.t = rt"""
)
def letters_in_common(spark, d):
    """Parts and suppliers whose names have 30 % of their letters in common; the SQL compares all pairs of distinct names."""
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    left = part.select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_name", "p_type", F.replace("p_brand", F.lit("#"), F.lit(" ")))).alias("text"))
    return M.letters_alike(left, supplier.select(F.col("s_suppkey").alias("id"), F.lower(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("text")), 0.3)


@R.query(
    """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'public_view' ELSE 'work_details' END AS kind, 'S' || o_orderkey % 3 AS source_id, o_custkey % 50 AS job, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 700 END AS ifms,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 40 + 1 END AS br, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey % 9 END AS brd, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 90 END AS gross, o_orderkey % 2 AS nett FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY br IS NULL, kind <> 'public_view', source_id, id) AS rk, br IS NOT NULL AND brd IS NOT NULL AS numbered FROM x),
amounts AS (SELECT job, gross, min(rk) AS f FROM r WHERE numbered GROUP BY ALL),
l AS (SELECT r.* FROM r LEFT JOIN amounts m ON r.job = m.job AND r.gross IS NOT DISTINCT FROM m.gross WHERE numbered OR ifms IS NOT NULL OR f IS NULL OR rk < f),
k AS (SELECT rk, 'I' || ifms AS key FROM l WHERE ifms IS NOT NULL UNION ALL SELECT rk, concat_ws(':', 'B', job, br, brd) FROM l WHERE numbered
  UNION ALL SELECT rk, concat_ws(':', 'R', job, coalesce(gross::VARCHAR, '-' || id), nett) FROM l WHERE ifms IS NULL AND NOT numbered),
f AS (SELECT rk, rk = min(rk) OVER (PARTITION BY key) AS first FROM k)
SELECT id, CASE WHEN ifms IS NOT NULL THEN 'IFMS' WHEN numbered THEN 'BR' ELSE 'ROW' END AS dedupe_key FROM l JOIN (SELECT rk FROM f GROUP BY rk HAVING bool_and(first)) USING (rk)"""
)
def bills_told_apart(spark, d):
    """Bills of several exports, each once: by id, by number and date, or by amounts where neither is there."""
    k = F.col("o_orderkey")
    money = lambda c: c.cast("decimal(18,2)")
    bills = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, "public_view").otherwise("work_details").alias("kind"), F.concat(F.lit("S"), k % 3).alias("source_id"), k.cast("int").alias("source_row"), (F.col("o_custkey") % 50).cast("string").alias("job_number"),
        F.when(k % 5 == 0, k % 700).cast("string").alias("ifms_id"), F.when(k % 3 > 0, F.lpad((k % 40 + 1).cast("string"), 4, "0")).alias("br_no"), F.when(k % 4 != 1, F.date_add(F.lit("2020-01-01").cast("date"), (k % 9).cast("int"))).alias("br_date"),
        money(F.when(k % 11 > 0, k % 90)).alias("gross"), F.lit(None).cast("decimal(18,2)").alias("deduction"), money(k % 2).alias("nett"),
    )
    return build.deduplicated(bills).select("id", "dedupe_key")


@R.query(
    """WITH x AS (SELECT o_orderkey AS file, (o_orderdate + INTERVAL 14 YEAR)::DATE AS day, round(o_totalprice, 2) AS amount, o_custkey % 30 AS n FROM orders)
SELECT file, 'commencement_date' AS field, NULL AS value, NULL AS number, day::VARCHAR AS date FROM x UNION ALL SELECT file, 'completion_due', NULL, NULL, (day + n::INT)::VARCHAR FROM x UNION ALL SELECT file, 'contract_value', NULL, amount, NULL FROM x WHERE amount >= 10000
UNION ALL SELECT file, 'tender_premium', NULL, CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * (n + 0.5e0), NULL FROM x UNION ALL SELECT file, 'period', NULL, n * 30, NULL FROM x WHERE n > 0 UNION ALL SELECT file, 'time_extension', CASE WHEN n % 3 = 0 THEN 'true' ELSE 'false' END, NULL, NULL FROM x
UNION ALL SELECT file, 'work_order_ref', 'EE/' || n || '/WO/ ' || file, NULL, day::VARCHAR FROM x"""
)
def mined_values(spark, d):
    """Values that orders' pages state, found again by the table of patterns; amounts and periods out of bounds are left out."""
    day, n, k = F.to_date(F.add_months("o_orderdate", 168)), (F.col("o_custkey") % 30).cast("int"), F.col("o_orderkey")
    shown = lambda c: F.date_format(c, "d.M.yyyy")
    text = F.concat_ws(
        "\n", F.format_string("No: EE/%d/WO/ %d  Date: %s", n, k, shown(day)), F.concat(F.lit("Date of commencement  of work "), shown(day)), F.concat(F.lit("Scheduled date of completion: "), shown(F.date_add(day, n))),
        F.concat(F.lit("for a tender price of Rs. "), F.format_number("o_totalprice", 2)), F.format_string("Tender premium %d.5 %% %s", n, F.when(n % 2 == 0, "above").otherwise("below")), F.format_string("Time of completion %d months", n),
        F.concat(F.lit("time extension if any : "), F.when(n % 3 == 0, "granted").otherwise("not granted")),
    )
    found = D.mine(table(spark, d, "orders").select(k.alias("file"), text.alias("text")))
    return found.select("file", "field", "value", "number", F.col("date").cast("string").alias("date"))


QUERIES, ORACLE_SQL = R.queries, R.sql
