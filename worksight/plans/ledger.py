"""Grid rows, direct records and changes between builds on the driver's tables: orders are works and jobs, their lines bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from worksight.operators import changes as C
from worksight.registry import Registry
from worksight.sources import direct, grid
from worksight.tables import table

R = Registry()
#: The day of the older build; what happened later is unknown to it.
CUT = "1998-01-01"


def _build(spark, d, whole: bool):
    o, line, cut = table(spark, d, "orders"), table(spark, d, "lineitem"), F.lit(CUT).cast("date")
    slug, paid = F.concat(F.lit("w-"), F.col("l_orderkey").cast("string")), F.date_add(F.to_date("l_shipdate"), 30)
    shipped = line if whole else line.filter(F.col("l_shipdate") <= cut)
    placed = o if whole else o.filter(F.col("o_orderdate") <= cut)
    none = F.lit(None).cast("string")
    status = F.col("o_orderstatus") if whole else F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") <= F.lit("1997-01-01").cast("date")), "F").otherwise("O")
    recent = line.filter(F.col("l_shipdate") > F.lit("1997-01-01").cast("date")) if whole else shipped
    return {
        "projects": placed.select(F.concat(F.lit("w-"), F.col("o_orderkey").cast("string")).alias("slug"), F.col("o_orderpriority").alias("title"), status.alias("status"), F.col("o_totalprice").alias("payments_gross")),
        "bills": shipped.select(
            slug.alias("slug"), slug.alias("job_number"), none.alias("bill_type"), F.col("l_extendedprice").alias("gross"), F.col("l_linenumber").cast("string").alias("br_no"),
            F.to_date("l_shipdate").alias("br_date"), (paid if whole else F.when(paid <= cut, paid)).alias("payment_date"), none.alias("contractor"),
        ),
        "signals": recent.select(slug.alias("slug"), F.col("l_linestatus").alias("code")),
        "finals": shipped.filter("l_returnflag = 'R'").select(slug.alias("slug"), F.lit("final").alias("value")),
    }


@R.query(f"""WITH o AS (SELECT format('w-{{}}', o_orderkey) AS slug, o_orderpriority AS title, o_orderdate <= DATE '{CUT}' AS known, o_orderstatus AS now,
 CASE WHEN o_orderstatus = 'F' AND o_orderdate <= DATE '1997-01-01' THEN 'F' ELSE 'O' END AS was FROM orders),
l AS (SELECT format('w-{{}}', l_orderkey) AS slug, l_shipdate <= DATE '{CUT}' AS known, l_shipdate::DATE + 30 AS paid, * FROM lineitem),
b AS (SELECT slug, l_linenumber, l_shipdate, known, paid, max(l_extendedprice) AS gross FROM l GROUP BY slug, l_linenumber, l_shipdate, known, paid, round_even(l_extendedprice, 0)),
sig AS (SELECT slug, l_linestatus AS code, bool_or(known) AS before, bool_or(l_shipdate > DATE '1997-01-01') AS after FROM l GROUP BY slug, l_linestatus)
SELECT 'project_added' AS kind, slug AS key, NULL AS was, NULL AS now, NULL::DOUBLE AS amount, title AS note FROM o WHERE NOT known
UNION ALL SELECT 'status', slug, was, now, NULL, NULL FROM o WHERE known AND was <> now
UNION ALL SELECT 'new_bill', slug, NULL, paid::VARCHAR, gross, 'bill, paid ' || paid::VARCHAR FROM b WHERE NOT known
UNION ALL SELECT 'newly_paid', slug, NULL, paid::VARCHAR, gross, 'bill, paid ' || paid::VARCHAR FROM b WHERE known AND paid > DATE '{CUT}'
UNION ALL SELECT 'final_bill', f.slug, NULL, NULL, NULL, o.title FROM (SELECT slug FROM l WHERE l_returnflag = 'R' GROUP BY slug HAVING NOT bool_or(known)) f LEFT JOIN o ON o.slug = f.slug
UNION ALL SELECT 'signal_added', slug, NULL, NULL, NULL, code FROM sig WHERE after AND NOT before
UNION ALL SELECT 'signal_gone', slug, NULL, NULL, NULL, code FROM sig WHERE before AND NOT after""")
def build_changes(spark, d):
    """All that a build as of 1998 and one of all the tables differ in."""
    return C.changes(_build(spark, d, False), _build(spark, d, True))


def _printed(spark, d):
    """Lines as a grid's window of each order shows them, twenty years later; an order has a handful of lines."""
    later = lambda n: F.date_format(F.date_add(F.add_months(F.to_date("l_shipdate"), 240), n), "dd-MMM-yyyy")
    key = F.col("l_orderkey")
    job = F.format_string("%03d-%02d-%06d", F.col("l_suppkey") % 1000, F.col("l_linenumber"), key % 1000000)
    numbered = F.when(F.col("l_returnflag") != "N", F.format_string("%06d", key)).otherwise("")
    refs = F.concat(F.lit("BR - "), numbered, F.lit(" / "), later(0), F.lit("<br/>CBR - 7-1 / <br/>Rtgs - "), F.format_string("%05d", "l_partkey"), F.lit(" / "), later(30))
    row = F.struct(
        F.lit("1").alias("slno"), F.format_string("%d-%d-%d", key, "l_linenumber", "l_partkey").alias("id"), F.concat(F.lit("<a onclick=\"vssFillData(1,'"), job, F.lit("');\">"), job, F.lit("</a><br/>Work of  <b>flag "), "l_returnflag", F.lit("</b>")).alias("wodetails"),
        F.lit("012345 A. Rao<br/>9000000001").alias("contractor"), refs.alias("brnumber"), F.format_number("l_extendedprice", 2).alias("amount"), F.format_number("l_quantity", 0).alias("nett"), F.lit("").alias("deduction"),
    )
    return table(spark, d, "lineitem").groupBy(key.cast("string").alias("from")).agg(F.collect_list(row).alias("rows")).select("from", F.col("from").alias("to"), F.lit("u").alias("url"), "rows")


@R.query("""SELECT format('{}-{}-{}', l_orderkey, l_linenumber, l_partkey) AS bill_id, printf('%03d-%02d-%06d', l_suppkey % 1000, l_linenumber, l_orderkey % 1000000) AS job_number,
printf('%03d', l_suppkey % 1000) AS ward_prefix, printf('%02d', l_linenumber) AS job_year, 'Work of flag ' || l_returnflag AS description, 'A. Rao' AS contractor,
CASE WHEN l_returnflag <> 'N' THEN printf('%06d', l_orderkey) END AS br_no, (l_shipdate + INTERVAL 20 YEAR)::DATE::VARCHAR AS br_date, '7-1' AS cbr_no, printf('%05d', l_partkey) AS rtgs_no,
((l_shipdate + INTERVAL 20 YEAR)::DATE + 30)::VARCHAR AS rtgs_date, l_extendedprice AS gross, l_quantity AS nett FROM lineitem""")
def payment_grid_rows(spark, d):
    """Lines printed as the payment grid prints them are read back; blank numbers are none."""
    rows = grid.grid_rows(_printed(spark, d))
    days = (F.col(c).cast("string").alias(c) for c in ("br_date", "rtgs_date"))
    return rows.select("bill_id", "job_number", "ward_prefix", "job_year", "description", "contractor", "br_no", "cbr_no", "rtgs_no", *days, *(F.col(c).cast("double").alias(c) for c in ("gross", "nett")))


@R.query("""WITH l AS (SELECT l_orderkey, l_suppkey, max(l_shipdate) AS day FROM lineitem GROUP BY l_orderkey, l_suppkey), k AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1998-01-01'),
paid AS (SELECT * FROM k WHERE o_orderstatus <> 'O'), d AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT (SELECT count(*) FROM lineitem) AS grid_rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS grid_bills, (SELECT min(l_shipdate)::DATE::VARCHAR FROM lineitem) AS first_payment,
(SELECT count(*) FROM paid) AS export_bills, (SELECT count(*) FROM paid WHERE o_orderkey IN (SELECT l_orderkey FROM l)) AS export_bills_in_grid,
(SELECT count(DISTINCT o_custkey) FROM k) AS known_jobs, (SELECT count(DISTINCT o_custkey) FROM k WHERE o_custkey IN (SELECT l_suppkey FROM l)) AS known_jobs_in_grid,
(SELECT count(*) FROM d) AS direct_bills, (SELECT count(*) FROM d WHERE o_orderkey IN (SELECT l_orderkey FROM l)) AS direct_bills_in_grid""")
def grid_denominators(spark, d):
    """How much of what other tables say was paid the grid holds."""
    o = table(spark, d, "orders")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("bill_id"), F.col("l_suppkey").cast("string").alias("job_number"), F.to_date("l_shipdate").alias("rtgs_date"))
    known = o.select(F.col("o_custkey").cast("string").alias("job_number"), F.col("o_orderkey").cast("string").alias("ifms_id"), F.nullif("o_orderstatus", F.lit("O")).alias("payment_ref"), F.to_date("o_orderdate").alias("payment_date"))
    of_direct = o.select(F.col("o_orderkey").cast("string").alias("bill_id"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("").alias("rtgs"))
    return grid.denominators(rows, known, of_direct, "1998-01-01").withColumn("first_payment", F.col("first_payment").cast("string"))


@R.query("""SELECT l_suppkey::VARCHAR AS job_number, head, amount FROM (SELECT l_suppkey, 'it' AS head, sum(l_quantity) AS amount FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT l_suppkey, 'withheld', sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END)::DOUBLE FROM lineitem GROUP BY l_suppkey) WHERE amount <> 0""")
def deduction_heads(spark, d):
    """Heads of deductions of each job's bills, renamed and summed; a head that isn't kept is left out."""
    line = table(spark, d, "lineitem")
    raw = F.create_map(F.lit("it"), F.col("l_quantity").cast("string"), F.lit("others3"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("string")), F.lit("gst"), F.lit("9"))
    empty = spark.createDataFrame([], direct.RECORD)
    records = line.select(F.col("l_suppkey").cast("string").alias("work_bill_id"), raw.alias("deductions"), *(F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in empty.columns if c not in ("work_bill_id", "deductions")))
    return direct.deduction_totals(direct.direct_bills(records).withColumnRenamed("wbid", "job_number"))


@R.query("""WITH ours AS (SELECT o_orderkey AS bill, o_custkey AS job, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS id, CASE WHEN o_orderstatus = 'P' THEN o_orderkey END AS br FROM orders),
d AS (SELECT o_orderkey AS wbid, o_custkey AS job, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS paid FROM orders)
SELECT d.wbid::VARCHAR AS wbid, coalesce(i.bill, n.bill) AS bill, CASE WHEN i.bill IS NOT NULL THEN 'id' WHEN n.bill IS NOT NULL THEN 'bill_number' END AS basis,
CASE WHEN coalesce(i.bill, n.bill) IS NOT NULL THEN 'matched' WHEN paid THEN 'new' ELSE 'pending' END AS state
FROM d LEFT JOIN ours i ON i.id = d.wbid AND i.job = d.job LEFT JOIN ours n ON n.br = d.wbid AND n.job = d.job""")
def direct_bill_cascade(spark, d):
    """Direct bills found among known ones by id, else by number, and what becomes of the others. Amounts, which go one to one in order, are left to tests."""
    o, key, none = table(spark, d, "orders"), F.col("o_orderkey"), F.lit(None).cast("decimal(18,2)")
    number = (key + 1).cast("string")  # a number of zeros alone would be none
    job, day = F.col("o_custkey").cast("string").alias("job_number"), F.to_date("o_orderdate").alias("br_date")
    ours = o.select(key.alias("bill"), job, F.when(F.col("o_orderstatus") == "F", key.cast("string")).alias("ifms_id"), F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("00"), number)).alias("br_no"), day, none.alias("gross"))
    theirs = o.select(key.cast("string").alias("wbid"), job, number.alias("br_no"), day, none.alias("gross"), F.coalesce(F.col("o_orderpriority").rlike("^[12]"), F.lit(False)).alias("paid"))
    return direct.match_bills(theirs, ours).select("wbid", "bill", "basis", "state")


QUERIES, ORACLE_SQL = R.queries, R.sql
