"""What pages and reviews show, and signals across works, on the driver's tables: orders are works, lines their bills, suppliers the payees."""

from __future__ import annotations

from pyspark.sql import functions as F

from worksight.operators import cases as C
from worksight.operators import dataset_signals as S
from worksight.operators import explorer as X
from worksight.registry import Registry
from worksight.tables import dealt, table

R = Registry()


#: Bills of works: a third of the payees isn't resolved, and some bills aren't paid yet.
_BILLS = """WITH bills AS (SELECT l_orderkey AS project_id, CASE WHEN l_suppkey % 3 > 0 THEN 'E' || l_suppkey END AS contractor_entity, 'N' || l_suppkey % 50 AS contractor, l_suppkey, CASE WHEN l_linenumber % 4 > 0 THEN l_shipdate::DATE END AS payment_date,
  (l_shipdate - INTERVAL 20 DAY)::DATE AS br_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS gross, 'S' || l_linenumber AS source_id FROM lineitem)"""


def _records(spark, d):
    day = F.to_date("l_shipdate")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.lit("bill").alias("record_type"), F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("E"), "l_suppkey")).alias("contractor_entity"), F.concat(F.lit("N"), F.col("l_suppkey") % 50).alias("contractor"),
        F.when(F.col("l_linenumber") % 4 > 0, day).alias("payment_date"), F.date_sub(day, 20).alias("br_date"), F.lit(None).cast("date").alias("wo_date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("gross"), F.concat(F.lit("S"), "l_linenumber").alias("source_id"),
    )


@R.query(f"""{_BILLS} SELECT min(CASE WHEN contractor_entity IS NOT NULL AND l_suppkey % 2 = 0 THEN 'Known ' || l_suppkey ELSE contractor END) AS name, sum(gross)::DOUBLE AS paid, count(*) AS bills, count(DISTINCT project_id) AS works
FROM bills WHERE payment_date IS NOT NULL GROUP BY coalesce(contractor_entity, contractor)""")
def payee_totals(spark, d):
    """Payees by their entity, or by name where none is known."""
    known = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("E"), "s_suppkey").alias("entity"), F.concat(F.lit("Known "), "s_suppkey").alias("name"))
    return X.payees(_records(spark, d), known)


@R.query(f"{_BILLS} SELECT project_id, contractor, min(coalesce(payment_date, br_date))::VARCHAR AS first, max(coalesce(payment_date, br_date))::VARCHAR AS last, count(*) AS n, sum(gross)::DOUBLE AS gross FROM bills GROUP BY project_id, contractor")
def case_payee_spans(spark, d):
    out = X.case_payees(_records(spark, d))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@R.query(f"""{_BILLS}, dated AS (SELECT project_id, coalesce(payment_date, br_date) AS date, gross FROM bills),
x AS (SELECT *, count(*) OVER w AS n, min(date) OVER w AS first, max(date) OVER w AS last, sum(gross) OVER w AS total, sum(gross) OVER (PARTITION BY project_id ORDER BY date, gross ROWS UNBOUNDED PRECEDING) AS paid FROM dated WINDOW w AS (PARTITION BY project_id))
SELECT project_id, date::VARCHAR AS date, round(100.0::DOUBLE * date_diff('day', first, date) / greatest(1, date_diff('day', first, last)), 1) AS x, round(40 - 38 * paid::DOUBLE / total::DOUBLE, 1) AS y, paid::DOUBLE AS paid FROM x WHERE n >= 2""")
def payment_curves(spark, d):
    """Points of each work's payments so far, as its chart draws them."""
    records = dealt(_records(spark, d), table(spark, d, "lineitem").count(), 250_000, "project_id")
    return X.cumulative_points(records).withColumn("date", F.col("date").cast("string"))


@R.query(f"{_BILLS} SELECT project_id, gross::DOUBLE AS gross, source_id, CASE WHEN source_id < 'S5' THEN 'Source ' || source_id END AS source_name FROM bills")
def records_of_sources(spark, d):
    sources = spark.range(1, 5).select(F.concat(F.lit("S"), "id").alias("id"), F.concat(F.lit("Source S"), "id").alias("name"))  # a register of sources, one row each
    return X.records_with_sources(_records(spark, d), sources).select("project_id", F.col("gross").cast("double").alias("gross"), "source_id", "source_name")


@R.query("""SELECT l_orderkey AS project_id, 'o-' || l_orderkey AS slug, CASE l_returnflag WHEN 'A' THEN 'slow_payment' ELSE 'fine_levied' END AS code, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 1 ELSE 2 END AS rank
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'""")
def signals_of_projects(spark, d):
    """Signals with the address of their work; one code isn't shown."""
    code = F.when(F.col("l_returnflag") == "R", "contractor_concentration").when(F.col("l_returnflag") == "A", "slow_payment").otherwise("fine_levied")
    severity = F.when(F.col("l_linenumber") == 1, "attention").when(F.col("l_linenumber") == 2, "notice").otherwise("info")
    signals = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), code.alias("code"), severity.alias("severity"))
    projects = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o-"), "o_orderkey").alias("slug"), F.lit("t").alias("title"), F.lit(1.0).alias("payments_gross"), F.lit(1.0).alias("contract_value"))
    return X.signals_with_projects(signals, projects).select("project_id", "slug", "code", "rank")


@R.query("SELECT c_custkey AS case_id, o_orderkey AS project_id, CASE WHEN o_orderkey IS NOT NULL THEN 'o-' || o_orderkey END AS slug FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 7 WHERE c_custkey % 3 = 0")
def cases_of_projects(spark, d):
    """Retained cases with the address of their work, where it is still there."""
    projects = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o-"), "o_orderkey").alias("slug"))
    cases = table(spark, d, "customer").join(projects.select(F.col("id").alias("project_id")), F.col("c_custkey") * 7 == F.col("project_id"), "left")
    cases = cases.select(F.col("c_custkey").alias("case_id"), "project_id", (F.col("c_custkey") % 3 == 0).cast("int").alias("retained"), F.col("c_custkey").alias("rank"))
    return X.case_list(cases, projects).select("case_id", "project_id", "slug")


@R.query("""SELECT unnest(['planned', 'awarded', 'work', 'money', 'outcome', 'evidence']) AS stage, unnest([count(*) FILTER (o_orderkey % 2 = 0), count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_totalprice > 1000), count(*) FILTER (o_custkey % 5 = 0), 0, count(*) FILTER (o_orderstatus <> 'O')]) AS n FROM orders""")
def stage_funnel(spark, d):
    """How many works have each stage, told by JSON; one stage is never there."""
    k = F.struct((F.col("o_orderkey") % 2 == 0).alias("planned"), (F.col("o_orderstatus") == "F").alias("awarded"), (F.col("o_totalprice") > 1000).alias("work"), (F.col("o_custkey") % 5 == 0).alias("money"), (F.col("o_orderstatus") != "O").alias("evidence"))
    return X.stage_counts(table(spark, d, "orders").select(F.to_json(k).alias("stages")))


@R.query("""WITH i AS (SELECT o_custkey AS c, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'explained' WHEN 1 THEN 'artefact' WHEN 2 THEN 'partially_explained' WHEN 3 THEN 'insufficient_evidence' ELSE 'unexplained_in_public_record' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, o_totalprice * 100 AS value, o_orderkey % 4 AS gap, o_orderkey % 900 AS days FROM orders),
p AS (SELECT *, CASE o_open WHEN 0 THEN 0 ELSE 1 END AS lives FROM (SELECT *, CASE status WHEN 'partially_explained' THEN 12e0 WHEN 'insufficient_evidence' THEN 8e0 WHEN 'unexplained_in_public_record' THEN 20e0 ELSE 0e0 END AS o_open, CASE confidence WHEN 'high' THEN 25e0 WHEN 'medium' THEN 15e0 ELSE 5e0 END AS sure,
  CASE WHEN value > 1e5 THEN round(least(25e0, 25 * log10(value / 1e5) / 3), 1) ELSE 0e0 END AS money FROM i)),
b AS (SELECT c, arg_max({'open': o_open, 'sure': sure, 'money': money, 'k': k}, o_open + sure + money + k / 1e12) AS best, least(10e0, sum(gap)) AS gap, max(days) AS days, bool_or(o_open > 0) AS retained FROM p GROUP BY c)
SELECT c AS "case", retained, best.sure AS evidence_strength, best.money AS financial_materiality, best.open AS unresolved, gap AS documentation_gap, round(least(10e0, days / 365e0 * 5), 1) AS timeline_deviation, 6e0 AS independent_sources,
  round(best.sure + best.money + best.open + gap + round(least(10e0, days / 365e0 * 5), 1) + 6, 1) AS case_score FROM b""")
def case_scores(spark, d):
    """The six parts of every case's score; a customer is a case, its orders are the issues."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("explained", "artefact", "partially_explained", "insufficient_evidence", "unexplained_in_public_record"))), (k % 5 + 1).cast("int"))
    sure = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (k % 3 + 1).cast("int"))
    issues = table(spark, d, "orders").select(F.col("o_custkey").alias("case"), F.lpad(k.cast("string"), 12, "0").alias("type"), status.alias("status"), sure.alias("confidence"), (F.col("o_totalprice") * 100).alias("value_at_issue"), (k % 4).cast("int").alias("documentation_gap"), (k % 900).cast("int").alias("timeline_days"))
    sources = issues.select("case").distinct().withColumn("n_sources", F.lit(3))
    parts = ("evidence_strength", "financial_materiality", "unresolved", "documentation_gap", "timeline_deviation", "independent_sources")
    return C.scored(issues, sources).select("case", "retained", *parts, "case_score")


@R.query("""WITH f AS (SELECT o_orderkey % 400 AS work, 'm' || o_orderkey % 700 AS md5, CASE WHEN o_orderkey % 700 % 3 = 0 THEN 'Site Photo' ELSE 'Work Order' END AS type, CASE WHEN o_orderkey % 700 % 7 = 0 THEN 'blank.pdf' ELSE 'plan.pdf' END AS name, CASE WHEN o_orderkey % 700 % 5 = 0 THEN 100 ELSE 90000 END AS bytes FROM orders),
per AS (SELECT md5, list_sort(list(DISTINCT work::VARCHAR)) AS works, bool_and(bytes < 8000) OR bool_and(name = 'blank.pdf') AS empty, bool_and(type = 'Site Photo') AS photo FROM f GROUP BY md5 HAVING count(DISTINCT work) >= 2)
SELECT unnest(works) AS work, CASE WHEN empty THEN 'placeholder_reused' WHEN photo THEN 'photo_reused' ELSE 'document_reused' END AS code, CASE WHEN empty THEN 'info' ELSE 'notice' END AS severity, len(works)::DOUBLE AS measure FROM per""")
def reused_file_signals(spark, d):
    """Files that several works carry: photos, documents, and such with nothing in them."""
    k = F.col("o_orderkey")
    m = k % 700
    files = table(spark, d, "orders").select((k % 400).alias("work"), F.concat(F.lit("m"), m).alias("md5"), F.when(m % 3 == 0, "Site Photo").otherwise("Work Order").alias("type"), F.when(m % 7 == 0, "blank.pdf").otherwise("plan.pdf").alias("name"), F.when(m % 5 == 0, 100).otherwise(90_000).alias("bytes"))
    return S.reused_files(files).select("work", "code", "severity", "measure")


@R.query("""WITH b AS (SELECT DISTINCT l_orderkey % 900 AS t, 'E' || l_suppkey % 30 AS e FROM lineitem WHERE l_linenumber <= 2), w AS (SELECT t, min(e) AS won, count(*) AS n FROM b GROUP BY t),
met AS (SELECT x.e AS a, y.e AS b, count(*) AS n, list(x.t) AS ts FROM b x JOIN b y ON x.t = y.t AND x.e < y.e GROUP BY ALL HAVING count(*) >= 3),
sole AS (SELECT won AS e, count(*) AS k FROM w WHERE n = 1 GROUP BY won HAVING count(*) >= 2)
SELECT t::VARCHAR AS work, 'frequent_co_bidders' AS code, CASE WHEN n >= 4 THEN 'notice' ELSE 'info' END AS severity, CASE WHEN substr(a, 2)::INT % 2 = 0 AND substr(b, 2)::INT % 2 = 0 THEN 'confirmed' ELSE 'inferred' END AS confidence, n::DOUBLE AS measure FROM (SELECT *, unnest(ts) AS t FROM met)
UNION ALL SELECT t::VARCHAR, 'repeat_single_bid_winner', 'notice', 'confirmed', k::DOUBLE FROM w JOIN sole ON won = e WHERE n = 1""")
def bidders_of_tenders(spark, d):
    """Bidders that meet often, and those who win alone more than once; the least of a tender's bidders has won it."""
    each = table(spark, d, "lineitem").filter("l_linenumber <= 2").select((F.col("l_orderkey") % 900).alias("tender"), F.concat(F.lit("E"), F.col("l_suppkey") % 30).alias("entity")).distinct()
    won = each.groupBy("tender").agg(F.min("entity").alias("won"))
    bidder = F.struct("entity", F.when(F.col("entity") == F.col("won"), "L1").otherwise("L2").alias("rank"))
    tenders = each.join(won, "tender").groupBy("tender").agg(F.collect_list(bidder).alias("bidders"))
    entities = each.select("entity").distinct().withColumn("basis", F.when(F.substring("entity", 2, 9).cast("int") % 2 == 0, "confirmed").otherwise("inferred"))
    return S.bidder_signals(tenders, tenders.select(F.col("tender").alias("work"), "tender"), entities).drop("related")


@R.query("""SELECT work::VARCHAR AS work, 'photo_gps_outside_area' AS code, min(p)::DOUBLE AS measure FROM (SELECT l_orderkey AS work, l_linenumber AS p, 12.9 + (l_partkey % 100) / 1000e0 AS lat, 77.6 + (l_suppkey % 80) / 1000e0 AS lon FROM lineitem WHERE l_returnflag <> 'N')
WHERE NOT (lat BETWEEN 12.92 AND 12.98 AND lon BETWEEN 77.61 AND 77.67) GROUP BY work""")
def photos_outside_the_area(spark, d):
    shown = F.col("l_returnflag") != "N"
    photos = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.when(shown, 12.9 + (F.col("l_partkey") % 100) / 1000).alias("lat"), F.when(shown, 77.6 + (F.col("l_suppkey") % 80) / 1000).alias("lon"), F.col("l_linenumber").alias("position"))
    return S.photos_outside(photos, 12.92, 12.98, 77.61, 77.67).select("work", "code", "measure")


@R.query("""WITH x AS (SELECT l_orderkey AS job, 'b' || l_partkey AS bill, l_linestatus = 'F' AS paid, l_returnflag = 'R' AS final, CASE WHEN l_suppkey % 4 = 0 THEN 'M.B.' ELSE 'Letter' END AS type, CASE l_partkey % 5 WHEN 0 THEN 'nil.pdf' WHEN 1 THEN 'measurement 1' ELSE 'page' END AS name, l_linenumber > 1 AS own FROM lineitem),
j AS (SELECT job, count(DISTINCT bill) FILTER (final AND paid) AS finals, count(*) FILTER (type = 'M.B.' AND name <> 'nil.pdf') AS real, bool_or(own) AS own, count(*) FILTER (type <> 'M.B.' AND name = 'measurement 1') AS elsewhere FROM x GROUP BY job)
SELECT job::VARCHAR AS work, 'final_bill_without_mb' AS code, 'notice' AS severity, 'confirmed' AS confidence, finals::DOUBLE AS measure FROM j WHERE finals > 0 AND real = 0 AND own AND elsewhere = 0""")
def final_bills_without_books(spark, d):
    """Jobs with a paid final bill and no measurement book under any name."""
    name = F.when(F.col("l_partkey") % 5 == 0, "nil.pdf").when(F.col("l_partkey") % 5 == 1, "measurement 1").otherwise("page")
    file = F.struct(name.alias("name"), F.when(F.col("l_suppkey") % 4 == 0, "M.B.").otherwise("Letter").alias("type"), F.when(F.col("l_linenumber") > 1, "bill_files").otherwise("wo_files").alias("listing"))
    listing = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.concat(F.lit("b"), "l_partkey").alias("bill"), F.when(F.col("l_returnflag") == "R", "Final").otherwise("Running").alias("bill_type"), (F.col("l_linestatus") == "F").alias("paid"), F.array(file).alias("files"))
    return S.final_without_book(S.measurement_books(listing)).drop("related")


QUERIES, ORACLE_SQL = R.queries, R.sql
