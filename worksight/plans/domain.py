"""Operators of works on the driver's tables: orders are works, their lines bills, customers and suppliers contractors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.functions import amounts as A
from worksight.functions import dates as D
from worksight.functions import text as T
from worksight.operators import dataset_signals as S
from worksight.operators import explorer as X
from worksight.operators import scope
from worksight.operators.facts import FINAL, RUNNING, base_facts
from worksight.registry import Registry
from worksight.storage import components
from worksight.streaming import admit_all
from worksight.tables import table

R = Registry()


def _projects(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        key.alias("id"), F.format_string("w-%d", key).alias("slug"), F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("search_text"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("D"), (F.col("o_custkey") % 7).cast("string")).alias("department"), F.when(key % 3 == 0, "exact").when(key % 3 == 1, "medium").alias("link_confidence"), (key % 7).cast("int").alias("lifecycle"),
        F.to_date("o_orderdate").cast("string").alias("last_activity"), F.lit(None).cast("string").alias("first_date"), F.to_date("o_orderdate").cast("string").alias("tender_published"),
        F.when(key % 5 != 0, F.col("o_totalprice")).alias("payments_gross"), F.when(key % 2 == 0, F.col("o_totalprice") * 2).alias("contract_value"), F.lit(0.0).alias("estimated_cost"), (key % 4).cast("int").alias("n_bills"),
        F.when(key % 2 == 0, "T").otherwise("").alias("tender_numbers"), F.element_at(F.array(F.lit("info"), F.lit("notice"), F.lit("attention")), (key % 3 + 1).cast("int")).alias("signal_level"), (key % 9).cast("int").alias("n_signals"),
    )


def _signals(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.concat("l_returnflag", "l_linestatus").alias("code"), F.when(F.col("l_linenumber") == 1, "notice").otherwise("info").alias("severity"))


_PROJECTS = """WITH p AS (SELECT o_orderkey AS id, lower(o_orderpriority || ' ' || o_orderstatus) AS search_text, o_orderpriority AS category, o_orderstatus AS status, 'D' || (o_custkey % 7) AS department,
  CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'medium' END AS link, o_orderkey % 7 AS lifecycle, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS paid,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 END AS contract, o_orderkey % 4 AS n_bills, o_orderkey % 2 = 0 AS tendered, o_orderkey % 3 AS level FROM orders)"""


@R.query(f"""{_PROJECTS} SELECT 'category' AS facet, category AS value, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'dept', department, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'link', link, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'signal', l_returnflag || l_linestatus, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 2""")
def explorer_facets(spark, d):
    """All five facets, four of them in one pass over the works."""
    return X.facets(_projects(spark, d), _signals(spark, d))


@R.query(f"""{_PROJECTS} SELECT count(*) AS n, sum(CAST(paid AS DECIMAL(18,2)))::DOUBLE AS paid, sum(CAST(contract AS DECIMAL(18,2)))::DOUBLE AS contract, count(*) FILTER (paid <> 0) AS n_paid, count(*) FILTER (contract <> 0) AS n_contract,
count(*) FILTER (lifecycle = 6) AS n_full, count(*) FILTER (n_bills <> 0 AND tendered) AS n_linked, count(*) FILTER (level IN (1, 2)) AS n_flagged
FROM p WHERE contains(search_text, '-') AND contains(search_text, 'f') AND link = 'exact' AND lifecycle >= 2 AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')""")
def explorer_filtered_summary(spark, d):
    """Words, a facet, a depth and a signal together, then what the list says of itself."""
    return X.summary(X.search(_projects(spark, d), _signals(spark, d), q="- F", link="exact", depth="2", signal="RF"))


def _sorted_page(order: str) -> str:
    return f"""{_PROJECTS} SELECT id, category FROM (SELECT *, row_number() OVER (ORDER BY {order}, id) AS r FROM p) WHERE r BETWEEN 51 AND 100"""


@R.query(_sorted_page("greatest(coalesce(paid, 0), coalesce(contract, 0)) DESC"))
def explorer_page_by_value(spark, d):
    return X.page(_projects(spark, d), "value", 2).select("id", "category")


@R.query(_sorted_page("CASE level WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 1 END DESC, id % 9 DESC"))
def explorer_page_by_signals(spark, d):
    return X.page(_projects(spark, d), "signals", 2).select("id", "category")


@R.query("""SELECT o_orderkey AS project_id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS has_contract, o_orderkey % 4 > 0 AS has_bills,
EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_completion, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N' AND l_linenumber > 1) AS has_photos,
EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS has_quantities, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AS has_signals,
o_orderstatus = 'P' AS has_case FROM orders""")
def project_flags_all(spark, d):
    """All seven flags; returnflags stand for facts, large quantities for work items."""
    lines = table(spark, d, "lineitem")
    field = F.when(F.col("l_returnflag") == "A", "contract_value").when(F.col("l_returnflag") == "R", "final_bill").otherwise("site_photos")
    facts = lines.select(F.col("l_orderkey").alias("project_id"), field.alias("field"), F.concat((F.col("l_linenumber") - 1).cast("string"), F.lit(" photos")).alias("value"))
    items = lines.filter("l_quantity > 45").select(F.col("l_orderkey").alias("project_id"))
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), (F.col("o_orderstatus") == "P").cast("int").alias("retained"))
    return X.project_flags(_projects(spark, d), facts, items, _signals(spark, d), cases)


@R.query(f"""WITH b AS (SELECT l_orderkey AS work, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross, min(l_shipdate::DATE) AS first, max(l_shipdate::DATE) AS last, max(l_shipdate::DATE) FILTER (l_returnflag = 'R') AS final FROM lineitem GROUP BY 1),
w AS (SELECT o_orderkey AS work, n, gross, first, last, final FROM orders LEFT JOIN b ON work = o_orderkey)
SELECT work, 'payments_gross' AS field, gross::VARCHAR AS value, CASE WHEN n IS NULL THEN 'unknown' ELSE 'confirmed' END AS confidence FROM w
UNION ALL SELECT work, 'n_bills', n::VARCHAR, 'confirmed' FROM w WHERE n > 0 UNION ALL SELECT work, 'first_payment', first::VARCHAR, 'confirmed' FROM w WHERE n > 0 UNION ALL SELECT work, 'last_payment', last::VARCHAR, 'confirmed' FROM w WHERE n > 0
UNION ALL SELECT work, 'final_bill', final::VARCHAR, 'confirmed' FROM w WHERE final IS NOT NULL
UNION ALL SELECT work, 'status', CASE WHEN final IS NOT NULL THEN '{FINAL}' ELSE '{RUNNING}' END, 'inferred' FROM w WHERE n > 0
UNION ALL SELECT work, 'completion_date', NULL, 'unknown' FROM w WHERE n > 0 UNION ALL SELECT work, 'estimated_cost', NULL, 'unknown' FROM w""")
def fact_catalogue(spark, d):
    """Facts of works from their bills alone; a work without bills has unknown ones."""
    day, none = F.to_date("l_shipdate"), F.lit(None)
    bills = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("work"), F.col("l_suppkey").cast("string").alias("contractor"), F.col("l_extendedprice").alias("gross"), none.cast("double").alias("nett"), F.lit("BR").alias("dedupe_key"),
        day.alias("payment_date"), day.alias("br_date"), none.cast("date").alias("wo_date"), none.cast("string").alias("wo_no"), none.cast("date").alias("start_date"), none.cast("date").alias("end_date"),
        F.when(F.col("l_returnflag") == "R", "Final").otherwise("Running").alias("bill_type"), F.lit("L").alias("source_id"), F.col("l_linenumber").alias("source_row"),
    )
    lists = F.array().cast("array<string>")
    works = table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), F.col("o_orderpriority").alias("title"), lists.alias("locations"), lists.alias("wards"), F.col("o_orderkey").cast("string").alias("job_number"))
    links = spark.createDataFrame([], "work long, base string, source string, exact boolean, score double, via string, tender_number string, call int, published_date date, status string, status_text string, ecv double, provisional_amount double, period_days int, period_text string, contractor string, contract_value double, negotiated_value double, awarded_date date, bidders array<struct<name string>>")
    wanted = ("payments_gross", "n_bills", "first_payment", "last_payment", "final_bill", "status", "completion_date", "estimated_cost")
    return base_facts(works, bills, links, fields=wanted).select("work", "field", "value", "confidence")


@R.query("""WITH b AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS r FROM lineitem GROUP BY 1, 2), n AS (SELECT l_orderkey, count(*) AS n FROM b GROUP BY 1)
SELECT l_suppkey AS entity, count(*) AS bids, count(*) FILTER (r = 1) AS wins, count(*) FILTER (r = 1 AND n = 1) AS single_wins FROM b JOIN n USING (l_orderkey) GROUP BY 1""")
def bid_counts(spark, d):
    """An order is a tender, its suppliers the bidders, that of the first line the winner."""
    each = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("r"))
    bidder = F.struct(F.col("l_suppkey").alias("entity"), F.concat(F.lit("L"), F.col("r").cast("string")).alias("rank"))
    return S.bid_counts(each.groupBy(F.col("l_orderkey").alias("tender")).agg(F.collect_list(bidder).alias("bidders")))


@R.query("""WITH per AS (SELECT o_custkey % 40 AS e, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS a FROM orders GROUP BY 1), s AS (SELECT *, a / sum(a) OVER () AS share FROM per)
SELECT o_orderkey::VARCHAR AS work, 'contractor_concentration' AS code, CASE WHEN e % 2 = 0 THEN 'confirmed' ELSE 'inferred' END AS confidence FROM orders JOIN s ON e = o_custkey % 40 WHERE n >= 2 AND (share >= 0.05 OR n >= 6)""")
def concentration_signals(spark, d):
    works = table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), (F.col("o_custkey") % 40).alias("entity"), F.col("o_totalprice").alias("payments_gross"), F.lit(None).cast("double").alias("contract_value"))
    entities = spark.range(40).select(F.col("id").alias("entity"), F.when(F.col("id") % 2 == 0, "confirmed").otherwise("inferred").alias("basis"))
    return S.concentration(works, entities)[0].select("work", "code", "confidence")


@R.query("SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS label FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) > 1")
def entity_components(spark, d):
    """Suppliers of a nation, each joined to the next, are one component; labels spread along the chain."""
    before = F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return components(table(spark, d, "supplier").select(before.alias("a"), F.col("s_suppkey").alias("b")).filter("a IS NOT NULL"))


def _class_sql() -> str:
    match = lambda p: "regexp_matches(t, '(?i)" + p.removeprefix("(?i)").replace("'", "''") + "')"
    parts = " + ".join(f"{match(p)}::INT" for p in scope.COMBINED_PARTS)
    rules = " ".join(f"WHEN {match(p)} THEN '{name}'" for name, p in scope.CATEGORIES)
    return f"SELECT doc_id, CASE WHEN {match(scope.NOT_A_WORK)} THEN NULL WHEN {parts} >= 2 AND NOT {match(scope.MAJOR_DRAIN)} THEN '{scope.COMBINED}' {rules} END AS category FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


@R.query(_class_sql())
def work_categories(spark, d):
    """The category that the rules give each text; most texts are no works, and many hold one of the words."""
    return table(spark, d, "documents").select("doc_id", scope.classify(F.col("text")).alias("category"))


_COMMON = ", ".join(f"'{w}'" for w in T.COMMON)


@R.query(f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: w IN ({_COMMON})))::INT AS english, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{4,}}'))::INT AS long_words FROM documents")
def readable_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.english_words(F.col("text")).alias("english"), T.long_words(F.col("text")).alias("long_words"))


@R.query("""SELECT o_orderkey, CASE WHEN x >= 1e7 THEN format('₹{:,.2f} Cr', x / 1e7) WHEN x >= 1e5 THEN format('₹{:,.2f} L', x / 1e5) ELSE format('₹{:,.0f}', x) END AS amount FROM (SELECT o_orderkey, o_totalprice * (o_orderkey % 3) * 100 AS x FROM orders)""")
def shown_amounts(spark, d):
    x = F.col("o_totalprice") * (F.col("o_orderkey") % 3) * 100
    return table(spark, d, "orders").select("o_orderkey", T.rupees(x).alias("amount"))


@R.query("SELECT l_orderkey, l_linenumber, l_extendedprice AS price, CASE WHEN l_linenumber % 2 = 0 THEN 'sqm' ELSE 'cum' END AS unit FROM lineitem")
def read_numbers_and_units(spark, d):
    """Prices printed with grouping and units in other spellings are read back."""
    unit = F.when(F.col("l_linenumber") % 2 == 0, "Sq.m").otherwise("Cum.")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.number(F.format_number("l_extendedprice", 2)).alias("price"), A.unit(unit).alias("unit"))


@R.query("SELECT o_orderkey, (o_orderdate + INTERVAL 20 YEAR)::DATE::VARCHAR AS day, (o_orderdate + INTERVAL 20 YEAR)::DATE::VARCHAR AS ordered, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE)::VARCHAR AS quarter_end FROM orders")
def read_dates(spark, d):
    """Days printed as documents and orders do are read back."""
    later = F.add_months(F.to_date("o_orderdate"), 240)
    short, spaced = F.date_format(later, "d/M/yy"), F.date_format(later, "d . M . yyyy")
    return table(spark, d, "orders").select("o_orderkey", D.document_date(short).cast("string").alias("day"), D.order_date(spaced).cast("string").alias("ordered"), D.quarter_end(F.to_date("o_orderdate")).cast("string").alias("quarter_end"))


@R.query()
def rate_limit_admission(spark, d):
    """Exact admission of events, ten an hour and user. Without SQL: it depends on earlier admissions; tests hold it against the plain form."""
    return admit_all(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 10, 3600, "event_id")


QUERIES, ORACLE_SQL = R.queries, R.sql
