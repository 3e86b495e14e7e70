"""Relational operators of the register pipeline on the driver's tables: joins, aggregates, windows, sets, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from worksight.plans.rules import MONEY
from worksight.registry import Registry
from worksight.tables import dealt, table

R = Registry()
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_LINES = ", ".join(LINE_ORDER)


def money(c: str):
    return F.col(c).cast(MONEY)


@R.query(f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {_LINES}) AS ord FROM lineitem),
k AS (SELECT ord, 'P' || l_orderkey || ':' || l_partkey AS key FROM r UNION ALL SELECT ord, 'S' || l_orderkey || ':' || l_suppkey || ':' || l_linestatus FROM r),
f AS (SELECT ord, ord = min(ord) OVER (PARTITION BY key) AS first FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r JOIN (SELECT ord FROM f GROUP BY ord HAVING bool_and(first)) USING (ord)""")
def dedupe_first_seen(spark, d):
    """A row stays if it is the first of every key that it carries; dropped rows still claim theirs.

    All keys name the order, so rows are dealt by it once and each key is a window within; a key with a NULL in it is none.
    """
    ord, keys = F.struct(*LINE_ORDER), (("l_orderkey", "l_partkey"), ("l_orderkey", "l_suppkey", "l_linestatus"))
    rows = table(spark, d, "lineitem").select(*LINE_ORDER).repartition("l_orderkey").distinct()
    known = [F.concat(*key).isNotNull() for key in keys]
    first = [~own | (ord == F.min(ord).over(W.partitionBy(*key))) for own, key in zip(known, keys)]
    kept = rows.withColumns({"keyed": known[0] | known[1], "first": first[0] & first[1]}).filter("keyed AND first")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@R.query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY md5(text)")
def dedupe_exact_documents(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@R.query("""SELECT digest, n_sources, n_docs FROM (SELECT md5(text) AS digest, count(DISTINCT source) AS n_sources, count(*) AS n_docs FROM documents GROUP BY 1) WHERE n_sources >= 2""")
def document_reuse_groups(spark, d):
    """Files found under two or more sources."""
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_docs")).filter("n_sources >= 2")


@R.query("SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier")
def union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


@R.query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@R.query("SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersect_customers(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderpriority LIKE '1%'").select("o_custkey").intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@R.query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_pairs(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@R.query("""SELECT l_orderkey, count(*) AS n_bills, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS gross, min(l_shipdate)::DATE::VARCHAR AS first_payment, max(l_shipdate)::DATE::VARCHAR AS last_payment,
array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS bill_types, bool_and(l_linestatus = 'F') AS all_final FROM lineitem GROUP BY l_orderkey""")
def job_rollup(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_bills"), F.sum(money("l_extendedprice")).cast("double").alias("gross"), F.min("l_shipdate").cast("date").cast("string").alias("first_payment"), F.max("l_shipdate").cast("date").cast("string").alias("last_payment"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("bill_types"), F.bool_and(F.col("l_linestatus") == "F").alias("all_final"),
    )


@R.query("""SELECT l_suppkey, l_returnflag AS modal FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first) AS r FROM
(SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2)) WHERE r = 1""")
def modal_value(spark, d):
    """Most common value; of equally common ones that seen first."""
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    return n.groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.struct("n", -F.col("first"))).alias("modal"))


@R.query("""WITH s AS (SELECT l_orderkey, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS paid FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY paid DESC, l_suppkey) AS rank, count(*) OVER (PARTITION BY l_orderkey) AS n FROM s)
SELECT l_orderkey, l_suppkey AS payee, paid::DOUBLE AS paid, n - 1 AS n_others FROM r WHERE rank = 1""")
def top_payee_ranked(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum(money("l_extendedprice")).alias("paid"))
    best = s.groupBy("l_orderkey").agg(F.max_by(F.struct("l_suppkey", "paid"), F.struct("paid", -F.col("l_suppkey"))).alias("top"), (F.count("*") - 1).alias("n_others"))
    return best.select("l_orderkey", F.col("top.l_suppkey").alias("payee"), F.col("top.paid").cast("double").alias("paid"), "n_others")


@R.query("""SELECT l_suppkey, v[len(v) // 2 + 1] AS upper_median FROM (SELECT l_suppkey, list_sort(list(date_diff('day', o_orderdate, l_shipdate))) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)""")
def upper_median(spark, d):
    """Middle value, the upper one of two, of the days from order to payment."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("lag"))
    n = rows.groupBy("l_suppkey", "lag").agg(F.count("*").alias("n"))  # whole days, so a group holds few values
    w = W.partitionBy("l_suppkey").orderBy("lag")
    at = n.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(W.partitionBy("l_suppkey"))})
    return at.filter("upto > total div 2").groupBy("l_suppkey").agg(F.min("lag").alias("upper_median"))


@R.query("""SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (month(l_shipdate) = 3 AND day(l_shipdate) >= 15)::DOUBLE AS year_end, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total FROM lineitem GROUP BY 1""")
def conditional_sum_year_end(spark, d):
    late = (F.month("l_shipdate") == 3) & (F.dayofmonth("l_shipdate") >= 15)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(late, money("l_extendedprice"))).cast("double").alias("year_end"), F.sum(money("l_extendedprice")).cast("double").alias("total"))


@R.query("""SELECT l_suppkey, day, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, day) AS r FROM (SELECT l_suppkey, l_shipdate::DATE::VARCHAR AS day, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r = 1 AND n >= 3""")
def payment_burst(spark, d):
    days = table(spark, d, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy("l_suppkey").agg(F.max_by(F.struct("day", "n"), F.struct("n", -F.unix_date(F.to_date("day")))).alias("b")).select("l_suppkey", "b.day", "b.n").filter("n >= 3")


@R.query("""SELECT l_suppkey, n_works, amount::DOUBLE AS amount, round(CAST(amount AS DOUBLE) / CAST(sum(amount) OVER () AS DOUBLE), 6) AS share FROM
(SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_works, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY 1)""")
def contractor_concentration(spark, d):
    rows = table(spark, d, "lineitem")
    per = rows.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n_works"), F.sum(money("l_extendedprice")).alias("amount"))
    total = rows.agg(F.sum(money("l_extendedprice")).alias("total"))
    return per.join(F.broadcast(total)).select("l_suppkey", "n_works", F.col("amount").cast("double").alias("amount"), F.round(F.col("amount").cast("double") / F.col("total").cast("double"), 6).alias("share"))  # one row


@R.query("""WITH b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3""")
def co_bidding_pairs(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    n = lines.count()
    b = dealt(lines, n, 250_000, "l_orderkey").distinct()
    pairs = b.join(b.withColumnRenamed("l_suppkey", "b"), "l_orderkey").filter("l_suppkey < b").select(F.col("l_suppkey").alias("a"), "b")
    return dealt(pairs, n, 250_000, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).filter("n >= 3")


@R.query("SELECT l_orderkey, min(l_suppkey) AS bidder FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def single_bidder(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("bidder")).filter("n = 1").select("l_orderkey", "bidder")


@R.query("SELECT bidder, count(*) AS n_wins FROM (SELECT l_orderkey, min(l_suppkey) AS bidder FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) GROUP BY 1 HAVING count(*) >= 2")
def repeat_single_winner(spark, d):
    return single_bidder(spark, d).groupBy("bidder").agg(F.count("*").alias("n_wins")).filter("n_wins >= 2")


@R.query("""SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS TINYINT) AS g_status, CAST(grouping(o_orderpriority) AS TINYINT) AS g_priority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def facets_grouping_sets(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("worksight_orders")
    return spark.sql("""SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g_status, grouping(o_orderpriority) AS g_priority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers
        FROM worksight_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")


@R.query("""SELECT count(*) AS n_works, count(*) FILTER (o_orderstatus = 'F') AS n_completed, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS contract_value, count(DISTINCT o_custkey) AS n_departments, min(o_orderdate)::DATE::VARCHAR AS first_date, max(o_orderdate)::DATE::VARCHAR AS last_date FROM orders""")
def headline_kpis(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n_works"), F.count_if(F.col("o_orderstatus") == "F").alias("n_completed"), F.sum(money("o_totalprice")).cast("double").alias("contract_value"), F.countDistinct("o_custkey").alias("n_departments"), F.min("o_orderdate").cast("date").cast("string").alias("first_date"), F.max("o_orderdate").cast("date").cast("string").alias("last_date"))


@R.query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice >= 200000) AS n_large, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total FROM orders GROUP BY 1""")
def list_summary(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") >= 200000).alias("n_large"), F.sum(money("o_totalprice")).cast("double").alias("total"))


@R.query("SELECT year(l_shipdate)::INT AS year, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS paid, count(*) AS n FROM lineitem GROUP BY 1")
def payments_by_year(spark, d):
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.sum(money("l_extendedprice")).cast("double").alias("paid"), F.count("*").alias("n"))


@R.query("SELECT p_type AS category, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS paid, count(DISTINCT l_orderkey) AS n_works FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def payments_by_category(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("category")).agg(F.sum(money("l_extendedprice")).cast("double").alias("paid"), F.countDistinct("l_orderkey").alias("n_works"))


@R.query("""WITH s AS (SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS paid FROM lineitem GROUP BY 1), r AS (SELECT paid, row_number() OVER (ORDER BY paid DESC, l_suppkey) AS r FROM s)
SELECT CASE WHEN r = 1 THEN 'top' WHEN r <= 10 THEN 'next9' ELSE 'rest' END AS bucket, sum(paid)::DOUBLE AS paid, count(*) AS n FROM r GROUP BY 1""")
def share_top_next9_rest(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(money("l_extendedprice")).alias("paid"))
    top = s.orderBy(F.desc("paid"), "l_suppkey").limit(10)  # ten rows; the share of the rest needs no rank
    ranked = top.withColumn("r", F.row_number().over(W.orderBy(F.desc("paid"), "l_suppkey"))).select("l_suppkey", "r")
    bucket = F.when(F.col("r") == 1, "top").when(F.col("r") <= 10, "next9").otherwise("rest").alias("bucket")
    return s.join(F.broadcast(ranked), "l_suppkey", "left").groupBy(bucket).agg(F.sum("paid").cast("double").alias("paid"), F.count("*").alias("n"))


@R.query("SELECT o_custkey, o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM orders")
def running_payments(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum(money("o_totalprice")).over(w).cast("double").alias("running"))


@R.query(f"SELECT l_orderkey, l_linenumber, l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, {_LINES} ROWS UNBOUNDED PRECEDING)::DOUBLE AS cumulative FROM lineitem")
def cumulative_bill_gross(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_shipdate", *LINE_ORDER).rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.sum(money("l_extendedprice")).over(w).cast("double").alias("cumulative"))


@R.query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS last_final FROM orders GROUP BY 1""")
def first_last_in_group(spark, d):
    key = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", key).alias("first_order"), F.max_by("o_orderkey", key).alias("last_order"), F.max_by(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), F.when(F.col("o_orderstatus") == "F", key)).alias("last_final"))


@R.query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, min(l_shipdate) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS final FROM lineitem) WHERE l_returnflag <> 'R' AND l_shipdate > final""")
def bills_after_final(spark, d):
    rows = table(spark, d, "lineitem")
    final = rows.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("final"))
    return rows.filter("l_returnflag <> 'R'").join(final, "l_orderkey").filter("l_shipdate > final").select("l_orderkey", "l_linenumber", "l_partkey")


@R.query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_turn FROM conversations""")
def forward_fill(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("last_user_turn"))


@R.query("SELECT conv_id, turn, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def lag_lead_context(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("previous_role"), F.lead("role").over(w).alias("next_role"))


@R.query("""SELECT conv_id, part, count(*) AS n_turns, min(turn) AS first_turn FROM (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM conversations) GROUP BY 1, 2""")
def group_by_start_marker(spark, d):
    """Wrapped records are joined: each start marker opens a group."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    rows = table(spark, d, "conversations").withColumn("part", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    return rows.groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"))


@R.query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_final, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS has_large FROM customer""")
def flags_exists(spark, d):
    flags = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_totalprice") > 300000).alias("l"))
    return table(spark, d, "customer").join(flags, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_final"), F.coalesce("l", F.lit(False)).alias("has_large"))


@R.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_in(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_not_exists(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@R.query("SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_bills, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_works FROM supplier")
def source_usage_scalar(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("b"), F.countDistinct("l_orderkey").alias("w"))
    zero = F.lit(0).cast("long")
    return table(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("b", zero).alias("n_bills"), F.coalesce("w", zero).alias("n_works"))


@R.query("""SELECT coalesce(s_name, 'unresolved') AS payee, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS paid FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey GROUP BY 1""")
def left_join_coalesce_group(spark, d):
    known = table(spark, d, "supplier").filter("s_acctbal > 0")
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(money("l_extendedprice")).alias("paid"))
    return per.join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy(F.coalesce("s_name", F.lit("unresolved")).alias("payee")).agg(F.sum("n").alias("n"), F.sum("paid").cast("double").alias("paid"))


@R.query("""WITH c AS (SELECT o_orderkey, l_partkey, l_linenumber, CASE WHEN l_shipdate::DATE = o_orderdate::DATE THEN 1 WHEN abs(l_extendedprice - o_totalprice) < 20000 THEN 2 ELSE 3 END AS prio FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, prio, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY prio, l_linenumber, l_partkey) AS r FROM c) WHERE r = 1 AND prio < 3""")
def cascade_match(spark, d):
    """First of exact key, then date, then amount within a band."""
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    prio = F.when(F.to_date("l_shipdate") == F.to_date("o_orderdate"), 1).when(F.abs(F.col("l_extendedprice") - F.col("o_totalprice")) < 20000, 2)
    return both.withColumn("prio", prio).filter("prio IS NOT NULL").groupBy("o_orderkey").agg(F.min(F.struct("prio", "l_linenumber", "l_partkey")).alias("m")).select("o_orderkey", "m.prio", "m.l_partkey", "m.l_linenumber")


@R.query("""SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND abs(l_extendedprice / l_quantity - p_retailprice) <= 0.35 * p_retailprice""")
def band_join_rate(spark, d):
    near = F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")) <= 0.35 * F.col("p_retailprice")
    return table(spark, d, "lineitem").join(table(spark, d, "part"), (F.col("l_partkey") == F.col("p_partkey")) & near).select("l_orderkey", "l_linenumber", "p_partkey")


@R.query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON substr(a.s_name, 1, 17) = substr(b.s_name, 1, 17) AND a.s_suppkey < b.s_suppkey AND starts_with(b.s_name, substr(a.s_name, 1, 17))")
def prefix_join(spark, d):
    """Names cut short by a source: equal over the first letters."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.substring("s_name", 1, 17).alias("head"))
    b = s.select(F.col("s_suppkey").alias("b"), F.col("s_name").alias("b_name"), "head")
    return s.join(b, "head").filter((F.col("s_suppkey") < F.col("b")) & F.col("b_name").startswith(F.col("head"))).select(F.col("s_suppkey").alias("a"), "b")


@R.query("SELECT l_orderkey, unnest(list_sort(list(DISTINCT l_suppkey))) AS supplier FROM lineitem GROUP BY l_orderkey")
def explode_lateral(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s")).select("l_orderkey", F.explode("s").alias("supplier"))


@R.query("""SELECT o_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING list_contains(list(l_partkey), 1) OR list_contains(list(l_partkey), 2)""")
def containment_join(spark, d):
    rows = table(spark, d, "lineitem")
    hit = rows.filter("l_partkey IN (1, 2)").select("l_orderkey").distinct()
    return rows.join(hit, "l_orderkey", "left_semi").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), ",").alias("parts"))


@R.query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'dropped' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS change, a.n AS old_n, b.n AS new_n FROM a FULL JOIN b ON a.k = b.k""")
def snapshot_diff(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_orderdate < TIMESTAMP_NTZ '1997-01-01'").groupBy("o_custkey").agg(F.count("*").alias("old_n"))
    new = o.filter("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'").groupBy("o_custkey").agg(F.count("*").alias("new_n"))
    return diff(old, new, "o_custkey", ["old_n"], ["new_n"]).withColumnRenamed("o_custkey", "k")


def diff(old: DataFrame, new: DataFrame, key: str, old_values: list[str], new_values: list[str]) -> DataFrame:
    """Full outer comparison of two versions: added, dropped, changed or same."""
    a, b = old.withColumn("__a", F.lit(True)), new.withColumn("__b", F.lit(True))
    changed = F.lit(False)
    for x, y in zip(old_values, new_values):
        changed = changed | ~F.col(x).eqNullSafe(F.col(y))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "dropped").when(changed, "changed").otherwise("same").alias("change")
    return a.join(b, key, "full").select(key, change, *old_values, *new_values)


@R.query("""SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 0""")
def explorer_search(spark, d):
    """A page of the explorer: equality facets, a membership facet, a named order."""
    return explore(table(spark, d, "orders"), {"o_orderpriority": "2-HIGH", "o_orderstatus": "O"}, [(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


def explore(rows: DataFrame, equal: dict, members: list, order: list, page: int, per_page: int = 50, text: str | None = None, words: str = "") -> DataFrame:
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == value)
    for word in words.lower().split():
        rows = rows.filter(F.col(text).contains(word))
    for keys, column in members:
        rows = rows.join(keys, column, "left_semi")
    return rows.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


@R.query("SELECT l_suppkey, paid::DOUBLE AS paid FROM (SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS paid FROM lineitem GROUP BY 1) ORDER BY paid DESC, l_suppkey LIMIT 30")
def topk_contractors(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(money("l_extendedprice")).alias("p")).orderBy(F.desc("p"), "l_suppkey").limit(30).select("l_suppkey", F.col("p").cast("double").alias("paid"))


@R.query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {_LINES}) AS r FROM lineitem) ORDER BY r, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def round_robin_files(spark, d):
    """The best file of every bill before the second of any."""
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), *LINE_ORDER)
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).orderBy("r", "l_orderkey", "l_linenumber", "l_partkey").limit(20).select("l_orderkey", "l_linenumber", "l_partkey")


@R.query("""WITH p AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS paid, max(l_shipdate) AS last FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'planned' AS stage, 'estimated_cost' AS field, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value, 'confirmed' AS confidence FROM orders UNION ALL
SELECT o_orderkey, 'money', 'payments_gross', CAST(paid AS VARCHAR), CASE WHEN paid IS NULL THEN 'unknown' ELSE 'confirmed' END FROM orders LEFT JOIN p ON o_orderkey = l_orderkey UNION ALL
SELECT o_orderkey, 'money', 'last_payment', CAST(last::DATE AS VARCHAR), CASE WHEN last IS NULL THEN 'unknown' ELSE 'confirmed' END FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def facts_long(spark, d):
    """Facts as rows; a fact without a value is unknown."""
    paid = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("paid"), F.max("l_shipdate").alias("last"))
    wide = table(spark, d, "orders").join(paid, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    fact = lambda stage, field, value: F.struct(F.lit(stage).alias("stage"), F.lit(field).alias("field"), value.cast("string").alias("value"), F.when(value.isNull(), "unknown").otherwise("confirmed").alias("confidence"))
    facts = F.array(fact("planned", "estimated_cost", money("o_totalprice")), fact("money", "payments_gross", F.col("paid")), fact("money", "last_payment", F.to_date("last")))
    return wide.select("o_orderkey", F.explode(facts).alias("f")).select("o_orderkey", "f.*")


@R.query("""WITH p AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS final FROM lineitem GROUP BY 1)
SELECT count(*) AS planned, count(*) FILTER (o_orderstatus <> 'O') AS awarded, count(*) FILTER (n IS NOT NULL) AS paid, count(*) FILTER (final) AS completed FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def lifecycle_funnel(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("final"))
    rows = table(spark, d, "orders").join(p, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.agg(F.count("*").alias("planned"), F.count_if(F.col("o_orderstatus") != "O").alias("awarded"), F.count_if(F.col("l_orderkey").isNotNull()).alias("paid"), F.count_if("final").alias("completed"))


@R.query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_quantity * p_retailprice - l_extendedprice) <= greatest(2, 0.005 * l_extendedprice)")
def arithmetic_rows(spark, d):
    """Rows whose quantity times rate gives their amount."""
    near = F.abs(F.col("l_quantity") * F.col("p_retailprice") - F.col("l_extendedprice")) <= F.greatest(F.lit(2.0), 0.005 * F.col("l_extendedprice"))
    return table(spark, d, "lineitem").join(table(spark, d, "part"), (F.col("l_partkey") == F.col("p_partkey")) & near).select("l_orderkey", "l_linenumber", "l_partkey")


@R.query("""SELECT p_partkey, billed, round(billed / (100.0 * p_size), 6) AS ratio, CASE WHEN billed / (100.0 * p_size) > 1.25 THEN 'billed_above_plan' WHEN billed / (100.0 * p_size) < 0.75 THEN 'measured_below_plan' ELSE 'within' END AS verdict
FROM part JOIN (SELECT l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS billed FROM lineitem GROUP BY 1) ON p_partkey = l_partkey WHERE p_size > 0""")
def plan_vs_billed(spark, d):
    billed = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("billed"))
    ratio = F.col("billed") / (100.0 * F.col("p_size"))
    verdict = F.when(ratio > 1.25, "billed_above_plan").when(ratio < 0.75, "measured_below_plan").otherwise("within")
    return table(spark, d, "part").filter("p_size > 0").join(billed, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "billed", F.round(ratio, 6).alias("ratio"), verdict.alias("verdict"))


QUERIES, ORACLE_SQL = R.queries, R.sql
