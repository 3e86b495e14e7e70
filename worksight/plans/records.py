"""Parsing, text, event-time and privacy operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from worksight.functions import parsing as P
from worksight.operators.cosine import cosine_pairs
from worksight.registry import Registry
from worksight.tables import table

R = Registry()


@R.query("""SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS dashed, o_orderdate::DATE::VARCHAR AS named, CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2035 THEN o_orderdate::DATE::VARCHAR END AS checked FROM orders""")
def parse_dates(spark, d):
    rows = table(spark, d, "orders")
    text = lambda layout: F.date_format("o_orderdate", layout)
    return rows.select("o_orderkey", P.parse_date(text("d/M/yyyy"), 1900, 2100).cast("string").alias("dashed"), P.parse_date(F.upper(text("d-MMM-yyyy")), 1900, 2100).cast("string").alias("named"), P.parse_date(F.concat(text("dd-MM-yyyy"), F.lit(" 10:56:36"))).cast("string").alias("checked"))


@R.query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, NULL::DOUBLE AS bad FROM orders")
def parse_money(spark, d):
    text = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    return table(spark, d, "orders").select("o_orderkey", P.money(F.concat(F.lit(" "), text)).cast("double").alias("amount"), P.money(F.lit("nan")).cast("double").alias("bad"))


@R.query("""SELECT o_orderkey, printf('%03d-%02d-%06d', o_custkey % 1000, o_orderkey % 100, o_orderkey % 1000000) AS job, regexp_replace(o_orderpriority, '[^A-Z0-9]', '', 'g') AS reference FROM orders""")
def normalise_key(spark, d):
    job = F.format_string(" %03d-%02d-%06d ", F.col("o_custkey") % 1000, F.col("o_orderkey") % 100, F.col("o_orderkey") % 1000000)
    return table(spark, d, "orders").select("o_orderkey", P.norm_job(job).alias("job"), P.norm_reference(F.col("o_orderpriority")).alias("reference"))


@R.query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), '') AS title, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def parse_html_record(spark, d):
    return table(spark, d, "pages").select("page_id", F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " ")), F.lit("")).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).cast("long").alias("n_paragraphs"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@R.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.query(r"""SELECT token, count(*) AS df FROM (SELECT DISTINCT item_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('of', 'the', 'and', 'in', 'to', 'at', 'for', 'from', 'with', 'on', 'by', 'no') AND NOT regexp_matches(w, '^\d{5,}$'))) AS token FROM benchmark) GROUP BY 1""")
def tokens_document_frequency(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.array_distinct(P.content_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@R.query(r"""SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('of', 'the', 'and', 'in', 'to', 'at', 'for', 'from', 'with', 'on', 'by', 'no') AND NOT regexp_matches(w, '^\d{5,}$'))) AS token FROM documents) GROUP BY 1""")
def corpus_document_frequency(spark, d):
    return table(spark, d, "documents").select(F.explode(F.array_distinct(P.content_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@R.query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('of', 'the', 'and', 'in', 'to', 'at', 'for', 'from', 'with', 'on', 'by', 'no') AND NOT regexp_matches(w, '^\d{5,}$'))) AS w FROM documents WHERE n_chars <= 400),
tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
v AS (SELECT doc_id, w, tf * ln((1 + n) / (1 + df)::DOUBLE) AS x, df FROM tf JOIN df USING (w), n), l AS (SELECT doc_id, sqrt(sum(x * x)) AS len FROM v GROUP BY 1)
SELECT a, b, CAST(round(dot / (la.len * lb.len), 4) AS DECIMAL(8,4))::DOUBLE AS cosine FROM (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.x * y.x) AS dot FROM v x JOIN v y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING bool_or(x.df <= 20))
JOIN l la ON a = la.doc_id JOIN l lb ON b = lb.doc_id WHERE dot / (la.len * lb.len) >= 0.5""")
def tfidf_cosine_pairs(spark, d):
    """Short texts with alike weighted words; pairs share at least one word that few texts have."""
    words = table(spark, d, "documents").filter("n_chars <= 400").select("doc_id", F.explode(P.content_tokens(F.col("text"))).alias("w"))
    tf = words.groupBy("doc_id", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    n = tf.agg(F.countDistinct("doc_id").alias("n"))
    v = tf.join(df, "w").join(F.broadcast(n)).select("doc_id", "w", (F.col("tf") * F.log((1 + F.col("n")) / (1 + F.col("df")))).alias("x"), "df")  # one row
    rare = v.filter("df <= 20").select("doc_id", "w")
    pairs = rare.join(rare.withColumnRenamed("doc_id", "b"), "w").filter("doc_id < b").select(F.col("doc_id").alias("a"), "b").distinct()
    left, right = v.select(F.col("doc_id").alias("a"), "w", F.col("x").alias("xa")), v.select(F.col("doc_id").alias("b"), "w", F.col("x").alias("xb"))
    dot = pairs.join(left, "a").join(right, ["b", "w"]).groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    length = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    la, lb = length.select(F.col("doc_id").alias("a"), F.col("len").alias("la")), length.select(F.col("doc_id").alias("b"), F.col("len").alias("lb"))
    cosine = F.col("dot") / (F.col("la") * F.col("lb"))
    return dot.join(la, "a").join(lb, "b").filter(cosine >= 0.5).select("a", "b", F.round(cosine, 4).alias("cosine"))


@R.query()
def tfidf_cosine_pairs_whole(spark, d):
    """All pairs over all whole texts. Without SQL: joining all words is too slow; tests hold it against brute force."""
    return cosine_pairs(table(spark, d, "documents").select("doc_id", "text"))


@R.query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)password|secret|token') THEN 'names a credential' WHEN lang = 'de' THEN 'by language' END AS reason,
CASE WHEN regexp_matches(text, '[|] .* [|]') THEN 'table' WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'symbols' ELSE 'prose' END AS kind FROM documents""")
def scope_reason_classify(spark, d):
    """First matching rule of a ladder names the reason and the class."""
    reason = F.when(F.col("text").rlike("(?i)password|secret|token"), "names a credential").when(F.col("lang") == "de", "by language")
    kind = F.when(F.col("text").rlike("[|] .* [|]"), "table").when(F.col("text").rlike("[#*$%&]{3}"), "symbols").otherwise("prose")
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"), kind.alias("kind"))


_MASKED = r"""regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[e-mail removed]', 'g'), '\+?\d{0,2} ?\(\d{3}\) ?\d{3}-\d{4}', '[number removed]', 'g')"""


@R.query(r"SELECT 'text' AS column_name, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n_mail, count(*) FILTER (regexp_matches(text, '\(\d{3}\) ?\d{3}-\d{4}')) AS n_numbers FROM documents")
def leak_scan(spark, d):
    return table(spark, d, "documents").agg(F.count_if(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).alias("n_mail"), F.count_if(F.col("text").rlike(r"\(\d{3}\) ?\d{3}-\d{4}")).alias("n_numbers")).select(F.lit("text").alias("column_name"), "n_mail", "n_numbers")


# DuckDB has no look-behind or look-ahead: the characters beside a number are captured and put back. One after a number may stand
# before the next, so the rule runs twice; addresses of web pages are put aside, as P.scrub does.
_MOBILE = r"(^|[^0-9])(?:\+?91[- ]?)?[6-9]\d{9}([^0-9]|$)"
_MASK_GAP = _MASKED.replace("(text,", "(gaps[i + 1],")
for _ in range(2):
    _MASK_GAP = rf"regexp_replace({_MASK_GAP}, '{_MOBILE}', '\1[number removed]\2', 'g')"


_SCRUBBED = rf"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, 'https?://[^ \t\n\x0B\f\r]+') AS urls, string_split_regex(text, 'https?://[^ \t\n\x0B\f\r]+') AS gaps FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN md5(array_to_string(list_transform(range(len(gaps)), lambda i: {_MASK_GAP} || coalesce(urls[i + 1], '')), '')) END AS digest FROM s"""


@R.query(_SCRUBBED)
def scrub_pii(spark, d):
    """Every document, null for null, under all three masks."""
    return table(spark, d, "documents").select("doc_id", F.md5(P.scrub(F.col("text"))).alias("digest"))


@R.query(_SCRUBBED)
def scrub_pii_whole(spark, d):
    """The same under the name that it had while scrub_pii left documents out."""
    return scrub_pii(spark, d)


@R.query()
def leak_scan_whole(spark, d):
    """Texts with each of the reference's three patterns outside web addresses. Without SQL: DuckDB has no look-behind."""
    text = F.regexp_replace("text", r"(?U)https?://\S+", " ")
    counts = [F.count_if(text.rlike(p)).alias(n) for n, p in P.LEAKS]
    return table(spark, d, "documents").agg(*counts).select(F.lit("text").alias("column_name"), *(n for n, _ in P.LEAKS))


@R.query("SELECT date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS quarter, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total FROM orders GROUP BY 1")
def quarter_windows(spark, d):
    return table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).cast("string").alias("quarter")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@R.query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@R.query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS arrivals FROM events""")
def sliding_arrivals(spark, d):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    w = W.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)
    return table(spark, d, "events").withColumn("s", seconds).select("event_id", F.count("*").over(w).alias("arrivals"))


@R.query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""")
def sessionised_events(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL '1' DAY"), 0).otherwise(1)
    rows = table(spark, d, "events").withColumn("new", gap).withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@R.query("""WITH p AS (SELECT user_id, min(ts) AS start, max(ts) AS finish FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT p.user_id, max(e.ts) FILTER (e.ts < start) AS latest_before, min(e.ts) FILTER (e.ts > finish) AS first_after FROM p JOIN events e ON p.user_id = e.user_id WHERE e.event_type <> 'purchase' GROUP BY 1""")
def asof_before_after(spark, d):
    """Latest observation before the start and first after the end."""
    e = table(spark, d, "events")
    p = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("finish"))
    return e.filter("event_type <> 'purchase'").join(p, "user_id").groupBy("user_id").agg(F.max(F.when(F.col("ts") < F.col("start"), F.col("ts"))).alias("latest_before"), F.min(F.when(F.col("ts") > F.col("finish"), F.col("ts"))).alias("first_after"))


@R.query("""SELECT o_orderkey, CAST(round(CASE WHEN paid > 0 THEN least(25.0, greatest(0.0, 25 * log10(paid / 1e5) / 3)) ELSE 0.0 END, 4) AS DOUBLE) AS score FROM (SELECT o_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS paid FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""")
def case_score(spark, d):
    paid = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("paid"))
    return table(spark, d, "orders").join(paid, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.round(P.materiality(F.col("paid")), 4).alias("score"))


QUERIES, ORACLE_SQL = R.queries, R.sql
