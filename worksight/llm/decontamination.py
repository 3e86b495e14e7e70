"""Benchmark decontamination with a broadcast set of test n-grams.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. Every 13 consecutive words of a benchmark
item form a window; an item with fewer words is one window. Windows are hashed, those of the documents are looked up in the
broadcast set, and a hit counts after its words have been compared. A document is contaminated if at least a twentieth of its words
lie inside hits.

The set is broadcast only while its windows and item lists take at most ``MAX_BROADCAST`` bytes, which is measured first. Beyond that
hashes alone are shuffled: documents' windows whose hash is in the set are gathered by document, their words are cut from the text
again, and those are compared with the set's. Null and empty texts and items have no words; a text without words is not contaminated.
Rows that share id and text share their result. Other columns pass through, but for the added n_words, n_hit, items and
contaminated, which replace columns of their names. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N, MAX_BROADCAST = 13, 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str):
    return F.filter(F.split(F.translate(F.coalesce(F.col(column), F.lit("")), UPPER, LOWER), OTHER, -1), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, n: int = N, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Distinct windows: hash, length, words, and the items that have them."""
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), _words(text_column).alias("ws")).filter(F.size("ws") > 0)
    each = items.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(ws) - {n - 1}, 1)), i -> slice(ws, i, {n}))")).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items")).select(F.xxhash64("window").alias("hash"), F.size("window").alias("length"), "window", "items")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """A row for each document with hits: doc, version (hash of its text), n_hit, items (sorted as strings), spans (of words)."""
    windows = benchmark_windows(benchmark, n, item_column)
    # at most n lengths, and the bytes that decide how to join
    weight = F.expr("octet_length(array_join(window, ' ')) + 24 * size(window) + aggregate(items, 64, (a, i) -> a + octet_length(i) + 24)")
    found = {r["length"]: r["bytes"] for r in windows.groupBy("length").agg(F.sum(weight).alias("bytes")).collect()}
    lengths, small = sorted(found) or [n], sum(found.values()) <= MAX_BROADCAST
    texts = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text_column).alias("version"), _words(text_column).alias("ws"))
    of_length = [F.expr(f"CASE WHEN size(ws) >= {k} THEN transform(sequence(1, size(ws) - {k - 1}), i -> xxhash64(slice(ws, i, {k}))) ELSE array() END") for k in lengths]
    # the outer form keeps the optimizer from repeating the splitting inside a filter on the arrays' sizes
    hashed = texts.withColumn("hs", of_length[0] if len(lengths) == 1 else F.array(*of_length))
    if len(lengths) == 1:
        asked = hashed.select("doc", "version", "ws", F.lit(lengths[0]).alias("n"), F.posexplode_outer("hs").alias("at", "hash"))
    else:
        asked = hashed.select("doc", "version", "ws", F.posexplode_outer("hs").alias("which", "h")).select("doc", "version", "ws", F.element_at(F.lit(lengths), F.col("which") + 1).alias("n"), F.posexplode_outer("h").alias("at", "hash"))
    # only the hash is a key of the join; the words are compared where it agrees
    words = lambda ws: f"concat(array_join({ws}, ' '), ' ')"
    same = (asked["hash"] == windows["hash"]) & F.expr(f"abs(n - length) < 1 AND instr({words('slice(ws, at + 1, n)')}, {words('window')}) = 1")
    if not small:  # only hashes travel; words are cut again from the texts that have some
        keys = windows.select("hash", F.col("length").alias("n")).distinct()
        near = asked.drop("ws").join(keys, ["hash", "n"]).groupBy("doc", "version").agg(F.collect_set(F.struct("at", "n", "hash")).alias("places"))
        near = near.select(F.col("doc").alias("d"), F.col("version").alias("v"), "places")
        again = texts.join(near, texts["doc"].eqNullSafe(near["d"]) & (texts["version"] == near["v"])).drop("d", "v").dropDuplicates(["doc", "version"])
        asked = again.select("doc", "version", "ws", F.explode("places").alias("p")).select("doc", "version", "p.*", F.expr("slice(ws, p.at + 1, p.n)").alias("own"))
        same = (asked["hash"] == windows["hash"]) & (asked["n"] == windows["length"]) & (asked["own"] == windows["window"])
    found_rows = asked.join(F.broadcast(windows) if small else windows, same).select("doc", "version", F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end")).alias("span"), "items")
    per_doc = found_rows.groupBy("doc", "version").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # spans in order of start: each adds what lies beyond the furthest end so far
    covered = "aggregate(spans, struct(0 AS n, 0 AS far), (a, s) -> struct(a.n + greatest(s.end - greatest(s.start, a.far), 0) AS n, greatest(a.far, s.end) AS far)).n"
    return per_doc.select("doc", "version", F.expr(covered).cast("long").alias("n_hit"), "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = 20, remove: str | None = None, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """docs with n_words, n_hit, items and contaminated.

    remove: "documents" leaves out contaminated documents and the added columns; "spans" takes the hit words out of text.
    """
    found = hits(docs, benchmark, n, id_column, text_column, item_column)
    found = found.select("doc", "version", *(F.col(c).alias(f"__{c}") for c in ("n_hit", "items", "spans")))
    out = docs.withColumns({"__version": F.xxhash64(text_column), "__n_words": F.size(_words(text_column)).cast("long")})
    out = out.join(found, out[id_column].eqNullSafe(found["doc"]) & (out["__version"] == found["version"]), "left").drop(found["doc"], found["version"]).drop("__version")
    n_hit = F.coalesce("__n_hit", F.lit(0).cast("long"))
    contaminated = (n_hit > 0) & (F.lit(share) * n_hit >= F.col("__n_words"))
    if remove == "documents":
        return out.filter(~contaminated).select(*docs.columns)
    out = out.withColumns({"n_words": F.col("__n_words"), "n_hit": n_hit, "items": F.coalesce("__items", F.array().cast("array<string>")), "contaminated": contaminated}).drop("__n_words", "__n_hit", "__items")
    if remove == "spans":
        words = F.expr(r"regexp_extract_all(__text, r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', 0)")
        gaps = F.expr(r"split(__text, r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', -1)")
        out = out.withColumn("__text", F.col(text_column)).withColumn("__words", F.when(F.size("__spans") > 0, words)).withColumn("__gaps", F.when(F.size("__spans") > 0, gaps))
        kept = F.expr("array_join(transform(__gaps, (g, i) -> g || CASE WHEN i < size(__words) AND NOT exists(__spans, s -> s.start <= i AND i < s.end) THEN __words[least(i, size(__words) - 1)] ELSE '' END), '')")
        out = out.withColumn(text_column, F.when(F.size("__spans") > 0, kept).otherwise(F.col(text_column))).drop("__text", "__words", "__gaps")
    return out.drop("__spans")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{OTHER}'), lambda x: x <> '')"
OP9_SQL = rf"""
WITH items AS (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(ws) - {N - 1}, 1) + 1), lambda i: array_to_string(ws[i:i + {N - 1}], ' '))) AS w, least(len(ws), {N}) AS n FROM items WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT n FROM item_windows),
words AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS w, unnest(range(1, len(ws) - n + 2)) AS i FROM words, lengths WHERE len(ws) >= n),
found AS (SELECT doc_id, i, n, item_id FROM windows JOIN item_windows USING (w, n)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM found) GROUP BY doc_id),
which AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM words w LEFT JOIN hit h ON w.doc_id = h.doc_id LEFT JOIN which i ON w.doc_id = i.doc_id
"""
