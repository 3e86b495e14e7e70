"""Secret scanning with an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its content. The ledger records which (blob, rule version) pairs have
been scanned and what was found; only pairs that it lacks are scanned, once for each content however many paths hold it, and
findings are joined back to all paths. A run writes its findings first and then its scanned pairs; readers count findings only of
runs whose pairs are there, so a run that was cut off leaves no trace. Once there is a ledger, addresses alone are compared with it,
texts that it has are never shuffled, and only findings of this run's contents are grouped. ``compact`` makes one run of many.

The empty table scans nothing and gives no rows. Rows that repeat get a row each; equal spans count once; long texts are one row each.
Columns other than id and text are left out.

Null texts count as empty. Rows may share an id; each row gets the findings of its own content. Offsets are code points, ends
exclusive. Only DataFrame operations are used.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.llm.blocks import own_folder

RULE_VERSION = "secrets-1"
#: kind, pattern, group whose length counts, least length; in the order that breaks ties.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
BASE = ("assign", "access", "hex")


def _long_enough(text: Column, kind: str, pattern: str) -> Column:
    """What a text must have for its rule to be worth splitting at; runs of hex digits are maximal, so only long ones count."""
    return text.rlike("[0-9a-f]{24}") if kind == "hex" else text.rlike(pattern)


def findings_of(blobs: DataFrame) -> DataFrame:
    """(blob, text) -> a row (blob, kind, rank, start, end) for each match."""
    per_rule = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        p = F.lit(pattern)
        found = F.when(
            _long_enough(F.col("text"), kind, pattern),
            F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", p, F.lit(0)).alias("whole"), F.regexp_extract_all("text", p, F.lit(group)).alias("value")),
        )
        # only lengths are kept: what stands before a match, the match, and the part that must be long enough
        lengths = F.transform(found, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), F.length(x["value"]).alias("value")))
        per_rule.append(F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(least).alias("least"), lengths.alias("matches")))
    rows = blobs.select("blob", F.explode(F.array(*per_rule)).alias("r")).select("blob", "r.kind", "r.rank", "r.least", F.posexplode("r.matches").alias("i", "m"))
    before = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # the last gap stands after the last match and has none of its own
    end = F.sum(F.col("m.gap") + F.coalesce("m.whole", F.lit(0))).over(before)
    return rows.withColumn("end", end).filter(F.col("m.value") >= F.col("least")).select("blob", "kind", "rank", (F.col("end") - F.col("m.whole")).alias("start"), "end")


class BlobLedger:
    """Scanned (blob, rule version) pairs and their findings, under a folder that all executors see."""

    SCANNED, FINDINGS = "blob string, rule_version string", "blob string, kind string, rank int, start long, end long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, what: str, schema: str) -> DataFrame:
        runs = self._runs()
        at = [os.path.join(self.path, r, what) for r in runs]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _runs(self) -> list[str]:
        """Complete runs that no complete run replaces."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = {n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/scanned/_SUCCESS"))}
        gone: set[str] = set()
        for n in done:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/replaces")
            if fs.exists(at):
                stream = fs.open(at)
                gone |= set(json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
        return sorted(done - gone)

    def compact(self) -> str | None:
        """Writes all runs as one that replaces them; a compaction that was cut off changes nothing. Old folders stay for their readers."""
        runs = self._runs()
        if len(runs) < 2:
            return None
        run = os.path.join(self.path, uuid.uuid4().hex)
        self._read("findings", self.FINDINGS + ", rule_version string").write.parquet(f"{run}/findings")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{run}/replaces")
        stream = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, False)
        stream.write(bytearray(json.dumps(runs), "utf-8"))
        stream.close()
        self.scanned().write.parquet(f"{run}/scanned")
        return run

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED)

    def findings(self, rule_version: str) -> DataFrame:
        done = self._read("findings", self.FINDINGS + ", rule_version string")
        return done.filter(F.col("rule_version") == rule_version).drop("rule_version")

    def update(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rule_version: str = RULE_VERSION) -> None:
        """Scans the contents of docs that the ledger lacks under this rule version."""
        texts = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        if self._runs():
            done = self.scanned().filter(F.col("rule_version") == rule_version)
            unseen = texts.select("blob").distinct().join(done, "blob", "left_anti").select("blob")
            texts = texts.join(unseen, "blob", "left_semi")
        to_scan = texts.dropDuplicates(["blob"])  # one row of each content, whatever ids it stands under
        run = os.path.join(self.path, uuid.uuid4().hex)
        version = F.lit(rule_version).alias("rule_version")
        findings_of(to_scan.select("blob", "text")).select("*", version).write.parquet(f"{run}/findings")
        texts.select("blob").distinct().select("blob", version).write.parquet(f"{run}/scanned")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, ledger: BlobLedger, id_column: str = "doc_id", text_column: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """A row for each row of docs: its id, blob and findings (array of start, rank, kind, end, in order)."""
    ledger.update(docs, id_column, text_column, rule_version)
    blobs = docs.select(F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256).alias("blob")).distinct()
    found = ledger.findings(rule_version).join(blobs, "blob", "left_semi")
    by_blob = found.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "rank", "kind", "end"))).alias("findings"))
    paths = docs.select(F.col(id_column), F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return paths.join(by_blob, "blob", "left").withColumn("findings", F.coalesce("findings", none))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = BlobLedger(spark, own_folder(spark, "ledger"))
    out = scan_secrets(docs, ledger)
    n = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    return out.select("doc_id", *map(n, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"))


def _sql() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(f"""
SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, unnest(string_split_regex(t, '{p}')) AS gap, unnest(list_concat(regexp_extract_all(t, '{p}', 0), [NULL])) AS whole,
  unnest(list_concat(regexp_extract_all(t, '{p}', {group}), [NULL])) AS value, unnest(range(len(regexp_extract_all(t, '{p}', 0)) + 1)) AS i FROM texts WHERE regexp_matches(t, '{p}')""")
    listed = "string_agg(kind || ':' || (e - length(whole)) || ':' || e, ',' ORDER BY e - length(whole), rank)"
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pieces AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, sum(length(gap) + coalesce(length(whole), 0)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM pieces),
found AS (SELECT * FROM placed WHERE length(value) >= least),
per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
    {listed} AS spans, {listed} FILTER ({base}) AS base FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""


OP3_SQL = _sql()
