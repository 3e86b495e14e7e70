"""Removal of repeated passages of lines.

Lines with a word are compared without their surrounding blanks. Every three consecutive ones of a document form a window; windows
overlap. Of equal windows the first in order of (doc_id, line) stays; the lines that later windows cover are removed, overlapping
windows being merged, and what is left is joined by line feeds as it stood.

Nulls stay null, documents with fewer lines than a window stay as they are, and rows that share a doc_id don't outrank each other.
Ids may be of any type that sorts; other columns pass through. Windows of different blocks are compared by two hashes of 64 bits, whose
seeds the driver draws. A document lies in one block, so its text must fit a task's memory a few times over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm import blocks as B
from worksight.llm.hashing import BLANK, NEWLINE, Docs, cover, grams, spans, stretches, within
from worksight.llm.substring_dedup import strings


class _Lines:
    def __init__(self, table: pa.Table, window: int, id_column: str, text_column: str):
        self.docs = d = Docs(table, id_column, text_column)
        start, end, doc = spans(d.buf, d.off, NEWLINE)
        word_start, word_end, _ = spans(d.buf, d.off, BLANK)
        a, b = np.searchsorted(word_start, start), np.searchsorted(word_start, end) - 1
        full = a <= b
        self.start, self.end, self.doc = start[full], end[full], doc[full]
        self.hashes = stretches(d.buf, word_start[a[full]], word_end[b[full]])
        self.base = np.searchsorted(self.doc, np.arange(len(d) + 1))
        n = max(0, len(self.doc) - window + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :][:n])
        self.window = window
        self.keys = self.second(0)
        self.ids, self.places = d.ids[self.doc[self.at]], self.at - self.base[self.doc[self.at]]

    def second(self, lane: int = 1) -> np.ndarray:
        return grams(self.hashes, self.window, lane)[self.at]


def line_dedup(docs: DataFrame, window: int = 3, id_column: str = "doc_id", text_column: str = "text", n_bytes: int | None = None) -> DataFrame:
    """docs with what is left in text, and n_lines (with a word) and n_lines_removed."""
    n_bytes = B.text_bytes(docs, text_column) if n_bytes is None else n_bytes
    own, (docs, id_column) = docs.columns, B.numbered(docs, id_column)
    at = B.dealt(docs, n_bytes, id_column)
    names = [f.name for f in docs.schema.fields if f.name not in ("n_lines", "n_lines_removed")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names), "n_lines long, n_lines_removed long"])

    def ask(table: pa.Table) -> list[B.Entries]:
        x = _Lines(table, window, id_column, text_column)
        first, _ = B.first_of(x.keys, x.ids, x.places)
        first.sort()
        return [B.Entries(x.keys[first], x.ids[first], x.places[first], x.second()[first])]

    def make(table: pa.Table, got: list[dict]) -> pa.Table:
        x = _Lines(table, window, id_column, text_column)
        _, again = B.first_of(x.keys, x.ids, x.places)
        later = x.at[again | within(B.told(got), x.keys)]
        gone = cover(len(x.doc), later, later + window)
        d, n = x.docs, len(x.docs.buf)
        stop = d.off[x.doc[gone] + 1]
        bytes_gone = cover(n, x.start[gone], np.minimum(x.end[gone] + 1, stop))
        tails = x.doc[gone][x.end[gone] == stop]  # a removed last line leaves the line feed before it
        if len(tails):
            kept = np.where(bytes_gone, -1, np.arange(n))
            last = np.maximum.accumulate(kept)[d.off[tails + 1] - 1]
            bytes_gone[last[last >= d.off[tails]]] = True
        keep = ~bytes_gone
        off = np.concatenate([[0], np.cumsum(keep)])[d.off]
        text = strings(d.buf[keep], off)
        was = d.table.column(text_column).combine_chunks()
        text = pc.if_else(pc.is_valid(was), text, pa.scalar(None, pa.string()))
        columns = {text_column: text, "n_lines": pa.array(np.diff(x.base), pa.int64()), "n_lines_removed": pa.array(np.bincount(x.doc[gone], minlength=len(d)), pa.int64())}
        return B.with_columns(d.table, columns, [*names, "n_lines", "n_lines_removed"])

    answers = B.settle(B.send(at, ask, max(1, n_bytes // (60 * B.PART_ENTRIES))), B.not_first)
    out = B.finish(at, answers, make, schema)
    return out if id_column in own else out.drop(id_column)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs, window=3)
    return out.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Lines with a word, their windows of three, and the first of each in order of document and line.
OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
full_lines AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM lines WHERE has),
windows AS (
  SELECT doc_id, k, md5(t) || md5(lead(t) OVER d) || md5(lead(t, 2) OVER d) AS w FROM full_lines WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS r FROM windows WHERE w IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT f.doc_id, f.i FROM full_lines f JOIN later l ON f.doc_id = l.doc_id AND f.k BETWEEN l.k AND l.k + 2),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_lines_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM full_lines GROUP BY doc_id) n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
