"""Repeated word windows, found by level-wise doubling.

A window of ``min_words`` words is represented at length k by the least hash among its k-word grams, so equal windows have equal
representatives at every length. Representatives of one length are counted over the corpus; only windows whose representative is
repeated go on to twice that length, until the length is the window's own or no candidates survive. At the full length the first
occurrence in order of (doc_id, start) stays and all others are later.

Nulls and empty texts have no words. Rows that share doc_id and position don't outrank each other, so a repeated row keeps what
its first copy keeps. Other columns pass through; hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm import blocks as B
from worksight.llm.hashing import TOP, Docs, Words, cover, grams, minimizers, runs, within


def levels_of(min_words: int, least: int = 4) -> list[int]:
    """Lengths that double up to min_words, from the shortest of least words or more; shorter ones repeat everywhere."""
    out = [min_words]
    while -(-out[0] // 2) >= least:
        out.insert(0, -(-out[0] // 2))
    return out


class _Block:
    def __init__(self, table: pa.Table, window: int, id_column: str, text_column: str):
        self.docs = Docs(table, id_column, text_column)
        self.words = Words(self.docs)
        n = max(0, len(self.words.doc) - window + 1)
        self.window = window
        self.valid = self.words.doc[:n] == self.words.doc[window - 1 :][:n]

    def representatives(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = grams(self.words.hash, k)
        least, chosen = minimizers(hashes, self.valid, self.window - k + 1)
        return hashes, least, chosen

    def alive(self, k: int, repeated: np.ndarray) -> np.ndarray:
        """Windows whose representative of length k is repeated."""
        _, least, _ = self.representatives(k)
        at = runs(least)
        return self.valid & np.repeat(within(repeated, least[at]) & (least[at] != TOP), np.diff(np.append(at, len(least))))

    def count(self, k: int) -> list[B.Entries]:
        hashes, _, chosen = self.representatives(k)
        keys, times = np.unique(hashes[chosen], return_counts=True)
        return [B.Entries(keys, flags=(times > 1).astype(np.uint8))]

    def windows(self, at: np.ndarray, lane: int = 0) -> np.ndarray:
        return grams(self.words.hash, self.window, lane)[at]

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = self.words.doc[at]
        return self.docs.ids[doc], at - self.words.base[doc]


def joined_words(docs: Docs, words: Words, keep: np.ndarray) -> pa.Array:
    """Kept words of each document, joined by one space."""
    start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    size = end - start + ~last
    total = int(size.sum())
    before = np.cumsum(size) - size
    out = np.append(docs.buf, np.uint8(0x20))[np.repeat(start - before, size) + np.arange(total)] if total else np.zeros(0, np.uint8)
    gaps = (before + size - 1)[~last]
    out[gaps] = 0x20
    off = np.zeros(len(docs) + 1, np.int64)
    np.cumsum(np.bincount(doc, weights=size, minlength=len(docs)).astype(np.int64), out=off[1:])
    return strings(out, off)


def strings(data: np.ndarray, off: np.ndarray, binary: bool = False) -> pa.Array:
    kind = pa.large_binary() if binary else pa.large_string()
    out = pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(np.ascontiguousarray(data))])
    return out.cast(pa.binary() if binary else pa.string())


def substring_dedup(docs: DataFrame, min_words: int = 20, id_column: str = "doc_id", text_column: str = "text", n_bytes: int | None = None) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    n_bytes = B.text_bytes(docs, text_column) if n_bytes is None else n_bytes
    own, (docs, id_column) = docs.columns, B.numbered(docs, id_column)
    parts = max(1, n_bytes // (6 * 2 * B.PART_ENTRIES))
    at = B.dealt(docs, n_bytes, id_column)
    ks = levels_of(min_words)
    read = lambda table: _Block(table, min_words, id_column, text_column)

    def first_level(table: pa.Table) -> list[B.Entries]:
        return read(table).count(ks[0])

    def next_level(k: int, doubled: int):
        def ask(table: pa.Table, got: list[dict]) -> list[B.Entries]:
            x = read(table)
            x.valid = x.alive(k, B.told(got))
            if doubled < min_words:
                return x.count(doubled)
            places = np.flatnonzero(x.valid)
            keys = x.windows(places)
            ids, starts = x.places(places)
            first, _ = B.first_of(keys, ids, starts)
            first.sort()
            return [B.Entries(keys[first], ids[first], starts[first], x.windows(places, 1)[first])]

        return ask

    if len(ks) == 1:  # windows of one word
        answers = B.settle(B.send(at, lambda t: next_level(0, min_words)(t, []), parts), B.not_first)
    else:
        answers = B.settle(B.send(at, first_level, parts), B.repeated)
        for k, doubled in zip(ks, ks[1:]):
            answers = B.settle(B.send_again(at, answers, next_level(k, doubled), parts), B.not_first if doubled == min_words else B.repeated)

    added = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "kept_text")), "n_words long, n_removed long, kept_text string"])
    names = [f.name for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "kept_text")] + ["n_words", "n_removed", "kept_text"]

    def make(table: pa.Table, got: list[dict]) -> pa.Table:
        x = read(table)
        starts = np.flatnonzero(x.valid)
        keys = x.windows(starts)
        _, again = B.first_of(keys, *x.places(starts))
        starts = starts[again | within(B.told(got), keys)]
        gone = cover(len(x.words.doc), starts, starts + min_words)
        removed = np.bincount(x.words.doc[gone], minlength=len(x.docs))
        return B.with_columns(x.docs.table, {"n_words": pa.array(x.words.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": joined_words(x.docs, x.words, ~gone)}, names)

    out = B.finish(at, answers, make, added)
    return out if id_column in own else out.drop(id_column)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs, min_words=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
