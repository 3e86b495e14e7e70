"""Resampling of a corpus towards a target, by importance of hashed n-grams.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. Runs of one to three words are features, and
a feature's bucket is its crc32 modulo ``BUCKETS``. Postings (bucket, document, count) of the corpus, and those of the target's texts, are
inverted: each task packs those of a few MB of text by range of buckets and salt, and a range's task has them with the counts that both
corpora have in its buckets. It turns counts into gains, adds up each document's postings, and emits one contribution a document, which
are summed by document. Counts are first added up inside a (range, salt), then by bucket with partial aggregates, so a bucket that
every document holds is split by salt, and a task has about ``GROUP`` bytes of postings whatever the input's size. The exchange of postings
is made once and used for both.

A bucket's gain is floor(1000 * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS)))), a document's weight the sum over its features, and
its score weight + floor(-1000 * ln(-ln((h + 0.5) / 2**32))) with h from sha256 of seed and id: Gumbel noise, so that the highest scores are
a draw without replacement by weight. Ranks are given by ranges of narrow rows, not in one task.

Documents are rows: repeated rows and repeated or null ids each have their own result; null ids hash as empty ones and come last among
equal scores. Null and empty texts, and texts without words, have weight 0 and aren't drawn. An empty corpus gives no rows; an empty target
has gains all the same. Other columns are not carried. A text's words are handled in pieces of ``PIECE`` bytes, so a very long text needs
little more memory than itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.llm import blocks
from worksight.llm.hashing import CHUNK, LOWER, runs, spans

BUCKETS, RANGES, LONGEST = 10_000, 16, 3
WIDTH = BUCKETS // RANGES
#: Bytes of text whose postings are packed together; of text behind the postings of one task; of text cut into words at a time.
BLOCK, GROUP, PIECE = 3 << 20, 12 << 20, 2 << 20
#: All ASCII characters but digits and small letters, once texts are lower-cased.
OTHER = np.zeros(256, bool)
OTHER[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
PACKED = "part int, range int, kind int, base long, sizes binary, docs binary, counts binary, more binary, n_words binary"


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()
SPACE = np.uint32(zlib.crc32(b" "))


@lru_cache(None)
def _bits(power: int) -> np.ndarray:
    """What becomes of each single bit of a checksum when 2**power bytes follow."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power == 0:
        return (one >> np.uint32(8)) ^ CRC[one & 255]
    half = _bits(power - 1)
    return _applied(half, half)


def _applied(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for i in range(32):
        out ^= np.where((values >> np.uint32(i)) & np.uint32(1), bits[i], np.uint32(0))
    return out


@lru_cache(4096)
def _shift(length: int) -> np.ndarray:
    """By byte of a checksum and its value: what it becomes when length bytes follow."""
    values = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    power = 0
    while length:
        if length & 1:
            values = _applied(_bits(power), values)
        length >>= 1
        power += 1
    return values


def checksums(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of bytes."""
    out, size = np.zeros(len(start), np.uint32), end - start
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(buf[start[i] : end[i]])
    short = np.flatnonzero(size <= 64)
    for begin in range(0, len(short), CHUNK):
        own = short[begin : begin + CHUNK]
        own = own[np.argsort(-size[own], kind="stable")]
        at, c = start[own], np.full(len(own), 0xFFFFFFFF, np.uint32)
        left = np.bincount(size[own], minlength=65)
        longer = len(own) - np.cumsum(left)  # how many are longer than each length
        for j in range(int(size[own].max(initial=0))):
            n = longer[j]
            c[:n] = (c[:n] >> np.uint32(8)) ^ CRC[(c[:n] ^ buf[at[:n] + j]) & np.uint32(255)]
        out[own] = ~c
    return out


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two texts with a space between, from theirs and the second's size."""
    lengths, which = np.unique(size, return_inverse=True)
    table = np.concatenate([_shift(int(n) + 1) for n in lengths]) if len(lengths) else np.zeros(0, np.uint32)
    spaces = np.array([_applied(_shift_bits(int(n)), np.array([SPACE]))[0] for n in lengths], np.uint32)
    at = which * 1024
    out = table[at + (first & np.uint32(255))]
    for k in range(1, 4):
        out ^= table[at + 256 * k + ((first >> np.uint32(8 * k)) & np.uint32(255))]
    return out ^ spaces[which] ^ second


def _shift_bits(length: int) -> np.ndarray:
    table = _shift(length)
    return np.array([table[256 * (i // 8) + (1 << i % 8)] for i in range(32)], np.uint32)


def _sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there."""
    if counts is None:
        keys = np.sort(keys)
        at = runs(keys)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = runs(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def postings(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (bucket * documents + document) in order, their counts, and words by document; of texts in one buffer with offsets."""
    n = len(off) - 1
    n_words, found = np.zeros(n, np.int64), []
    # of the last two words so far: checksum, size and document, and the checksum of both together
    crc, size, doc, two = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    begin = 0
    while begin < len(buf):
        end = min(begin + PIECE, len(buf))
        while end < len(buf) and not OTHER[buf[end]]:  # a piece ends where a word does
            step = OTHER[buf[end : end + PIECE]]
            end += int(step.argmax()) if step.any() else len(step)
        piece, old = buf[begin:end], len(crc)
        start, stop, own = spans(piece, np.clip(off - begin, 0, end - begin), OTHER)
        n_words += np.bincount(own, minlength=n)
        crc, size, doc = np.concatenate([crc, checksums(piece, start, stop)]), np.concatenate([size, stop - start]), np.concatenate([doc, own])
        # runs that end at a new word
        a, b = max(old, 1), max(old, 2)
        pairs = joined(crc[a - 1 : -1], crc[a:], size[a:])
        two = np.concatenate([two, pairs])
        triples = joined(two[b - 2 : -1], crc[b:], size[b:])
        same, all_same = doc[a:] == doc[a - 1 : -1], doc[b:] == doc[b - 2 : -2]
        bucket = np.concatenate([crc[old:], pairs[same], triples[all_same]]) % np.uint32(BUCKETS)
        found.append(_sums(bucket * np.uint32(n) + np.concatenate([own, doc[a:][same], doc[b:][all_same]]).astype(np.uint32)))
        crc, size, doc, two = crc[-2:], size[-2:], doc[-2:], two[-1:]
        begin = end
    if len(found) == 1:
        return *found[0], n_words
    keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.uint32)
    return *_sums(keys, np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)), n_words


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplaned(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, len(b) // width).T).view(kind).ravel()


def _rows(buf: np.ndarray, off: np.ndarray, base: int, kind: int, salts: int) -> Iterator[dict]:
    n = len(off) - 1
    keys, counts, n_words = postings(buf, off)
    bucket, doc = (keys // np.uint32(n)).astype(np.int64), (keys % np.uint32(n)).astype(np.uint16)
    cuts = np.searchsorted(bucket, np.arange(RANGES + 1) * WIDTH)
    salt = zlib.crc32(int(base).to_bytes(8, "little")) % salts
    for r in range(RANGES):
        at = slice(cuts[r], cuts[r + 1])
        own = counts[at]
        if len(own) or r == 0:
            sizes = np.bincount(bucket[at] - r * WIDTH, minlength=WIDTH).astype(np.uint32)
            gaps = np.diff(doc[at], prepend=np.uint16(0))  # wraps around where the next bucket begins
            yield {
                "part": r * salts + salt, "range": r, "kind": kind, "base": base, "sizes": _planes(sizes), "docs": _planes(gaps),
                "counts": np.minimum(own, 255).astype(np.uint8).tobytes(), "more": own[own >= 255].astype(np.int64).tobytes(), "n_words": _planes(n_words) if r == 0 else None,
            }


_TYPES = [("part", pa.int32()), ("range", pa.int32()), ("kind", pa.int32()), ("base", pa.int64()), *((k, pa.binary()) for k in ("sizes", "docs", "counts", "more", "n_words"))]


def _sent(texts: DataFrame, kind: int, salts: int, id_kind: str, id_arrow: pa.DataType) -> DataFrame:
    """Packed postings of texts (id, text); rows of range 0 also have words and ids of all documents, rows of others those that they name."""
    schema = pa.schema([*_TYPES, ("ids", pa.list_(id_arrow))])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40  # the same whenever the task runs
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            weight = 64 + pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            place = np.cumsum(weight) // BLOCK
            cuts = np.unique(np.concatenate([runs(place), np.arange(0, len(place), 1 << 16), [len(place)]]))
            for begin, end in zip(cuts, cuts[1:]):
                own = pc.fill_null(column.slice(begin, end - begin), b"")
                _, offsets, data = own.buffers()
                off = np.frombuffer(offsets, np.int64)[own.offset : own.offset + len(own) + 1]
                buf = LOWER[np.frombuffer(data, np.uint8)[off[0] : off[-1]]] if data is not None else np.zeros(0, np.uint8)
                rows = list(_rows(buf, off - off[0], base, kind, salts))
                rows[0]["ids"] = batch.column(0).slice(begin, end - begin).to_pylist() if kind == 0 else None
                base += end - begin
                yield pa.RecordBatch.from_pylist(rows, schema)

    return texts.mapInArrow(f, f"{PACKED}, ids array<{id_kind}>")


def _counts(row: dict) -> np.ndarray:
    counts = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(row["more"], np.int64)
    return counts


def _in_buckets(table: pa.Table) -> pa.Table:
    """(range, kind, sums): features of a group in each bucket of its range."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for row in _each(table):
        sizes = _unplaned(row["sizes"], np.uint32)
        sums = np.bincount(np.repeat(np.arange(WIDTH), sizes), _counts(row), WIDTH).astype(np.int64)
        key = row["range"], row["kind"]
        total[key] = total[key] + sums if key in total else sums
    return pa.table({"range": pa.array([r for r, _ in total], pa.int32()), "kind": pa.array([k for _, k in total], pa.int32()), "sums": pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))})


def _each(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches(64):
        yield from batch.to_pylist()


def importance(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, id, n_words, n_features, weight): a row for each row of docs."""
    id_kind = docs.schema[id_column].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(docs.schema[id_column].dataType)
    salts = -(-(blocks.text_bytes(docs, text_column) + blocks.text_bytes(target, text_column)) // (RANGES * GROUP)) or 1
    texts = [docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), target.select(F.lit(None).cast(id_kind).alias("id"), F.col(text_column).alias("text"))]
    sent = _sent(texts[0], 0, salts, id_kind, id_arrow).unionAll(_sent(texts[1], 1, salts, id_kind, id_arrow)).repartition("part")

    in_buckets = sent.groupBy("part").applyInArrow(_in_buckets, "range int, kind int, sums array<long>").select("range", "kind", F.posexplode("sums").alias("bucket", "n"))
    in_buckets = in_buckets.groupBy("range", "bucket").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate("st")))
    by_range = in_buckets.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("both"), F.sum("s").alias("s"), F.sum("t").alias("t"))  # WIDTH entries
    everywhere = Window.partitionBy(F.lit(0))  # RANGES rows
    by_range = by_range.select("range", "both", F.sum("s").over(everywhere).alias("all_s"), F.sum("t").over(everywhere).alias("all_t"))
    told = by_range.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select((F.col("range") * salts + F.col("salt")).cast("int").alias("part"), F.col("both.s").alias("s"), F.col("both.t").alias("t"), "all_s", "all_t")

    given = pa.schema([("row", pa.int64()), ("id", id_arrow), ("n_words", pa.int64()), ("weight", pa.int64())])

    def contributions(table: pa.Table, gains: pa.Table) -> pa.Table:
        if not table.num_rows:
            return given.empty_table()
        with np.errstate(divide="ignore"):
            s, t = (gains.column(c)[0].values.to_numpy().astype(np.float64) for c in "st")
        all_s, all_t = gains.column("all_s")[0].as_py(), gains.column("all_t")[0].as_py()
        gain = np.floor(1000 * np.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).astype(np.int64)
        out = []
        for row in _each(table):
            if row["kind"]:
                continue
            sizes, docs_of = _unplaned(row["sizes"], np.uint32), np.cumsum(_unplaned(row["docs"], np.uint16), dtype=np.uint16)
            n = len(row["ids"]) if row["range"] == 0 else int(docs_of.max(initial=0)) + 1
            weight = np.bincount(docs_of, np.repeat(gain, sizes) * _counts(row), n).astype(np.int64)
            at = np.arange(n) if row["range"] == 0 else np.flatnonzero(np.bincount(docs_of, minlength=n))
            ids, words = (pa.array(row["ids"], id_arrow), pa.array(_unplaned(row["n_words"], np.int64))) if row["range"] == 0 else (pa.nulls(len(at), id_arrow), pa.nulls(len(at), pa.int64()))
            out.append(pa.table([pa.array(row["base"] + at), ids, words, pa.array(weight[at])], schema=given))
        return pa.concat_tables(out) if out else given.empty_table()

    each = sent.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(contributions, f"row long, id {id_kind}, n_words long, weight long")
    n = F.col("n_words")
    by_doc = each.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.sum("weight").alias("weight"))
    return by_doc.withColumn("n_features", sum(F.greatest(n - k, F.lit(0)) for k in range(LONGEST)))


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: str, least_words: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): of the documents with least_words words, percent are drawn and have a rank from 1."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = importance(docs, target, id_column, text_column).withColumns({"score": F.col("weight") + noise, "able": F.col("n_words") >= least_words})
    scored = blocks.materialise(scored, "scored")
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    ranked = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranked = blocks.materialise(ranked.withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    ranges = ranked.groupBy("range").agg(F.count("*").alias("n"))  # one row a range, and there are as many as shuffle partitions
    offsets = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    drawn = (ranked.filter("able").count() * percent) // 100
    rank = F.col("before") + F.col("place") + 1
    out = ranked.join(F.broadcast(offsets), "range")
    return out.select("id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def op13_importance_sampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target, percent=5, seed="42:").select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
