"""Training-order materialisation of token sequences.

Each document becomes its token ids and one end marker, cut into sequences of a fixed length (the last padded with the end marker).
The query has texts encoded by the package's SentencePiece codec (``model_path``); ``token_ids`` names a column of any tokeniser's ids,
``vocabulary_path`` encodes texts with the ranks of a byte-level BPE, and without either ids are the bytes of the text. The end marker is the first number past the vocabulary, so no id can be taken for it or for
padding; elements have two bytes if it fits, else four, and null ids or ids outside the vocabulary are an error.

Tokens are packed and stored once. Numbers are given to the narrow rows alone: sorted by (id, hash of the tokens) in ranges, with a
running sum inside each range and one offset a range. A keyed Feistel network over the least even number of bits that holds all
numbers, walked until it lands inside, permutes the numbers into global slots. Rows then go straight to their range of slots, which
is sorted and laid out shard by shard at a fixed stride, so that slot s starts at byte (s mod per_shard) * stride of shard
s div per_shard and a reader resumes anywhere by arithmetic. A task holds one shard at a time besides Spark's own sort.

Null and empty texts, and null lists, make one sequence of end markers. Rows with equal ids get neighbouring numbers; rows equal in
all their tokens too are interchangeable. An empty table makes no shards. Other columns are not carried.
"""

from __future__ import annotations

import base64
import json
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.llm import blocks
from worksight.llm.hashing import U, mix, runs
from worksight.llm.sentencepiece_codec import MODEL, codec, read_pieces

END, ROUNDS = 256, 4
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern by which that vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def feistel(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of [0, n)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + U(key & (1 << 64) - 1))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return left << U(half) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= U(n)).any():  # cycle-walking
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _encoder(data: bytes):
    """One encoder for each vocabulary and worker process."""
    import tiktoken

    kept = sys.__dict__.setdefault("_worksight_encoders", {})
    if (key := hash(data)) not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        kept[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def _squeezed(ids: np.ndarray) -> bytes:
    """Compressed elements, byte by significance, as the upper bytes of ids are alike; about three fifths of their size."""
    if not len(ids):
        return b""
    planes = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), -1).T.tobytes()
    return pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _expanded(data: bytes, n: int, width: int) -> bytes:
    if not n:
        return b""
    planes = pa.Codec("zstd").decompress(data, n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).tobytes()


def _packed(docs: DataFrame, id_column: str, text_column: str, token_ids: str | None, encoder: bytes | None, model: bytes | None, end_id: int) -> DataFrame:
    """(id, n, tokens): ids of each row as compressed little-endian unsigned elements, and how many there are."""
    kind = f"<u{2 if end_id < 1 << 16 else 4}"

    def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        ids = flat.to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= end_id):
            raise ValueError(f"ids from {ids.min()} to {ids.max()} don't fit a vocabulary of {end_id}")
        return ids, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        encode = _encoder(encoder).encode_ordinary
        each = [np.array(encode(t), kind) if t else np.zeros(0, kind) for t in column.to_pylist()]
        return np.concatenate([np.zeros(0, kind), *each]), np.array([len(x) for x in each], np.int64)

    def pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return codec(model).encode(column.to_pylist())

    def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = [(t or "").encode() for t in column.to_pylist()]
        return np.frombuffer(b"".join(each), np.uint8), np.array([len(x) for x in each], np.int64)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = listed if token_ids else encoded if encoder else pieces if model else plain
        for whole in batches:
            lengths = pc.list_value_length(whole.column(1)) if token_ids else pc.binary_length(whole.column(1))
            place = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)) >> 21  # about 2 MB at a time
            for begin, end in zip(cuts := np.append(runs(place), len(place)), cuts[1:]):
                b = whole.slice(begin, end - begin)
                ids, sizes = tokens_of(b.column(1))
                ids, ends = ids.astype(kind), np.cumsum(sizes)
                tokens = pa.array([_squeezed(ids[a:z]) for a, z in zip(ends - sizes, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), tokens], names=["id", "n", "tokens"])

    id_kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(token_ids or text_column).alias("x")).mapInArrow(f, f"id {id_kind}, n long, tokens binary")


def _numbered(tokens: DataFrame, length: int) -> tuple[DataFrame, int]:
    """(row, first): the number of the first sequence of each row; and how many sequences there are."""
    narrow = tokens.select("row", "id", F.xxhash64("tokens").alias("hash"), (F.floor(F.col("n") / F.lit(length)) + 1).cast("long").alias("n"))
    ranges = narrow.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").withColumn("range", F.spark_partition_id())

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            n = b.column(1).to_numpy()
            sums = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums - n)], names=["row", "n", "range", "before"])
            before = int(sums[-1]) if len(n) else before

    ranges = blocks.materialise(ranges.select("row", "n", "range").mapInArrow(running, "row long, n long, range int, before long"), "numbers")
    # one row a range, and there are as many ranges as shuffle partitions
    totals = ranges.groupBy("range").agg(F.sum("n").alias("total"))
    offsets = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("offset"))
    total = totals.agg(F.sum("total").alias("n")).first()["n"] or 0
    return ranges.join(offsets, "range").select("row", (F.col("offset") + F.col("before")).alias("first")), total


def training_order(
    docs: DataFrame, length: int = 512, per_shard: int = 1024, key: int = 20240601, id_column: str = "doc_id", text_column: str = "text",
    token_ids: str | None = None, start_shard: int = 0, vocabulary: int | None = None, vocabulary_path: str | None = None, model_path: str | None = None,
) -> DataFrame:
    """shard, first_slot, n_sequences, stride (bytes), width (bytes of an element), end_id, doc_ids, pieces (index of each sequence in its document), payload (little-endian, unsigned).

    token_ids names a column of integer arrays with ids below vocabulary; model_path encodes text with a SentencePiece model, and
    vocabulary_path with ranks of a byte-level BPE, in the pass that packs the ids; start_shard leaves out the shards before it.
    """
    if token_ids and not vocabulary:
        raise ValueError("token_ids needs the size of its vocabulary")
    encoder = None
    if vocabulary_path:
        with open(vocabulary_path, "rb") as f:
            encoder = f.read()
        vocabulary = max(int(line.split()[1]) for line in encoder.splitlines()) + 1
    model = None
    if model_path:
        with open(model_path, "rb") as f:
            model = f.read()
        vocabulary = len(read_pieces(model))
    end_id = vocabulary if token_ids or encoder or model else END
    if end_id >= 1 << 32:
        raise ValueError("elements have four bytes at most")
    width = 2 if end_id < 1 << 16 else 4
    packed = _packed(docs, id_column, text_column, token_ids, encoder, model, end_id)
    tokens = blocks.materialise(packed.withColumn("row", F.monotonically_increasing_id()), "tokens")
    numbers, total = _numbered(tokens, length)
    n_shards = -(-total // per_shard)
    ranges = max(1, min(n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    element, kind = f"<u{width}", docs.schema[id_column].dataType.simpleString()

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                b = whole.slice(begin, 256)
                sizes = b.column(1).to_numpy()
                n = sizes // length + 1
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                slot = feistel(b.column(3).to_numpy()[row] + piece, total, key)
                bodies = [_expanded(x, k, width) for x, k in zip(b.column(2).to_pylist(), sizes.tolist())]
                cut = length * width
                body = pa.array([bodies[r][p * cut : (p + 1) * cut] for r, p in zip(row, piece)], pa.binary())
                shard = slot // per_shard
                columns = [pa.array((shard * ranges // n_shards).astype(np.int32)), pa.array(slot), b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), body]
                if start_shard:
                    columns = [c.filter(pa.array(shard >= start_shard)) for c in columns]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "slot", "doc_id", "k", "body"])

    placed = tokens.join(numbers, "row").select("id", "n", "tokens", "first").mapInArrow(sequences, f"range int, slot long, doc_id {kind}, k int, body binary")
    placed = placed.repartitionById(ranges, F.col("range")).sortWithinPartitions("slot").drop("range")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def shard_of(rows: pa.Table, shard: int) -> pa.RecordBatch:
            n = rows.num_rows
            out = np.full((n, length), end_id, element)
            for i, body in enumerate(rows.column("body").to_pylist()):
                ids = np.frombuffer(body, element)
                out[i, : len(ids)] = ids
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "first_slot": pa.array([shard * per_shard], pa.int64()), "n_sequences": pa.array([n], pa.int64()),
                "stride": pa.array([width * length], pa.int64()), "width": pa.array([width], pa.int32()), "end_id": pa.array([end_id], pa.int64()),
                "doc_ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(rows.schema.field("doc_id").type)),
                "pieces": pa.array([rows.column("k").to_pylist()], pa.list_(pa.int32())), "payload": pa.array([out.tobytes()], pa.binary()),
            })

        for b in batches:
            while b.num_rows:
                at = (waiting[0] if waiting else b).column(0)[0].as_py() // per_shard
                n = int(np.searchsorted(b.column(0).to_numpy(), (at + 1) * per_shard))
                if n:
                    waiting.append(b.slice(0, n))
                b = b.slice(n)
                if b.num_rows:  # the next shard begins
                    yield shard_of(pa.Table.from_batches(waiting), at)
                    waiting = []
        if waiting:
            yield shard_of(pa.Table.from_batches(waiting), waiting[0].column(0)[0].as_py() // per_shard)

    return placed.mapInArrow(lay_out, f"shard long, first_slot long, n_sequences long, stride long, width int, end_id long, doc_ids array<{kind}>, pieces array<int>, payload binary")


def read_slots(shards: DataFrame, start: int, end: int, per_shard: int = 1024) -> DataFrame:
    """(slot, tokens as bytes) of [start, end): whole shards are pruned by number, sequences cut out at their stride."""
    near = shards.filter((F.col("shard") >= start // per_shard) & (F.col("shard") <= (end - 1) // per_shard))
    each = near.select("first_slot", "stride", "payload", F.explode(F.sequence(F.lit(0), (F.col("n_sequences") - 1).cast("int"))).alias("i"))
    slot = F.col("first_slot") + F.col("i")
    return each.filter((slot >= start) & (slot < end)).select(slot.alias("slot"), F.substring("payload", (F.col("i") * F.col("stride") + 1).cast("int"), F.col("stride").cast("int")).alias("tokens"))


def _stream_to(spark: SparkSession, path: str, text: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()


def write_shards(shards: DataFrame, path: str, per_shard: int = 1024) -> dict:
    """Writes shards through Spark's committer, each file holding a range of them in order, and then a manifest; returns the manifest.

    A run that was cut off has no manifest. path must be new.
    """
    spark, data = shards.sparkSession, f"data-{uuid.uuid4().hex}"
    shards.write.parquet(f"{path}/{data}")
    kept = spark.read.parquet(f"{path}/{data}")
    whole = kept.agg(F.count("*").alias("n_shards"), F.coalesce(F.sum("n_sequences"), F.lit(0)).alias("n_sequences"), F.max("stride").alias("stride"), F.max("width").alias("width"), F.max("end_id").alias("end_id")).first()
    manifest = {"data": data, "per_shard": per_shard, **whole.asDict()}
    _stream_to(spark, f"{path}/manifest.json", json.dumps(manifest))
    return manifest


def read_shards(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(slot, tokens as bytes) of a written run from slot start to its end; files before it are pruned by their ranges of shards."""
    manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()["value"])
    shards = spark.read.parquet(f"{path}/{manifest['data']}")
    return read_slots(shards, start, max(start + 1, manifest["n_sequences"]), manifest["per_shard"])


def op8_training_order(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return training_order(docs, length=512, per_shard=1024, model_path=MODEL)
