"""Whole-corpus exchanges of packed hashes.

Documents are dealt into blocks of a few MB by a hash of their id. A block sends the hashes it must compare with the rest of the
corpus as one packed row for each range of hashes; the task that owns a range answers every block with the keys that matter to it.
Within a block equal keys are combined first, so a key that a third of all documents share costs one entry a block. All rounds of
an operator form one plan in which the dealt-out documents are a single reused exchange.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from worksight.llm.hashing import U, mix, runs

BLOCK, PART = "__block", "__part"
#: Bytes of text in a block, and entries a range of hashes should hold.
BLOCK_BYTES, PART_ENTRIES = 3 << 20, 1_500_000
SENT = f"{PART} int, {BLOCK} long, kind int, keys binary, more binary, docs binary, places binary, flags binary"
ANSWERED = f"{BLOCK} long, kind int, keys binary, more binary, flags binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Only a session whose executors live in the driver, as in tests, gets one of its own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = shared_dir.own = tempfile.mkdtemp(prefix="worksight-")
        atexit.register(shutil.rmtree, at, True)
    return at


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession, at: str) -> None:
    try:
        remove(spark, at)
    except Exception:  # the session's JVM may have gone before us
        pass


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one; what is written there goes when the driver ends."""
    at = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    atexit.register(_remove_at_exit, spark, at)
    return at


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table of its own in the shared folder and returns it as read from there."""
    return written(df, own_folder(df.sparkSession, name))


def written(df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def numbered(docs: DataFrame, id_column: str) -> tuple[DataFrame, str]:
    """docs and the name of an integer column that orders rows as id_column does: itself, or else a number added to them.

    Ids that are no integers are sorted by ranges; a number holds the range and the place in it, so nothing is counted or collected.
    """
    if isinstance(docs.schema[id_column].dataType, IntegralType):
        return docs, id_column
    ids = docs.select(F.col(id_column).alias("__id")).filter(F.col("__id").isNotNull()).distinct()
    ids = ids.repartitionByRange("__id").sortWithinPartitions("__id").withColumn("__number", F.monotonically_increasing_id())
    ids = materialise(ids, "ids")
    return docs.join(ids, docs[id_column] == ids["__id"], "left").drop("__id"), "__number"


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def dealt(docs: DataFrame, n_bytes: int, id_column: str = "doc_id") -> DataFrame:
    n = max(1, -(-n_bytes // BLOCK_BYTES))
    return docs.withColumn(BLOCK, F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(n)))


@dataclass
class Entries:
    """What a block asks or tells about keys; equal keys at most once where the caller can combine them."""

    keys: np.ndarray
    docs: np.ndarray | None = None
    places: np.ndarray | None = None
    more: np.ndarray | None = None
    flags: np.ndarray | None = None
    kind: int = 0


def _tight(a: np.ndarray) -> bytes:
    """Differences, by significance of their bytes, which the shuffle's compression then shortens."""
    d = np.diff(a, prepend=a.dtype.type(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(len(d), -1).T).tobytes()


def _loose(b: bytes, kind: type) -> np.ndarray:
    w = np.dtype(kind).itemsize
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(w, -1).T).view(kind).ravel()
    return np.cumsum(d, dtype=kind)


def part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    return ((mix(keys ^ U(0x5851F42D4C957F2D)) >> U(33)) % U(n_parts)).astype(np.int32)


def pack(block: int, all_entries: list[Entries], n_parts: int) -> list[dict]:
    """A row for each range that has entries; ranges without any cost nothing, however many there are."""
    rows = []
    for e in all_entries:
        part = part_of(e.keys, n_parts)
        order = np.argsort(part, kind="stable")
        cuts = np.append(runs(part[order]), len(order))
        for begin, end in zip(cuts, cuts[1:]):
            at = order[begin:end]
            rows.append({
                PART: int(part[at[0]]),
                BLOCK: block,
                "kind": e.kind,
                "keys": e.keys[at].tobytes(),
                "more": None if e.more is None else e.more[at].tobytes(),
                "docs": None if e.docs is None else _tight(e.docs[at].astype(np.int64)),
                "places": None if e.places is None else _tight(e.places[at].astype(np.int64)),
                "flags": None if e.flags is None else e.flags[at].astype(np.uint8).tobytes(),
            })
    return rows


class Received:
    """All entries of one kind that came to a range, joined; owner: index into blocks."""

    def __init__(self, rows: list[dict]):
        def joined(name: str, read) -> np.ndarray:
            got = [read(r[name]) for r in rows if r[name] is not None]
            return np.concatenate(got) if got else np.zeros(0)

        self.blocks = [r[BLOCK] for r in rows]
        self.keys = joined("keys", lambda b: np.frombuffer(b, np.uint64)).astype(np.uint64)
        self.more = joined("more", lambda b: np.frombuffer(b, np.uint64)).astype(np.uint64)
        self.docs = joined("docs", lambda b: _loose(b, np.int64)).astype(np.int64)
        self.places = joined("places", lambda b: _loose(b, np.int64)).astype(np.int64)
        self.flags = joined("flags", lambda b: np.frombuffer(b, np.uint8)).astype(np.uint8)
        self.owner = np.repeat(np.arange(len(rows)), [len(r["keys"]) // 8 for r in rows])

    def answer(self, chosen: np.ndarray, kind: int = 0, more: np.ndarray | None = None, flags: np.ndarray | None = None) -> list[dict]:
        """Rows that tell each block which of its entries are chosen."""
        owner = self.owner[chosen]
        order = np.argsort(owner, kind="stable")
        at, owner = chosen[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(len(self.blocks) + 1))
        return [{BLOCK: b, "kind": kind, "keys": self.keys[x].tobytes(), "more": None if more is None else more[x].tobytes(), "flags": None if flags is None else flags[x].tobytes()} for i, b in enumerate(self.blocks) if len(x := at[cuts[i] : cuts[i + 1]])]


_TYPES = {PART: pa.int32(), BLOCK: pa.int64(), "kind": pa.int32(), "keys": pa.binary(), "more": pa.binary(), "docs": pa.binary(), "places": pa.binary(), "flags": pa.binary()}
_SENT = pa.schema([(k, _TYPES[k]) for k in (PART, BLOCK, "kind", "keys", "more", "docs", "places", "flags")])
_ANSWERED = pa.schema([(k, _TYPES[k]) for k in (BLOCK, "kind", "keys", "more", "flags")])


def send(docs: DataFrame, ask: Callable[[pa.Table], list[Entries]], n_parts: int) -> DataFrame:
    def f(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(pack(table.column(BLOCK)[0].as_py(), ask(table), n_parts), _SENT)

    return docs.groupBy(BLOCK).applyInArrow(f, SENT)


def send_again(docs: DataFrame, answers: DataFrame, ask: Callable[[pa.Table, list[dict]], list[Entries]], n_parts: int) -> DataFrame:
    def f(table: pa.Table, got: pa.Table) -> pa.Table:
        rows = pack(table.column(BLOCK)[0].as_py(), ask(table, got.to_pylist()), n_parts) if table.num_rows else []
        return pa.Table.from_pylist(rows, _SENT)

    return docs.groupBy(BLOCK).cogroup(answers.groupBy(BLOCK)).applyInArrow(f, SENT)


def settle(sent: DataFrame, decide: Callable[[dict[int, Received]], list[dict]]) -> DataFrame:
    def f(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        by_kind = {k: Received([r for r in rows if r["kind"] == k]) for k in {r["kind"] for r in rows}}
        return pa.Table.from_pylist(decide(by_kind), _ANSWERED)

    return sent.groupBy(PART).applyInArrow(f, ANSWERED)


def finish(docs: DataFrame, answers: DataFrame, make: Callable[[pa.Table, list[dict]], pa.Table], schema: str) -> DataFrame:
    def f(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        return make(table, got.to_pylist())

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    empty = to_arrow_schema(fields).empty_table()
    return docs.groupBy(BLOCK).cogroup(answers.groupBy(BLOCK)).applyInArrow(f, fields)


def told(rows: list[dict], kind: int = 0, column: str = "keys") -> np.ndarray:
    """The values of one kind that a block was told, sorted."""
    got = [np.frombuffer(r[column], np.uint64) for r in rows if r["kind"] == kind and r[column] is not None]
    return np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def repeated(got: dict[int, Received]) -> list[dict]:
    """Keys that occur twice or more; flags: 1 where a block holds its key several times."""
    if 0 not in got:
        return []
    x = got[0]
    order = np.argsort(x.keys)
    keys = x.keys[order]
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    total = np.add.reduceat(1 + x.flags[order].astype(np.int64), starts)
    return x.answer(order[np.repeat(total > 1, np.diff(np.append(starts, len(keys))))])


def not_first(got: dict[int, Received]) -> list[dict]:
    """Keys that occur earlier in the order of (doc, place)."""
    return got[0].answer(later(got[0])) if 0 in got else []


def later(x: Received) -> np.ndarray:
    """Entries whose key, and second key where there is one, also stands earlier."""
    second = x.more if len(x.more) else np.zeros(len(x.keys), np.uint64)
    order = np.lexsort((x.places, x.docs, second, x.keys))
    keys, second, docs, places = x.keys[order], second[order], x.docs[order], x.places[order]
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]) | (second[1:] != second[:-1])) + 1])
    first = np.repeat(starts, np.diff(np.append(starts, len(keys))))
    return order[(docs != docs[first]) | (places != places[first])]


def first_of(keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys in order of (doc, place): the index of the first of each key, and which entries stand later than it."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    at = first[back]
    return first, (docs != docs[at]) | (places != places[at])


def with_columns(table: pa.Table, columns: dict[str, pa.Array], schema: list[str]) -> pa.Table:
    """table with columns replaced or added, in the order of schema."""
    return pa.table([columns[c] if c in columns else table.column(c) for c in schema], names=schema)
