"""Centroid clustering with Drake's adaptive distance bounds, exact over integer vectors.

Vectors with exactly ``size`` components, none null or non-finite, take part; each component x becomes floor(scale * x). All distances
are squared Euclidean ones of integers, so the result doesn't depend on partitions or on the order of sums.

Each vector keeps an upper bound of the distance to its own centroid, lower bounds for its several nearest other centroids in order,
and one remainder bound for all the rest. When centroids have moved, the upper bound grows by its centroid's way and the lower bounds
shrink by theirs (the remainder's by the longest way). A vector of which all lower bounds stay above the upper bound isn't looked at;
where only the first few don't, those few centroids are measured again; where the remainder bound doesn't, all are. A bound must be
strictly greater, and bounds are rounded outwards, so ties are always measured and go to the smaller number. The count of bounds starts
at a quarter of the centroids and shrinks to the most that a round has needed, but not below an eighth.

A round is one pass over narrow rows without a shuffle, written to a table in the shared folder that cuts lineage; sums are combined
inside each task, so one row a centroid and task is shuffled. Only centroids, their sums and counts (k * size numbers) pass through the
driver.

Other columns are not carried. Rows with a null id take part but are no initial centroid; repeated rows are vectors of their own, and
repeated ids are ordered by their components. With fewer vectors than k each becomes a centroid; an empty table gives no rows. Components
beyond 2**26 after scaling are an error, as distances could leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm import blocks

LIMIT = 1 << 26
#: Below this components and their products are whole numbers in doubles, whose matrix product is the fastest.
EXACT = 1 << 22


@dataclass
class Clustering:
    #: (id, cluster, distance): a row for each vector that took part.
    rows: DataFrame
    centroids: np.ndarray
    #: By centroid: vectors and their distances' sum.
    counts: list[int]
    sums: list[int]
    #: By round: bounds held, and vectors that needed no distance, a few, or all of them.
    rounds: list[dict]


def _floats(x: np.ndarray, up: bool) -> np.ndarray:
    """x as floats that are not smaller (up) or not larger."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf if up else -np.inf))


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c.astype(np.int64)], 1)


def _measure_all(v: np.ndarray, c: np.ndarray, n_bounds: int) -> tuple[np.ndarray, ...]:
    """Cluster, its distance, the nearest others in order and all bounds, the remainder's last."""
    square = _squares(v, c)
    order = np.argsort(square, axis=1, kind="stable")
    sorted_ = np.take_along_axis(square, order, 1)
    bounds = np.full((len(v), n_bounds + 1), np.inf)
    bounds[:, : min(n_bounds + 1, len(c) - 1)] = np.sqrt(sorted_[:, 1 : n_bounds + 2]) * (1 - 1e-9)
    return order[:, 0], sorted_[:, 0], order[:, 1 : n_bounds + 1], bounds


def _again(v: np.ndarray, c: np.ndarray, own: np.ndarray, upper: np.ndarray, near: np.ndarray, bounds: np.ndarray, way: np.ndarray) -> dict:
    """The next state of vectors whose centroids have moved by way."""
    b = near.shape[1]
    upper = upper + way[own]
    bounds = bounds - np.concatenate([way[near], np.full((len(v), 1), way.max(initial=0))], 1)
    bounds = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]  # so that those which aren't certified come first
    open_ = (bounds <= upper[:, None]).sum(1)
    todo = np.flatnonzero(open_)
    distance = ((v[todo] - c[own[todo]]) ** 2).sum(1)
    upper[todo] = np.sqrt(distance) * (1 + 1e-9)
    open_[todo] = (bounds[todo] <= upper[todo][:, None]).sum(1)
    some, every = np.flatnonzero((open_ > 0) & (open_ <= b)), np.flatnonzero(open_ > b)
    if len(some):
        top = int(open_[some].max())
        square = np.full((len(some), 1 + top), np.iinfo(np.int64).max)
        which = np.concatenate([own[some][:, None], near[some, :top]], 1)
        tie = len(c) + np.broadcast_to(np.arange(1 + top), which.shape)  # places that aren't measured stay where they are
        tie = np.where(np.arange(1 + top) <= open_[some][:, None], which, tie)
        for j in range(1 + top):
            at = np.flatnonzero(open_[some] >= j)
            square[at, j] = ((v[some[at]] - c[which[at, j]]) ** 2).sum(1)
        order = np.lexsort((tie, square), axis=-1)
        which, square = np.take_along_axis(which, order, 1), np.take_along_axis(square, order, 1)
        own[some], near[some, :top], upper[some] = which[:, 0], which[:, 1:], np.sqrt(square[:, 0]) * (1 + 1e-9)
        measured = np.arange(1, 1 + top) <= open_[some][:, None]
        bounds[some, :top] = np.where(measured, np.sqrt(square[:, 1:].astype(np.float64)) * (1 - 1e-9), bounds[some, :top])
    if len(every):
        own[every], square, near[every], bounds[every] = _measure_all(v[every], c, b)
        upper[every] = np.sqrt(square) * (1 + 1e-9)
    return {"own": own, "upper": upper, "near": near, "bounds": bounds, "open": open_}


def _vectors(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors, and which rows they are."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    rows = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    flat = column.filter(sized).flatten().cast(pa.float64())
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    whole = np.isfinite(x).all(1)
    x = np.floor(x[whole] * scale)
    if np.abs(x).max(initial=0) > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} after scaling")
    return x.astype(np.int64), rows[whole]


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(x).ravel(), kind))


def cluster(vectors: DataFrame, k: int, rounds: int, seed: str, size: int, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> Clustering:
    """Vectors by their nearest of k centroids after ``rounds`` rounds of Lloyd's iteration.

    Centroids start as the k vectors with the smallest sha256 of seed and id.
    """
    if not 0 < k < 1 << 15:
        raise ValueError("k must be from 1 to 32767")
    id_kind = vectors.schema[id_column].dataType.simpleString()
    source = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("x"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, rows = _vectors(batch.column(1), size, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _lists(v, pa.int32())], names=["id", "v"])

    kept = source.mapInArrow(read, f"id {id_kind}, v array<int>")
    first = kept.filter("id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), "v").limit(k).collect()
    c = np.array([r["v"] for r in first], np.int64).reshape(len(first), size)
    if not len(c):  # nothing to measure against
        return Clustering(kept.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c, [], [], [])
    n_bounds, told = min(max(1, -(-k // 4)), len(c) - 1), []
    state_kind = f"id {id_kind}, v array<int>, own short, upper float, near array<short>, bounds array<float>, open short"

    def state(ids: pa.Array, v: np.ndarray, own: np.ndarray, upper: np.ndarray, near: np.ndarray, bounds: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
        columns = [ids, _lists(v, pa.int32()), pa.array(own.astype(np.int16)), pa.array(_floats(upper, True)), _lists(near.astype(np.int16), pa.int16()), _lists(_floats(bounds, False), pa.float32()), pa.array(open_.astype(np.int16))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "v", "own", "upper", "near", "bounds", "open"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, size)
            own, square, near, bounds = _measure_all(v, c, n_bounds)
            yield state(batch.column(0), v, own, np.sqrt(square) * (1 + 1e-9), near, bounds, np.full(len(v), n_bounds + 1))

    def read_state(batch: pa.RecordBatch, held: int, keep: int) -> tuple[np.ndarray, ...]:
        wide = lambda i, n, kind: batch.column(i).flatten().to_numpy().astype(kind).reshape(batch.num_rows, n)
        near, bounds = wide(4, held, np.int64), wide(5, held + 1, np.float64)
        if keep < held:  # bounds given up join the remainder
            near, bounds = near[:, :keep], np.concatenate([bounds[:, :keep], bounds[:, keep:].min(1)[:, None]], 1)
        return wide(1, size, np.int64), batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.float64), near, bounds

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each centroid: sums of components, and the count behind them."""
        total = np.zeros((len(c), size + 1), np.int64)
        for batch in batches:
            v, own = batch.column(0).flatten().to_numpy().astype(np.int64).reshape(-1, size), batch.column(1).to_numpy()
            if not len(own):
                continue
            order = np.argsort(own, kind="stable")
            at = np.flatnonzero(np.diff(own[order], prepend=-1))
            total[own[order][at]] += np.concatenate([np.add.reduceat(v[order], at), np.diff(np.append(at, len(own)))[:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), _lists(total, pa.int64())], names=["own", "total"])

    at, held = blocks.own_folder(vectors.sparkSession, "bounds"), n_bounds
    now = blocks.written(kept.mapInArrow(begin, state_kind), at)
    for _ in range(rounds):
        parts = now.select("v", "own").mapInArrow(summed, "own long, total array<long>").select("own", F.posexplode("total").alias("at", "n"))
        got = np.zeros((len(c), size + 1), object)
        for r in parts.groupBy("own", "at").agg(F.sum("n").alias("n")).collect():  # k * (size + 1) numbers
            got[r["own"], r["at"]] = r["n"]
        was, c = c, np.array([[int(x) // int(t[size]) for x in t[:size]] if t[size] else old.tolist() for t, old in zip(got, c)], np.int64).reshape(c.shape)
        way = np.sqrt(((c - was) ** 2).sum(1)) * (1 + 1e-9)
        keep = n_bounds

        def move(batches: Iterator[pa.RecordBatch], c=c, way=way, held=held, keep=keep) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, own, upper, near, bounds = read_state(batch, held, keep)
                yield state(batch.column(0), v, **{"open_" if k == "open" else k: x for k, x in _again(v, c, own, upper, near, bounds, way).items()})

        before, at, held = at, blocks.own_folder(vectors.sparkSession, "bounds"), keep
        now = blocks.written(now.mapInArrow(move, state_kind), at)
        blocks.remove(vectors.sparkSession, before)
        seen = now.agg(F.sum(F.expr("int(open = 0)")).alias("none"), F.sum(F.expr(f"int(open BETWEEN 1 AND {held})")).alias("few"), F.sum(F.expr(f"int(open > {held})")).alias("all"), F.max(F.when(F.col("open") <= held, F.col("open"))).alias("most")).first()
        told.append({"bounds": held, "none": seen["none"], "few": seen["few"], "all": seen["all"]})
        n_bounds = min(held, max(1, -(-k // 8), seen["most"] or 0))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, own = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, size), batch.column(2).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(((v - c[own]) ** 2).sum(1))], names=["id", "cluster", "distance"])

    rows = now.select("id", "v", "own").mapInArrow(finish, f"id {id_kind}, cluster int, distance long")
    counts, sums = [0] * len(c), [0] * len(c)
    for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("sum")).collect():  # k rows
        counts[r["cluster"]], sums[r["cluster"]] = r["n"], r["sum"]
    return Clustering(rows, c, counts, sums, told)


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, seed="2:", size=64)
    by_cluster = [(i, s, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, (x, s) in enumerate(zip(found.centroids.tolist(), found.sums))]
    told = spark.createDataFrame(by_cluster, "cluster int, cluster_inertia long, centroid_sha256 string")  # k rows
    out = found.rows.join(F.broadcast(told), "cluster").withColumn("inertia", F.lit(sum(found.sums)).cast("long"))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
