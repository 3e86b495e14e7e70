"""N-gram Jaccard join with several global token orders.

A document's set holds its distinct k-word shingles, by 64-bit hash. All orders put shingles of few documents before common ones
(classes of their document frequency, counted over the corpus by 40-bit hash, so rare collisions move a shingle in all orders alike)
and differ within a class. Two sets that reach the threshold share a token among the first n - ceil(t * n) + 1 tokens of either, in
every order. A document whose prefix is all its own is done; pairs must share prefix tokens in all orders before they are verified
on the whole sets.

Equal sets are one node. Nodes are first connected: each is verified against leaders of its lists, and across what is still apart all
pairs are whose places in a list leave enough tokens to reach the threshold. Then every link between different sets is counted, within
components, in blocks that give counts and never pairs.
Documents without words are linked with nothing. Null texts have none. Rows that share an id are told apart by their sets, and ids may
be of any type that sorts. Case: A-Z are lower-cased.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm import blocks as B
from worksight.llm.hashing import Docs, U, Words, grams, mix, runs, stretches

ORDERS, STARS = 3, 3
#: Nodes and shingles of a part of a list or component, and blocks that components of one part share.
PART_NODES, PART_SHINGLES, SMALL = 512, 500_000, 4096
_SCHEMA = "node long, n_shingles long, tokens binary, p1 array<long>, p2 array<long>, p3 array<long>"


class _Sets:
    """Distinct shingles of each document of a block, sorted by document and hash."""

    def __init__(self, table: pa.Table, k: int, id_column: str, text_column: str):
        self.docs = d = Docs(table, id_column, text_column)
        w = Words(d, lower=True)
        n = len(w.doc)
        at = np.flatnonzero(w.doc[: max(0, n - k + 1)] == w.doc[k - 1 :][: max(0, n - k + 1)])
        short = np.flatnonzero((w.count > 0) & (w.count < k))
        whole = stretches(w.hash.view(np.uint8), 8 * w.base[short], 8 * w.base[short + 1])
        h, doc = np.concatenate([grams(w.hash, k)[at], whole]), np.concatenate([w.doc[at], short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
        self.hash, self.doc = h[new], doc[new]
        self.base = np.searchsorted(self.doc, np.arange(len(d) + 1))
        self.size = np.diff(self.base)


def _cut(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(24)).astype(np.int64)


def shingle_sets(docs: DataFrame, k: int, percent: int, id_column: str, text_column: str, n_bytes: int) -> DataFrame:
    """A row for each document: id, node (hash of its set), n_shingles and, if it may have partners, tokens and prefixes."""
    at = B.dealt(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), n_bytes)
    parts = max(1, n_bytes // (12 * B.PART_ENTRIES))
    read = lambda table: _Sets(table, k, "doc_id", "text")

    def ask(table: pa.Table) -> pa.Table:
        keys, times = np.unique(_cut(read(table).hash), return_counts=True)
        part = (keys >> 8) * parts >> 32  # ranges of equal width, by the upper 32 bits
        cuts = np.append(runs(part), len(keys))
        block = table.column(B.BLOCK)[0].as_py()
        rows = [{B.PART: int(part[a]), B.BLOCK: block, "kind": 0, "keys": B._tight(keys[a:b]), "flags": np.minimum(times[a:b], 255).astype(np.uint8).tobytes()} for a, b in zip(cuts, cuts[1:])]
        return pa.Table.from_pylist([{c: r.get(c) for c in B._SENT.names} for r in rows], B._SENT)

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        each = [B._loose(r["keys"], np.int64) for r in rows]
        keys = np.concatenate(each)
        times = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in rows]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        heads = runs(keys[order])
        total = np.zeros(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(times[order], heads), np.diff(np.append(heads, len(keys))))
        level = np.log2(np.maximum(total, 1)).astype(np.uint8)
        out, begin = [], 0
        for r, own in zip(rows, each):
            mine = slice(begin, begin + len(own))
            begin += len(own)
            if (many := total[mine] > 1).any():
                out.append({B.BLOCK: r[B.BLOCK], "kind": 0, "keys": B._tight(own[many]), "flags": level[mine][many].tobytes()})
        return pa.Table.from_pylist([{c: r.get(c) for c in B._ANSWERED.names} for r in out], B._ANSWERED)

    def make(table: pa.Table, got: list[dict]) -> pa.Table:
        x = read(table)
        n = len(x.docs)
        keys = np.concatenate([np.zeros(0, np.int64), *(B._loose(r["keys"], np.int64) for r in got)])
        levels = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r["flags"], np.uint8) for r in got)])
        order = np.argsort(keys)
        keys, levels = keys[order], levels[order]
        cut = _cut(x.hash)
        where = np.minimum(np.searchsorted(keys, cut), max(0, len(keys) - 1))
        level = np.where(keys[where] == cut, levels[where], 0).astype(np.uint8) if len(keys) else np.zeros(len(cut), np.uint8)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x.hash), dtype=np.uint64)])
        node = mix(sums[x.base[1:]] - sums[x.base[:-1]] + x.size.astype(np.uint64)).view(np.int64)
        prefix = np.where(x.size > 0, x.size + (-percent * x.size // 100) + 1, 0)  # n - ceil(t n) + 1
        own = np.bincount(x.doc[level == 0], minlength=n)
        alive = (x.size > 0) & (own < prefix)
        tokens = [x.hash[x.base[i] : x.base[i + 1]].tobytes() if alive[i] else None for i in range(n)]
        chosen = np.flatnonzero(alive[x.doc]) if n else np.zeros(0, np.int64)
        doc, hashes, lev = x.doc[chosen], x.hash[chosen], level[chosen]
        lists = []
        for k_order in range(ORDERS):
            order = np.lexsort((mix(hashes ^ U(0x9E3779B97F4A7C15 + k_order)), lev, doc))
            d = doc[order]
            rank = np.arange(len(d)) - np.searchsorted(d, d)
            keep = order[(rank < prefix[d]) & (lev[order] > 0)]
            off = np.searchsorted(doc[keep], np.arange(n + 1)).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(off), pa.array(hashes[keep].view(np.int64))))
        return pa.table([x.docs.table.column("doc_id"), pa.array(node), pa.array(x.size, pa.int64()), pa.array(tokens, pa.binary()), *lists], names=["doc_id", "node", "n_shingles", "tokens", "p1", "p2", "p3"])

    kind = docs.schema[id_column].dataType.simpleString()
    answers = at.groupBy(B.BLOCK).applyInArrow(ask, B.SENT).groupBy(B.PART).applyInArrow(count, B.ANSWERED)
    return B.finish(at, answers, make, f"doc_id {kind}, {_SCHEMA}")


def _shared(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in rows:
        yield pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets reach the threshold."""
    side = lambda s: sets.select(*(F.col(c).alias(f"{s}_{c}") for c in ("node", "n_shingles", "tokens", "p1", "p2", "p3")))
    both = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
    least, most = F.least("a_n_shingles", "b_n_shingles"), F.greatest("a_n_shingles", "b_n_shingles")
    both = both.filter(100 * least >= percent * most)
    for p in ("p1", "p2", "p3"):
        both = both.filter(F.arrays_overlap(f"a_{p}", f"b_{p}"))
    shared = F.pandas_udf(_shared, "long")
    both = both.select("a", "b", (F.col("a_n_shingles") + F.col("b_n_shingles")).alias("n"), shared("a_tokens", "b_tokens").alias("both"))
    return both.filter(100 * F.col("both") >= percent * (F.col("n") - F.col("both"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b). Labels spread to neighbours and then jump."""
    both = B.materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = B.materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("to"))
        further = labels.select(F.col("node").alias("to"), F.col("label").alias("jump"))
        new = B.materialise(new.join(further, "to", "left").select("node", F.least("to", F.coalesce("jump", "to")).alias("label"), F.col("label").alias("was")), "labels")
        if new.filter("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _labelled(edges: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """nodes with comp, the component that they have so far."""
    if edges is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(components(edges), "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")


def _open(lists: DataFrame) -> DataFrame:
    """Tokens whose nodes are in several components."""
    return lists.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")


def _connected(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links enough to connect all that links connect.

    In each round every node is tested against one leader of the lists that it shares; a list whose nodes are one component is done.
    What three rounds leave open is joined pair by pair across components, lists being split by size class and, if long, into parts.
    """
    spark = lists.sparkSession
    # a node is central if many share its tokens: the text that others were edited from
    central = lists.groupBy("node").agg(F.sum("n").alias("score"))
    lists = B.materialise(lists.select("token", "node", "rest", "size").join(central, "node"), "lists")
    edges = tested = led = None
    for _ in range(STARS):
        at = _labelled(edges, lists)
        if edges is not None:
            at = B.materialise(at, "lists")
            at = at.join(_open(at), "token")
        free = at if led is None else at.join(led, ["token", "node"], "left_anti")
        lead = F.max(F.struct("score", "node", "comp")).alias("lead")
        leads = free.groupBy("token").agg(lead).select("token", F.col("lead.node").alias("lead"), F.col("lead.comp").alias("lead_comp"), F.col("lead.score").alias("lead_score"))
        leads = B.materialise(leads, "leads")
        asked = at.join(leads, "token").filter("comp <> lead_comp").groupBy("node", "lead", "lead_score").agg(F.count("*").alias("n"))
        best = asked.groupBy("node").agg(F.max_by("lead", F.struct("lead_score", "n", "lead")).alias("lead"))
        pairs = best.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        pairs = B.materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = B.materialise(_verified(pairs, sets, percent), "edges")
        edges = found if edges is None else edges.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        leads = leads.select("token", F.col("lead").alias("node"))
        led = leads if led is None else led.union(leads)
        _release(spark)
    at = B.materialise(_labelled(edges, lists).select("token", "node", "comp", "rest", "size"), "lists")
    at = at.join(_open(at), "token")
    # sets that can reach the threshold are in the same size class or in neighbouring ones
    at = at.withColumn("class", F.floor(F.log("size") / F.lit(log(100 / percent) + 1e-9)))
    length = at.groupBy("token").agg(F.ceil(F.count("*") / F.lit(PART_NODES)).cast("int").alias("parts"))
    at = B.materialise(at.join(length, "token"), "lists")
    left = at.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = at.select("token", "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"o_{c}") for c in ("node", "comp", "size", "rest", "class")))
    other = other.withColumn("class", F.explode(F.array("class", F.col("class") + 1)))
    # at the first token that two sets share, what both have left bounds what they share
    enough = (100 + percent) * F.least("rest", "o_rest") >= percent * (F.col("size") + F.col("o_size"))
    near = (F.col("comp") != F.col("o_comp")) & (100 * F.least("size", "o_size") >= percent * F.greatest("size", "o_size"))
    once = (F.col("class") > F.col("o_class")) | (F.col("node") < F.col("o_node"))
    pairs = left.join(other, ["token", "class", "part"]).filter(near & enough & once)
    pairs = pairs.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()
    pairs = B.materialise(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    return edges.union(B.materialise(_verified(pairs, sets, percent), "edges"))


def _links_between(sizes: np.ndarray, tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets at left are linked with which at right, from products of their incidence matrices a slice of tokens at a time."""
    own = np.concatenate([left, right])
    values = np.concatenate([tokens[i] for i in own])
    row = np.repeat(np.arange(len(own)), sizes[own])
    _, value, times = np.unique(values, return_inverse=True, return_counts=True)
    value = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[value]  # tokens of one set alone are shared by none
    order = np.argsort(value, kind="stable")
    order = order[np.searchsorted(value[order], 0) :]
    row, value = row[order], value[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(value[-1]) + 1 if len(value) else 0, 4096):
        a, b = np.searchsorted(value, [begin, begin + 4096])
        there = np.zeros((len(own), 4096), np.float32)
        there[row[a:b], value[a:b] - begin] = 1
        both += there[: len(left)] @ there[len(left) :].T
    both = both.astype(np.int64)
    return 100 * both >= percent * (sizes[left][:, None] + sizes[right] - both)


def count_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, n_links): the links of each node of members (node, comp), which are within its component.

    Components are dealt into parts of bounded size, and each pair of parts is one block; a block gives a count for each of its
    nodes, never its pairs. Small components share blocks.
    """
    weight = F.ceil(F.greatest(F.count("*") / F.lit(PART_NODES), F.sum("n_shingles") / F.lit(PART_SHINGLES))).cast("int")
    at = members.join(sets.select("node", "n_shingles", "tokens"), "node")
    parts = members.join(sets.select("node", "n_shingles"), "node").groupBy("comp").agg(F.count("*").alias("n"), weight.alias("parts")).filter("n > 1")
    small = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("comp"), F.lit(SMALL))).otherwise(F.col("comp"))
    at = at.join(parts.select("comp", "parts"), "comp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at = at.select(small.alias("home"), "comp", "node", "n_shingles", "tokens", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("comp")
        comp, part, node, sizes = (table.column(c).to_numpy() for c in ("comp", "part", "node", "n_shingles"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        tokens = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("tokens")]
        out = np.zeros(len(node), np.int64)
        for begin, end in zip(heads := np.append(runs(comp), len(comp)), heads[1:]):
            own = np.arange(begin, end)
            left, right = own[part[begin:end] == lo], own[part[begin:end] == hi]
            if len(left) and len(right):
                linked = _links_between(sizes, tokens, left, right, percent)
                if lo == hi:
                    np.fill_diagonal(linked, False)
                    out[left] += linked.sum(1)
                else:
                    out[left] += linked.sum(1)
                    out[right] += linked.sum(0)
        return pa.table({"node": node, "n": out})

    counted = at.groupBy("home", "lo", "hi").applyInArrow(count, "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n_links"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", n_bytes: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links) and n_links (distinct other sets that this one is linked with)."""
    spark = docs.sparkSession
    n_bytes = B.text_bytes(docs, text_column) if n_bytes is None else n_bytes
    named = id_column
    docs, id_column = B.numbered(docs.select(named, text_column), named)
    every = shingle_sets(docs, k, percent, id_column, text_column, n_bytes).withColumn("row", F.monotonically_increasing_id())
    every = B.materialise(every, "sets")
    _release(spark)
    alive = every.filter("tokens IS NOT NULL")
    nodes = alive.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("row").alias("row"))
    sets = alive.join(nodes.select("node", "row"), ["node", "row"])  # one row of each set
    # rest: tokens of the set from this one on in the first order; those of the set alone stand before the prefix's
    last = F.ceil(F.col("n_shingles") * percent / F.lit(100)) - 1 + F.size("p1")
    lists = sets.select("node", F.col("n_shingles").alias("size"), last.alias("last"), F.posexplode("p1").alias("at", "token"))
    lists = B.materialise(lists.select("node", "token", "size", (F.col("last") - F.col("at")).alias("rest")), "lists")
    shared = lists.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    edges = _connected(B.materialise(lists.join(shared, "token"), "lists"), sets, percent)
    labels = components(edges)
    links = B.materialise(count_links(labels.withColumnRenamed("label", "comp"), sets, percent), "links")
    _release(spark)
    of_node = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    least = of_node.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_node = of_node.join(least, "comp").join(links, "node", "left").select("node", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    rows = every.select("doc_id", "node", "n_shingles", F.col("tokens").isNotNull().alias("alive"))
    out = rows.join(of_node, "node", "left")
    own = ~F.col("alive") | F.col("component_id").isNull()
    out = out.select(
        F.col("doc_id").alias(id_column), "n_shingles",
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(own, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
    )
    if id_column == named:
        return out
    names = docs.select(id_column, named).distinct()
    out = out.join(names, id_column, "left").withColumnRenamed("component_id", "component")
    names = names.select(F.col(id_column).alias("component"), F.col(named).alias("component_id"))
    return out.join(names, "component", "left").select(named, "n_shingles", "component_id", "n_links")


def _release(spark) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, k=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links")
