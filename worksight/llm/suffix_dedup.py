"""Repeated byte strings, found with a run-length suffix index.

Every string of ``length`` bytes is represented by the least of its 24-byte grams (by hash, leftmost). Consecutive starts with the
same representative form a stretch; its content is settled first: of stretches with equal content only the first occurrence in
order of (doc_id, start) is kept, and stretches whose representative occurs nowhere else are done. What is left, one copy of every
distinct content, goes to the shard that owns the representative, where all equal strings therefore meet.

A shard builds the Burrows-Wheeler transform of its contents and keeps its runs: for every run head the text position, its
predecessor in suffix order and their common length. Streaming over the text, the values of all other positions follow from the
last run head before them (both move on by one and the length shrinks by one), which gives the matching statistics with the
predecessor. Starts that match over ``length`` bytes or more are linked, and all but the first of each group are later.

A representative with more than ``HOT`` distinct contents within one block is common to very many documents (the edges of a
passage that everything quotes). Its strings are settled one by one, by hash, combined within each block before they are sent.

Nulls and empty texts have no bytes. Rows that share doc_id and position don't outrank each other. Ids may be of any type that sorts.
Contents meet by gram and a hash of 64 bits, single strings by two such hashes; the driver draws their seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm import blocks as B
from worksight.llm.hashing import CHUNK, SEEDS, Docs, U, cover, grams, mix, packed, runs, slide, stretches, within
from worksight.llm.substring_dedup import strings

#: A shard is as large as an index that is built at once; a byte of it takes some 120 bytes of memory meanwhile. Equal strings share a shard at any size.
GRAM, HOT, SHARD_BYTES = 24, 16, 1 << 20
LATER, INDEXED, HASHED = 1, 2, 3


def _byte_grams(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive bytes."""
    if k % 8 or len(buf) < k:
        return stretches(buf, at := np.arange(max(0, len(buf) - k + 1)), at + k)
    eight = packed(buf)[: len(buf) - 7]
    out = np.empty(len(buf) - k + 1, np.uint64)
    for begin in range(0, len(out), CHUNK):
        own = eight[begin : begin + CHUNK + k - 8]
        h = mix(own[: len(own) - k + 8] ^ SEEDS[0])
        for at in range(8, k, 8):
            h = mix(h ^ own[at : at + len(h)])
        out[begin : begin + CHUNK] = h
    return out


class _Stretches:
    def __init__(self, table: pa.Table, length: int, id_column: str, text_column: str):
        self.docs = d = Docs(table, id_column, text_column)
        self.length = length
        k = min(GRAM, length)
        m, n = length - k + 1, max(0, len(d.buf) - length + 1)
        sizes = np.maximum(np.diff(d.off) - length + 1, 0)
        hashes = _byte_grams(d.buf, k)
        valid = cover(n, d.off[:-1][sizes > 0], (d.off[:-1] + sizes)[sizes > 0])
        if n:
            least = slide((hashes & U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64), m) & U(0xFFFFFFFF)
            least = np.where(valid, least, U(0xFFFFFFFF))
            start = runs(least)
            size = np.diff(np.append(start, n))
            good = least[start] != U(0xFFFFFFFF)
            self.start, self.size, at = start[good], size[good], least[start[good]].astype(np.int64)
        else:
            self.start = self.size = at = np.zeros(0, np.int64)
        self.gram = hashes[at] if len(at) else np.zeros(0, np.uint64)
        self.content = stretches(d.buf, self.start, self.start + self.size - 1 + length)
        self.doc = np.searchsorted(d.off, self.start, side="right") - 1
        self.ids, self.places = d.ids[self.doc], self.start - d.off[self.doc]
        self.first, self.again = B.first_of(self.content, self.ids, self.places)
        # contents of each representative, in order of occurrence, to find the hot ones
        f = np.sort(self.first)
        order = np.argsort(self.gram[f], kind="stable")
        heads = runs(self.gram[f][order])
        sizes = np.diff(np.append(heads, len(order)))
        rank = np.arange(len(order)) - np.repeat(heads, sizes)
        hot = np.repeat(sizes > HOT, sizes)
        self.sent, self.sent_hot = f[order][rank < HOT], hot[rank < HOT]
        self.unsent = self.content[f[order][rank >= HOT]]

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Starts of all strings in the stretches."""
        size = self.size[which]
        return np.repeat(self.start[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _settle_contents(got: dict[int, B.Received]) -> list[dict]:
    if 0 not in got:
        return []
    x = got[0]
    order = np.lexsort((x.places, x.docs, x.more, x.keys))
    key, content, docs, places = x.keys[order], x.more[order], x.docs[order], x.places[order]
    new_key = np.append(True, key[1:] != key[:-1])
    new = new_key | np.append(True, content[1:] != content[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (docs != docs[first]) | (places != places[first])
    heads = np.flatnonzero(new_key)
    sizes = np.diff(np.append(heads, len(order)))
    contents = np.repeat(np.add.reduceat(new.astype(np.int64), heads), sizes)
    hot = np.repeat(np.maximum.reduceat(x.flags[order], heads), sizes) > 0
    pick = lambda mask, kind: x.answer(order[mask], kind, more=x.more)
    return pick(later, LATER) + pick(~later & ~hot & (contents > 1), INDEXED) + pick(~later & hot, HASHED)


class RunIndex:
    """Run-length index of contents, each a byte string; earlier strings come first."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        n = len(data) + len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(n + 8, np.uint8)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[:n][inside] = data + np.uint8(1)  # UTF-8 has no bytes of 0xF8 and more, so 0 is free to end a content
        narrow = np.int32 if n < 1 << 31 else np.int64
        self.left = (np.repeat(ends, sizes + 1) - np.arange(n)).astype(narrow)
        pack = np.zeros(n, np.uint64)
        for k in range(8):
            pack |= text[k : n + k].astype(np.uint64) << U(56 - 8 * k)
        cut = np.maximum(7 - self.left, 0).astype(np.uint64) * U(8)
        self.pack = np.where(self.left < 7, (pack >> cut) << cut, pack)
        rank = np.unique(self.pack, return_inverse=True)[1].astype(narrow)
        self.ranks, width = [(8, rank)], 8
        while rank.max(initial=0) < n - 1 and width <= int(sizes.max(initial=0)):
            ahead = np.minimum(np.arange(n) + width, n - 1)
            rank = np.unique(rank.astype(np.int64) * (n + 1) + np.where(self.left >= width, rank[ahead] + 1, 0), return_inverse=True)[1].astype(narrow)
            width *= 2
            self.ranks.append((width, rank))
        suffixes = np.argsort(rank, kind="stable")
        bwt = np.where(suffixes > 0, text[suffixes - 1], 0)
        head = np.append(True, (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0))
        #: A sample for every run head: text position, predecessor in suffix order, common length.
        at = np.flatnonzero(head)
        self.position = suffixes[at]
        self.before = np.where(at > 0, suffixes[at - 1], -1)
        order = np.argsort(self.position)
        self.position, self.before = self.position[order], self.before[order]
        self.common = np.where(self.before < 0, 0, self.common_length(self.position, np.maximum(self.before, 0)))
        self.n_runs, self.n = len(at), n

    def common_length(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        most = np.minimum(self.left[p], self.left[q])
        out = np.zeros(len(p), np.int64)
        for width, rank in reversed(self.ranks):
            a, b = np.minimum(p + out, self.n_last()), np.minimum(q + out, self.n_last())
            out += np.where((out + width <= most) & (rank[a] == rank[b]), width, 0)
        a, b = np.minimum(p + out, self.n_last()), np.minimum(q + out, self.n_last())
        odd, tail = self.pack[a] ^ self.pack[b], np.zeros(len(p), np.int64)
        same = np.ones(len(p), bool)
        for k in range(8):
            same &= (odd >> U(56 - 8 * k)) & U(0xFF) == 0
            tail += same
        return np.minimum(out + tail, most)

    def n_last(self) -> int:
        return len(self.left) - 1

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """For every text position its predecessor in suffix order and the length they share."""
        sample = np.zeros(self.n, np.int64)
        sample[self.position] = np.arange(len(self.position))
        sample = np.maximum.accumulate(sample)
        moved = np.arange(self.n) - self.position[sample]
        return self.before[sample] + moved, np.maximum(self.common[sample] - moved, 0)

    def later(self, length: int) -> np.ndarray:
        """Positions whose string of this length also starts earlier in the text."""
        before, common = self.stream()
        own = np.arange(self.n)
        root = np.where(common >= length, before, own)
        while len(at := np.flatnonzero(root[root] != root)):
            root[at] = root[root[at]]
        first = own.copy()
        linked = np.flatnonzero(common >= length)
        np.minimum.at(first, root[linked], linked)
        return own > first[root]


def _settle_strings(length: int):
    def decide(got: dict[int, B.Received]) -> list[dict]:
        rows = []
        if HASHED in got:
            rows += got[HASHED].answer(B.later(got[HASHED]), HASHED)
        if INDEXED in got:
            x = got[INDEXED]
            size = (x.places & 65535) + length - 1
            offset = np.cumsum(size) - size
            order = np.lexsort((x.places, x.docs, x.keys))
            key = x.keys[order]
            shard = (np.cumsum(size[order]) - size[order]) // SHARD_BYTES
            shard = shard[np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), np.arange(len(key)), 0))]
            for a, b in zip(cuts := np.append(runs(shard), len(shard)), cuts[1:]):
                at = order[a:b]
                n = size[at]
                begin = np.cumsum(n) - n
                data = x.flags[np.repeat(offset[at] - begin, n) + np.arange(int(n.sum()))]
                late = RunIndex(data, n).later(length)
                begin += np.arange(len(n))  # with the ends
                which = np.repeat(np.arange(len(n)), n + 1)
                found = np.flatnonzero(late)
                new = np.append(True, (found[1:] != found[:-1] + 1) | (which[found[1:]] != which[found[:-1]]))[: len(found)]
                heads = np.flatnonzero(new)
                count = np.diff(np.append(heads, len(found)))
                owner = at[which[found[heads]]]
                run = ((found[heads] - begin[which[found[heads]]]) * 65536 + count).astype(np.uint64)
                for block in np.unique(x.owner[owner]):
                    mine = x.owner[owner] == block
                    rows.append({B.BLOCK: x.blocks[block], "kind": INDEXED, "keys": x.more[owner[mine]].tobytes(), "more": run[mine].tobytes(), "flags": None})
        return rows

    return decide


def suffix_dedup(docs: DataFrame, length: int = 100, id_column: str = "doc_id", text_column: str = "text", n_bytes: int | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    if length > 65_535:
        raise ValueError("length is at most 65,535")
    total = B.text_bytes(docs, text_column) if n_bytes is None else n_bytes
    own, (docs, id_column) = docs.columns, B.numbered(docs, id_column)
    at = B.dealt(docs, total, id_column)
    parts = max(1, total // (20 * B.PART_ENTRIES))
    read = lambda table: _Stretches(table, length, id_column, text_column)

    def ask(table: pa.Table) -> list[B.Entries]:
        x = read(table)
        s = x.sent
        return [B.Entries(x.gram[s], x.ids[s], x.places[s], x.content[s], x.sent_hot.astype(np.uint8))]

    def hashed(x: _Stretches, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts = np.sort(x.windows(chosen))
        doc = np.searchsorted(x.docs.off, starts, side="right") - 1
        return starts, stretches(x.docs.buf, starts, starts + length), x.docs.ids[doc], starts - x.docs.off[doc]

    def send_strings(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B._SENT.empty_table()
        rows, block, x = got.to_pylist(), table.column(B.BLOCK)[0].as_py(), read(table)
        # what the block will need again comes back with the next answer
        out = [{B.PART: block % parts, B.BLOCK: block, "kind": k + 10, "keys": B.told(rows, k, "more").tobytes()} for k in (LATER, HASHED)]
        f = np.sort(x.first)
        chosen = f[within(np.union1d(B.told(rows, HASHED, "more"), x.unsent), x.content[f])]
        if len(chosen):
            at, keys, ids, places = hashed(x, chosen)
            first, _ = B.first_of(keys, ids, places)
            first.sort()
            second = stretches(x.docs.buf, at[first], at[first] + length, 1)
            out += B.pack(block, [B.Entries(keys[first], ids[first], places[first], second, kind=HASHED)], parts)
        chosen = f[within(B.told(rows, INDEXED, "more"), x.content[f])]
        part = B.part_of(x.gram[chosen], parts)
        for p in np.unique(part):
            s = chosen[part == p]
            n = x.size[s] + length - 1
            data = x.docs.buf[np.repeat(x.start[s] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            out.append({B.PART: int(p), B.BLOCK: block, "kind": INDEXED, "keys": x.gram[s].tobytes(), "more": x.content[s].tobytes(), "docs": B._tight(x.ids[s]), "places": B._tight(x.places[s] * 65536 + x.size[s]), "flags": data.tobytes()})
        return pa.Table.from_pylist([{c: r.get(c) for c in B._SENT.names} for r in out], B._SENT)

    def settle(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        back = [{B.BLOCK: r[B.BLOCK], "kind": r["kind"], "keys": r["keys"]} for r in rows if r["kind"] > 10]
        rows = [r for r in rows if r["kind"] < 10]
        out = back + _settle_strings(length)({k: B.Received([r for r in rows if r["kind"] == k]) for k in {r["kind"] for r in rows}})
        return pa.Table.from_pylist([{c: r.get(c) for c in B._ANSWERED.names} for r in out], B._ANSWERED)

    contents = B.settle(B.send(at, ask, parts), _settle_contents)
    sent = at.groupBy(B.BLOCK).cogroup(contents.groupBy(B.BLOCK)).applyInArrow(send_strings, B.SENT)
    answers = sent.groupBy(B.PART).applyInArrow(settle, B.ANSWERED)
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    names = [f.name for f in docs.schema.fields if f.name not in added] + added
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in added), "n_bytes long, n_removed long, n_spans long, kept binary"])

    def make(table: pa.Table, got: list[dict]) -> pa.Table:
        x = read(table)
        d, n = x.docs, len(x.docs.buf)
        whole = x.again | within(B.told(got, LATER + 10), x.content)
        starts, ends = [x.start[whole]], [x.start[whole] + x.size[whole] - 1 + length]
        f = np.sort(x.first)
        chosen = f[within(np.union1d(B.told(got, HASHED + 10), x.unsent), x.content[f])]
        if len(chosen):
            at, keys, ids, places = hashed(x, chosen)
            _, again = B.first_of(keys, ids, places)
            late = at[again | within(B.told(got, HASHED), keys)]
            starts.append(late)
            ends.append(late + length)
        told = [r for r in got if r["kind"] == INDEXED]
        if told:
            content, run = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in told]) for c in ("keys", "more"))
            order = np.argsort(content, kind="stable")
            content, run = content[order], run[order].astype(np.int64)
            kept = np.flatnonzero(~x.again)
            lo = np.searchsorted(content, x.content[kept])
            times = np.searchsorted(content, x.content[kept], side="right") - lo
            run = run[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
            begin = np.repeat(x.start[kept], times) + (run >> 16)
            starts.append(begin)
            ends.append(begin + (run & 65535) - 1 + length)
        gone = cover(n, np.concatenate(starts), np.concatenate(ends))
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[d.off[1:]] - sums[d.off[:-1]]
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = d.off[:-1][np.diff(d.off) > 0]
        head[inner] = gone[inner]
        heads = np.concatenate([[0], np.cumsum(head)])
        columns = {"n_bytes": pa.array(np.diff(d.off), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(heads[d.off[1:]] - heads[d.off[:-1]], pa.int64()), "kept": strings(d.buf[~gone], d.off - sums[d.off], binary=True)}
        return B.with_columns(d.table, columns, names)

    out = B.finish(at, answers, make, schema)
    return out if id_column in own else out.drop(id_column)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = suffix_dedup(docs, length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
