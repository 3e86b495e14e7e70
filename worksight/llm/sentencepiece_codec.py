"""SentencePiece encoding and decoding by unigram Viterbi.

Pieces are read from a model file and kept in a double-array trie over their UTF-8 bytes. A text gets a marker for each space and one
before its start; the segmentation with the highest sum of log scores wins, of equal ones that whose last differing piece starts
earlier. Characters that no piece covers cost 10 more than the worst piece and become byte pieces. Models that hold merge ranks
instead of log scores get the log probability of that rank under Zipf's law.

No piece holds a marker after another character, so a text falls into chunks (markers and the word after them, or a line feed or
tab where no piece has one) that are segmented on their own; equal chunks of a batch are segmented once, and all chunks of a batch
advance together. Decoding joins pieces, turns markers into spaces, byte pieces into bytes and drops the first space, which gives
the text back exactly, but for the marker's own character (U+2581), which comes back as a space.

Null and empty texts have no pieces (null decodes to null). Other columns pass through; rows are independent of each other.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.hashing import stretches

#: Segmentations that a worker remembers.
KEPT = 1_000_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
_BYTE_PIECE, _UNKNOWN, _CONTROL = 6, 2, 3


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            n = number()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, data[i : i + n]
            i += n


def read_pieces(model: bytes) -> list[tuple[bytes, float, int]]:
    """(piece, score, type) in order of their ids."""
    out = []
    for field, value in _fields(model):
        if field == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: 1} | dict(_fields(value))
            out.append((piece[1], struct.unpack("<f", piece[2])[0], piece[3]))
    return out


class DoubleArray:
    """Trie in two arrays: the child of state s by byte b is base[s] + b + 1 if check holds s there."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values):
            s = 0
            for b in key:
                if b not in children[s]:
                    children[s][b] = len(children)
                    children.append({})
                    value.append(-1)
                s = children[s][b]
            value[s] = v
        n = 8 * len(children) + 4096
        used = bytearray(n)
        used[0] = 1
        self.base, self.check, self.value = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        place, queue, cursor, free = {0: 0}, [0], 1, 1
        for s in queue:
            self.value[place[s]] = value[s]
            offsets = sorted(b + 1 for b in children[s])
            if not offsets:
                continue
            if len(offsets) == 1:  # fills the holes
                free = max(free, offsets[0] + 1)
                while used[free]:
                    free += 1
                at = free - offsets[0]
            else:
                at, tries = cursor, 0
                while any(used[at + x] for x in offsets):
                    at += 1
                    tries += 1
                if tries > 64:  # crowded up to here
                    cursor = at
            self.base[place[s]] = at
            for b, c in children[s].items():
                spot = at + b + 1
                used[spot], self.check[spot], place[c] = 1, place[s], spot
                queue.append(c)
        self.depth = max(map(len, keys), default=0)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and which exist."""
        to = self.base[state] + byte + 1
        return to, self.check[to] == state


class Codec:
    def __init__(self, model: bytes):
        pieces = read_pieces(model)
        ranks = all(s == round(s) for _, s, t in pieces if t == 1)
        self.pieces = [p for p, _, _ in pieces]
        plain = [i for i, (_, _, t) in enumerate(pieces) if t in (1, 4)]
        self.score = np.array([-np.log(max(1.0, -s)) if ranks else s for _, s, _ in pieces])
        self.unknown_score = self.score[plain].min() - 10
        self.byte_id = np.full(256, next((i for i, x in enumerate(pieces) if x[2] == _UNKNOWN), 0), np.int64)
        for i, (p, _, t) in enumerate(pieces):
            if t == _BYTE_PIECE:
                self.byte_id[int(p[1:-1], 16)] = i
        if any(MARK in p.lstrip(MARK) and p.lstrip(MARK) != p and MARK in p.decode().lstrip("▁").encode() for p in (self.pieces[i] for i in plain)) or any(MARK in self.pieces[i].decode().lstrip("▁").encode() for i in plain):
            raise ValueError("a piece holds a marker after another character")
        self.trie = DoubleArray([self.pieces[i] for i in plain], plain)
        #: Bytes that are in no piece and stand alone.
        have = set(b"".join(self.pieces[i] for i in plain))
        self.alone = np.array([b < 128 and b not in have for b in range(256)])
        out = [bytes([int(p[1:-1], 16)]) if t == _BYTE_PIECE else b"" if t == _CONTROL else p.replace(MARK, b" ") for p, _, t in pieces]
        self.kept = np.empty(0, [("hash", np.uint64), ("second", np.uint64), ("place", np.int64), ("size", np.int64)])
        self.kept_ids = np.zeros(0, np.int64)
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([len(x) for x in out])
        self.out_start = np.cumsum(self.out_size) - self.out_size

    def segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and their number in each."""
        n = len(chunks)
        size = np.array([len(c) for c in chunks], np.int64)
        order = np.argsort(-size, kind="stable")
        longest = int(size.max(initial=0))
        begin = np.cumsum(size) - size
        text = np.frombuffer(b"".join(chunks) + b"\0", np.uint8).astype(np.int32)
        cell = begin + np.arange(n)  # a chunk of n bytes has n + 1 places
        total = int(size.sum()) + n
        best, piece, back = np.full(total, -np.inf), np.full(total, -1, np.int64), np.zeros(total, np.int64)
        best[cell] = 0.0
        in_order = -size[order]
        for i in range(longest):
            live = order[: np.searchsorted(in_order, -i, side="left")]  # longer than i
            live = live[(text[begin[live] + i] & 0xC0) != 0x80]
            live = live[best[cell[live] + i] > -np.inf]
            if not len(live):
                continue
            first = text[begin[live] + i]
            wide = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            single = np.zeros(len(live), bool)
            at, state, which = live, np.zeros(len(live), np.int32), np.arange(len(live))
            k = i
            while len(at) and k < longest:
                state, ok = self.trie.step(state, text[begin[at] + k])
                at, state, which = at[ok], state[ok], which[ok]
                k += 1
                found = self.trie.value[state] >= 0
                if found.any():
                    a, v = at[found], self.trie.value[state[found]]
                    single[which[found][wide[which[found]] == k - i]] = True
                    new, to = best[cell[a] + i] + self.score[v], cell[a] + k
                    better = new > best[to]
                    best[to[better]], piece[to[better]], back[to[better]] = new[better], v[better], i
                go = size[at] > k
                at, state, which = at[go], state[go], which[go]
            a, w = live[~single], np.minimum(wide[~single], size[live[~single]] - i)
            new, to = best[cell[a] + i] + self.unknown_score, cell[a] + i + w
            better = new > best[to]
            best[to[better]], piece[to[better]], back[to[better]] = new[better], -2, i
        # walk back, all chunks together, and write from the end
        steps_chunk, steps_id, steps_place = [], [], []
        at, place = np.flatnonzero(size > 0), size[size > 0]
        while len(at):
            p, b = piece[cell[at] + place], back[cell[at] + place]
            known = p >= 0
            steps_chunk.append(at[known])
            steps_id.append(p[known])
            steps_place.append(b[known])
            for k in range(4):
                x = ~known & (b + k < place)
                steps_chunk.append(at[x])
                steps_id.append(self.byte_id[text[begin[at[x]] + b[x] + k]])
                steps_place.append(b[x] + k)
            on = b > 0
            at, place = at[on], b[on]
        chunk, ids, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (steps_chunk, steps_id, steps_place))
        order = np.argsort(begin[chunk] + place, kind="stable")
        return ids[order], np.bincount(chunk, minlength=n)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number in each."""
        each = [b" " + t.encode("utf-8", "replace").replace(MARK, b" ") if t else b"" for t in texts]
        data, off = b"".join(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        if len(self.kept) > KEPT:
            self.kept, self.kept_ids = self.kept[:0], self.kept_ids[:0]
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        start, end = self._chunks(np.frombuffer(data, np.uint8), off)
        of, at, sizes = self._segmented(data, start, end)
        n = sizes[of]
        out = self.kept_ids[np.repeat(at[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return out.astype(np.int32), np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, off)])

    def _chunks(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts at texts, before each run of blanks and around bytes that stand alone; no piece crosses a cut."""
        blank = buf == 0x20
        alone = self.alone[buf] & ~blank
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut |= alone
        cut[1:] |= alone[:-1]
        cut[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], len(buf))

    def _segmented(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk the distinct one that it equals, and of those where in kept_ids their ids stand and how many they are.

        Chunks of a batch are told apart by a hash of 64 bits, those kept from earlier batches by two; they stay until there are more than KEPT.
        """
        buf = np.frombuffer(data, np.uint8)
        hashes, first, of = np.unique(stretches(buf, start, end), return_index=True, return_inverse=True)
        second_hash = stretches(buf, start[first], end[first], 1)
        at = np.minimum(np.searchsorted(self.kept["hash"], hashes), max(0, len(self.kept) - 1))
        have = (self.kept["hash"][at] == hashes) & (self.kept["second"][at] == second_hash) if len(self.kept) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~have)
        ids, sizes = self.segment([data[a:b].replace(b" ", MARK) for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
        place, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        place[have], size[have] = self.kept["place"][at[have]], self.kept["size"][at[have]]
        place[new], size[new] = len(self.kept_ids) + np.cumsum(sizes) - sizes, sizes
        self.kept_ids = np.concatenate([self.kept_ids, ids])
        fresh = np.empty(len(new), self.kept.dtype)
        fresh["hash"], fresh["second"], fresh["place"], fresh["size"] = hashes[new], second_hash[new], place[new], sizes
        kept = np.concatenate([self.kept, fresh])
        _, one = np.unique(kept["hash"], return_index=True)
        self.kept = kept[one]
        return of, place, size

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        n = self.out_size[ids]
        data = self.out_bytes[np.repeat(self.out_start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def codec(model: bytes) -> Codec:
    """One codec for each model and worker process; functions that travel by value have no module to keep it in."""
    kept = sys.__dict__.setdefault("_worksight_codecs", {})
    key = hash(model)
    if key not in kept:
        kept[key] = Codec(model)
    return kept[key]


def encode(docs: DataFrame, model_path: str = MODEL, text_column: str = "text", decoded: bool = False) -> DataFrame:
    """docs with n_pieces, piece_ids and, if asked for, the text that they decode to. The model travels with the plan."""
    with open(model_path, "rb") as f:
        model = f.read()
    added = ["n_pieces", "piece_ids", *(["decoded"] if decoded else [])]
    names = [c for c in docs.columns if c not in added] + added
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in added), "n_pieces long, piece_ids array<int>", *(["decoded string"] if decoded else [])])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            begin = 0
            while begin < whole.num_rows:  # about 2 MB of text at a time, so that long documents don't add up
                column = whole.column(whole.schema.get_field_index(text_column))
                sizes = np.cumsum(pc.fill_null(pc.binary_length(column.slice(begin)), 0).to_numpy(zero_copy_only=False))
                n = 1 + int(np.searchsorted(sizes[:-1], 2 << 20))
                batch = whole.slice(begin, n)
                begin += n
                texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
                ids, sizes = c.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))
                columns = {"n_pieces": pa.array(sizes, pa.int64()), "piece_ids": lists}
                if decoded:
                    columns["decoded"] = pa.array([None if t is None else x for t, x in zip(texts, c.decode(ids, sizes))], pa.string())
                yield pa.RecordBatch.from_arrays([columns.get(x) if x in columns else batch.column(batch.schema.get_field_index(x)) for x in names], names=names)

    return docs.mapInArrow(f, schema)


def decode(docs: DataFrame, model_path: str = MODEL, ids_column: str = "piece_ids") -> DataFrame:
    """docs with decoded, the text of stored ids; null ids give null."""
    with open(model_path, "rb") as f:
        model = f.read()
    names = [c for c in docs.columns if c != "decoded"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names), "decoded string"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids_column)).to_pylist()
            sizes = np.array([len(x or ()) for x in lists], np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            texts = [None if x is None else t for x, t in zip(lists, c.decode(ids, sizes))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    return docs.mapInArrow(f, schema)


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, decoded=True)
    return out.select("doc_id", "n_pieces", "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
