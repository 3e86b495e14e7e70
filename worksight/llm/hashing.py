"""Vectorised 64-bit hashing of words, n-grams and sliding windows over a block of texts."""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)
_ODD = 0x9E3779B97F4A7C15

#: Word separators: space and the controls from tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Drawn anew by each driver, so no text can be made to collide; functions carry them to the workers by value, and all tasks of a
#: job agree. The lanes are independent: keys that decide a result across blocks use both.
SEEDS = tuple(U(secrets.randbits(64)) for _ in range(2))
FACTORS = tuple(U(secrets.randbits(64) | 1) for _ in range(2))
#: Values handled at a time, so that they stay in a core's cache; bytes of a long stretch that are hashed as one piece.
CHUNK, PIECE = 1 << 15, 1024


def packed(buf: np.ndarray) -> np.ndarray:
    """At each byte it and the seven after it as one number; zeros follow the end."""
    n = len(buf)
    padded = np.zeros(n + 15, np.uint8)
    padded[:n] = buf
    out = np.empty(n, np.uint64)
    for k in range(8):
        own = out[k::8]
        own[:] = np.frombuffer(padded, "<u8", len(own), k)
    return out


def stretches(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of the bytes of each stretch, folded in eight at a time; not linear, so no two texts are bound to agree."""
    size = end - start
    out = mix(size.astype(np.uint64) * U(_ODD) ^ SEEDS[lane])
    own = np.flatnonzero(size > 0)
    if not len(own):
        return out
    if int(size.max()) > PIECE:
        long = np.flatnonzero(size > PIECE)
        pieces = -(-size[long] // PIECE)
        off = np.concatenate([[0], np.cumsum(pieces)])
        at = np.repeat(start[long], pieces) + (np.arange(off[-1]) - np.repeat(off[:-1], pieces)) * PIECE
        each = stretches(buf, at, np.minimum(at + PIECE, np.repeat(end[long], pieces)), lane)
        out[long] = mix(out[long] ^ stretches(each.view(np.uint8), 8 * off[:-1], 8 * off[1:], lane))
        own = np.flatnonzero((size > 0) & (size <= PIECE))
    padded = np.append(buf, np.zeros(8, np.uint8))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    for begin in range(0, len(own), CHUNK):
        which = own[begin : begin + CHUNK]
        at, left, h = start[which], size[which], out[which]
        while True:
            value = eight[at]
            short = left < 8
            value[short] &= (U(1) << (left[short] * 8).astype(np.uint64)) - U(1)
            h = mix(h ^ value)
            more = left > 8
            if not more.all():
                out[which[~more]] = h[~more]
                which, at, left, h = which[more], at[more], left[more], h[more]
                if not len(which):
                    break
            at, left = at + 8, left - 8
    return out


def _grams_of(values: np.ndarray, k: int, lane: int) -> np.ndarray:
    """Hashes of twice as many values at each step; those whose sizes add up to k are joined."""
    n, width, done, out = len(values) - k + 1, 1, 0, None
    while True:
        if k & width:
            part = values[done : done + n]
            out = part if out is None else mix(out * FACTORS[lane] + part)
            done += width
        width *= 2
        if width > k:
            return mix(out ^ SEEDS[lane]) if k == 1 else out
        values = mix(values[: -(width // 2)] * FACTORS[lane] + values[width // 2 :] + SEEDS[lane])


def grams(values: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A hash of every k consecutive values, which are hashes themselves."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, step = np.empty(n, np.uint64), max(CHUNK, 4 * k)
    for begin in range(0, n, step):
        own = values[begin : begin + step + k - 1]
        out[begin : begin + len(own) - k + 1] = _grams_of(own, k, lane)
    return out


class Docs:
    """The texts of an Arrow table as one byte buffer with offsets, in order of (doc_id, text)."""

    def __init__(self, table: pa.Table, id_column: str = "doc_id", text_column: str = "text"):
        if table.num_rows > 1:
            table = table.take(pc.sort_indices(table, [(id_column, "ascending"), (text_column, "ascending")]))
        self.table = table
        ids = table.column(id_column).cast(pa.int64())
        self.ids = pc.fill_null(ids, -(2**63)).to_numpy()
        text = table.column(text_column).cast(pa.large_binary())
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_binary())
        text = pc.fill_null(text, b"")
        n = len(text)
        _, offsets, data = text.buffers()
        off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
        self.buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if n and data is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def spans(buf: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every maximal stretch without separators."""
    inside = ~separator[buf]
    n = len(buf)
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    return start, end, doc


class Words:
    """Words of a block, their documents and hashes."""

    def __init__(self, docs: Docs, lower: bool = False, separator: np.ndarray = BLANK):
        buf = LOWER[docs.buf] if lower else docs.buf
        self.start, self.end, self.doc = spans(buf, docs.off, separator)
        self.hash = stretches(buf, self.start, self.end)
        #: Words before each document, and one more for the end.
        self.base = np.searchsorted(self.doc, np.arange(len(docs) + 1))
        self.count = np.diff(self.base)


def slide(a: np.ndarray, m: int, f=np.minimum) -> np.ndarray:
    """f over every m consecutive values."""
    n = len(a) - m + 1
    out, step = np.empty(max(0, n), a.dtype), max(CHUNK, 4 * m)
    for begin in range(0, n, step):
        w, x = 1, a[begin : begin + step + m - 1]
        size = len(x) - m + 1
        while 2 * w <= m:
            x = f(x[:-w], x[w:])
            w *= 2
        out[begin : begin + size] = f(x[:size], x[m - w :]) if m > w else x
    return out


def minimizers(grams: np.ndarray, valid: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """grams: hash at each position; valid: whether the window of m grams that starts there lies in one document.

    Returns the least hash in each window (the largest value where invalid), and the positions of all grams that are the least
    of some valid window. Both depend on the content of a window alone, so equal windows choose equal grams.
    """
    n = len(grams) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = slide(grams, m)
    most = np.zeros(n + 2 * (m - 1), np.uint64)
    most[m - 1 : m - 1 + n] = np.where(valid[:n], least, U(0))
    chosen = np.flatnonzero(slide(most, m, np.maximum) == grams)
    return np.where(valid[:n], least, TOP), chosen


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


def within(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks the positions of [0, n) inside any of the stretches."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0
