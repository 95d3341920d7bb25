"""Vectorised word and shingle hashing for Arrow batches of texts.

Everything here is a small per-batch helper: Spark partitions the texts and
hands Arrow record batches to ``mapInArrow``; these functions turn a run of
texts into flat numpy arrays (word spans, 64-bit word hashes, shingle hashes)
without a Python loop over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are hashed in runs of about this many bytes, so the working memory of
# a task does not depend on the Arrow batch size.  One longer text makes a run
# of its own.
RUN_BYTES = 4 << 20
_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MUL = [np.uint64(x) for x in (
    0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MUL[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MUL[1]
    return x ^ (x >> np.uint64(31))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as large strings, null as the empty text."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def runs(col: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``run_bytes`` bytes each."""
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(off, off[lo] + run_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield lo, hi
        lo = hi


def text_bytes(col: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of rows lo..hi and their offsets (from 0)."""
    _, o, d = col.buffers()
    off = np.frombuffer(o, np.int64)[col.offset + lo:col.offset + hi + 1]
    data = np.frombuffer(d, np.uint8)[off[0]:off[-1]] if d is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """Words (maximal runs of non-separator bytes) of a run of texts.

    ``start``/``end``: byte spans; ``doc``: row of each word; ``first``:
    for each row the index of its first word (one more entry at the end).
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, separator: np.ndarray = WHITE):
        inside = np.empty(len(data) + 1, bool)
        np.logical_not(separator[data], out=inside[:-1])
        inside[-1] = False
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = inside[:-1]
        edge = off[1:-1]
        edge = edge[edge < len(data)]
        starts = inside & ~before
        starts[edge] |= inside[edge]
        ends = before & ~inside
        ends[edge] |= before[edge]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, off)
        self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))


_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, _SEGMENT)
        step = np.full(n, _BASE, np.uint64)
        step[0] = 1
        _POW = np.cumprod(step)
        step[1:] = _BASE_INV
        _INV = np.cumprod(step)
    return _POW, _INV


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte span (spans ascending), mixed with
    its length.  Segments of about 1 MB keep the working memory small."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(int(np.searchsorted(end, start[lo] + _SEGMENT, "right")), lo + 1)
        a, b = int(start[lo]), int(end[hi - 1])
        pw, inv = _powers(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * pw[:b - a], out=sums[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = (sums[e] - sums[s]) * inv[np.minimum(s, len(inv) - 1)]
        out[lo:hi] ^= (e - s).astype(np.uint64) * _MUL[2]
        lo = hi
    return mix64(out)


def windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay within one owner, and the index
    of each window's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    at = np.flatnonzero(owner[:m] == owner[n - 1:])
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h += hashes[at + j] * _MUL[j] + np.uint64(j + 1)
        h ^= h >> np.uint64(29)
    return mix64(h), at


def shingles(w: Words, hashes: np.ndarray, owner: np.ndarray, first: np.ndarray,
             n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """n-word shingles by owner; an owner with fewer words (but some) has its
    whole sequence as one.  Returns hashes and owners, ascending by owner."""
    h, at = windows(hashes, owner, n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        return h, owner[at]
    sh = np.zeros(len(short), np.uint64)
    for j in range(n - 1):
        live = count[short] > j
        x = sh[live] + hashes[first[short[live]] + j] * _MUL[j] + np.uint64(j + 1)
        sh[live] = x ^ (x >> np.uint64(29))
    sh = mix64(sh ^ (count[short].astype(np.uint64) * _MUL[4]))
    own = np.concatenate([owner[at], short])
    order = np.argsort(own, kind="stable")
    return np.concatenate([h, sh])[order], own[order]


def shingle_sets(col: pa.Array, lo: int, hi: int, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of rows lo..hi, A-Z lower-cased."""
    data, off = text_bytes(col, lo, hi)
    data = LOWER[data]
    w = Words(data, off)
    h, own = shingles(w, span_hashes(data, w.start, w.end), w.doc, w.first, n)
    cut = np.searchsorted(own, np.arange(hi - lo + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def digest64(*parts: bytes) -> int:
    """Signed 64-bit BLAKE2b digest."""
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)
