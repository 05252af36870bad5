"""Vectorised text kernels shared by the corpus operators.

A *word* is a maximal run of ASCII letters, digits and underscores or of
non-ASCII characters in the lower-cased text: regex ``[a-z0-9_\\x80-\\U0010FFFF]+``.
All kernels work on the UTF-8 buffer of an Arrow column, so no per-row Python
object is made; a null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = r"[a-z0-9_\x80-\U0010FFFF]+"
#: Texts are handled in slices of about this many bytes to bound the scratch arrays.
SLICE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_WORD = np.zeros(256, np.bool_)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_"]] = True
_WORD[128:] = True
_ORDER = (_rng.integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_pows: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled on demand."""
    have = _pows.get(str(base))
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    _pows[str(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, sub-column) pieces of at most ``limit`` bytes, one row at least."""
    n = len(column)
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield at, column.slice(at, end - at)
        at = end


class Words:
    """Words of a column: ``start``/``end`` byte offsets, ``hash`` and, by row, ``first`` (len rows + 1)."""

    def __init__(self, column: pa.Array, lower: bool = True, want_hash: bool = True):
        self.data, self.off = utf8(pc.utf8_lower(column) if lower else column)
        n = len(self.data)
        word = _WORD[self.data]
        edge = np.zeros(n + 1, np.bool_)
        edge[self.off] = True
        before = np.empty(n, np.bool_)
        if n:
            before[0] = False
            before[1:] = word[:-1]
            self.start = np.flatnonzero(word & (~before | edge[:n]))
            after = np.empty(n, np.bool_)
            after[-1] = False
            after[:-1] = word[1:]
            self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        else:
            self.start = self.end = np.empty(0, np.int64)
        self.first = np.searchsorted(self.start, self.off)
        if want_hash:
            acc = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _powers(_BASE, n), out=acc[1:])
            h = (acc[self.end] - acc[self.start]) * _powers(_BASE_INV, n + 1)[self.start]
            self.hash = mix(h)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word n-gram, first n-gram of each row); a row of 1..n-1 words has one short gram, an empty row none."""
    h, first = words.hash, words.first
    count = np.diff(first)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    gfirst = np.concatenate([[0], np.cumsum(grams)])
    # position of each gram's first word
    pos = np.arange(gfirst[-1]) - np.repeat(gfirst[:-1], grams) + np.repeat(first[:-1], grams)
    length = np.repeat(np.minimum(count, n), grams)
    out = length.astype(np.uint64)
    top = len(h)
    for i in range(n):
        at = pos + i
        ok = i < length
        part = h[np.minimum(at, top - 1)] * _ORDER[i] if top else np.empty(0, np.uint64)
        out = out + np.where(ok, part, np.uint64(0))
    return mix(out), gfirst


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of every full window of n words inside a row."""
    h, first = words.hash, words.first
    total = len(h)
    if total < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = np.zeros(total + 1, np.uint64)
    np.cumsum(h * _powers(_BASE, total), out=acc[1:])
    value = (acc[n:] - acc[:-n]) * _powers(_BASE_INV, total - n + 1)
    row = words.row_of()
    at = np.flatnonzero(row[: total - n + 1] == row[n - 1 :])
    return mix(value[at]), at


def row_sets(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each row: (values, first of each row)."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((grams, rows))
    g, r = grams[order], rows[order]
    keep = np.ones(len(g), np.bool_)
    keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[keep], r[keep]
    return g, np.searchsorted(r, np.arange(len(first)))
