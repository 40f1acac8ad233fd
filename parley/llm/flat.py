"""Array kernels over Arrow batches of texts: words, rolling hashes and winnowing without a loop per word.

A batch is cut into slices of whole documents of about ``SLICE`` bytes, so the arrays stay small whatever
the batch holds; one document is a single value and takes some ten times its own bytes while it is worked on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.
SLICE = 1 << 20

_ODD = {name: np.uint64(value) for name, value in
        {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93, "reach": 0xA0761D6478BD642F, "window": 0xE7037ED1A0B428DB}.items()}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) <= n:
        base = int(_ODD[kind]) | 1
        up, down = (np.full(max(n + 1, 1 << 16), b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = _POWERS[kind] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have


class Sums:
    """Prefix sums that give a hash of any span of the values."""

    def __init__(self, values: np.ndarray, kind: str):
        self.up, self.down = _powers(kind, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def each(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` values."""
        spans = (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]
        spans ^= spans >> np.uint64(29)
        spans *= np.uint64(0xBF58476D1CE4E5B9)
        spans ^= spans >> np.uint64(32)
        return spans

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and the n + 1 places where its rows begin; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the n + 1 places where each row's words begin."""
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = ~word
    starts = np.flatnonzero(word & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (gap[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, with what ``word_bounds`` gives. Long texts are hashed in pieces cut between words."""
    starts, ends, rows = word_bounds(raw, at)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 2 * SLICE, side="right")))
        base = starts[lo]
        out[lo:hi] = Sums(_BYTE[raw[base: ends[hi - 1]]], "byte").span(starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return out, starts, ends, rows


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


#: Low bits of an ordering key that hold a place, and how many windows are ordered at once.
_PLACE = np.uint64((1 << 24) - 1)
_AT_ONCE = 1 << 23


class Anchors:
    """Winnowed anchors of a slice of documents.

    Every window of ``length`` units inside one document selects one of its seeds of ``seed`` units: the one of
    least hash, the rightmost of equal ones. What a window selects depends on its content alone, so equal windows
    select the same seed at the same offset. The reach of an anchor is all that a window around it can cover.
    """

    def __init__(self, units: np.ndarray, rows: np.ndarray, length: int, seed: int):
        self.length, self.seed, self.spread = length, seed, length - seed + 1
        self.units, self.rows, n = units, rows, len(units)
        none = np.zeros(0, np.int64)
        self.starts = self.chosen = self.at = self.doc = none
        self.hash = np.zeros(0, np.uint64)
        if n < length:
            return
        sums = Sums(units, "word")
        grams = sums.each(seed)
        m = n - length + 1
        where = np.empty(m, np.int64)
        for lo in range(0, m, _AT_ONCE):
            hi = min(m, lo + _AT_ONCE)
            part = grams[lo: hi + self.spread - 1]
            keys = (part & ~_PLACE) | (_PLACE - np.arange(len(part), dtype=np.uint64))
            where[lo:hi] = lo + (_PLACE - (sliding_min(keys, self.spread) & _PLACE)).astype(np.int64)
        inside = np.ones(m, bool)
        for end in rows[1:-1].tolist():
            inside[max(0, end - length + 1): min(m, end)] = False
        self.starts = np.flatnonzero(inside)
        self.chosen = where[self.starts]
        first = np.ones(len(self.chosen), bool)
        first[1:] = self.chosen[1:] != self.chosen[:-1]
        self.at = self.chosen[first]
        self.doc = np.searchsorted(rows, self.at, side="right") - 1
        self.hash = grams[self.at]

    def reach(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and hash of what each anchor reaches; the anchor's own place in it counts."""
        lo = np.maximum(self.rows[self.doc], self.at - self.spread + 1)
        hi = np.minimum(self.rows[self.doc + 1], self.at + self.length)
        hashes = Sums(self.units, "reach").span(lo, hi) + (self.at - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        return lo, hi, mix(hashes)

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that select one of the anchors marked in ``wanted``."""
        pick = np.zeros(len(self.units) + 1, bool)
        pick[self.at[wanted]] = True
        starts = self.starts[pick[self.chosen]]
        return starts, Sums(self.units, "window").span(starts, starts + self.length)
