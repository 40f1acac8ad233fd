"""Benchmark items in documents, up to a share of edits: q-gram lemma filter and banded alignment.

An item of m characters within k edits of a part of a text shares at least m + 1 - (k + 1) q of its q-grams with it, on
diagonals (place in the text less place in the item) at most k apart. Hits are counted in overlapping bands of
diagonals; a band with enough of them is aligned, and nothing else is. Items too short for q-grams of the usual length
take the longest that the lemma allows, and items of fewer than q characters, which have no edits to spend at the usual
rate, are looked up as they are. Documents stay in their partitions: only the benchmark travels, in blocks of at most
``block_chars`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.flat import Sums, mix
from parley.llm.worker import tidied

#: Characters of the benchmark sent to tasks at once.
BLOCK_CHARS = 4 << 20
_TABLE = 1 << 22
_AT_ONCE = 1 << 18
_FAR = 1 << 20


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Fewest edits between the item and a part of the text, and where that part ends, on diagonals ``low`` to ``high``."""
    width, n = high - low + 1, len(text)
    column = np.arange(width)
    padded = np.full(len(item) + width + 2, 0xFFFFFFFF, np.uint32)
    lo, hi = max(0, low), min(n, low + len(item) + width)
    if hi > lo:
        padded[lo - low: hi - low] = text[lo:hi]
    place = low + column
    cost = np.where((place >= 0) & (place <= n), 0, _FAR)
    for i in range(1, len(item) + 1):
        up = np.append(cost[1:], _FAR) + 1
        cost = np.minimum(cost + (padded[i - 1: i - 1 + width] != item[i - 1]), up)
        cost = np.minimum.accumulate(cost - column) + column
        place = low + i + column
        cost[(place < 0) | (place > n)] = _FAR
    best = int(cost.argmin())
    return int(cost[best]), len(item) + low + best


class _Grams:
    """The q-grams of the items that go by one q."""

    def __init__(self, q: int, items: dict[int, np.ndarray]):
        self.q = q
        grams = [Sums(mix(c), "word").each(q) for c in items.values()]
        hashes = np.concatenate(grams)
        item = np.repeat(np.array(list(items), np.int64), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.table = np.zeros(_TABLE, bool)
        self.table[(self.hashes >> np.uint64(42)).astype(np.int64)] = True


class Benchmark:
    """Items with their q-grams, ready to be looked up."""

    def __init__(self, ids: list[int], texts: list[str], q: int, rate: float):
        kept = [(i, t) for i, t in zip(ids, map(normal, texts)) if t]
        self.ids = [i for i, _ in kept]
        self.items = [_codes(t) for _, t in kept]
        size = np.array([len(c) for c in self.items], np.int64)
        self.edits = (size * rate).astype(np.int64)
        # the longest q-grams of which a match is bound to share one
        width = np.minimum(q, size // (self.edits + 1))
        self.enough = size + 1 - (self.edits + 1) * width
        self.step = self.edits + 8
        short = (size < q) & (self.edits == 0)
        self.short = None
        if short.any():
            self.short = ahocorasick.Automaton()
            same: dict[str, list[int]] = {}
            for j in np.flatnonzero(short).tolist():
                same.setdefault(kept[j][1], []).append(j)
            for text, numbers in same.items():
                self.short.add_word(text, (len(text), numbers))
            self.short.make_automaton()
        self.grams = [_Grams(w, {j: self.items[j] for j in np.flatnonzero(~short & (width == w)).tolist()})
                      for w in np.unique(width[~short]).tolist()]

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, begin, end, edits) of the best matches that do not overlap, in normal characters."""
        out, lo = [], 0
        normals = [normal(t or "") for t in texts]
        while lo < len(normals):
            hi, held = lo, 0
            while hi < len(normals) and (hi == lo or held + len(normals[hi]) < _AT_ONCE):
                held += len(normals[hi]) + 1
                hi += 1
            out += [(lo + t, *rest) for t, *rest in self._slice(normals[lo:hi])]
            lo = hi
        return out

    def _slice(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        if self.short is not None:
            for t, text in enumerate(texts):
                upto: dict[int, int] = {}
                for last, (m, numbers) in self.short.iter(text):
                    if last + 1 - m >= upto.get(numbers[0], 0):
                        upto[numbers[0]] = last + 1
                        for j in numbers:
                            yield t, j, last + 1 - m, last + 1, 0
        if not self.grams:
            return
        codes = [_codes(t) for t in texts]
        flat = np.concatenate([np.append(c, np.uint32(0xFFFFFFFF)) for c in codes])
        begins = np.cumsum([0, *(len(c) + 1 for c in codes)])
        sums = Sums(mix(flat), "word")
        for grams in self.grams:
            if len(flat) >= grams.q:
                yield from self._near(codes, begins, sums, grams)

    def _near(self, codes: list[np.ndarray], begins: np.ndarray, sums: Sums, known: _Grams) -> Iterator[tuple[int, int, int, int, int]]:
        grams = sums.each(known.q)
        at = np.flatnonzero(known.table[(grams >> np.uint64(42)).astype(np.int64)])
        left, right = np.searchsorted(known.hashes, grams[at], "left"), np.searchsorted(known.hashes, grams[at], "right")
        count = right - left
        if not count.sum():
            return
        at = np.repeat(at, count)
        entry = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        item, text = known.item[entry], np.searchsorted(begins, at, side="right") - 1
        diagonal = at - begins[text] - known.place[entry]
        step, edits = self.step[item], self.edits[item]
        band = diagonal // step
        low = diagonal - band * step < edits  # close enough to the band below to belong to it as well
        rows = np.concatenate((np.stack((text, item, band), 1), np.stack((text, item, band - 1), 1)[low]))
        rows, hits = np.unique(rows, axis=0, return_counts=True)
        rows = rows[hits >= self.enough[rows[:, 1]]]
        found: dict[tuple[int, int], list] = {}
        for t, j, b in rows.tolist():
            k, s = int(self.edits[j]), int(self.step[j])
            edits_, end = align(self.items[j], codes[t], b * s - k, b * s + s + 2 * k)
            if edits_ <= k:
                m = len(self.items[j])
                head = codes[t][:end][::-1]
                _, back = align(self.items[j][::-1], head, -k, k)
                found.setdefault((t, j), []).append((edits_, end - min(back, end, m + k), end))
        for (t, j), places in found.items():
            taken: list[tuple[int, int]] = []
            for edits_, begin, end in sorted(places):
                if all(end <= a or begin >= b for a, b in taken):
                    taken.append((begin, end))
                    yield t, j, begin, end, edits_


def _blocks(benchmark: DataFrame, q: int, rate: float, block_chars: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size, whatever its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_chars) if size > block_chars else 1)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield Benchmark([r.item_id for r in rows], [r.text for r in rows], q, rate)


def contaminated(documents: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.06, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, begin, end, edits): where a document holds an item within ``rate`` of its length in edits.

    Both sides are lowered and white space counts as one space; places count characters of that form. Every item with a
    character in that form takes part and allows ``rate`` of its length in edits, rounded down; items of fewer than ``q`` characters without
    an edit are found wherever they stand, inside words too. Null texts hold nothing, repeated rows and items
    match alike, empty tables give no rows, other columns are not read.
    """
    schema = "doc_id long, item_id long, begin long, end long, edits int"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, q, rate, block_chars):
        def run(batches: Iterator[pa.RecordBatch], block: Benchmark = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs = batch.column("doc_id").to_pylist()
                rows = block.matches(batch.column("text").to_pylist())
                yield pa.record_batch([
                    pa.array([docs[t] for t, *_ in rows], pa.int64()), pa.array([block.ids[j] for _, j, *_ in rows], pa.int64()),
                    *(pa.array([r[c] for r in rows], kind) for c, kind in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32())))],
                    ["doc_id", "item_id", "begin", "end", "edits"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(documents: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.06, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item, all columns as they are."""
    out = documents
    for block in _blocks(benchmark, q, rate, block_chars):
        def run(batches: Iterator[pa.RecordBatch], block: Benchmark = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in block.matches(batch.column("text").to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(tidied(run), documents.schema)
    return out
