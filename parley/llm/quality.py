"""Quality scores from histogram gradient-boosted trees over document statistics.

The statistics come from whole texts in array code, a slice of documents at a time. The trees are grown on a bounded
sample of labelled rows and flattened into arrays; scoring walks all rows of a batch down all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.flat import slices, text_bytes, word_hashes
from parley.llm.worker import tidied
from parley.sources.store import materialise

#: Labelled rows the trees are grown on, at most.
SAMPLE = 20_000

_UPPER, _LOWER, _DIGIT, _WHITE, _LINE, _WIDE, _END, _SHOUT, _BAR, _SIGN, _OTHER = range(11)
_KIND = np.full(256, _OTHER, np.uint8)
for _bytes, _kind in ((range(128, 256), _WIDE), (range(65, 91), _UPPER), (range(97, 123), _LOWER), (range(48, 58), _DIGIT), (b" \t\r\v\f", _WHITE),
                      (b"\n", _LINE), (b".,;:", _END), (b"!?", _SHOUT), (b"|", _BAR), (b"#$%&*@^~<>=+", _SIGN)):
    _KIND[list(_bytes)] = _kind

STATISTICS = 24


def _by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[rows[1:]] - sums[rows[:-1]]


def _repeats(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row and the count of its commonest one."""
    n = len(rows) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(rows))
    keys = np.sort((row << np.uint64(44)) | (values >> np.uint64(20)))
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(keys)))
    owner = (keys[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, length)
    return np.bincount(owner, minlength=n), most


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` numbers for each text; an empty text has zeros."""
    n = len(at) - 1
    size = np.diff(at)
    kind = _KIND[raw]
    counts = np.stack([_by_row(kind == k, at) for k in range(11)], axis=1).astype(np.float64)
    hashes, starts, ends, rows = word_hashes(raw, at)
    words = np.diff(rows)
    length = ends - starts
    distinct, most = _repeats(hashes, rows)
    inside = np.ones(len(hashes), bool)
    inside[rows[:-1][words > 0]] = False
    before = np.concatenate((np.zeros(min(1, len(hashes)), np.uint64), hashes[:-1]))
    same = inside & (hashes == before)
    pairs = hashes * np.uint64(0x9E3779B97F4A7C15) + before
    pair_rows = np.concatenate(([0], np.cumsum(_by_row(inside, rows)))).astype(np.int64)
    pair_distinct, _ = _repeats(pairs[inside], pair_rows)
    longest = np.zeros(n)
    np.maximum.at(longest, np.repeat(np.arange(n), words), length)
    last = raw[ends - 1] if len(ends) else raw[:0]
    first = raw[starts] if len(starts) else raw[:0]
    ended = _by_row((_KIND[last] == _END) | (_KIND[last] == _SHOUT), rows)
    signed = _by_row(_KIND[last] == _SIGN, rows)
    capital = _by_row(_KIND[first] == _UPPER, rows)
    lines = counts[:, _LINE] + (size > 0)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    letters = counts[:, _UPPER] + counts[:, _LOWER] + counts[:, _WIDE]
    spread = _by_row((length - (_by_row(length, rows) / per_word)[np.repeat(np.arange(n), words)]) ** 2, rows)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines), size / np.maximum(lines, 1), _by_row(length, rows) / per_word, np.sqrt(spread / per_word),
        longest, distinct / per_word, most / per_word, _by_row(same, rows) / per_word, pair_distinct / np.maximum(words - 1, 1),
        counts[:, _UPPER] / np.maximum(letters, 1), *(counts[:, k] / per_byte for k in (_DIGIT, _WHITE, _WIDE, _END, _SHOUT, _BAR, _SIGN, _OTHER)),
        ended / per_word, signed / per_word, capital / per_word, words / np.maximum(lines, 1)]
    return np.stack(columns, axis=1).astype(np.float32)


def _all_statistics(column: pa.Array) -> np.ndarray:
    raw, at = text_bytes(column)
    parts = [statistics(raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]) for lo, hi in slices(at)]
    return np.concatenate(parts) if parts else np.zeros((0, STATISTICS), np.float32)


def with_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, stats) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _all_statistics(batch.column("text"))
            rows = pa.ListArray.from_arrays(np.arange(0, stats.size + 1, STATISTICS, dtype=np.int32), pa.array(stats.reshape(-1)))
            yield pa.record_batch([batch.column("doc_id"), rows], ["doc_id", "stats"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidied(run), "doc_id long, stats array<float>")


class Trees(NamedTuple):
    """Complete trees of one depth, flattened: a row each. A node sends a row right if the feature exceeds the threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1] if self.feature.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, weight: float = 1.0,
         least: float = 3.0) -> Trees:
    """Boosts trees on logistic loss over quantile bins. Without rows the score is 1/2, with one class it is nearly constant."""
    inner = (1 << depth) - 1
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    if not len(x):
        return none
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(len(x), base)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            gain = np.zeros(width)
            best_feature, best_bin = np.zeros(width, np.int64), np.full(width, bins)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * (bins + 1) + binned[:, f]
                g = np.bincount(key, gradient, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                h = np.bincount(key, hessian, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                value = gl ** 2 / (hl + weight) + (gt - gl) ** 2 / (ht - hl + weight) - gt ** 2 / (ht + weight)
                value[(hl < least / 4) | (ht - hl < least / 4)] = 0
                value[:, len(e):] = 0
                at = value.argmax(axis=1)
                better = value[np.arange(width), at] > gain + 1e-9
                gain[better], best_feature[better], best_bin[better] = value[np.arange(width), at][better], f, at[better]
            for k in range(width):
                if gain[k] > 0:
                    feature[first + k] = best_feature[k]
                    threshold[first + k] = edges[best_feature[k]][best_bin[k]]
            here = node - first
            node = 2 * node + 1 + (binned[np.arange(len(x)), best_feature[here]] > best_bin[here])
        g, h = np.bincount(node - inner, gradient, inner + 1), np.bincount(node - inner, hessian, inner + 1)
        leaf = rate * g / (h + weight)
        total += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(doc_id) -> "F.Column":
    """Rows never learnt from: a fifth, by the CRC-32 of the doc_id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _marks(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, quality) to learn from: about ``sample`` documents at most, chosen by a hash of doc_id.

    Held-out rows and null labels are not learnt from; of several labels of a document the least counts.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = marks.count()
    if labelled > sample:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / labelled))
    return marks


def train(stats: DataFrame, marks: DataFrame) -> Trees:
    """Trees grown on ``stats`` of the documents in ``marks``."""
    rows = stats.join(marks, "doc_id").select("doc_id", "stats", "quality").toPandas().sort_values("doc_id")
    x = np.stack(list(rows["stats"])).astype(np.float32) if len(rows) else np.zeros((0, STATISTICS), np.float32)
    return grow(x, rows["quality"].to_numpy(np.float64))


def scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts are scored by their zeros. Repeated rows score alike."""
    stats = materialise(with_statistics(documents), "stats")
    trees = train(stats, _marks(labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            yield pa.record_batch([batch.column("doc_id"), pa.array(trees.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def keep_good(documents: DataFrame, labels: DataFrame, least: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``documents`` scoring ``least`` or more, all columns as they are; the texts stay where they are."""
    marks = materialise(_marks(labels, sample), "marks")
    # some ``sample`` ids at most go to all tasks; the texts of the others are not looked at twice
    learnt = documents.select("doc_id", "text").join(F.broadcast(marks.select("doc_id")), "doc_id", "left_semi")
    trees = train(with_statistics(learnt), marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(trees.score(_all_statistics(batch.column("text"))) >= least))

    return documents.mapInArrow(tidied(run), documents.schema)
