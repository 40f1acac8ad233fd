"""Importance resampling towards a target: documents drawn by how much likelier their words are in the target.

Hashed runs of one and two words are counted over the whole corpus and the target; the log ratio of a bucket is its gain and the mean gain
of a document its weight. Noise of the Gumbel kind, fixed by the document's id, turns a draw without replacement into the highest
scores. Where the draw ends is found by a weighted median of medians: each part of the table tells the median of the keys still in
question and how many they are, the median of those by size is the pivot, and at least a quarter of the keys is settled on one side of
it. Only what is drawn is sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.flat import slices, text_bytes
from parley.sources.store import materialise

#: Keys that one task sorts by itself once no more are in question.
FEW = 1 << 16
#: Words of up to this many bytes are joined by table.
_SHORT = 48

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _shift_tables() -> np.ndarray:
    """``[n, k, b]``: what byte ``k`` of a CRC-32 with value ``b`` becomes when ``n`` bytes follow."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    out = np.empty((_SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * 8)
    for n in range(_SHORT):
        out[n + 1] = (out[n] >> 8) ^ byte[out[n] & 0xFF]
    return out


class Features:
    """The buckets of all features of texts, by the CRC-32 of their bytes.

    A word's sum is taken once for each different word of a slice; that of two words follows from both by table.
    """

    def __init__(self, buckets: int):
        self.buckets, self.tables = np.uint32(buckets), _shift_tables()

    def of(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, the buckets of the features, and the text of each feature."""
        n = len(at) - 1
        raw = _FOLD[raw]
        inside = _WORD[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        gap = np.concatenate(([True], ~inside, [True]))
        starts = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
        rows = np.searchsorted(starts, at)
        words = np.diff(rows)
        if not len(starts):
            return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = ends - starts
        where = np.concatenate(([0], np.cumsum(length)))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[inside]))]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        different = coded.dictionary.to_pylist()
        alone = np.fromiter((zlib.crc32(w) for w in different), np.uint32, len(different))
        spaced = np.fromiter((zlib.crc32(b" ", c) for c in alone.tolist()), np.uint32, len(different))
        doc = np.repeat(np.arange(n), words)
        first = np.flatnonzero(doc[:-1] == doc[1:])
        left, right = spaced[code[first]], code[first + 1]
        size = np.minimum(length[first + 1], _SHORT)
        both = alone[right]
        for k in range(4):
            both = both ^ self.tables[size, k, (left >> np.uint32(8 * k)) & np.uint32(0xFF)]
        for k in np.flatnonzero(length[first + 1] > _SHORT).tolist():
            both[k] = zlib.crc32(different[right[k]], int(left[k]))
        sums = np.concatenate((alone[code], both))
        return words, (sums % self.buckets).astype(np.int64), np.concatenate((doc, doc[first]))


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all ``texts`` (text) fall into each bucket; each task sums before anything moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            for lo, hi in slices(at):
                total += np.bincount(features.of(raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo])[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log of its share of the target over its share of the source, each with one added, rounded down."""
    n = len(source)
    ratio = (target + 1.0) * (source.sum() + n) / ((source + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand Gumbel numbers fixed by ``seed`` and the id, rounded down; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(documents: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            for lo, hi in slices(at):
                words, bucket, doc = features.of(raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo])
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, doc, gain[bucket])
                n = words + np.maximum(words - 1, 0)
                yield pa.record_batch([
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    ["doc_id", "n_words", "n_features", "weight"])

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


#: The order of the draw, the best first: all columns ascending. Null ids come last, rows alike in all of them are alike in every result.
_KEY = ("down", "void", "id", "n")


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select((-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("void"),
                       F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("n_features").alias("n"))


def _before(row: tuple, equal: bool) -> Column:
    """Whether a row's key comes before ``row``; with ``equal``, or is equal to it."""
    out = F.lit(equal)
    for name, value in reversed(list(zip(_KEY, row))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower median of a part's keys, and how many they are."""
    rows = [np.stack([b.column(c).to_numpy() for c in _KEY]) for b in batches]
    keys = np.concatenate(rows, axis=1) if rows else np.zeros((4, 0), np.int64)
    if keys.shape[1]:
        order = np.lexsort(keys[::-1])
        middle = keys[:, order[(len(order) - 1) // 2]]
        yield pa.record_batch([*(pa.array([int(v)]) for v in middle), pa.array([len(order)])], [*_KEY, "size"])


def cutoff(keys: DataFrame, wanted: int, few: int = FEW) -> tuple[tuple, int]:
    """The ``wanted``-th key of the stored ``keys``, and how many rows equal to it belong to the first ``wanted``.

    Each round settles a quarter of the rows in question at least. What is left is written again once it has
    halved, so all rounds together read a few times the table. The driver sees one row a part.
    """
    left, size = keys, keys.count()
    if not 0 < wanted <= size:
        raise ValueError("wanted must lie between 1 and the number of keys")
    stored = size
    while size > few:
        # a row for each part: few numbers, whatever a part holds
        middles = sorted(left.mapInArrow(_medians, "down long, void long, id long, n long, size long").collect())
        sizes = np.cumsum([m["size"] for m in middles])
        pivot = tuple(middles[int(np.searchsorted(sizes, (size + 1) // 2))])[:4]
        below, upto = left.agg(F.count_if(_before(pivot, False)), F.count_if(_before(pivot, True))).first()
        if below < wanted <= upto:
            return pivot, wanted - below
        if wanted <= below:
            left, size = left.where(_before(pivot, False)), below
        else:
            left, size, wanted = left.where(~_before(pivot, True)), size - upto, wanted - upto
        if size * 2 < stored:
            left, stored = materialise(left, "open-keys"), size
    rest = sorted(tuple(r) for r in left.collect())  # ``few`` rows at most
    pivot = rest[wanted - 1]
    return pivot, wanted - rest.index(pivot)


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their place in the order of the keys: ranges, and a sum over the ranges' sizes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *_KEY).sortWithinPartitions(*_KEY).select("*", F.monotonically_increasing_id().alias("at"))
    ranged = materialise(ranged.select("*", F.shiftright("at", 33).alias("range")), "drawn")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    # one row for each range
    before = sizes.select("range", F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(F.broadcast(before), "range").select(*rows.columns, place.alias("rank"))


def draw(documents: DataFrame, target: DataFrame, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7,
         few: int = FEW) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of ``documents``; rank is null where it is not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn, rounded down: the highest scores, equal scores by the
    smaller doc_id, null ids last, equal ids by fewer features; rows alike in all that are interchangeable. Null and empty texts have
    no features, weight 0 and are never drawn. Empty tables are counts of zero; only doc_id and text are read.
    """
    gain = gains(bucket_counts(documents, buckets), bucket_counts(target, buckets))
    rows = materialise(scored(documents, gain, seed), "scored")
    fit = F.col("n_words") >= least_words
    wanted = rows.where(fit).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    last, ties = cutoff(materialise(_keys(rows.where(fit)), "keys"), wanted, few)
    keyed = rows.select(*out, fit.alias("fit"), *(F.expr(e).alias(k) for e, k in zip(("-score", "cast(doc_id is null as long)", "coalesce(doc_id, 0L)", "n_features"), _KEY)))
    first = keyed.where(F.col("fit") & _before(last, False)).select(*out, *_KEY)
    rest = keyed.where(~F.col("fit") | ~_before(last, True)).select(*out)
    # rows at the cutoff are alike: so many of them are drawn, the others not
    equal = keyed.where(F.col("fit") & _before(last, True) & ~_before(last, False)).groupBy(*out, *_KEY).agg(F.count(F.lit(1)).alias("rows"))
    drawn = equal.select(*out, *_KEY, F.explode(F.sequence(F.lit(1), F.lit(ties).cast("long"))).alias("copy")).drop("copy")
    left = equal.where(F.col("rows") > ties).select(*out, F.explode(F.sequence(F.lit(ties + 1).cast("long"), "rows")).alias("copy")).drop("copy")
    undrawn = rest.unionByName(left).withColumn("rank", F.lit(None).cast("long"))
    return _ranked(first.unionByName(drawn)).select(*out, "rank").unionByName(undrawn)
