"""Windows of text that occur earlier in the corpus, found in three passes over blocks of documents.

Documents are ranged by doc_id and packed into compressed blocks, numbered in doc_id order, in a table bucketed by the
task that packed them: every later step reads it in place. A block asks about the 64-bit hashes it holds by sending them,
sorted and delta-coded, to a bucket by their leading bits; the bucket sees all blocks' hashes in order and answers
with one bit each. Each pass asks only about what the one before left undecided:

1. seeds of the anchors that the windows select (48 bits): a seed that occurs once in the corpus ends there;
2. the whole reach of each anchor left: where an earlier block or document has it too, all of it is repeated;
3. the single windows around the anchors still open, which stand where repeats begin and end.

A block sends a hash once however often it holds it, so copies of one text or passage cost a bucket one entry per
block. No pairs are formed. Two different spans are taken for one with odds of about 2**-64 a pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.flat import _BYTE, Anchors, slices, text_bytes, word_hashes
from parley.sources.store import materialise, new_table_path

#: Bytes of text in a block, and of the corpus for each bucket of hashes.
BLOCK = 4 << 20
BUCKET = 128 << 20

_BLOCKS = "part int, block long, n_bytes long, ids array<long>, sizes array<long>, data binary"


class Rule(NamedTuple):
    """What a window is: ``length`` units (words or bytes) with anchors of ``seed`` units.

    ``own``: an earlier place in the same document counts as well.
    """

    length: int
    seed: int
    words: bool
    own: bool


def pack(documents: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """The stored table of blocks. Rows of one doc_id share a block; null ids come first, null texts are empty."""
    spark = documents.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            row = {"part": part, "block": (part << 32) + seq, "n_bytes": held, "ids": ids, "sizes": [len(t) for t in texts],
                   "data": zstandard.ZstdCompressor(level=3).compress(b"".join(texts))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("block", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())),
                ("sizes", pa.list_(pa.int64())), ("data", pa.binary())]))

        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                if held >= block_bytes and doc != ids[-1]:
                    yield block()
                    ids, texts, held, seq = [], [], 0, seq + 1
                ids.append(doc)
                texts.append(raw[at[k]: at[k + 1]].tobytes())
                held += len(texts[-1])
        if ids:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = ranged.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    name, path = f"parley_blocks_{uuid.uuid4().hex}", new_table_path(spark, "blocks")
    ranged.mapInArrow(run, _BLOCKS).write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(
        n, "part").saveAsTable(name)
    return spark.table(name)


class Block:
    """One block with its anchors, in (document, place) order; places count the units of the whole block."""

    def __init__(self, row: dict, rule: Rule):
        self.rule, self.ids = rule, row["ids"]
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, row["n_bytes"])), np.uint8)
        self.at = np.concatenate(([0], np.cumsum(np.array(row["sizes"], np.int64))))
        new = [a != b for a, b in zip(self.ids, self.ids[1:])]
        self.rank = np.concatenate(([0], np.cumsum(new))).astype(np.int64)
        self.pieces: list[tuple[int, Anchors]] = []
        rows, base, bounds = [np.zeros(1, np.int64)], 0, []
        got = {k: [] for k in ("seed", "doc", "lo", "hi", "reach")}
        for lo, hi in slices(self.at):
            raw, at = self.raw[self.at[lo]: self.at[hi]], self.at[lo: hi + 1] - self.at[lo]
            if rule.words:
                units, begins, ends, inner = word_hashes(raw, at)
                bounds.append((begins + self.at[lo], ends + self.at[lo]))
            else:
                units, inner = _BYTE[raw], at
            anchors = Anchors(units, inner, rule.length, rule.seed)
            self.pieces.append((base, anchors))
            rows.append(inner[1:] + base)
            if len(anchors.at):
                begin, end, reach = anchors.reach()
                for k, v in (("seed", anchors.hash), ("doc", anchors.doc + lo), ("lo", begin + base), ("hi", end + base), ("reach", reach)):
                    got[k].append(v)
            base += len(units)
        self.rows, self.n = np.concatenate(rows), base
        self.seed, self.doc, self.lo, self.hi, self.reach = (
            np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("seed", "reach") else np.int64) for k, v in got.items())
        self.seed = self.seed >> np.uint64(16)
        self.bounds = tuple(np.concatenate(x) for x in zip(*bounds)) if bounds else (np.zeros(0, np.int64),) * 2
        self.covered = np.zeros(base + 1, np.int32)

    def cover(self, lo: np.ndarray, hi: np.ndarray) -> None:
        np.add.at(self.covered, lo, 1)
        np.add.at(self.covered, hi, -1)

    def removed(self) -> np.ndarray:
        return np.cumsum(self.covered[:-1]) > 0

    def earlier(self, values: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which values, in (document, place) order, this block holds at an earlier place that counts."""
        order = np.argsort(values, kind="stable")
        sorted_values = values[order]
        new = np.ones(len(values), bool)
        new[1:] = sorted_values[1:] != sorted_values[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(values) else order
        out = np.zeros(len(values), bool)
        out[order] = ~new if self.rule.own else self.rank[doc[order]] > self.rank[doc[order[head]]]
        return out

    def questions(self, answers: dict[str, list]) -> tuple[str, np.ndarray]:
        """The values of the next pass; after the last one, marks what is covered and asks nothing."""
        if "seeds" not in answers:
            return "seeds", self.seed
        again = np.zeros(len(self.seed), bool)
        if len(self.seed):
            values, back, count = np.unique(self.seed, return_inverse=True, return_counts=True)
            again = (count > 1)[back] | _flags(values, answers["seeds"], 48)[back]
        kept = np.flatnonzero(again)
        if "reaches" not in answers:
            return "reaches", self.reach[kept]
        reach, doc = self.reach[kept], self.doc[kept]
        whole = self.earlier(reach, doc)
        if len(reach):
            values, back = np.unique(reach, return_inverse=True)
            whole |= _flags(values, answers["reaches"], 64)[back]
        open_ = np.zeros(len(self.seed), bool)
        open_[kept[~whole]] = True
        starts, hashes, done = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        for base, anchors in self.pieces:
            at, value = anchors.windows(open_[done: done + len(anchors.at)])
            starts.append(at + base)
            hashes.append(value)
            done += len(anchors.at)
        at, value = np.concatenate(starts), np.concatenate(hashes)
        if "windows" not in answers:
            return "windows", value
        self.cover(self.lo[kept[whole]], self.hi[kept[whole]])
        if len(value):
            found = self.earlier(value, np.searchsorted(self.rows, at, side="right") - 1)
            values, back = np.unique(value, return_inverse=True)
            found |= _flags(values, answers["windows"], 64)[back]
            self.cover(at[found], at[found] + self.rule.length)
        return "", value[:0]


def _buckets(values: np.ndarray, bits: int, n: int) -> np.ndarray:
    return ((values >> np.uint64(bits - 32)) * np.uint64(n)) >> np.uint64(32)


def _flags(values: np.ndarray, answers: list, bits: int) -> np.ndarray:
    """The answers to sorted distinct values: a run of bits from each bucket, in bucket order."""
    if not len(values):
        return np.zeros(0, bool)
    answers = sorted(answers, key=lambda a: a["bucket"])
    out = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in answers]
    flags = np.concatenate(out).astype(bool)
    if len(flags) != len(values):
        raise ValueError("answers do not match the values asked about")
    return flags


def _encode(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, their bytes laid out plane by plane."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _decode(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=8 * n), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


_ASK = "bucket int, part int, block long, n int, data binary"
_ANSWER = "part int, block long, bucket int, n int, bits binary"


def _ask(rule: Rule, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                kind, values = Block(row, rule).questions(_known(row))
                values = np.unique(values)
                if not len(values):
                    continue
                bucket = _buckets(values, 48 if kind == "seeds" else 64, buckets)
                begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                end = np.append(begin[1:], len(values))
                yield pa.record_batch([
                    pa.array(bucket[begin].astype(np.int32)), pa.array([row["part"]] * len(begin), pa.int32()),
                    pa.array([row["block"]] * len(begin), pa.int64()), pa.array((end - begin).astype(np.int32)),
                    pa.array([_encode(values[a:b]) for a, b in zip(begin, end)], pa.binary())],
                    ["bucket", "part", "block", "n", "data"])
    return run


def _judge(any_other: bool) -> Callable:
    """Answers a bucket: which values another block holds too, or an earlier block."""
    def run(asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("block")
        n = asked.column("n").to_pylist()
        values = np.concatenate([_decode(d, k) for d, k in zip(asked.column("data").to_pylist(), n)])
        order = np.argsort(values, kind="stable")
        again = np.zeros(len(values), bool)
        again[1:] = values[order][1:] == values[order][:-1]
        if any_other:
            again[:-1] |= again[1:]
        flags = np.empty(len(values), bool)
        flags[order] = again
        ends = np.cumsum(n)
        bits = [np.packbits(flags[e - k: e]).tobytes() for e, k in zip(ends, n)]
        return pa.table({"part": asked.column("part"), "block": asked.column("block"), "bucket": asked.column("bucket"),
                         "n": asked.column("n"), "bits": pa.array(bits, pa.binary())})
    return run


_PASSES = ("seeds", "reaches", "windows")


def _known(row: dict) -> dict[str, list]:
    return {k: row[k] or [] for k in _PASSES if k in row}


def _with(blocks: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Blocks with the answers so far. The blocks stay where they are; only the answers move."""
    if answers is None:
        return blocks
    given = answers.withColumnRenamed("part", "to_part").withColumnRenamed("block", "to_block").hint("shuffle_hash")
    same_block = given["to_block"] - blocks["block"] == 0  # not a join key: blocks are bucketed by part alone
    return blocks.join(given, (blocks["part"] == given["to_part"]) & same_block, "left").drop("to_part", "to_block")


def repeated(documents: DataFrame, rule: Rule, report: Callable[[Block], pa.RecordBatch], schema: str,
             block_bytes: int = BLOCK, bucket_bytes: int = BUCKET) -> DataFrame:
    """What ``report`` makes of each block once the units covered by repeated windows are known."""
    if not 0 < rule.seed <= rule.length:
        raise ValueError("a seed must fit into a window")
    blocks = pack(documents, block_bytes)
    spark = documents.sparkSession
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    answers = None
    for name in _PASSES:
        asked = _with(blocks, answers).mapInArrow(_ask(rule, buckets), _ASK)
        judged = asked.groupBy("bucket").applyInArrow(_judge(name == "seeds"), _ANSWER)
        got = materialise(judged.groupBy("part", "block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name)), name)
        answers = got if answers is None else materialise(answers.join(got, ["part", "block"], "full"), "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row, rule)
                block.questions(_known(row))
                yield report(block)

    return _with(blocks, answers).mapInArrow(run, schema)
