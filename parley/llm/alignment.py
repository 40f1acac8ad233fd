"""Two tokenizers side by side: where tokens of both end at the same byte, they cut a text into groups.

Each text is cut into units (``units.py``). The ends of both id lists of a unit go into dictionaries from end to index; the keys that
both hold, sorted, slice the lists into groups, and each group links all its tokens of one side with all of the other. How many
documents hold a link is summed over the corpus: a block of documents hands on each of its links once, with its documents, and is
told the sum of each and whether it is its first token's highest. Links of a document are not spread out; they stay packed in
its block as units, and the answers come to the block.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import units
from parley.llm.flat import slices, text_bytes
from parley.llm.worker import Memory, kept
from parley.sources.store import materialise

#: Bytes of text in a block.
BLOCK = 4 << 20
#: Units a worker remembers, at least.
_REMEMBER = 60_000


def align(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> list[tuple[list[int], list[int]]]:
    """The groups of two id lists over the same bytes, given the bytes of every id of both vocabularies."""
    a_ends = {end: k for k, end in enumerate(accumulate([a_sizes[i] for i in a]), 1)}
    b_ends = {end: k for k, end in enumerate(accumulate([b_sizes[i] for i in b]), 1)}
    out, i, j = [], 0, 0
    for end in sorted(a_ends.keys() & b_ends.keys()):
        m, n = a_ends[end], b_ends[end]
        out.append((a[i:m], b[j:n]))
        i, j = m, n
    return out


#: What is known of a unit whose tokens do not give back its bytes.
_NONE = (False, 0, 0, 0, 0, b"", b"")


class Aligner:
    """Aligns units; a unit is known as (whole, tokens of each side, groups, links, groups spelt out, links as 64-bit pairs)."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = units.ByteLevel(byte_level), units.Pieces(pieces)
        self.a_sizes, self.b_sizes = self.a.sizes.tolist(), self.b.sizes.tolist()
        self.names = [str(i) for i in range(max(len(self.a_sizes), len(self.b_sizes)))]
        self.memory = Memory(_REMEMBER)

    def _aligned(self, a: list[int], b: list[int]) -> tuple:
        names, spelt, pairs = self.names, [], array("q")
        groups = align(a, b, self.a_sizes, self.b_sizes)
        for left, right in groups:
            if len(left) == len(right) == 1:
                spelt.append(f"{left[0]}|{right[0]}")
                pairs.append(left[0] << 32 | right[0])
            else:
                spelt.append(",".join([names[x] for x in left]) + "|" + ",".join([names[y] for y in right]))
                pairs.extend([x << 32 | y for x in left for y in right])
        return True, len(a), len(b), len(groups), len(pairs), ";".join(spelt).encode(), pairs.tobytes()

    def known(self, wanted: list[bytes]) -> list[tuple]:
        rows = self.memory.rows(wanted)
        new = [k for k, row in enumerate(rows) if row is None]
        texts = [wanted[k] for k in new]
        (a_ids, a_whole), (b_ids, b_whole) = self.a.units(texts), self.b.units(texts)
        for k, unit, a, b, x, y in zip(new, texts, a_ids, b_ids, a_whole, b_whole):
            row = self._aligned(a, b) if x and y else _NONE
            rows[k] = row
            if len(unit) <= 48:
                self.memory.put(unit, row)
        return rows


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def _pack(values: np.ndarray) -> bytes:
    """32-bit numbers, their bytes laid out plane by plane."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, 4 * n)), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


def _spread(lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places ``begin .. begin + length`` of each entry, end to end."""
    out = np.cumsum(lengths)
    return np.arange(int(out[-1]) if len(out) else 0) + np.repeat(begins - (out - lengths), lengths)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK_ROW = ("block long, doc_id array<long>, " + "".join(f"{c} array<long>, " for c in _COUNTS) + "groups_sha256 array<string>, "
              "n_units array<int>, n_codes int, codes binary, n_places int, unit_links array<int>, places binary, pairs array<long>, documents array<int>")


def _block(aligner: Aligner, ids: pa.Array, raw: np.ndarray, at: np.ndarray, number: int) -> pa.RecordBatch:
    """One row of all that is needed of a slice of documents once the links are counted."""
    filled = np.diff(at) > 0
    raw, at = np.insert(raw, at[:-1][filled], 32), at + np.concatenate(([0], np.cumsum(filled)))
    begins = units.cuts(raw, at)
    different, code = units.coded(raw, begins)
    rows = aligner.known(different)
    bad = np.array([not r[0] for r in rows], bool)[code] if rows else np.zeros(0, bool)
    if bad.any():
        # a document with such a unit is judged as a whole
        whole = np.zeros(len(ids), bool)
        whole[np.searchsorted(at, begins[bad], side="right") - 1] = True
        begins = units.cuts(raw, at, whole)
        different, code = units.coded(raw, begins)
        rows = aligner.known(different)
    doc = np.searchsorted(at, begins, side="right") - 1
    edges = np.searchsorted(begins, at)
    n_units = np.diff(edges)
    # common units have low codes, which pack better
    rank = np.empty(len(rows), np.int64)
    order = np.argsort(-np.bincount(code, minlength=len(rows)), kind="stable")
    rank[order] = np.arange(len(rows))
    code, rows = rank[code], [rows[k] for k in order.tolist()]
    numbers = np.array([r[1:5] for r in rows], np.int64).reshape(-1, 4)
    sums = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(numbers[code], axis=0)))
    totals = sums[edges[1:]] - sums[edges[:-1]]
    names, codes = [r[5] for r in rows], code.tolist()
    digests = [hashlib.sha256(b";".join([names[c] for c in codes[lo:hi]])).hexdigest() if n else ""
               for lo, hi, n in zip(edges[:-1].tolist(), edges[1:].tolist(), totals[:, 0].tolist())]
    links = np.frombuffer(b"".join([r[6] for r in rows]), np.int64)
    pairs = _distinct(links)
    place = np.searchsorted(pairs, links)
    n_links, begin = numbers[:, 3], np.cumsum(numbers[:, 3]) - numbers[:, 3]
    once = _distinct(doc * max(1, len(rows)) + code)
    held_doc, held = once // max(1, len(rows)), once % max(1, len(rows))
    seen = np.repeat(held_doc, n_links[held]) * max(1, len(pairs)) + place[_spread(n_links[held], begin[held])]
    documents = np.bincount(_distinct(seen) % max(1, len(pairs)), minlength=len(pairs))
    by_use = np.empty(len(pairs), np.int64)
    by_use[np.argsort(-documents, kind="stable")] = np.arange(len(pairs))

    def one(values, kind) -> pa.Array:
        return pa.array([values], pa.list_(kind))

    return pa.record_batch([
        pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(one(totals[:, k], pa.int64()) for k in range(4)),
        one(digests, pa.string()), one(n_units, pa.int32()), pa.array([len(code)], pa.int32()), pa.array([_pack(code)], pa.binary()),
        pa.array([len(place)], pa.int32()), one(n_links, pa.int32()), pa.array([_pack(by_use[place])], pa.binary()),
        one(pairs[np.argsort(by_use)], pa.int64()), one(documents[np.argsort(by_use)], pa.int32())],
        [c.split()[0] for c in _BLOCK_ROW.split(", ")])


_ANSWER = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answered(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of the documents of a block, given (pair, total, best) of all its links."""
    pair, total, best = (answers.column(c).to_numpy() for c in ("pair", "total", "best"))
    order = np.argsort(pair)
    out = []
    for k in range(blocks.num_rows):
        row = {c: blocks.column(c)[k] for c in blocks.column_names}
        pairs, n_links, n_units = (row[c].values.to_numpy(zero_copy_only=False) for c in ("pairs", "unit_links", "n_units"))
        found = order[np.searchsorted(pair, pairs, sorter=order)]
        if (pair[found] != pairs).any():
            raise ValueError("answers do not match the links of the block")
        place = _unpack(row["places"].as_py(), row["n_places"].as_py())
        code = _unpack(row["codes"].as_py(), row["n_codes"].as_py())
        columns = {c: row[c].values for c in ("doc_id", *_COUNTS, "groups_sha256")}
        unit_edges, edges = (np.concatenate(([0], np.cumsum(n, dtype=np.int64))) for n in (n_links, n_units))
        for name, values in (("n_best", best[found].astype(np.int64)), ("count_sum", total[found])):
            sums = np.concatenate(([0], np.cumsum(values[place])))
            per_unit = sums[unit_edges[1:]] - sums[unit_edges[:-1]]
            sums = np.concatenate(([0], np.cumsum(per_unit[code])))
            columns[name] = pa.array(sums[edges[1:]] - sums[edges[:-1]])
        out.append(pa.table([columns[c.split()[0]] for c in _ANSWER.split(", ")], [c.split()[0] for c in _ANSWER.split(", ")]))
    return pa.concat_tables(out) if out else pa.schema([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in _ANSWER.split(", ")]).empty_table()


def blocks(documents: DataFrame, byte_level: str, pieces: str, block_bytes: int = BLOCK) -> DataFrame:
    """The stored table of aligned blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(("aligner", byte_level, pieces), lambda: Aligner(byte_level, pieces))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            for lo, hi in slices(at, block_bytes):
                yield _block(aligner, batch.column("doc_id").slice(lo, hi - lo), raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo], number)
                number += 1

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, _BLOCK_ROW), "aligned")


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, total, best): in how many documents each link stands, and whether no link of its first token stands in more."""
    held = aligned.select(F.inline(F.arrays_zip("pairs", "documents"))).groupBy("pairs").agg(F.sum("documents").alias("total"))
    totals = materialise(held.select(F.col("pairs").alias("pair"), "total"), "link-counts")
    # one row for each id of a vocabulary at most
    highest = totals.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("total").alias("highest"))
    return totals.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("a")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def aligned_tokens(documents: DataFrame, byte_level: str, pieces: str, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``documents``.

    A space stands before each text. Texts that are null or empty, or whose bytes one of the tokenizers does not give back, have zeros and
    an empty digest, and no links. Repeated rows count as often as they stand there, also for the links; null doc_ids are documents
    like others. An empty table gives no rows; only doc_id and text are read.
    """
    stored = blocks(documents, byte_level, pieces, block_bytes)
    asked = stored.select(F.col("block").alias("to_block"), F.explode("pairs").alias("pair"))
    answers = asked.join(link_counts(stored), "pair").select("to_block", "pair", "total", "best")
    return stored.groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(_answered, _ANSWER)
