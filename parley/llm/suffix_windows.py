"""Byte windows repeated across documents, by winnowed hash membership; no suffix is ordered and there is no digit pass.

Each window holds an anchor, a cut point chosen by content, at the same place wherever it occurs. Three rounds of 64-bit hashes ask,
block by block, whether a hash occurs elsewhere, one bit back for each: that of the seed at the anchor, that of all that windows around
it can reach, and those of the windows themselves. What leaves no repeated hash leaves the rounds; what is left at the end are equal windows.
This stands in for a radix sort of suffixes, which would write several times the tenfold of the input by estimate (not measured).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.repeats import BLOCK, Block, Rule, repeated


def _report(block: Block) -> pa.RecordBatch:
    gone = block.removed()
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8))))
    out = {"n_bytes": [], "n_removed": [], "n_spans": [], "begins": [], "ends": [], "kept_sha256": []}
    for a, b in zip(block.at[:-1].tolist(), block.at[1:].tolist()):
        part = gone[a:b]
        begins = np.flatnonzero(edge[a:b] == 1)
        if b > a and part[0] and not len(begins[begins == 0]):
            begins = np.concatenate(([0], begins))
        ends = np.flatnonzero(part & ~np.concatenate((part[1:], [False]))) + 1 if b > a else begins
        out["n_bytes"].append(b - a)
        out["n_removed"].append(int(part.sum()))
        out["n_spans"].append(len(begins))
        out["begins"].append(begins)
        out["ends"].append(ends)
        out["kept_sha256"].append(hashlib.sha256(block.raw[a:b][~part].tobytes()).hexdigest())
    longs = pa.list_(pa.int64())
    return pa.record_batch([
        pa.array(block.ids, pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
        pa.array(out["n_spans"], pa.int64()), pa.array(out["begins"], longs), pa.array(out["ends"], longs),
        pa.array(out["kept_sha256"], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "begins", "ends", "kept_sha256"])


def repeated_bytes(documents: DataFrame, length: int = 50, seed: int | None = None, block_bytes: int = BLOCK // 4) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, begins, ends, kept_sha256) of every document.

    A byte is removed if a ``length``-byte string over it also starts in a document with a smaller doc_id; begins and
    ends are the byte offsets of the maximal removed runs. A null text is empty, a text shorter than ``length`` keeps all,
    a null doc_id is smaller than any other. Rows that share a doc_id are reported one by one and do not count as
    earlier than each other. An empty table gives no rows; other columns are not read.
    """
    rule = Rule(length, min(length, 24) if seed is None else seed, words=False, own=False)
    return repeated(documents, rule, _report,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, begins array<long>, ends array<long>, kept_sha256 string",
                    block_bytes)
