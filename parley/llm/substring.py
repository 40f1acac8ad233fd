"""Word runs repeated anywhere earlier, by seed and extend.

Documents meet on winnowed anchors: seeds of a few words of which every window selects one by content alone. From a shared anchor a
match is extended both ways as far as a window of the threshold length can reach; where it holds all that way the whole reach is repeated, and
where it breaks off the windows near the end tell how far it goes. Together they are the maximal repeats of at least
``length`` words.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.repeats import BLOCK, Block, Rule, repeated


def _report(block: Block) -> pa.RecordBatch:
    gone = block.removed()
    begins, ends = block.bounds
    n_words, n_removed, digests = [], [], []
    for a, b in zip(block.rows[:-1].tolist(), block.rows[1:].tolist()):
        part = gone[a:b]
        n_words.append(b - a)
        n_removed.append(int(part.sum()))
        kept = b" ".join(block.raw[x:y].tobytes() for x, y in zip(begins[a:b][~part].tolist(), ends[a:b][~part].tolist()))
        digests.append(hashlib.sha256(kept).hexdigest())
    return pa.record_batch([pa.array(block.ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                            pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_words(documents: DataFrame, length: int = 20, seed: int | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document.

    A word is removed if a window of ``length`` words over it also starts earlier: in a document with a smaller doc_id
    or further up in the same one. Words are runs without ASCII white space, unchanged. A null text has no words, a null
    doc_id is smaller than any other. Rows that share a doc_id follow each other in no set order, and a later
    one counts a former one as earlier. An empty table gives no rows; other columns are not read.
    """
    rule = Rule(length, min(length, 6) if seed is None else seed, words=True, own=True)
    return repeated(documents, rule, _report, "doc_id long, n_words long, n_removed long, kept_sha256 string", block_bytes)
