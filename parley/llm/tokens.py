"""Token ids in flat binary files with 64-bit document offsets.

Documents are ranged by doc_id; each task writes one file of unsigned integers, end to end, and one of offsets. A prefix
sum over the tasks' totals gives every file its base, so any document is found by one subtraction. Files are mapped
into memory when they are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import files
from parley.llm.flat import slices, text_bytes
from parley.llm.units import ByteLevel
from parley.llm.worker import kept, tidied
from parley.sources.store import materialise, new_table_path

#: Different pieces a worker remembers, at least; twice as many at most.
_REMEMBER = 120_000
#: What uses of a piece count for after each further call.
_FADE = np.float32(0.97)
#: Bytes encoded at once.
_AT_ONCE = 2 << 20

# Kinds of bytes: letters, digits, marks, apostrophe, space, other white space and controls, and bytes beyond ASCII.
_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _WHITE, _WIDE = range(7)
_KIND = np.full(256, _WIDE, np.uint8)
_KIND[33:127] = _MARK
_KIND[:33] = _WHITE
_KIND[127] = _WHITE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39], _KIND[32] = _QUOTE, _SPACE


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places where a text may be cut without changing its tokens.

    Byte-level tokenizers split a text into runs of letters, digits, marks and white space before they join bytes, and only one space
    goes with the run after it. Cuts: between unlike ASCII runs without an apostrophe, where white space
    begins, and after a single white character other than a space. Next to other characters only what is certain is cut.
    """
    kind = _KIND[raw]
    left, right = kind[:-1], kind[1:]
    plain = left <= _MARK
    cut = plain & (right <= _MARK) & (left != right)
    cut |= (left <= _QUOTE) & ((right == _SPACE) | (right == _WHITE))
    # letters of two bytes behind C3, other than the signs for times and divided by
    latin = (raw[:-1][:-1] == 0xC3) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7) if len(raw) > 2 else np.zeros(0, bool)
    after_latin = np.concatenate((np.zeros(min(1, len(left)), bool), latin))
    cut |= after_latin & ((right == _SPACE) | (right == _WHITE) | (right == _DIGIT) | (right == _MARK))
    line = raw[:-1] == 10
    lone = np.concatenate((np.zeros(min(1, len(left)), bool), (left[:-1] <= _QUOTE) | after_latin[:-1]))
    cut |= line & lone & ((right <= _QUOTE) | (raw[1:] == 0xC3))
    return np.flatnonzero(cut) + 1


def _binary(edges: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    """Bytes laid end to end as rows that begin and end at ``edges``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [
        None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Known:
    """Different pieces and their ids; of more than twice ``limit``, the ``limit`` that were used most of late stay."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, np.zeros(0, np.float32)
        self.place: dict[bytes, int] = {}
        self.ids = _binary(np.zeros(1, np.int64), np.zeros(0, np.uint8))

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """Where the ids of each piece stand in ``ids``, -1 for those not known."""
        return np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))

    def use(self, places: np.ndarray, times: np.ndarray) -> None:
        self.used *= _FADE
        self.used[places] += times

    def add(self, pieces: list[bytes], ids: pa.LargeBinaryArray, times: np.ndarray) -> None:
        short = np.fromiter(map(len, pieces), np.int64, len(pieces)) <= 64
        if not short.all():
            pieces, ids, times = [pieces[k] for k in np.flatnonzero(short).tolist()], ids.filter(pa.array(short)), times[short]
        self.place.update(zip(pieces, range(len(self.used), len(self.used) + len(pieces))))
        self.ids, self.used = pa.concat_arrays([self.ids, ids]), np.concatenate((self.used, times.astype(np.float32)))
        if len(self.used) > 2 * self.limit:
            most = np.sort(np.argpartition(self.used, -self.limit)[-self.limit:])
            stay = np.zeros(len(self.used), bool)
            stay[most] = True
            self.place = {piece: k for k, piece in enumerate(compress(self.place, stay.tolist()))}
            self.ids, self.used = self.ids.take(pa.array(most)), self.used[most]


class Encoder:
    """Encodes many texts at once; each different piece goes through the tokenizer once while it is remembered."""

    def __init__(self, vocabulary: str):
        self.vocabulary = ByteLevel(vocabulary, special=True)
        self.size = len(self.vocabulary.bytes)
        self.added = [t.content.encode() for t in self.vocabulary.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known(_REMEMBER)

    def _edges(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pieces begin. A text that spells out an added token stays in one piece."""
        found = cuts(raw)
        text = raw.tobytes()
        for added in self.added:
            place = text.find(added)
            while place >= 0:
                doc = int(np.searchsorted(at, place, side="right")) - 1
                found = found[(found <= at[doc]) | (found >= at[doc + 1])]
                place = text.find(added, int(at[doc + 1]))
        begin = np.zeros(len(raw) + 1, bool)
        begin[found] = begin[at] = begin[0] = True
        return np.flatnonzero(begin)

    def encode(self, raw: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, each with ``end_id`` behind it, and the n + 1 places where they begin."""
        n = len(at) - 1
        edges = self._edges(raw, at) if len(raw) else np.zeros(1, np.int64)
        pieces = _binary(edges, raw).dictionary_encode()
        different, index = (x.to_numpy(zero_copy_only=False) for x in (pieces.dictionary, pieces.indices))
        different = different.tolist()
        times = np.bincount(index, minlength=len(different))
        places = self.known.places(different)
        old, new = places >= 0, np.flatnonzero(places < 0)
        self.known.use(places[old], times[old])
        places[new] = np.arange(len(new)) + len(self.known.ids)
        fresh = [different[k] for k in new.tolist()]
        ids, counts, _ = self.vocabulary.flat(fresh)
        found = _binary(4 * np.concatenate(([0], np.cumsum(counts))), ids.astype(np.uint32).view(np.uint8))
        rows = pa.concat_arrays([self.known.ids, found, pa.array([np.array([end_id], np.uint32).tobytes()], pa.large_binary())])
        ends = np.searchsorted(edges, at[1:]) if len(raw) else np.zeros(n, np.int64)
        taken = rows.take(pa.array(np.insert(places[index], ends, len(rows) - 1)))
        self.known.add(fresh, found, times[new])
        _, out, ids = taken.buffers()
        out = np.frombuffer(out, np.int64)[: len(taken) + 1] // 4
        return np.frombuffer(ids, np.uint32)[: int(out[-1])], out[np.concatenate(([0], ends + np.arange(1, n + 1)))]


def write(documents: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Writes ``<folder>/part-N.ids`` and ``.offsets`` and returns the stored list of files with their bases.

    Ids take 2 bytes if the vocabulary allows, else 4, little-endian; ``end_id`` ends each document. Offsets are n + 1 64-bit
    numbers within the file. A null text is empty, null doc_ids come first, rows that repeat a doc_id stand side by side
    in the order of their text. An empty table gives no documents; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = kept(("encoder", vocabulary), lambda: Encoder(vocabulary))
        kind = np.dtype("<u2") if max(encoder.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        docs, offsets = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]

        def fill(out) -> None:
            for batch in batches:
                docs.append(batch.column("doc_id").fill_null(-1 << 63).to_numpy())
                raw, at = text_bytes(batch.column("text"))
                for lo, hi in slices(at, _AT_ONCE):
                    ids, places = encoder.encode(raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo], end_id)
                    out.write(ids.astype(kind).tobytes())
                    offsets.append(places[1:] + offsets[-1][-1])

        path = f"{folder}/part-{part:06d}"
        files.write_whole(f"{path}.ids", fill)
        places, names = np.concatenate(offsets).astype("<i8"), np.concatenate(docs).astype("<i8")
        files.write_whole(f"{path}.offsets", lambda out: out.write(places.tobytes()))
        files.write_whole(f"{path}.docs", lambda out: out.write(names.tobytes()))
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([kind.itemsize], pa.int32()),
                               pa.array([len(names)], pa.int64()), pa.array([int(places[-1])], pa.int64())],
                              ["part", "path", "width", "documents", "tokens"])

    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = ranged.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    listed = materialise(ranged.mapInArrow(tidied(run), "part int, path string, width int, documents long, tokens long"), "token-files")
    # one row per file, so a window over all of them stays small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(listed.select("*", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")), "token-index")


def read(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with files.reader(row["path"] + ".offsets") as f:
                    offsets = np.frombuffer(f.read(), "<i8")
                with files.reader(row["path"] + ".docs") as f:
                    docs = np.frombuffer(f.read(), "<i8")
                with files.reader(row["path"] + ".ids") as f:
                    for lo in range(0, len(docs), 10_000):
                        hi, sums = min(len(docs), lo + 10_000), []
                        for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1: hi + 1].tolist()):
                            f.seek(a * row["width"])
                            ids = np.frombuffer(f.read((b - a) * row["width"]), f"<u{row['width']}")
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        yield pa.record_batch([
                            pa.array(docs[lo:hi], mask=docs[lo:hi] == -1 << 63), pa.array(offsets[lo:hi] + row["base"]),
                            pa.array(np.diff(offsets[lo: hi + 1])), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    return read(write(documents, new_table_path(documents.sparkSession, "tokens"), vocabulary, end_id))
