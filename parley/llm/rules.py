"""Quality rules: length and repetition first, then how far a text lies from its language.

Two histograms of every text, of character classes and of the commonest words of its language, are held against those of all
texts of that language that pass the length and repetition rules. The measure is the Jensen-Shannon distance (the root of the
divergence to base 2: 0 for equal histograms, 1 for disjoint ones). Short texts have ragged histograms, so each measure applies
only from a least length on; so does a language's reference.

Words, lines and windows are told apart by their text, not by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.flat import slices, text_bytes, word_bounds
from parley.sources.store import materialise

#: Words counted by a task before it hands them on.
_HOLD = 200_000

_OTHER, _LOWER, _UPPER, _DIGIT, _WHITE, _LINE, _POINT, _SHOUT, _SIGN, _WIDE = CLASSES = range(10)
_KIND = np.full(256, _OTHER, np.uint8)
for _bytes, _kind in ((range(97, 123), _LOWER), (range(65, 91), _UPPER), (range(48, 58), _DIGIT), (b" \t\v\f\r", _WHITE), (b"\n", _LINE),
                      (b".,;:'\"()-", _POINT), (b"!?", _SHOUT), (b"#*$%&|<>", _SIGN), (range(128, 256), _WIDE)):
    _KIND[list(_bytes)] = _kind
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = (_KIND == _LOWER) | (_KIND == _WIDE)


class Limits(NamedTuple):
    """When a text fails. The first two need no language; a distance counts from its least number of words on."""

    least_words: int = 50
    most_repeated: int = 50  # per cent of the words
    common: int = 100  # words in a reference
    char_words: int = 100
    char_distance: float = 0.30
    word_words: int = 200
    word_distance: float = 0.40
    reference_words: int = 5_000
    languages: int = 1_000


def _codes(raw: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> pa.DictionaryArray:
    """Strings made of the marked bytes, as codes into the different ones."""
    at = np.concatenate(([0], np.cumsum(lengths)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [
        None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[inside]))]).dictionary_encode()


def _dense(keys: np.ndarray) -> np.ndarray:
    return pa.array(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[rows[1:]] - sums[rows[:-1]]


def _repeat_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and those inside a window of three words that the text holds twice or more."""
    starts, ends, rows = word_bounds(raw, at)
    n, doc = len(starts), np.repeat(np.arange(len(at) - 1), np.diff(rows))
    if n < 3:
        return np.diff(rows), np.zeros(len(at) - 1, np.int64)
    words = _codes(raw, (_KIND[raw] != _WHITE) & (_KIND[raw] != _LINE), ends - starts)
    many, code = len(words.dictionary), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    pairs = _dense(doc[whole] * many + code[whole])
    pairs = _dense(pairs * many + code[whole + 1])
    windows = _dense(pairs * many + code[whole + 2])
    again = whole[np.bincount(windows)[windows] > 1] if len(windows) else whole
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + 3, -1)
    return np.diff(rows), _by_row(np.cumsum(covered[:-1]) > 0, rows)


def _dup_lines(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    line = raw == 10
    begins = np.union1d(at[:-1][np.diff(at) > 0], np.flatnonzero(line) + 1)
    begins = begins[begins < len(raw)]
    if not len(begins):
        return np.zeros(len(at) - 1, np.int64)
    begins = np.concatenate((begins, [len(raw)]))
    code = _codes(raw, ~line, _by_row(~line, begins)).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = _by_row((_KIND[raw] != _WHITE) & ~line, begins) > 0
    doc = np.searchsorted(at, begins[:-1], side="right") - 1
    keys = (doc * (int(code.max()) + 1) + code)[worded]
    first = np.unique(keys, return_index=True)[1]
    return np.bincount(doc[worded], minlength=len(at) - 1) - np.bincount(doc[worded][first], minlength=len(at) - 1)


class Counts(NamedTuple):
    """What the rules know of the texts of a slice, an entry or row for each."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    classes: np.ndarray
    failed: np.ndarray


def counts(raw: np.ndarray, at: np.ndarray, limits: Limits) -> Counts:
    """The counts of texts laid end to end; an empty text has zeros and fails."""
    kind, points = _KIND[raw], (raw & 0xC0) != 0x80
    n_words, repeated = _repeat_words(raw, at)
    return Counts(
        n_words, _by_row(points & (kind != _WHITE) & (kind != _LINE), at), _by_row(kind == _SIGN, at), _dup_lines(raw, at), repeated,
        np.stack([_by_row((kind == k) & points, at) for k in CLASSES], axis=1),
        (n_words < limits.least_words) | (100 * repeated > limits.most_repeated * n_words))


def _letter_words(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of letters, A-Z lowered: the different ones, a code for each, and the n + 1 places where each text's begin."""
    raw = _FOLD[raw]
    letter = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    gap = np.concatenate(([True], ~letter, [True]))
    starts = np.flatnonzero(letter & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(letter & (gap[2:] | edge[1:])) + 1
    words = _codes(raw, letter, ends - starts)
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, at)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` to the counts ``q`` (one row, or a row each); 0 where a row has none."""
    p, q = p / np.maximum(p.sum(axis=-1, keepdims=True), 1), q / np.maximum(q.sum(axis=-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    found = np.sqrt(np.maximum(parts.sum(axis=-1) / 2, 0))
    return np.where((p.sum(axis=-1) > 0) & (q.sum(axis=-1) > 0), found, 0.0)


class Reference(NamedTuple):
    """A language: its character classes, commonest words, and their counts with all other words behind them."""

    classes: np.ndarray
    words: list[bytes]
    word_counts: np.ndarray


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))


def references(documents: DataFrame, limits: Limits = Limits()) -> dict[str | None, Reference]:
    """The reference of each language, from all its texts that pass the length and repetition rules.

    At most ``limits.languages`` languages, those with the most words, have one of their own, which bounds what is sent to the tasks; the
    others share the reference under None. A null language is the language "".
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int | None, bytes], int] = {}

        def flush() -> pa.RecordBatch:
            keys = list(held)
            out = pa.record_batch([
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.binary()), pa.array(list(held.values()), pa.int64())], ["lang", "class", "word", "n"])
            held.clear()
            return out

        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for lo, hi in slices(at):
                part, edges = raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
                found = counts(part, edges, limits)
                words, code, rows = _letter_words(part, edges)
                words = words.to_pylist()
                for k in np.unique(lang[lo:hi]).tolist():
                    good = (lang[lo:hi] == k) & ~found.failed
                    for c, n in enumerate(found.classes[good].sum(axis=0).tolist()):
                        if n:
                            held[names[k], c, b""] = held.get((names[k], c, b""), 0) + n
                    seen = np.bincount(code[np.repeat(good, np.diff(rows))], minlength=len(words))
                    for w in np.flatnonzero(seen).tolist():
                        key = names[k], None, words[w]
                        held[key] = held.get(key, 0) + int(seen[w])
                if len(held) > _HOLD:
                    yield flush()
        if held:
            yield flush()

    counted = materialise(_texts(documents).mapInArrow(run, "lang string, class int, word binary, n long"), "language-counts")
    words = counted.where("class is null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    largest = words.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(limits.languages)
    # at most ``languages`` short rows
    own = F.broadcast(largest.select("lang", F.col("lang").alias("group")))
    words = materialise(words.join(own, "lang", "left").groupBy("group", "word").agg(F.sum("n").alias("n")), "language-words")
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "word"))
    top = words.withColumn("place", place).where(F.col("place") <= limits.common)
    totals = {r["group"]: r["n"] for r in words.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    classes: dict = {}
    grouped = counted.where("class is not null").join(own, "lang", "left").groupBy("group", "class").agg(F.sum("n").alias("n"))
    for r in grouped.collect():
        classes.setdefault(r["group"], np.zeros(len(CLASSES)))[r["class"]] = r["n"]
    common: dict = {}
    for r in sorted(top.collect(), key=lambda r: r["place"]):
        common.setdefault(r["group"], []).append((bytes(r["word"]), r["n"]))
    out = {}
    for group, total in totals.items():
        if total >= limits.reference_words:
            n = np.array([n for _, n in common[group]], np.float64)
            out[group] = Reference(classes[group], [w for w, _ in common[group]], np.append(n, total - n.sum()))
    # languages with a reference of their own too short for use are told from those that share one
    return out | {r["lang"]: None for r in largest.collect() if r["lang"] not in out}


def judge(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept), a row for each row.

    A text fails with fewer than ``least_words`` words, with more than ``most_repeated`` per cent of them repeated, or with a
    distance to its language above its limit. A distance is null where the text or the reference is too short for it; such a text
    is not failed for it. Null and empty texts have no words and fail. Repeated rows are judged alike, null doc_ids too; an empty
    table gives no rows; only doc_id, text and lang are read. The counts of the references are those of all documents.
    """
    known = references(documents, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for lo, hi in slices(at):
                part, edges = raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
                found = counts(part, edges, limits)
                words, code, rows = _letter_words(part, edges)
                letters = np.diff(rows)
                far = np.full((2, hi - lo), np.nan)
                for k in np.unique(lang[lo:hi]).tolist():
                    ref = known.get(names[k], known.get(None))
                    if ref is None:
                        continue
                    here = lang[lo:hi] == k
                    long = here & (found.n_words >= limits.char_words)
                    far[0, long] = distance(found.classes[long], ref.classes)
                    place = pc.index_in(words, pa.array(ref.words, words.type)).fill_null(len(ref.words)).to_numpy()
                    long = np.flatnonzero(here & (letters >= limits.word_words))
                    for d in long.tolist():
                        seen = np.bincount(place[code[rows[d]: rows[d + 1]]], minlength=len(ref.words) + 1)
                        far[1, d] = distance(seen, ref.word_counts)
                kept = ~found.failed & ~(far[0] > limits.char_distance) & ~(far[1] > limits.word_distance)
                yield pa.record_batch([
                    batch.column("doc_id").slice(lo, hi - lo), *(pa.array(x) for x in found[:5]), pa.array(found.failed),
                    *(pa.array(x, pa.float64(), mask=np.isnan(x)) for x in far), pa.array(kept)], [f.split()[0] for f in _JUDGED.split(", ")])

    return _texts(documents).mapInArrow(run, _JUDGED)


_JUDGED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "char_distance double, word_distance double, kept boolean")
