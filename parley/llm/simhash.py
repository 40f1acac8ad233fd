"""SimHash near-duplicates: fingerprints of word shingles, linked through deletion-variant signatures.

A fingerprint is cut into ``distance // 2 + 1`` segments. Two fingerprints that differ in at most ``distance`` bits
have a segment that differs in at most one, so they meet under that segment as it is, or under the segment with one bit
wiped out. Only fingerprints with unlike values of the wiped bit are joined there, so a pair meets once per segment.
Keys that many fingerprints share are cut again over the remaining bits in the same way: no key is dropped or capped,
and equal fingerprints count as one throughout, so a group of copies costs what one document does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.flat import mix, text_bytes
from parley.llm.graph import components, forest, groups, shrink
from parley.llm.worker import tidied
from parley.operators.skew import checked_broadcast, spread_join
from parley.sources.store import materialise

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A key met by more fingerprints than this is cut further.
CROWD = 256
#: Of the pairs at the wanted overlap, the share that is to meet under a segment whatever the size of the table.
RECALL = 0.99
#: By how many standard deviations the differing bits of a pair may exceed what the wanted overlap lets expect: in the whole fingerprint, which
#: decides, and in its first words, which only propose.
SLACK, LOOSE = 0.0, 3.2
#: Words of a fingerprint that travel to propose links.
PROPOSE = 4
#: Rows of two numbers that go to all tasks instead of moving the texts, some 60 MB.
BROADCAST_ROWS = 1 << 21
#: Words of a fingerprint that tell unlike texts apart before the others are compared.
_FIRST = 6
#: Bytes of unfolded variants that one task sorts.
TASK_BYTES = 64 << 20


def _votes(hashes: np.ndarray, words_of_64: int) -> np.ndarray:
    """How many of the hashes set each bit; the words after the first are made of rehashed ones."""
    steps = np.array([n * 0x9E3779B97F4A7C15 % (1 << 64) for n in range(words_of_64)], np.uint64)
    votes = np.zeros(64 * words_of_64, np.int64)
    for lo in range(0, len(hashes), 4080):
        part = hashes[lo: lo + 4080, None] + steps
        part[:, 1:] = mix(part[:, 1:])
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # as many as a byte can count
            votes += np.add.reduce(bits[k: k + 255], axis=0, dtype=np.uint8)
    return votes


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of all shingles, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()[shingle - 1:] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(begins, ends)], np.uint64)


def fingerprint(text: bytes, shingle: int, words_of_64: int = 1) -> list[int]:
    """The SimHash of one text as signed 64-bit numbers; those after the first come from rehashed shingles."""
    return _prints(_shingles(text, shingle), words_of_64)


def _prints(hashes: np.ndarray, words_of_64: int) -> list[int]:
    if not len(hashes):
        return [0] * words_of_64
    return np.packbits(_votes(hashes, words_of_64) * 2 > len(hashes), bitorder="little").view(np.int64).tolist()


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every document: whole text, A-Z lowered, all shingles of ``shingle`` words, repeats included.

    Fewer words than a shingle make one shingle of them all; a null or blank text has fingerprint 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            prints = [fingerprint(raw[a:b].tobytes(), shingle)[0] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def _segment(part: Column, first: int, wide: int) -> Column:
    """Array of (piece, value, side): a segment whole (side 2) and with each of its bits wiped (side: that bit)."""
    def wiped(p: Column) -> Column:
        return F.struct(
            (F.lit(first + 1) + p).alias("piece"),
            part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), p))).alias("value"),
            F.call_function("shiftright", part, p).bitwiseAND(F.lit(1)).cast("int").alias("side"))

    whole = F.struct(F.lit(first).alias("piece"), part.alias("value"), F.lit(2).alias("side"))
    return F.concat(F.array(whole), F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), wiped))


def _variants(bits: Column, width: int, size: int, first: int = 0) -> Column:
    """The variants of every segment of ``size`` bits of the lowest ``width``; the last segment may be shorter."""
    out = []
    for n in range(-(-width // size)):
        wide = min(size, width - n * size)
        part = F.shiftrightunsigned(bits, n * size).bitwiseAND(F.lit((1 << wide) - 1 if wide < 64 else -1))
        out.append(_segment(part, first + n * 65, wide))
    return F.concat(*out)


def _size(width: int, distance: int) -> int:
    """Bits of a segment when one of them must differ in at most one bit."""
    return -(-width // (distance // 2 + 1))


def _rest(bits: Column, piece: Column, distance: int) -> Column:
    """The bits outside the segment of ``piece``, moved together."""
    size = _size(64, distance)
    out = F.lit(0).cast("long")
    for n in range(-(-64 // size)):
        low = bits.bitwiseAND(F.lit((1 << n * size) - 1))
        high = F.shiftleft(F.shiftrightunsigned(bits, (n + 1) * size), n * size) if (n + 1) * size < 64 else F.lit(0).cast("long")
        out = F.when(F.floor(piece / 65) == n, low.bitwiseOR(high)).otherwise(out)
    return out


def links(prints: DataFrame, distance: int = 3, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of ``node`` whose different fingerprints ``fp`` lie within ``distance`` bits.

    ``prints`` holds each fingerprint once, with its node. A pair may come up to once per segment.
    """
    if not 0 <= distance <= 31:
        raise ValueError("distance must lie between 0 and 31 bits")
    keyed = prints.select("node", "fp", F.explode(_variants(F.col("fp"), 64, _size(64, distance))).alias("k")).select("node", "fp", "k.*")
    # Spark takes exploded rows to be as few as those they come from and would broadcast them: only keys that were counted may be
    crowded = checked_broadcast(keyed.groupBy("piece", "value").count().where(F.col("count") > crowd).select("piece", "value"))
    plain = keyed.hint("merge").join(crowded, ["piece", "value"], "left_anti").select(
        "*", F.lit(-1).alias("piece2"), F.lit(0).cast("long").alias("value2"), F.lit(2).alias("side2"))
    deep = keyed.hint("merge").join(crowded, ["piece", "value"]).withColumn("rest", _rest(F.col("fp"), F.col("piece"), distance))
    left_over = max(1, 64 - _size(64, distance))
    deep = deep.select("*", F.explode(_variants(F.col("rest"), left_over, _size(left_over, distance))).alias("k")).select(
        "piece", "value", "node", "fp", "side", F.col("k.piece").alias("piece2"), F.col("k.value").alias("value2"), F.col("k.side").alias("side2"))
    both = plain.unionByName(deep)
    key = ["piece", "value", "piece2", "value2"]
    left = both.where("side <> 1").select(*key, F.col("node").alias("a"), F.col("fp").alias("fa"), F.col("side2").alias("sa")).hint("merge")
    right = both.where("side <> 0").select(*key, F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("side").alias("sb"), F.col("side2").alias("tb"))
    on = [left[c] == right[c] for c in key] + [
        F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance,
        # whole segments: each pair once; wiped bits, on either level: unlike bits only
        (F.col("sb") == 1) | (F.col("fa") < F.col("fb")),
        ((F.col("sa") == 2) & (F.col("tb") == 2)) | (F.col("sa") + F.col("tb") == 1)]
    return left.join(right, on).select("a", "b")


def near_duplicates(documents: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): every document with the least doc_id its chain of links reaches, itself included.

    Equal fingerprints are linked. A null doc_id takes part, but names no component (null if its whole group is null).
    Every row gives a row, repeated ones too; an empty table gives none; other columns of ``documents`` are not read.
    """
    prints = materialise(fingerprints(documents, shingle), "prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    # a fingerprint is its own node, so those of rows without doc_id pass links on
    linked = materialise(classes.join(groups(links(classes.select(F.col("fp").alias("node"), "fp"), distance)), F.col("fp") == F.col("node")).drop("node"), "linked")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    # the copies for the salts are exploded rows, and prints has a row for each document: neither is broadcast
    least = spread_join(linked.hint("merge"), least, ["component"], ["fp"], salts=8).select("fp", "least")
    named = classes.join(least, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return prints.hint("merge").join(named, "fp").select("doc_id", "fp", "component_id")


def _bands(n: int) -> int:
    """Bits of a segment when alike texts are sought: few chance meetings for ``n`` fingerprints."""
    return min(32, max(16, math.ceil(math.log2(max(2, n))) - 1))


def _bit_odds(similarity: float) -> float:
    """Odds that a bit differs: overlap j of sets of one size is a cosine of 2j / (1 + j), and a bit differs with the angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _words(size: int, similarity: float) -> int:
    """64-bit words whose segments of ``size`` bits hold one that differs in at most one bit for RECALL of the pairs at ``similarity``."""
    odds = _bit_odds(similarity)
    meets = (1 - odds) ** size + size * odds * (1 - odds) ** (size - 1)
    return math.ceil(math.ceil(math.log(1 - RECALL) / math.log(1 - meets)) * size / 64)


def _apart(prints: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the fingerprints of rows ``i`` and ``j`` differ."""
    return sum(np.bitwise_count(p[i] ^ p[j]).astype(np.uint16) for p in prints)


def _near(prints: list[np.ndarray], i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Whether the fingerprints of rows ``i`` and ``j`` lie within ``distance``."""
    i, j = np.broadcast_arrays(i, j)
    near = _apart(prints[:_FIRST], i, j) <= distance
    if len(prints) > _FIRST:
        at = np.nonzero(near)
        near[at] = _apart(prints, i[at], j[at]) <= distance
    return near


def _forest(node: np.ndarray, prints: list[np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever all links within ``distance`` join, at most one for each row.

    Rows already reached are compared only with those not yet reached, so a group of near copies costs one comparison a row.
    """
    a, b = [node[:0]], [node[:0]]
    front, left = np.zeros(1, np.int64), np.arange(1, len(node))
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
            continue
        take = max(1, (1 << 20) // len(left))
        now, front = front[:take], front[take:]
        near = _near(prints, now[:, None], left[None, :], distance)
        hit = near.any(axis=0)
        a.append(node[now[near[:, hit].argmax(axis=0)]])
        b.append(node[left[hit]])
        front, left = np.concatenate([front, left[hit]]), left[~hit]
    return np.concatenate(a), np.concatenate(b)


def _meetings(distance: int, crowd: int, block: int | None):
    """Links of rows (key, side, node, words of the fingerprint) sorted by key and node: one pass that holds a batch and one key's rows.

    Under a key every row is compared with the least node, then those not both linked to it with one another; a link between
    two rows that are joined anyway may be left out, and of what a task finds only a forest leaves it. Keys of more than ``crowd`` rows are searched outwards from the rows
    already reached. A key of more than ``block`` rows is only counted, (key, null, rows), for another pass to cut up.
    ``side`` is the value of a wiped bit: only rows unlike in it are compared. -1 compares all.
    """
    def links(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, side, node, prints = rows[0], rows[1], rows[2], rows[3:]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(begin, len(key)))
        many = begin[length > 1]
        start, end = np.repeat(begin, length), np.repeat(begin + length, length)

        def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            unlike = (side[i] < 0) | (side[i] != side[j])
            unlike[unlike] = _near(prints, i[unlike], j[unlike], distance)
            return unlike

        few = np.flatnonzero((end - start > 1) & (end - start <= crowd))
        few = few[few != start[few]]
        tied = np.zeros(len(key), bool)
        tied[few] = fits(start[few], few)
        hit = np.flatnonzero(tied)
        a, b = [node[start[hit]]], [node[hit]]
        for step in range(1, crowd - 1):
            few = few[few + step < end[few]]
            if not len(few):
                break
            at = few[~(tied[few] & tied[few + step])]
            at = at[fits(at, at + step)]
            a.append(node[at])
            b.append(node[at + step])
        for lo in many[end[many] - many > crowd].tolist():
            hi = end[lo]
            if side[lo] < 0 or (side[lo:hi] != side[lo]).any():
                for out, found in zip((a, b), _forest(node[lo:hi], [p[lo:hi] for p in prints], distance)):
                    out.append(found)
        return np.concatenate(a), np.concatenate(b)

    def joined(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = shrink(*(np.concatenate(x) for x in zip(*found)))
        return pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "rows"])

    def counted(key: int, rows: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array([key]), pa.nulls(1, pa.int64()), pa.array([rows], pa.int64())], ["a", "b", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over, found, n = None, None, [], 0
        for batch in batches:
            if n > 1 << 20:
                yield joined(found)
                found, n = [], 0
            rows = [batch.column(n).to_numpy() for n in range(batch.num_columns)]
            rows[3:] = [p.view(np.uint64) for p in rows[3:]]
            if over:
                here = int(np.searchsorted(rows[0], over[0], side="right"))
                over[1] += here
                rows = [x[here:] for x in rows]
            if not len(rows[0]):
                continue
            if over:
                yield counted(*over)
                over = None
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                found.append(links([x[:last] for x in rows]))
                n += len(found[-1][0])
            held = [x[last:] for x in rows]
            if block and len(held[0]) > block:
                held, over = None, [int(held[0][0]), len(held[0])]
        if held:
            found.append(links(held))
        if found:
            yield joined(found)
        if over:
            yield counted(*over)

    return run


def _alike(classes: DataFrame, count: int, words_of_64: int, size: int, distance: int, crowd: int, block: int, judged: int = 0) -> DataFrame:
    """Links (a, b) of the classes (node, fp array) that share a segment, whole or with a bit wiped, and lie within ``distance``.

    They join whatever all such links join. ``count`` is the number of classes. Segments lie over all bits of the first ``words_of_64`` words,
    across their borders; the first ``judged`` words (0: as many) travel and are compared. Keys of more than ``block`` rows are cut by a hash of the
    node into parts that meet pair by pair.
    """
    segments, low = 64 * words_of_64 // size, size // 2
    names = [f"f{n}" for n in range(judged or words_of_64)]
    # a segment's variants wiped in one half agree in the other half: they travel as one row and unfold where they meet
    slots = []
    for m in range(segments):
        word, at = divmod(m * size, 64)
        part = F.shiftrightunsigned(F.col("fp")[word], at)
        if at + size > 64:
            part = part.bitwiseOR(F.shiftleft(F.col("fp")[word + 1], 64 - at))
        part = part.bitwiseAND(F.lit((1 << size) - 1))
        for first, end, intact in ((-1, low, F.shiftright(part, low)), (low, size, part.bitwiseAND(F.lit((1 << low) - 1)))):
            slots.append(F.struct(
                F.lit(m * 65).alias("piece"), F.lit(first).alias("first"), F.lit(end - 1).alias("last"), part.alias("part"), intact.alias("intact")))
    held = classes.select("node", *(F.col("fp")[n].alias(c) for n, c in enumerate(names)), F.explode(F.array(*slots)).alias("k")).select(
        "node", *names, "k.*")

    def variants(rows: DataFrame) -> DataFrame:
        bit = F.explode(F.sequence("first", "last")).alias("bit")
        at = F.greatest(F.col("bit"), F.lit(0))
        wiped = F.when(F.col("bit") < 0, F.col("part")).otherwise(
            F.col("part").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), at))))
        key = F.shiftleft((F.col("piece") + 1 + F.col("bit")).cast("long"), 32).bitwiseOR(wiped)
        side = F.when(F.col("bit") < 0, F.lit(-1)).otherwise(F.call_function("shiftright", F.col("part"), at).bitwiseAND(F.lit(1))).cast("long")
        return rows.select("*", bit).select(key.alias("key"), side.alias("side"), "node", *names)

    def met(rows: DataFrame, block: int | None) -> DataFrame:
        return materialise(rows.sortWithinPartitions("key", "node").mapInArrow(
            tidied(_meetings(distance, crowd, block)), "a long, b long, rows long").distinct(), "links")

    tasks = math.ceil(count * segments * (size + 1) * 8 * (len(names) + 5) / TASK_BYTES)
    found = met(variants(held.repartition(max(1, tasks), "piece", "first", "intact")), block)
    over = found.where("b is null").select(F.col("a").alias("key"), F.ceil(F.col("rows") * 4 / block).cast("int").alias("parts"))
    if over.isEmpty():
        return found.select("a", "b")
    cut = variants(held).join(over, "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part")
    cut = cut.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), F.lit(-1).cast("long").alias("side"), "node", *names)
    return found.where("b is not null").unionByName(met(cut.repartition("key"), None)).select("a", "b")


def bound(similarity: float, words_of_64: int, slack: float = SLACK) -> int:
    """In how many bits of their fingerprints near copies differ at most."""
    bits, odds = 64 * words_of_64, _bit_odds(similarity)
    return math.floor(bits * odds + slack * math.sqrt(bits * odds * (1 - odds)))


def keep_one_of_each(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, words_of_64: int = 16, crowd: int = 64,
                     block: int = 1 << 18) -> DataFrame:
    """The row of least doc_id of each group of near copies, all columns as they are.

    Near copies are texts whose fingerprints of ``64 * words_of_64`` bits over their sets of ``shingle``-word shingles differ in at most as many
    bits as sets that overlap by ``similarity`` let expect, and SLACK deviations more; a group is what a chain of them joins. That is
    the rule: bits estimate the overlap, with 1,024 of them to some 0.025, and the sets themselves are not compared. Fingerprints meet
    under segments of about log2 of the number of texts, whole or with one bit wiped, as many as RECALL asks for. First only their
    first 256 bits travel and propose links, at most one a text for each key, under a looser bound; the whole fingerprints verify these. Texts of a
    group where a link fails meet once more, with all their bits, which decide at once. Equal sets are one class. Rows without words form no group, nor do rows
    without doc_id; of repeated rows one stays.
    """
    size = _bands(documents.count())
    segment_words = _words(size, similarity)
    words_of_64 = max(words_of_64, segment_words, PROPOSE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            sets = [np.unique(_shingles(raw[a:b].tobytes(), shingle)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([xxhash.xxh64_intdigest(x.tobytes()) >> 1 for x in sets], pa.int64()),
                pa.array([_prints(x, words_of_64) for x in sets], pa.list_(pa.int64())),
                pa.array([len(x) > 0 for x in sets]), batch.column("sum")], ["doc_id", "node", "fp", "words", "sum"])

    row_id, row_sum = documents["doc_id"].cast("long"), F.xxhash64(documents["text"].cast("string"))
    narrow = documents.select(row_id.alias("doc_id"), documents["text"].cast("string").alias("text"), row_sum.alias("sum"))
    prints = materialise(narrow.mapInArrow(tidied(run), "doc_id long, node long, fp array<long>, words boolean, sum long"), "prints")
    known = prints.where("words and doc_id is not null")
    classes = materialise(known.groupBy("node").agg(F.any_value("fp").alias("fp"), F.min(F.struct("doc_id", "sum")).alias("first")), "classes")
    count, bits = classes.count(), bound(similarity, words_of_64)
    proposed = materialise(forest(_alike(classes, count, segment_words, size, bound(similarity, PROPOSE, LOOSE), crowd, block, PROPOSE)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "proposed")
    apart = sum(F.bit_count(F.col("left")[n].bitwiseXOR(F.col("right")[n])) for n in range(words_of_64))
    ends = [classes.select(F.col("node").alias(n), F.col("fp").alias(fp)) for n, fp in (("a", "left"), ("b", "right"))]
    judged = materialise(proposed.join(ends[0], "a").join(ends[1], "b").select("a", "b", (apart <= bits).alias("alike")), "judged")
    links, failed = judged.where("alike").select("a", "b"), judged.where("not alike")
    if not failed.isEmpty():
        loose = materialise(groups(proposed), "loose")
        torn = failed.join(loose, failed["b"] == loose["node"]).select("component").distinct()
        left_open = materialise(loose.join(torn, "component").select("node").join(classes, "node").select("node", "fp"), "open")
        links = links.unionByName(forest(_alike(left_open, left_open.count(), segment_words, size, bits, crowd, block, words_of_64)))
    linked = materialise(classes.select("node", "first").join(groups(links), "node"), "linked")
    best = linked.groupBy("component").agg(F.min("first").alias("best"))
    best = spread_join(linked, best, ["component"], ["node"], salts=8).select("node", "best")
    named = classes.select("node", "first").join(best, "node", "left").select("node", F.coalesce("best", "first").alias("best"))
    gone = known.join(named, "node").where("doc_id <> best.doc_id or sum <> best.sum").select("doc_id", "sum")
    # rows that repeat a doc_id and its text: all but one go as well
    twice = materialise(known.groupBy("doc_id", "sum").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "sum"), "twice")

    def these(rows: DataFrame, found: DataFrame) -> list:
        return [rows["doc_id"].cast("long") == found["doc_id"], F.xxhash64(rows["text"].cast("string")) == found["sum"]]

    gone = materialise(gone.distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = documents.join(gone, these(documents, gone), "left_anti")
    if twice.isEmpty():
        return kept
    return kept.join(twice, these(kept, twice), "left_anti").unionByName(kept.join(twice, these(kept, twice), "left_semi").dropDuplicates(["doc_id", "text"]))
