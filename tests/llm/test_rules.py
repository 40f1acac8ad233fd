"""Quality rules and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parley.llm import resampling, rules

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(["the", "of", "And", "\u00fcber", "x1", "end."]) if r.random() < 0.4 else "v" + "abcdefghij"[r.randrange(10)] * r.randrange(1, 40) for _ in range(n)]


def texts():
    out = [" ".join(words(k, 120 + 40 * (k % 5))) for k in range(60)]
    out += ["", None, " \n\t ", "one", "a b", "x" * 50_000, " ".join(words(99, 20_000)), "spam spam spam " * 80, "A\nA\n\n \nA\nB", "\x0b\x0c q\r\n q"]
    out += [" ".join(w + "######" for w in words(7, 300)), " | ".join(f"cell{k}" for k in range(300)), out[0], out[0]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i is None or i % 9 else None, 1, "x") for i, t in rows],
                                 "doc_id long, text string, lang string, n_words long, word string").repartition(3)


def brute_rules(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = {p + k for p in range(len(found) - 2) if windows[tuple(found[p:p + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base


def test_rules(spark):
    rows = list(enumerate(texts()))
    found = {r.doc_id: r for r in rules.judge(frame(spark, rows), rules.Limits(reference_words=1000)).collect()}
    assert {d: tuple(r)[1:7] for d, r in found.items()} == {d: brute_rules(t) for d, t in rows}
    assert all(not r.kept for r in found.values() if r.base_failed)
    symbols, cells = found[70], found[71]
    assert symbols.char_distance > 0.3 and cells.word_distance > 0.4 and not symbols.kept and not cells.kept
    assert all(found[d].kept and found[d].char_distance < 0.15 for d in range(60))


def test_distance_is_that_of_the_counts():
    r = np.random.default_rng(1)
    p, q = r.integers(0, 9, (20, 6)).astype(float), r.integers(0, 9, 6).astype(float)
    for row, got in zip(p, rules.distance(p, q)):
        a, b = row / row.sum(), q / q.sum()
        m = (a + b) / 2
        kl = [sum(x * math.log2(x / y) for x, y in zip(z, m) if x > 0) for z in (a, b)]
        assert got == pytest.approx(math.sqrt(sum(kl) / 2))
    assert rules.distance(np.zeros((1, 3)), np.ones(3)).tolist() == [0.0]
    assert rules.distance(np.array([[1.0, 0]]), np.array([0, 5.0])).tolist() == [1.0]


def test_languages_beyond_the_bound_share_a_reference(spark):
    rows = spark.createDataFrame([(k, " ".join(words(k, 400)), f"l{k % 4}") for k in range(24)], "doc_id long, text string, lang string")
    known = rules.references(rows, rules.Limits(languages=2, reference_words=500))
    assert len(known) == 3 and None in known and all(r is not None and len(r.word_counts) == len(r.words) + 1 for r in known.values())
    assert sum(r.word_counts.sum() for r in known.values()) == sum(
        len(re.findall(rb"[^\x00-\x60\x7B-\x7F]+", r.text.encode().translate(LOW))) for r in rows.collect())


def test_rules_of_short_references_and_empty_table(spark):
    rows = frame(spark, [(None, "too short"), (None, "too short"), (3, " ".join(words(1, 300)))])
    found = sorted(map(tuple, rules.judge(rows).collect()), key=str)
    assert found[0][0] == 3 and found[0][7:] == (None, None, True) and found[1] == found[2]
    assert rules.judge(rows.where("false")).collect() == []


def features(text):
    found = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOW))
    return len(found), [zlib.crc32(f) % 10000 for f in [*found, *(a + b" " + b for a, b in zip(found, found[1:]))]]


def brute_draw(rows, target, percent=25):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10000) / ((s[b] + 1) * (sum(t.values()) + 10000)))) for b in s}
    out = []
    for doc, text in rows:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((n >= 20, doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    drawn = order[: len(order) * percent // 100]
    return sorted(([*r[1:], n] for n, r in enumerate(drawn, 1)), key=str), sorted(
        ([*r[1:], None] for r in [*order[len(drawn):], *(r for r in out if not r[0])]), key=str)


@pytest.mark.parametrize("few, percent", [(1 << 16, 25), (1, 25), (2, 60), (1, 100), (1, 0)])
def test_draw(spark, few, percent):
    body = texts() + ["\u00e9\u00df" * 40 + " " + "A" * 90 + " tail " + " ".join(words(5, 30))]
    rows = list(enumerate(body)) + [(None, body[1]), (None, body[1]), (3, body[3]), (3, body[3]), (3, body[4])] + [(500, body[8])] * 9
    target = [" ".join(words(k, 30)) for k in range(5)] + [None, ""]
    found = resampling.draw(frame(spark, rows), frame(spark, list(enumerate(target))), few=few, percent=percent).collect()
    drawn, left = brute_draw(rows, target, percent)
    assert sorted((list(r) for r in found if r.rank), key=str) == drawn and sorted((list(r) for r in found if not r.rank), key=str) == left


def test_draw_from_empty_tables(spark):
    rows = frame(spark, [(1, " ".join(words(1, 30)))] + [(k, None) for k in range(2, 9)])
    assert [r.rank for r in resampling.draw(rows, rows.where("false"), percent=100).collect() if r.n_features] == [1]
    assert resampling.draw(rows.where("false"), rows).collect() == []


def test_cutoff_settles_ties_exactly(spark):
    keys = spark.createDataFrame([(k // 50, 0, 0, 0) for k in range(400)], "down long, void long, id long, n long").repartition(5)
    for wanted in (1, 50, 51, 175, 400):
        assert resampling.cutoff(keys, wanted, few=1) == (((wanted - 1) // 50, 0, 0, 0), (wanted - 1) % 50 + 1)
