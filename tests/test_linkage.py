"""People and message identity."""

import datetime as dt

import pytest

from parley.operators import linkage as L
from parley.schema import RAW_MESSAGE

AT = dt.datetime(2024, 1, 1, 10, 0)


def raw(spark, rows):
    """(minute, sender, text, type, attachment) rows of archive 0."""
    return spark.createDataFrame([(0, i + 1, AT + dt.timedelta(minutes=m), *r) for i, (m, *r) in enumerate(rows)], RAW_MESSAGE)


@pytest.mark.parametrize("name,key", [
    ("+91 98765 43210", "phone:9876543210"), ("+919876543210", "phone:9876543210"), ("98765-43210", "phone:9876543210"),
    ("~ (987) 654 3210", "phone:9876543210"), ("123456", "name:123456"), ("+1-234", "name:+1-234"), ("Rohit  Sharma ", "name:rohit sharma"),
    ("~Rohit", "name:rohit"), ("~  Rohit\tS", "name:rohit s"), ("ÀÉ", "name:àé"), ("1234567890123456789012", "name:1234567890123456789012"),
])
def test_canonical_key(spark, name, key):
    df = spark.createDataFrame([(name,)], "sender string")
    r = df.select(L.canonical_key("sender").alias("k"), L.is_phone_number("sender").alias("p")).first()
    assert (r.k, r.p) == (key, key.startswith("phone:"))


def test_participants_and_suggestions(spark):
    counts = spark.createDataFrame([(0, "+91 98765 43210", 3), (0, "9876543210", 2), (0, "Rohit", 1), (0, "rohit", 4), (0, "~Rohit Sharma", 5), (1, "Rohit Sharma", 1)],
                                   "archive_id int, sender string, n long")
    people = {(r.archive_id, r.participant_id): r for r in L.resolve_participants(counts).collect()}
    p = people[0, "phone:9876543210"]
    assert (p.display_name, p.message_count, p.is_phone_only, p.aliases) == ("+91 98765 43210", 5, True, ["+91 98765 43210", "9876543210"])
    assert people[0, "name:rohit"].display_name == "rohit" and people[0, "name:rohit sharma"].display_name == "Rohit Sharma"
    links = spark.createDataFrame([(0, "9876543210", "name:rohit")], "archive_id int, sender string, participant_id string")
    linked = {r.participant_id: r for r in L.resolve_participants(counts.where("archive_id = 0"), links).collect()}
    assert linked["name:rohit"].message_count == 7 and linked["name:rohit"].display_name == "rohit" and not linked["name:rohit"].is_phone_only
    pairs = L.suggest_merges(L.resolve_participants(counts)).collect()
    assert [(r.archive_id, r.short_name, r.long_name) for r in pairs] == [(0, "rohit", "Rohit Sharma")]


def keyed(df):
    return L.assign_keys(df, ["archive_id"])


def merged(old, new):
    got = L.merge_exports(keyed(old), keyed(new)).collect()
    return sorted((r.ts, r.dedup_key, r.text, r.attachment) for r in got), L.merge_counts(keyed(old), keyed(new)).first()


def test_reimport_is_idempotent(spark):
    rows = [(0, "A", "ok", "text", None), (0, "A", "ok", "text", None), (1, "B", "", "media", None)]
    got, n = merged(raw(spark, rows), raw(spark, rows))
    assert len(got) == 3 and (n.total, n.added, n.skipped, n.upgraded) == (3, 0, 3, 0)


def test_richer_version_wins_either_way(spark):
    bare, rich = [(0, "A", "", "media", None)], [(0, "A", "cap", "media", "IMG-1.jpg")]
    for old, new, upgraded in ((bare, rich, 1), (rich, bare, 0)):
        got, n = merged(raw(spark, old), raw(spark, new))
        assert [(g[2], g[3]) for g in got] == [("cap", "IMG-1.jpg")] and n.upgraded == upgraded and n.added == 0


def test_ties_keep_the_stored_version(spark):
    got, _ = merged(raw(spark, [(0, "A", "Ok  then", "text", None)]), raw(spark, [(0, "A", "ok THEN ", "text", None)]))
    assert [g[2] for g in got] == ["Ok  then"]


def test_overlap_gate(spark):
    old = raw(spark, [(0, f"P{i}", "x", "text", None) for i in range(9)])
    new = raw(spark, [(0, f"P{i}", "x", "text", None) for i in range(8, 20)])
    r = L.participant_overlap(old, new).first()
    assert r.overlap == pytest.approx(1 / 12) and r.refused
    subset = L.participant_overlap(old, raw(spark, [(0, "P1", "x", "text", None)])).first()
    assert subset.overlap == 1.0 and not subset.refused
    nobody = L.participant_overlap(old, raw(spark, [(0, None, "x", "system", None)])).first()
    assert nobody.overlap is None and not nobody.refused
