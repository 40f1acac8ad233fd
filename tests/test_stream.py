"""Ordered scans, sessions and medians against plain Python."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from parley.operators import ordered, quantile, sessions, skew
from parley.schema import RAW_MESSAGE


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_MESSAGE)


def messages(n, seed, archives=2, people=4, same_minute=False):
    rnd = random.Random(seed)
    at, out = dt.datetime(2024, 1, 1), []
    for i in range(n):
        if not same_minute:
            at += dt.timedelta(seconds=rnd.choice([0, 0, 5, 600, 14400, 14401, 40000]))
        kind = rnd.choice(["text", "text", "media", "deleted", "system"])
        out.append((rnd.randrange(archives), i + 1, at, None if kind == "system" else f"P{rnd.randrange(people)}", rnd.choice(["ok", "why"]), kind, None))
    rnd.shuffle(out)
    return out


def brute(rows, gap_hours):
    out = {}
    for archive in {r[0] for r in rows}:
        stream = sorted((r for r in rows if r[0] == archive and r[5] != "system"), key=lambda r: (r[2], r[1]))
        before, session = None, 0
        for i, r in enumerate(stream):
            gap = None if before is None else (r[2] - before[2]).total_seconds()
            start = gap is None or gap > gap_hours * 3600
            session += start
            reply = gap if not start and before[3] != r[3] else None
            out[archive, r[1]] = (i, session, start, gap, None if before is None else f"name:{before[3].lower()}", reply)
            before = r
    return out


@pytest.mark.parametrize("n,slice_rows,same_minute", [(300, 1_000_000, False), (300, 10, False), (200, 10, True), (1, 10, False)])
def test_enrich_matches_a_plain_loop(spark, n, slice_rows, same_minute):
    rows = messages(n, n + slice_rows, same_minute=same_minute)
    got = sessions.enrich(raw(spark, rows), slice_rows=slice_rows).collect()
    want = brute(rows, 4.0)
    assert {(r.archive_id, r.line_no): (r.msg_id, r.session_id, r.is_session_start, r.gap_seconds, r.prev_participant_id, r.reply_gap_seconds) for r in got} == want
    assert len({(r.archive_id, r.dedup_key) for r in got}) == len(got)


def test_hot_hour_is_cut_and_order_stays_exact(spark):
    rows = messages(2000, 5, archives=1, same_minute=True)
    sliced, keys, cut = ordered.with_time_slices(raw(spark, rows), ["archive_id"], rows=100)
    assert cut
    sizes = [r["count"] for r in sliced.groupBy(*keys).count().collect()]
    assert len(sizes) > 5 and max(sizes) < 500
    ids = {r.line_no: r.msg_id for r in sessions.order_messages(raw(spark, rows), slice_rows=100).collect()}
    assert ids == {line: i for i, line in enumerate(sorted(ids))}


def test_gap_equal_to_the_threshold_stays_together(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(0, 1, at, "A", "x", "text", None), (0, 2, at + dt.timedelta(hours=4), "B", "x", "text", None),
            (0, 3, at + dt.timedelta(hours=8, seconds=1), "B", "x", "text", None)]
    got = sessions.enrich(raw(spark, rows)).orderBy("msg_id").collect()
    assert [r.session_id for r in got] == [1, 1, 2]
    assert [r.reply_gap_seconds for r in got] == [None, 14400.0, None]


def test_sessions_at_after_ingest(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    rows = messages(200, 9)
    stored = sessions.enrich(raw(spark, rows))
    again = {(r.archive_id, r.msg_id): r.session_no for r in sessions.sessions_at(stored, 1.0).collect()}
    fresh = {(r.archive_id, r.msg_id): r.session_id for r in sessions.enrich(raw(spark, rows), 1.0).collect()}
    assert again == fresh


@pytest.mark.parametrize("seed", range(3))
def test_median(spark, seed):
    rnd = random.Random(seed)
    data = [(k, rnd.choice([0.0, 0.25, 1.5, 1.75, rnd.random() * 100])) for k in range(6) for _ in range(rnd.randrange(1, 40))]
    df = spark.createDataFrame(data, "k int, v double")
    got = {r.k: r.m for r in quantile.exact_median(df, ["k"], "v", "m").collect()}
    want = {k: statistics.median([v for q, v in data if q == k]) for k in {q for q, _ in data}}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_joins_equal_plain_joins(spark, how):
    left = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20).alias("k"))
    right = spark.createDataFrame([(1, "a"), (2, "b"), (7, "c")], "k long, v string")
    want = sorted(map(tuple, left.join(right, "k", how).select(*([c for c in ("id", "k", "v") if c != "v" or how in ("inner", "left")])).collect()))
    for fn in (lambda: skew.skew_join(left, right, ["k"], ["id"], how, heavy_rows=10), lambda: skew.spread_join(left, right, ["k"], ["id"], how, salts=4)):
        got = fn().select(*([c for c in ("id", "k", "v") if c != "v" or how in ("inner", "left")]))
        assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("max_rows", [1, 100])
def test_checked_broadcast_changes_no_rows(spark, max_rows):
    hits = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "k long, v string")
    big = spark.range(8).withColumnRenamed("id", "k")
    got = skew.checked_broadcast(hits, max_rows).join(big, "k").collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (2, "y")]


def test_worker_functions_travel_with_the_task():
    from pyspark.cloudpickle import cloudpickle

    import parley

    assert parley.__name__ in cloudpickle.list_registry_pickle_by_value()


def test_load_spreads_by_size(spark, monkeypatch):
    """Adaptive merging does not put more into a task than its share."""
    monkeypatch.setattr(skew, "TASK_BYTES", 4096)
    raw = spark.range(400).selectExpr("CAST(id % 2 AS INT) AS archive_id", "id AS line_no", "CAST(timestamp_seconds(1704067200 + id * 3600) AS TIMESTAMP_NTZ) AS ts",
                                      "'a' AS sender", "'text' AS msg_type", "repeat('x', 100) AS text", "CAST(NULL AS STRING) AS attachment")
    got = sessions.enrich(raw)
    assert got.count() == 400 and got.groupBy(F.spark_partition_id()).count().count() > 10
    assert sorted(r.msg_id for r in got.collect()) == sorted([*range(200)] * 2)
