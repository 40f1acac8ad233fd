"""The blocked index and its ranked search against the flat index and plain counting."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import blocks as X
from parley.operators import retrieval as R

AT = dt.datetime(2024, 1, 1, 10, 0)
SCHEMA = "archive_id int, msg_id long, ts timestamp_ntz, sender string, msg_type string, content string"


@pytest.fixture(scope="module")
def chat(spark):
    """One archive holds most rows. A common word is everywhere; few messages repeat it or are short."""
    rng, rows = random.Random(5), []
    for archive, n in ((0, 900), (1, 70), (2, 3)):
        for i in range(n):
            words = ["tree"] * (6 if i % 211 == 7 else 1) + rng.choices("red green blue lake hill".split(), k=rng.randint(3, 30))
            rows.append((archive, i, AT + dt.timedelta(minutes=i), f"p{i % 4}", "text", None if i % 97 == 5 else "" if i % 97 == 6 else " ".join(words)))
    rows.append((3, 0, AT, "p0", "text", "?! ..."))  # characters, but no word
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def stored(chat):
    docs = chat.select("archive_id", F.col("msg_id").alias("doc_id"), "content")
    return X.build_blocks(docs, 16).cache(), R.index_stats(docs).cache(), R.build_postings(docs).cache()


def test_blocks_hold_every_posting_once_in_order(chat, stored):
    want = {}
    for r in chat.collect():
        bag = [w for w in (r.content or "").split() if w.isalpha()]
        for term in set(bag):
            want.setdefault((r.archive_id, term, r.msg_id // 16), []).append((r.msg_id % 16, bag.count(term), len(bag)))
    got = {(r.archive_id, r.term, r.doc_block): r for r in stored[0].collect()}
    assert got.keys() == want.keys()
    for key, postings in want.items():
        r, postings = got[key], sorted(postings)
        assert list(zip(r.places, r.tf, r.dl)) == postings and r.n == len(postings)
        assert r.max_tf == max(p[1] for p in postings) and r.min_share == min(p[2] / p[1] for p in postings)


@pytest.mark.parametrize("query", ["tree", "tree lake", "Red GREEN blue", "absent", "tree absent", "?!"])
@pytest.mark.parametrize("k", [1, 5])
def test_ranking_is_that_of_the_flat_index(chat, stored, query, k):
    index, stats, postings = stored
    got = X.bm25_top(chat, index, stats, query, k, block_ids=16)
    want = R.bm25_search(chat, postings, stats, query, k)
    columns = ["archive_id", "msg_id", "sender", "rank", F.round("score", 9), "content"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


@pytest.mark.parametrize("how", [{"participant": "P1"}, {"after": "2024-01-01T20:00"}, {"participant": "nobody"}])
def test_filters_come_before_the_kth_score(chat, stored, how):
    index, stats, postings = stored
    columns = ["archive_id", "msg_id", "rank", F.round("score", 9)]
    got = X.bm25_top(chat, index, stats, "tree lake", 4, block_ids=16, **how).select(columns).collect()
    assert sorted(got) == sorted(R.bm25_search(chat, postings, stats, "tree lake", 4, **how).select(columns).collect())


def test_ties_and_many_hits(spark, chat, stored, monkeypatch):
    same = spark.createDataFrame([(0, i, "red") for i in range(100)], "archive_id int, doc_id long, content string")
    ranking = X.rank_blocks(X.build_blocks(same, 16), R.index_stats(same), "red", 3, block_ids=16)
    assert [r.doc_id for r in R._top(ranking.scores, 3, F.desc(F.round("score", 9)), F.asc("doc_id")).orderBy("rank").collect()] == [0, 1, 2]
    monkeypatch.setattr(X, "NAMED", 1)  # too many to be named: the joins alone
    index, stats, postings = stored
    got = X.bm25_top(chat, index, stats, "tree", 5, block_ids=16).select("archive_id", "msg_id").collect()
    assert sorted(got) == sorted(R.bm25_search(chat, postings, stats, "tree", 5).select("archive_id", "msg_id").collect())


def test_a_frequent_word_opens_few_blocks(stored):
    index, stats, _ = stored
    read = {r.archive_id: r for r in X.blocks_read(X.rank_blocks(index, stats, "tree", 4, block_ids=16).ranges).collect()}
    assert read[0].ranges == 57 and read[0].first == 4 and read[0].late <= 6
    assert read[2].ranges == read[2].first == 1


def test_empty_index(spark, chat):
    none = chat.select("archive_id", F.col("msg_id").alias("doc_id"), "content").where("false")
    assert X.bm25_top(chat, X.build_blocks(none), R.index_stats(none), "tree").count() == 0


def test_one_shuffle_builds_and_heads_are_read_alone(spark, stored, tmp_path):
    fresh = spark.range(50).selectExpr("CAST(id % 3 AS INT) AS archive_id", "id AS doc_id", "concat('red ', id) AS content")
    plan = X.build_blocks(fresh, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning") == 1
    stored[0].write.parquet(f"{tmp_path}/index")
    heads = spark.read.parquet(f"{tmp_path}/index").where("term = 'tree'").groupBy("term").agg(F.sum("n"))
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<term:string,n:int>" in plan and "EqualTo(term,tree)" in plan


def test_indexes_move_texts_not_postings(spark):
    """Terms are counted within their row: one shuffle, of the texts, also where the archive is a constant."""
    docs = spark.range(300).selectExpr("0 AS archive_id", "id AS doc_id", "concat('red red blue w', id % 7) AS content")
    for index in (R.build_postings(docs), X.build_blocks(docs)):
        plan = index._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Generate" in plan.split("Exchange")[0]
    uses = {(r.term, r.doc_id): r.tf for r in R.build_postings(docs).where("doc_id < 9").collect()}
    assert uses["red", 8] == 2 and uses["blue", 8] == 1 and uses["w1", 8] == 1 and len(uses) == 27
    blank = spark.createDataFrame([(0, 1, ""), (0, 2, None), (0, 3, "?!"), (0, 4, "x")], "archive_id int, doc_id long, content string")
    assert [tuple(r) for r in R.build_postings(blank).collect()] == [(0, "x", 4, 1, 1)]
