"""Chunks, ranking, fusion, reading, ad-hoc SQL and attachments."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.operators import media as M
from parley.operators import ordered, retrieval as R
from parley.operators.transcript import read_window, session_excerpts
from parley.plans import adhoc

AT = dt.datetime(2024, 1, 1, 10, 0)
CONTENT = "archive_id int, msg_id long, session_id long, ts timestamp_ntz, sender string, msg_type string, content string"


def content(spark, rows):
    return spark.createDataFrame([(0, i, s, AT + dt.timedelta(minutes=i), who, kind, text) for i, (s, who, kind, text) in enumerate(rows)], CONTENT)


def windows(n, size=25, overlap=5):
    step, out = size - overlap, []
    for start in range(0, n, step):
        w = list(range(n))[start:start + size]
        if start > 0 and len(w) <= overlap:
            break
        out.append((w[0], w[-1]))
    return out


def test_chunks_match_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 50)
    rows, want, first = [], set(), 0
    for session, n in enumerate([1, 5, 20, 24, 25, 26, 30, 45, 46, 65, 66, 129]):
        rows += [(session, f"P{i % 3}", "text", f"t{i}") for i in range(n)]
        want |= {(session, first + a, first + b) for a, b in windows(n)}
        first += n
    got = R.chunk_table(R.build_chunks(content(spark, rows))).orderBy("chunk_id").collect()
    assert {(r.session_id, r.start_msg_id, r.end_msg_id) for r in got} == want
    assert [r.chunk_id for r in got] == list(range(len(got)))


def test_chunk_text(spark):
    rows = [(1, "A", "text", "hi"), (1, "B", "media", ""), (1, "B", "deleted", None), (1, "A", "text", "  ")]
    r = R.build_chunks(content(spark, rows)).first()
    assert r.body == "[Monday, 01 January 2024]\n10:00 A: hi\n10:01 B: (sent an attachment)\n10:02 B: (deleted a message)"
    assert r.participants == ["A", "B"] and r.n_messages == 4


BUSY = [(1, "A", "text", "one")] + [(1, "A", "media", "[image sent]")] * 40 + [(1, "B", "text", "two")] + [(1, "B", "media", "[image sent]")] * 5 + \
       [(1, "B", "text", "")] + [(1, "B", "media", "[image sent]")] * 5 + [(1, "A", "text", "three")]


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_busy_day(spark, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    r = read_window(content(spark, BUSY)).first()
    assert (r.message_count, r.messages_with_text, r.attachments, r.empty_messages, r.truncated) == (54, 3, 50, 1, False)
    assert r.transcript.split("\n") == ["[Monday, 01 January 2024]", "10:00 A: one", "10:01 A: (40 attachments)", "10:41 B: two",
                                        "10:42 B: (10 attachments)", "10:53 A: three"]


@pytest.mark.parametrize("limit", [10, 57, 58, 59, 60, 61, 80, 200])
def test_window_tail(spark, limit):
    c = content(spark, [(1, "A", "text", f"word {i}") for i in range(8)])
    full = "[Monday, 01 January 2024]\n" + "\n".join(f"10:0{i} A: word {i}" for i in range(8))
    want = full if len(full) <= limit else "[earlier messages omitted]\n" + full[-limit:]
    assert read_window(c, limit=limit).first().transcript == want


def test_long_excerpt(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    c = content(spark, [(1, "A", "text", f"w{i}") for i in range(30)] + [(2, "B", "text", "x")])
    got = {r.session_id: r.excerpt.split("\n") for r in session_excerpts(c, c).collect()}
    assert len(got[1]) == 25 and got[1][12] == "... 6 more messages ..." and got[1][11].endswith("w11") and got[1][13].endswith("w18")
    assert got[2] == ["10:30 B: x"]


def test_bm25_against_the_formula(spark):
    texts = ["red fox red", "blue fox", "", "green", "red 42 नमस्ते"]
    docs = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "archive_id int, doc_id long, content string")
    got = {r.doc_id: r.score for r in R.bm25_scores(R.build_postings(docs), R.index_stats(docs), "Red, नमस्ते!").collect()}
    bags = {i: t.split() for i, t in enumerate(texts) if t}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)

    def score(bag):
        total = 0.0
        for term in ("red", "नमस्ते"):
            df, tf = sum(term in b for b in bags.values()), bag.count(term)
            if tf:
                total += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / avg))
        return total

    assert set(got) == {0, 4}
    assert got[0] == pytest.approx(score(bags[0]))


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(50, 8)).astype("float32")
    rows = [(0, i, [float(x) for x in v], AT, AT, ["Ann"] if i % 2 else ["Bob"]) for i, v in enumerate(vecs)] + [(0, 99, [1.0], AT, AT, ["Ann"]), (0, 98, [0.0] * 8, AT, AT, ["Ann"])]
    df = spark.createDataFrame(rows, "archive_id int, chunk_id long, embedding array<float>, start_ts timestamp_ntz, end_ts timestamp_ntz, participants array<string>")
    q = [float(x) for x in vecs[3]]
    sims = vecs.astype("float64") @ vecs[3].astype("float64") / (np.linalg.norm(vecs.astype("float64"), axis=1) * np.linalg.norm(vecs[3].astype("float64")))
    want = [int(i) for i in np.argsort(-sims) if i % 2][:5]
    got = R.vector_search(df, q, 5, participant="ann", after="2024-01-01", before="2024-01-01").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == want and got[0].score == pytest.approx(1.0)
    assert R.vector_search(df, q, 5, after="2024-01-02").count() == 0


def test_embed_once_per_text(spark):
    chunks = spark.createDataFrame([(0, 0, "h1", "red fox"), (0, 1, "h1", "red fox"), (1, 0, "h2", "blue"), (1, 1, "h3", "green")], "archive_id int, chunk_id long, body_hash string, body string")
    have = spark.createDataFrame([(1, 1, [1.0])], "archive_id int, chunk_id long, embedding array<float>")
    cache = spark.createDataFrame([("h2", [9.0])], "body_hash string, embedding array<float>")
    vectors, fresh = R.embed_missing(chunks, have, cache, R.hash_embedding)
    got = {(r.archive_id, r.chunk_id): r.embedding for r in vectors.collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0)} and got[1, 0] == [9.0] and got[0, 0] == got[0, 1] and len(got[0, 0]) == 64
    assert [r.body_hash for r in fresh.collect()] == ["h1"]


def test_answers_are_asked_once_and_resumed(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    chunks = spark.createDataFrame([(0, i, f"h{i}", f"text {i}") for i in range(5)], "archive_id int, chunk_id long, body_hash string, body string")
    have = chunks.limit(0).select("archive_id", "chunk_id")
    cache = spark.createDataFrame([], "body_hash string, embedding array<float>")

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    def moody(texts):
        if "text 3" in texts:
            raise RuntimeError("busy")
        return [[1.0] for _ in texts]

    vectors, fresh = R.embed_missing(chunks, have, cache, embed)
    assert vectors.count() == 5 and fresh.count() == 5 and calls.value == 5
    path = str(tmp_path / "answers")
    vectors, fresh = R.embed_missing(chunks, have, cache, moody, path=path)
    assert {r.body_hash for r in fresh.collect()} == {"h0", "h1", "h2", "h4"} == {f"h{r.chunk_id}" for r in vectors.collect()}
    errors = spark.read.parquet(path).where("error IS NOT NULL").collect()
    assert [(r.body_hash, r.error) for r in errors] == [("h3", "RuntimeError: busy")]
    calls.value = 0
    vectors, _ = R.embed_missing(chunks, have, cache, embed, path=path)
    assert calls.value == 1 and {r.chunk_id: r.embedding for r in vectors.collect()} == {0: [1.0], 1: [1.0], 2: [1.0], 3: [6.0], 4: [1.0]}


def test_a_broken_round_keeps_the_rounds_before(spark, tmp_path):
    from parley.operators.answers import remember

    work = spark.range(40).selectExpr("CAST(id AS STRING) AS k")
    path, seen = str(tmp_path / "answers"), []

    def ask(rows):
        out = rows.selectExpr("k", "k AS said", "CAST(NULL AS STRING) AS error")
        seen.append(rows)
        if len(seen) == 4:  # the first call only tells the schema
            raise RuntimeError("lost")
        return out

    with pytest.raises(RuntimeError):
        remember(work, "k", ask, path, round_rows=10)
    done = spark.read.parquet(path).count()
    assert 0 < done < 40
    seen.extend([None] * 9)
    told = remember(work, "k", ask, path, round_rows=10)
    assert told.count() == 40 and spark.read.parquet(path).count() == 40


def test_hybrid_reinforces_and_interleaves(spark):
    c = content(spark, [(s, "A", "text", t) for s, t in enumerate(["red fox", "blue whale", "green tree", "red whale"])])
    docs = c.select("archive_id", F.col("msg_id").alias("doc_id"), "content")
    postings, stats = R.build_postings(docs), R.index_stats(docs)
    chunks = R.chunk_table(R.build_chunks(c))
    vectors, _ = R.embed_missing(chunks, chunks.limit(0).select("archive_id", "chunk_id"),
                                 chunks.limit(0).select("body_hash", F.array(F.lit(0.0).cast("float")).alias("embedding")), R.hash_embedding)
    both = dict(chunks=chunks, vectors=vectors, embed=R.hash_embedding)
    fused = R.search_chat(c, postings, stats, "green tree", 4, **both).orderBy("rank").collect()
    assert fused[0].key == "2" and fused[0].source == "semantic" and fused[0].fusion_score == pytest.approx(2 / 61)
    plain = R.search_chat(c, postings, stats, "green tree", 4, interleave=True, **both).orderBy("rank").collect()
    assert [r.key for r in plain][:2] == ["2", "m2"]
    assert R.search_chat(c, postings, stats, " ", participant="a").first().message_count == 4
    with pytest.raises(ValueError):
        R.search_chat(c, postings, stats, "")


def test_search_tells_what_it_found_and_falls_back(spark):
    rows = [(0, i, i // 4, AT + dt.timedelta(days=i), "Ann" if i % 2 else "Bob", "text", f"line {i} " + ("Zebra" if i in (2, 9) else "horse")) for i in range(12)]
    rows += [(1, i, 0, AT + dt.timedelta(days=i), "Cy", "text", f"nothing {i}") for i in range(3)] + [(2, 0, 0, AT - dt.timedelta(days=9), "Di", "text", "zebra")]
    c = spark.createDataFrame(rows, CONTENT)
    docs = c.select("archive_id", F.col("msg_id").alias("doc_id"), "content")
    postings, stats = R.build_postings(docs), R.index_stats(docs)
    ranked = R.search_chat(c, postings, stats, "zebra", 5).collect()
    assert {(r.archive_id, r.key) for r in ranked} == {(0, "m2"), (0, "m9"), (2, "m0")} and {r.note for r in ranked} == {None}
    first = next(r for r in ranked if r.key == "m2")
    assert first.text == "03 Jan 2024 10:00 Bob: line 2 Zebra" and first.participants == ["Bob"] and first.start_ts == first.end_ts == AT + dt.timedelta(days=2)
    plain = R.search_chat(c, None, None, "ZEBRA").orderBy("archive_id", "rank").collect()
    assert [(r.archive_id, r.key, r.rank) for r in plain] == [(0, "m9", 1), (0, "m2", 2), (2, "m0", 1)]
    for index in ((postings, stats), (None, None)):
        ranged = {(r.archive_id, r.key): r for r in R.search_chat(c, *index, "zebra", after="2024-01-01", before="2024-01-05").collect()}
        assert set(ranged) == {(0, "m2"), (1, "window")}  # the third chat has nothing in those days
        told = ranged[1, "window"]
        assert told.text.endswith("10:00 Cy: nothing 0\n10:00 Cy: nothing 1\n10:00 Cy: nothing 2") and "zebra" in told.note and told.participants == ["Cy"]
    assert R.search_chat(c, postings, stats, "giraffe").count() == 0
    assert R.search_chat(c.where("false"), None, None, "zebra", after="2024-01-01").count() == 0


@pytest.mark.parametrize("block, most", [(4096, 1000), (3, 1000), (3, 0)])
def test_messages_find_their_chunk(spark, monkeypatch, block, most):
    monkeypatch.setattr(R, "SPAN_IDS", block)
    monkeypatch.setattr(R, "SPAN_BLOCKS", most)
    c = content(spark, [(i // 40, "A", "text" if i % 9 else "system", f"t{i}") for i in range(90)])
    chunks = R.chunk_table(R.build_chunks(c, 7, 2))
    hits = c.select("archive_id", "msg_id", (F.col("msg_id") + 1).alias("rank"))
    held = [(r.chunk_id, r.start_msg_id, r.end_msg_id) for r in chunks.collect()]
    want = {m: min((i for i, a, b in held if a <= m <= b), default=None) for m in range(90)}
    assert {r.msg_id: r.chunk_id for r in R.chunk_of_message(hits, R.chunk_spans(chunks)).collect()} == want and None in want.values()


def test_run_sql(spark):
    rows = spark.createDataFrame([(0, i, AT, "p", "text", None, "it's; a 'drop'") for i in range(600)] + [(1, 0, AT, "q", "text", None, "other")],
                                 "archive_id int, msg_id long, ts timestamp_ntz, participant_id string, msg_type string, gap_seconds double, text string")
    spark.range(3).createOrReplaceTempView("hidden_view")
    base, spark = spark, adhoc.publish(spark, 0, {"messages": rows})
    other = adhoc.publish(base, 1, {"messages": rows})
    assert adhoc.run_sql(other, "SELECT text FROM messages").collect()[0].text == "other"
    assert other.conf.get("spark.sql.session.timeZone") == "UTC" and not base.catalog.tableExists("messages")
    capped = adhoc.run_sql(spark, "SELECT * FROM messages LIMIT 1000")
    assert capped.count() == 500 and capped.select("truncated").distinct().first().truncated
    few = adhoc.run_sql(spark, "SELECT msg_id FROM messages ORDER BY msg_id DESC LIMIT 3").collect()
    assert [r.truncated for r in few] == [False] * 3 and few[0].msg_id > few[2].msg_id
    for text in ("SELECT hidden_view.id FROM hidden_view AS hidden_view WHERE 'with hidden_view as (' <> ''",
                 "SELECT * FROM (WITH hidden_view AS (SELECT 1 AS id) SELECT * FROM hidden_view) a JOIN hidden_view USING (id)",
                 "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "SELECT (SELECT max(id) FROM hidden_view)"):
        with pytest.raises(PermissionError):
            adhoc.run_sql(spark, text)
    assert adhoc.run_sql(spark, "WITH hidden_view AS (SELECT 5 AS id), z AS (SELECT * FROM Hidden_View) SELECT id FROM z").first().id == 5
    assert adhoc.run_sql(spark, "SELECT count(*) FROM messages WHERE text LIKE '%drop%' AND text LIKE '%;%'").first()[0] == 600
    assert adhoc.run_sql(spark, "WITH x AS (SELECT archive_id FROM messages) SELECT max(archive_id) m FROM x").first().m == 0
    assert adhoc.run_sql(spark, "SELECT count(*) FROM sessions_at(2.0D)").first()[0] == 600
    told = adhoc.run_sql(spark, "SELECT upper(text) || '!' t, if(msg_id > 1, 1, 0) i, row_number() OVER (ORDER BY ts) r, filter(array(1, 2), x -> x > 1) f, "
                                "date_format(ts, 'HH') h, CAST(msg_id AS STRING) s FROM messages WHERE msg_id IN (2, 3) ORDER BY r").first()
    assert (told.t, told.i, told.r, told.f, told.h, told.s) == ("IT'S; A 'DROP'!", 1, 1, [2], "10", "2")


def test_run_sql_gives_all_rows(spark, tmp_path):
    rows = spark.range(700).selectExpr("0 AS archive_id", "id AS msg_id")
    whole = adhoc.run_sql(adhoc.publish(spark, 0, {"v_messages": rows}), "SELECT msg_id FROM v_messages", max_rows=None)
    assert whole.count() == 700 and not whole.where("truncated").count()
    # the registered query, over a chat of 600 people
    spark.sql("""SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts, id * 10 + 4 AS user_id, 'view' AS event_type,
        1.0D AS value, '{"k": 1}' AS props FROM range(600)""").write.parquet(str(tmp_path / "events.parquet"))
    import __spark_entry__ as entry

    got = entry.queries()["run_sql"](spark, str(tmp_path))
    assert got.count() == 600 and got.where("started > 0").count() == 1 and not got.where("truncated").count()


def test_functions_are_allowed_by_name(spark):
    spark.udf.register("leak", lambda: "x")
    for text in ("SELECT leak()", "SELECT current_user()", "SELECT input_file_name()", "SELECT spark_partition_id()", "SELECT no_such_function(1)",
                 "SELECT sum(1) FILTER (WHERE version() = '')", "SELECT transform(array(1), x -> java_method('a', 'b'))", "SELECT default.upper('x')"):
        with pytest.raises(PermissionError):
            adhoc.run_sql(spark, text)


@pytest.mark.parametrize("query", [
    "", "DROP TABLE messages", "SELECT 1; SELECT 2", "INSERT INTO messages SELECT * FROM messages", "SHOW TABLES", "EXPLAIN SELECT 1",
    "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM secrets", "SELECT * FROM default.messages",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT (SELECT max(x) FROM secrets) FROM messages",
    "WITH messages2 AS (SELECT * FROM parquet.`/x`) SELECT * FROM messages2", "SET spark.x = 1", "CREATE VIEW v AS SELECT 1",
    "SELECT * FROM messages WHERE msg_id IN (SELECT java_method('a', 'b') FROM messages)",
    "SELECT secrets.x FROM (SELECT 1 AS secrets) a, secrets",
])
def test_run_sql_refuses(spark, query):
    from pyspark.errors import ParseException

    with pytest.raises((PermissionError, ParseException, Exception)) as e:
        adhoc.run_sql(spark, query)
    assert isinstance(e.value, (PermissionError, ParseException)) or "Parse" in type(e.value).__name__ or "PARSE" in str(e.value)


@pytest.mark.parametrize("name,kind", [
    ("IMG-20230812-WA0001.jpg", "image"), ("img-1.webp", "sticker"), ("PTT-1.opus", "voice"), ("0042-AUDIO-2023.opus", "voice"), ("song.mp3", "audio"),
    ("x/GIF-1.mp4", "video"), ("a.VCF", "contact"), ("noext", "other"), (".jpg", "other"), ("a.tar.gz", "other"), ("plain.webp", "image"),
])
def test_classify(spark, name, kind):
    assert spark.createDataFrame([(name,)], "p string").select(M.classify_media("p")).first()[0] == kind


def files(spark, *paths):
    df = spark.createDataFrame([(0, p, 10, f"h-{p.lower()}") for p in paths], "archive_id int, path string, size_bytes long, content_hash string")
    return M.catalog_columns(df)


@pytest.mark.parametrize("reference,path,tier", [
    ("a.jpg", "y/a.jpg", 1), ("old/a.jpg", "y/a.jpg", 2), ("B.JPG", "z/b.jpg", 3), ("v.opus", "m/v.ogg", 4), ("none.jpg", None, None),
])
def test_resolve(spark, reference, path, tier):
    refs = spark.createDataFrame([(0, reference)], "archive_id int, reference string")
    r = M.resolve_attachments(refs, files(spark, "x/a.jpg", "y/a.jpg", "z/b.jpg", "m/v.ogg", "n/v.wav")).first()
    assert (r and (r.path, r.tier)) == (path and (path, tier))


def test_describe_each_content_once(spark):
    calls = spark.sparkContext.accumulator(0)
    rows = [(0, i, i, f"f{i}.jpg", f"p{i}", "image", ".jpg", 10, h, True, "pending") for i, h in enumerate(["a", "a", "b", "c", "c"])]
    media = spark.createDataFrame(rows, "archive_id int, media_id long, msg_id long, filename string, path string, kind string, ext string, size_bytes long, content_hash string, readable boolean, status string")
    for c, t in (("description", "string"), ("transcript", "string"), ("ocr_text", "string"), ("detected_objects", "array<string>"), ("error", "string"), ("model_used", "string")):
        media = media.withColumn(c, F.lit(None).cast(t))
    cache = spark.createDataFrame([("a", "known", None, None, None, "m")], "content_hash string, description string, transcript string, ocr_text string, detected_objects array<string>, model_used string")

    def describe(pdf):
        calls.add(len(pdf))
        bad = pdf["content_hash"] == "c"
        return pd.DataFrame({"description": [None if b else "new" for b in bad], "transcript": None, "ocr_text": None, "detected_objects": None,
                             "status": ["error" if b else "done" for b in bad], "error": ["boom" if b else None for b in bad], "model_used": "m"})

    told, fresh = M.enrich_media(media, cache, describe)
    got = {r.media_id: (r.description, r.status, r.error) for r in told.collect()}
    assert calls.value == 2
    assert got == {0: ("known", "done", None), 1: ("known", "done", None), 2: ("new", "done", None), 3: (None, "error", "boom"), 4: (None, "error", "boom")}
    assert [r.content_hash for r in fresh.collect()] == ["b"]


def test_one_bad_file_does_not_end_the_job(spark):
    files = spark.createDataFrame([(h,) for h in "abc"], "content_hash string").coalesce(1)

    def describe(pdf):
        if (pdf["content_hash"] == "b").any():
            raise ValueError("no picture")
        return pd.DataFrame({"description": pdf["content_hash"], "transcript": None, "ocr_text": None, "detected_objects": None,
                             "status": "done", "error": None, "model_used": "m"})

    got = {r.content_hash: (r.description, r.status, r.error) for r in M.describe_files(files, describe).collect()}
    assert got == {"a": ("a", "done", None), "b": (None, "error", "ValueError: no picture"), "c": ("c", "done", None)}


def test_moments_need_a_known_kind(spark):
    from parley.plans.insights import find_moments

    with pytest.raises(ValueError):
        find_moments("odd", None, None)
