"""Search: windows of messages, an inverted index, vectors, and their fusion."""

import math
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import body_hash, display_date, strip, tokens
from parley.operators.answers import remember
from parley.operators.media import EMBED_BATCH
from parley.operators.ordered import block_of, dense_ids, totals_across
from parley.operators.skew import checked_broadcast, parts_of, skew_join, spread, spread_join
from parley.operators.transcript import read_window

# Fixed values.
CHUNK_SIZE, CHUNK_OVERLAP = 25, 5
TOP_K = 12
RRF_DAMPING = 60
K1, B = 1.2, 0.75
# Message ids in a block of the spans; blocks that are named to the scan.
SPAN_IDS = 4096
SPAN_BLOCKS = 1000
CONTEXT = 10
SILENT = {"media": "(sent an attachment)", "deleted": "(deleted a message)", "system": "(system notice)"}


# --- chunks ---------------------------------------------------------------------------


def build_chunks(content: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` messages inside a session, each repeating ``overlap`` of the last.

    A message is sent to the one or two windows that hold it, so a group has at most ``size``
    rows however long the session is. A later window with only repeated messages is dropped.
    """
    size = max(2, size)
    overlap = min(max(0, overlap), size - 1)
    step = size - overlap
    # Message ids are dense, so a position in the session is a difference of ids.
    rows = totals_across(
        content.where("msg_type <> 'system'").withColumn("_block", block_of("msg_id")),
        ["archive_id", "session_id"], ["_block"], {"_first": (F.min("msg_id"), F.min)})
    p = F.col("msg_id") - F.col("_first")
    lowest = F.greatest(F.lit(0), F.ceil((p - (size - 1)) / step))
    windows = rows.select(
        "archive_id", "session_id", "msg_id", "ts", "sender", "msg_type", "content",
        F.explode(F.sequence(lowest, F.floor(p / step))).alias("window"),
    )
    # windows of a bounded number of bytes meet in a task
    windows = windows.repartition(parts_of(content, "content"), "archive_id", "session_id", "window")
    text = strip(F.coalesce("content", F.lit("")))
    silent = None
    for kind, words in SILENT.items():
        silent = F.when(F.col("msg_type") == kind, words) if silent is None else silent.when(F.col("msg_type") == kind, words)
    said = F.when(text != "", text).otherwise(F.coalesce(silent, F.lit("")))
    line = F.concat(F.date_format("ts", "HH:mm"), F.lit(" "), "sender", F.lit(": "), "_said")
    held = F.sort_array(F.collect_list(F.when(F.col("_said") != "", F.struct("msg_id", line.alias("line")))))
    return (
        windows.withColumn("_said", said)
        .groupBy("archive_id", "session_id", "window").agg(
            F.min("msg_id").alias("start_msg_id"), F.max("msg_id").alias("end_msg_id"),
            F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
            F.sort_array(F.collect_set("sender")).alias("participants"),
            F.count(F.lit(1)).cast("int").alias("n_messages"),
            F.array_join(F.transform(held, lambda r: r["line"]), "\n").alias("_lines"),
        )
        .where((F.col("window") == 0) | (F.col("n_messages") > overlap))
        .withColumn("body", F.concat(
            F.lit("["), display_date("start_ts"), F.lit("]"),
            F.when(F.col("_lines") != "", F.concat(F.lit("\n"), "_lines")).otherwise("")))
        .drop("_lines")
    )


def chunk_table(chunks: DataFrame) -> DataFrame:
    """Dense ``chunk_id`` per archive and the hash of the body."""
    numbered = dense_ids(chunks.withColumn("_block", block_of("start_msg_id")), ["archive_id"], ["_block"],
                         ["start_msg_id", "window"], "chunk_id")
    return numbered.drop("_block", "window").withColumn("body_hash", body_hash("body"))


# --- keyword search -------------------------------------------------------------------


def counted_terms(docs: DataFrame, *keep: str) -> DataFrame:
    """(archive_id, doc_id, keep..., dl, term, tf) of non-empty content; terms are counted within their row, so nothing is shuffled.

    The outer explode keeps the optimiser from testing the size of the words first, which would cut each text twice.
    """
    words = docs.where("content IS NOT NULL AND content <> ''").select(
        "archive_id", "doc_id", *keep, F.sort_array(tokens("content")).alias("_t"))
    t, n = F.col("_t"), F.size("_t")
    begins = words.select("archive_id", "doc_id", *keep, "_t", F.filter(
        F.sequence(F.lit(0), n), lambda i: (i < n) & ((i == 0) | (F.get(t, i) != F.get(t, i - 1)))).alias("_b"))
    counted = F.transform("_b", lambda place, j: F.struct(
        F.get(t, place).alias("term"), (F.coalesce(F.get(F.col("_b"), j + 1), n) - place).alias("tf")))
    return begins.select("archive_id", "doc_id", *keep, n.alias("dl"), F.explode_outer(counted).alias("p")).where("p IS NOT NULL").select(
        "archive_id", "doc_id", *keep, "dl", "p.term", "p.tf")


def build_postings(docs: DataFrame) -> DataFrame:
    """(archive_id, doc_id, content) to (archive_id, term, doc_id, tf, dl) of non-empty content; a document is one row.

    The texts are shuffled, not the postings: a task holds the postings of a bounded share of the documents.
    """
    return counted_terms(spread(docs.select("archive_id", "doc_id", "content"), ["archive_id", "doc_id"], "content")).select("archive_id", "term", "doc_id", "dl", F.col("tf").cast("long").alias("tf"))


def index_stats(docs: DataFrame) -> DataFrame:
    """Per archive: number of indexed documents and their mean length."""
    return docs.where("content IS NOT NULL AND content <> ''").groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(tokens("content"))).alias("n_tokens"))


def query_terms(query: str) -> list[str]:
    import regex

    return sorted(set(regex.findall(r"[\p{L}\p{M}\p{N}]+", query.lower())))


def bm25_scores(postings: DataFrame, stats: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 per (archive, document). Query terms are literals, so the index is only filtered."""
    hits = postings.where(F.col("term").isin(query_terms(query)))
    df = hits.groupBy("archive_id", "term").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("n_docs")
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = df.join(stats, "archive_id").select(
        "archive_id", "term", idf.alias("_idf"), (F.col("n_tokens") / n).alias("_avg"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("_avg"))
    return spread_join(hits, weights, ["archive_id", "term"], ["doc_id"]).groupBy("archive_id", "doc_id").agg(
        F.sum(F.col("_idf") * F.col("tf") * (k1 + 1) / norm).alias("score"))


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    from parley.plans.reports import top

    return top(df, k, list(order))


def content_filter(content: DataFrame, participant: str | None = None, after: str | None = None,
                   before: str | None = None) -> DataFrame:
    from parley.plans.adhoc import filter_time_range

    if participant:
        content = content.where(F.lower("sender").contains(participant.lower()))
    return filter_time_range(content, after, before)


def bm25_search(content: DataFrame, postings: DataFrame, stats: DataFrame, query: str, k: int = TOP_K,
                participant: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Best messages per archive; filters apply before the ranking, names after it.

    ``content`` has archive_id, msg_id, ts, sender, content; documents are messages.
    """
    scored = bm25_scores(postings, stats, query).withColumnRenamed("doc_id", "msg_id")
    if participant or after or before:
        kept = content_filter(content, participant, after, before).select("archive_id", "msg_id")
        scored = scored.join(kept, ["archive_id", "msg_id"], "left_semi")
    best = _top(scored, k, F.desc(F.round("score", 9)), F.asc("msg_id"))
    return checked_broadcast(best).join(content.select("archive_id", "msg_id", "ts", "sender", "content"), ["archive_id", "msg_id"])


def keyword_like_search(content: DataFrame, query: str, k: int = TOP_K, participant: str | None = None,
                        after: str | None = None, before: str | None = None) -> DataFrame:
    """Substring search, newest first, for archives without an index."""
    found = content_filter(content, participant, after, before).where(F.lower("content").contains(query.lower()))
    return _top(found.select("archive_id", "msg_id", "ts", "sender", "content"), k, F.desc("ts"), F.desc("msg_id")
                ).withColumn("score", F.lit(1.0))


# --- vectors --------------------------------------------------------------------------


def l2_normalise(vector: str) -> Column:
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def cosine_to(vector: str, query: list[float]) -> Column:
    """Cosine to one fixed query vector, a whole Arrow batch at a time; null for other widths."""
    import numpy as np

    q = np.asarray(query, dtype="float64")
    q_norm = math.sqrt(float(q @ q))
    dims = len(q)

    @F.arrow_udf(T.DoubleType())
    def score(column):
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.full(len(column), np.nan)
        usable = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
        picked = column.filter(pa.array(usable))
        rows = picked.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dims)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[usable] = (rows @ q) / (np.sqrt((rows * rows).sum(axis=1)) * q_norm)
        return pa.array(out, mask=np.isnan(out))

    return score(F.col(vector))


def vector_search(vectors: DataFrame, query: list[float], k: int = TOP_K, participant: str | None = None,
                  after: str | None = None, before: str | None = None, key: str = "chunk_id",
                  vector: str = "embedding") -> DataFrame:
    """Exact top-k per archive by cosine. Filters (if any) need participants, start_ts, end_ts."""
    from parley.plans.adhoc import time_bounds

    low, high = time_bounds(after, before)
    if participant:
        vectors = vectors.where(F.exists("participants", lambda p: F.lower(p).contains(participant.lower())))
    if low is not None:
        vectors = vectors.where(F.col("start_ts") >= low)
    if high is not None:
        vectors = vectors.where(F.col("end_ts") <= high)
    scored = vectors.withColumn("score", cosine_to(vector, query)).drop(vector).where("score IS NOT NULL")
    return _top(scored, k, F.desc(F.round("score", 9)), F.asc(key))


def hash_embedding(texts, dims: int = 64):
    """A model-free stand-in: signed counts of hashed words. Takes and gives plain sequences."""
    import numpy as np
    import regex
    import xxhash

    out = np.zeros((len(texts), dims), dtype="float32")
    for row, text in enumerate(texts):
        for word in regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower()):
            h = xxhash.xxh64_intdigest(word)
            out[row, h % dims] += 1.0 if (h >> 32) & 1 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1.0, norms)


def embed_texts(texts: DataFrame, embed: Callable, key: str, body: str, batch: int = EMBED_BATCH) -> DataFrame:
    """(key, embedding) through the pluggable model, in calls of ``batch`` texts; no more texts than that are Python strings at a time."""

    def run(batches):
        import pyarrow as pa

        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = pa.array([list(v) for v in embed(part.column(1).to_pylist())], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], [key, "embedding"])

    return texts.select(F.col(key).cast("string").alias(key), body).mapInArrow(run, f"{key} string, embedding array<float>")


def embed_or_tell(texts: DataFrame, embed: Callable, key: str, body: str, batch: int = EMBED_BATCH) -> DataFrame:
    """(key, embedding, error): a call that fails is repeated text by text; what fails again carries the error."""

    def run(batches):
        import pandas as pd

        def told(part):
            try:
                vectors = list(embed(part[body].tolist()))
                return pd.DataFrame({key: part[key].to_numpy(), "embedding": vectors, "error": None})
            except Exception as problem:
                if len(part) > 1:
                    return pd.concat([told(part.iloc[i:i + 1]) for i in range(len(part))])
                return pd.DataFrame({key: part[key].to_numpy(), "embedding": [None], "error": f"{type(problem).__name__}: {problem}"})

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                yield told(pdf.iloc[at:at + batch])

    return texts.select(key, body).mapInPandas(run, f"{key} string, embedding array<float>, error string")


def split_missing(chunks: DataFrame, vectors: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks without a vector: (those whose body is cached, distinct bodies still to embed)."""
    todo = chunks.join(vectors.select("archive_id", "chunk_id"), ["archive_id", "chunk_id"], "left_anti")
    cached = skew_join(todo.drop("body"), cache.select("body_hash", "embedding"), ["body_hash"], ["archive_id", "chunk_id"])
    distinct = todo.groupBy("body_hash").agg(F.any_value("body").alias("body"))
    missing = distinct.join(cache.select("body_hash"), "body_hash", "left_anti")
    cached = cached.select("archive_id", "chunk_id", "embedding")
    return cached, missing


def embed_missing(chunks: DataFrame, vectors: DataFrame, cache: DataFrame, embed: Callable,
                  batch: int = EMBED_BATCH, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new vectors, new cache rows): each distinct text is embedded once, and both are read from the stored answers.

    Texts the model fails on get no vector and stay pending. A rerun with the same ``path`` asks only what is left.
    """
    cached, missing = split_missing(chunks, vectors, cache)
    told = remember(missing, "body_hash", lambda rows: embed_or_tell(rows, embed, "body_hash", "body", batch), path)
    fresh = told.where("error IS NULL").select("body_hash", "embedding")
    todo = chunks.join(vectors.select("archive_id", "chunk_id"), ["archive_id", "chunk_id"], "left_anti")
    filled = skew_join(todo.select("archive_id", "chunk_id", "body_hash"), fresh, ["body_hash"], ["archive_id", "chunk_id"])
    return cached.unionByName(filled.select("archive_id", "chunk_id", "embedding")), fresh


# --- fusion ---------------------------------------------------------------------------


def rrf_fuse(hits: DataFrame, k: int = TOP_K, damping: int = RRF_DAMPING, payload: tuple[str, ...] = ("source",)) -> DataFrame:
    """Reciprocal rank fusion of (archive_id, key, source, rank from 1, payload...).

    The payload of a key comes from the semantic list where it is in both; on equal scores
    semantic keys go first, then the better rank.
    """
    first = F.when(F.col("source") == "semantic", 0).otherwise(1)
    fused = hits.groupBy("archive_id", "key").agg(
        F.sum(1.0 / (F.lit(damping) + F.col("rank"))).alias("fusion_score"),
        F.min_by(F.struct(*payload), F.struct(first, "rank")).alias("_p"),
        F.min(first).alias("_first"), F.min("rank").alias("_rank"),
    )
    ordered = _top(fused.select("archive_id", "key", "fusion_score", "_first", "_rank", "_p.*"), k,
                   F.desc(F.round("fusion_score", 12)), F.asc("_first"), F.asc("_rank"), F.asc("key"))
    return ordered.drop("_first", "_rank")


def chunk_spans(chunks: DataFrame) -> DataFrame:
    """Which chunks reach into which block of message ids: a row for each chunk and block, to be stored with the chunks."""
    first, last = (F.floor(F.col(c) / SPAN_IDS).cast("long") for c in ("start_msg_id", "end_msg_id"))
    return chunks.select("archive_id", F.explode(F.sequence(first, last)).alias("id_block"), "chunk_id", "start_msg_id", "end_msg_id")


def chunk_of_message(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Message hits with the first chunk that covers them, null where none does.

    Few hits name their blocks, so that a stored table of spans is read there only.
    """
    cols = hits.columns
    hits = checked_broadcast(hits.withColumn("id_block", F.floor(F.col("msg_id") / SPAN_IDS).cast("long")))
    blocks = [r.id_block for r in hits.select("id_block").distinct().limit(SPAN_BLOCKS + 1).collect()]
    if len(blocks) <= SPAN_BLOCKS:
        spans = spans.where(F.col("id_block").isin(blocks))
    inside = F.col("msg_id").between(F.col("start_msg_id"), F.col("end_msg_id"))
    found = spans.join(hits, ["archive_id", "id_block"]).where(inside).groupBy("archive_id", "msg_id").agg(F.min("chunk_id").alias("chunk_id"))
    return hits.join(found, ["archive_id", "msg_id"], "left").select(*cols, "chunk_id")


def _told(content: DataFrame, fused: DataFrame, messages: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """Fused keys with their times, people and text: of the message, or of the chunk."""
    said = F.concat(F.date_format("ts", "dd MMM yyyy HH:mm"), F.lit(" "), F.coalesce("sender", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")))
    who = F.when(F.col("sender").isNull(), F.array().cast("array<string>")).otherwise(F.array("sender"))
    rows = messages.select(
        "archive_id", F.concat(F.lit("m"), F.col("msg_id").cast("string")).alias("key"), F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"),
        who.alias("participants"), said.alias("text"))
    if chunks is not None:
        wanted = fused.where("NOT startswith(key, 'm')").select("archive_id", F.col("key").cast("long").alias("chunk_id"))
        rows = rows.unionByName(chunks.select("archive_id", F.col("chunk_id").cast("long").alias("chunk_id"), "start_ts", "end_ts", "participants", "body").join(
            checked_broadcast(wanted), ["archive_id", "chunk_id"]).select(
            "archive_id", F.col("chunk_id").cast("string").alias("key"), "start_ts", "end_ts", "participants", F.col("body").alias("text")))
    return fused.join(rows, ["archive_id", "key"], "left").withColumn("note", F.lit(None).cast("string"))


def search_chat(content: DataFrame, postings: DataFrame | None, stats: DataFrame | None, query: str | None = None, k: int = TOP_K,
                participant: str | None = None, after: str | None = None, before: str | None = None,
                chunks: DataFrame | None = None, vectors: DataFrame | None = None,
                embed: Callable | None = None, interleave: bool = False, spans: DataFrame | None = None) -> DataFrame:
    """Hybrid search: (archive_id, key, source, rank, fusion_score, start_ts, end_ts, participants, text, note).

    With ``interleave`` message hits and chunk hits stay separate keys; otherwise a message
    hit counts for the chunk that covers it, so that the two rankings reinforce each other. ``spans`` are the stored
    ``chunk_spans``. Without chunks and vectors it is keyword only, and without postings the newest substring matches take the place of the ranking.
    An archive where nothing is found gets one row, the transcript of the time range, if there is a range.
    Without a query the window alone is read, as ``read_window`` gives it.
    """
    if not (query or "").strip():
        if not (participant or after or before):
            raise ValueError("give something to search for, a date range or a participant")
        return read_window(content_filter(content, participant, after, before))
    if postings is None:
        matched = keyword_like_search(content, query, k, participant, after, before)
    else:
        matched = bm25_search(content, postings, stats, query, k, participant, after, before)
    matched = checked_broadcast(matched.select("archive_id", "msg_id", "rank", "ts", "sender", "content"))
    keyword = matched.select("archive_id", "msg_id", "rank")
    as_message = F.concat(F.lit("m"), F.col("msg_id").cast("string"))
    semantic = None
    if vectors is not None and chunks is not None and embed is not None:
        described = vectors.join(chunks.select("archive_id", "chunk_id", "participants", "start_ts", "end_ts"),
                                 ["archive_id", "chunk_id"])
        found = vector_search(described, list(embed([query])[0]), k, participant, after, before)
        semantic = found.select("archive_id", F.col("chunk_id").cast("string").alias("key"), "rank",
                                F.lit("semantic").alias("source"))
    key = as_message
    if semantic is not None and not interleave:
        keyword = chunk_of_message(keyword, chunk_spans(chunks) if spans is None else spans)
        key = F.coalesce(F.col("chunk_id").cast("string"), as_message)
    listed = keyword.groupBy("archive_id", key.alias("key")).agg(F.min("rank").alias("rank")).withColumn("source", F.lit("keyword"))
    fused = checked_broadcast(rrf_fuse(listed if semantic is None else semantic.unionByName(listed), k))
    told = _told(content, fused, matched, None if semantic is None else chunks)
    if not (after or before):
        return told
    lost = content_filter(content, participant, after, before).join(fused.select("archive_id").distinct(), "archive_id", "left_anti")
    times = lost.where("msg_type <> 'system'").groupBy("archive_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.sort_array(F.collect_set("sender")).alias("participants"))
    window = read_window(lost).join(times, "archive_id").select(
        "archive_id", F.lit("window").alias("key"), F.lit("window").alias("source"), F.lit(1).alias("rank"),
        F.lit(None).cast("double").alias("fusion_score"), "start_ts", "end_ts", "participants", F.col("transcript").alias("text"),
        F.lit(f"nothing matched {query!r}; this is the conversation of that time").alias("note"))
    return told.select(window.columns).unionByName(window)


def get_context(content: DataFrame, hits: DataFrame, before: int = CONTEXT, after: int = CONTEXT) -> DataFrame:
    """Messages around many hits at once: each hit names its neighbours, then one equi join."""
    near = hits.select("archive_id", F.col("msg_id").alias("center_msg_id"), F.explode(
        F.sequence(F.col("msg_id") - before, F.col("msg_id") + after)).alias("msg_id"))
    return checked_broadcast(near).join(content.select("archive_id", "msg_id", "ts", "sender", "msg_type", "content"), ["archive_id", "msg_id"])


def find_media(named_media: DataFrame, query: str | None = None, kind: str | None = None,
               sender: str | None = None, k: int = 20) -> DataFrame:
    found = named_media
    if query:
        test = F.lit(False)
        for col in ("description", "transcript", "ocr_text", "caption", "filename"):
            test = test | F.coalesce(F.lower(col).contains(query.lower()), F.lit(False))
        found = found.where(test)
    if kind:
        found = found.where(F.col("kind") == kind)
    if sender:
        found = found.where(F.lower("sender").contains(sender.lower()))
    cols = ["media_id", "msg_id", "filename", "kind", "ts", "sender", "caption", "description", "transcript", "ocr_text", "status"]
    return _top(found.select("archive_id", *cols), k, F.asc("ts"), F.asc("media_id"))
