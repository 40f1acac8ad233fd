"""A blocked inverted index, and a ranking that reads only the blocks that can hold one of the best.

A block has the postings of one term in one range of document ids: places in the range, uses, lengths, and in front of them
what bounds their weight. The blocks of all terms share their borders, so the bounds of a query's terms add up by range. The
heads of the blocks are read first; the ranges with the highest bounds give a k-th score, and of the others only those
that reach it are opened. The bounds hold for any mean length, so blocks stay valid when other documents come and go.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.retrieval import B, K1, TOP_K, _top, content_filter, counted_terms, query_terms
from parley.operators.skew import checked_broadcast, parts_of
from parley.sources.store import materialise

A = "archive_id"
# Document ids in a block; ranges or messages that are named to a scan.
BLOCK_IDS = 64
NAMED = 1000
# Scores are ranked by nine digits: a bound this close below the k-th score may still tie with it.
MARGIN = 2e-9
HEAD = ["n", "max_tf", "min_share"]


def build_blocks(docs: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(archive_id, doc_id, content) to (archive_id, term, doc_block, n, max_tf, min_share, places, tf, dl) of non-empty content.

    ``places`` are distances from the first id of the block, ascending; ``dl`` is the length of a document, ``min_share`` the least
    length for each use of the term. Terms are counted within their row, and the
    texts are shuffled by ranges of blocks, not the postings: a task holds the blocks of a bounded share of the documents, and a group has at
    most ``block_ids`` documents. Each file of a stored index holds some blocks of all terms, in order. ``doc_id`` names a
    document within its archive; rows without one are left out.
    """
    block = F.floor(F.col("doc_id").cast("long") / block_ids).cast("long").alias("doc_block")
    rows = docs.where("content IS NOT NULL AND content <> '' AND doc_id IS NOT NULL").select(
        A, F.col("doc_id").cast("long").alias("doc_id"), "content", F.struct(A, block).alias("_part"))
    # one column, so that the groups stay where their texts are also where the archive is a constant
    placed = rows.repartitionByRange(max(2, parts_of(rows, "content")), "_part")
    postings = counted_terms(placed, "_part").select(
        "_part", "term", F.pmod("doc_id", F.lit(block_ids)).cast("int").alias("place"), "tf", "dl")
    grouped = postings.groupBy("_part", "term").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min(F.col("dl") / F.col("tf")).alias("min_share"),
        F.sort_array(F.collect_list(F.struct("place", "tf", "dl"))).alias("_p"))
    return grouped.select(f"_part.{A}", "term", "_part.doc_block", *HEAD, F.col("_p.place").alias("places"), "_p.tf", "_p.dl")


class Ranking(NamedTuple):
    """What a ranked search has read: exact ``scores`` (archive_id, doc_id, score), the k best among them, and all
    ``ranges`` (archive_id, doc_block, bound, reading): 1 if opened first, 2 if opened for its bound, null if skipped."""

    scores: DataFrame
    ranges: DataFrame


def _named(rows: DataFrame, column: str, few: DataFrame) -> DataFrame:
    """``rows`` with the values of ``few`` written into the filter, if they are few: a sorted table is then read there only."""
    values = [r[0] for r in few.select(column).distinct().limit(NAMED + 1).collect()]
    return rows.where(F.col(column).isin(values)) if len(values) <= NAMED else rows


def rank_blocks(index: DataFrame, stats: DataFrame, query: str, k: int = TOP_K, wanted: DataFrame | None = None,
                k1: float = K1, b: float = B, block_ids: int = BLOCK_IDS) -> Ranking:
    """BM25 over stored ``build_blocks``; the k best documents of each archive are among the scores, exactly.

    A weight is ``idf * (k1 + 1) / (1 + k1 * (1 - b) / tf + k1 * b * dl / (tf * mean))``, so the most uses and the least length for each use
    bound a block. The k ranges with the highest bounds hold at least k documents; ``wanted`` (archive_id, doc_id) filters
    before the k-th score is taken, so that a filter opens more ranges and loses nothing.
    """
    used = index.where(F.col("term").isin(query_terms(query)))
    heads = used.select(A, "term", "doc_block", *HEAD)
    df, n_docs = F.col("df"), F.col("n_docs")
    weights = checked_broadcast(heads.groupBy(A, "term").agg(F.sum("n").alias("df")).join(stats, A).select(
        A, "term", F.log((n_docs - df + 0.5) / (df + 0.5) + 1).alias("_idf"), (F.col("n_tokens") / n_docs).alias("_avg")))

    def weight(uses: Column, share: Column) -> Column:
        return F.col("_idf") * (k1 + 1) / (1 + k1 * (1 - b) / uses + k1 * b * share / F.col("_avg"))

    bounds = materialise(heads.join(weights, [A, "term"]).groupBy(A, "doc_block").agg(
        F.sum(weight(F.col("max_tf"), F.col("min_share"))).alias("bound")), "bounds")

    def scored(ranges: DataFrame) -> DataFrame:
        few = checked_broadcast(ranges.select(A, "doc_block"))
        opened = _named(used, "doc_block", few).join(few, [A, "doc_block"]).select(
            A, "term", "doc_block", F.explode(F.arrays_zip("places", "tf", "dl")).alias("p"))
        found = opened.join(weights, [A, "term"]).groupBy(
            A, (F.col("doc_block") * block_ids + F.col("p.places")).alias("doc_id")).agg(
            F.sum(weight(F.col("p.tf"), F.col("p.dl") / F.col("p.tf"))).alias("score"))
        return materialise(found if wanted is None else found.join(wanted, [A, "doc_id"], "left_semi"), "scored")

    first = materialise(_top(bounds, k, F.desc(F.round("bound", 9)), F.asc("doc_block")).drop("rank"), "first")
    scores = scored(first)
    floors = _top(scores, k, F.desc(F.round("score", 9)), F.asc("doc_id")).groupBy(A).agg(
        F.min("score").alias("_floor"), F.count(F.lit(1)).alias("_got")).where(F.col("_got") >= k)
    late = materialise(bounds.join(first, [A, "doc_block"], "left_anti").join(checked_broadcast(floors), A, "left").select(
        A, "doc_block", "bound", F.when(F.coalesce(F.col("bound") + MARGIN >= F.col("_floor"), F.lit(True)), 2).alias("reading")), "late")
    second = late.where("reading = 2")
    if not second.isEmpty():
        scores = scores.unionByName(scored(second))
    return Ranking(scores, first.withColumn("reading", F.lit(1)).unionByName(late))


def bm25_top(content: DataFrame, index: DataFrame, stats: DataFrame, query: str, k: int = TOP_K, participant: str | None = None,
             after: str | None = None, before: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The rows of ``bm25_search`` from a blocked index; of ``content``, the stored messages, only the hits are read."""
    wanted = None
    if participant or after or before:
        wanted = content_filter(content, participant, after, before).select(A, F.col("msg_id").alias("doc_id"))
    scores = rank_blocks(index, stats, query, k, wanted, block_ids=block_ids).scores.withColumnRenamed("doc_id", "msg_id")
    best = checked_broadcast(_top(scores, k, F.desc(F.round("score", 9)), F.asc("msg_id")))
    hits = _named(content.select(A, "msg_id", "ts", "sender", "content"), "msg_id", best)
    return best.join(hits, [A, "msg_id"])


def blocks_read(ranges: DataFrame) -> DataFrame:
    """Per archive: ranges with a term of the query, those opened first, and those opened for their bound."""
    return ranges.groupBy(A).agg(
        F.count(F.lit(1)).alias("ranges"), F.count_if(F.col("reading") == 1).alias("first"), F.count_if(F.col("reading") == 2).alias("late"))
