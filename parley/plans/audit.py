"""Consistency checks: each is a reason to distrust a number. One row per archive and check."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.ordered import block_of, lag_across

A = "archive_id"
# Fixed value: no chat is older.
OLDEST = "2009-01-01"


def _per_archive(bad: DataFrame) -> DataFrame:
    return bad.groupBy(A).agg(F.count(F.lit(1)).alias("n"))


def orphan_senders(messages: DataFrame) -> DataFrame:
    return _per_archive(messages.where("participant_id IS NULL AND msg_type <> 'system'"))


def unknown_participants(messages: DataFrame, people: DataFrame) -> DataFrame:
    counts = messages.where("participant_id IS NOT NULL").groupBy(A, "participant_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(people, [A, "participant_id"], "left_anti").groupBy(A).agg(F.sum("n").alias("n"))


def wrong_message_counts(messages: DataFrame, people: DataFrame) -> DataFrame:
    actual = messages.where("msg_type <> 'system'").groupBy(A, "participant_id").agg(F.count(F.lit(1)).alias("_n"))
    both = people.select(A, "participant_id", "message_count").join(actual, [A, "participant_id"], "left")
    return _per_archive(both.where(F.col("message_count") != F.coalesce("_n", F.lit(0))))


def out_of_order(messages: DataFrame) -> DataFrame:
    rows = messages.where("msg_type <> 'system'").select(A, "msg_id", "ts").withColumn("_block", block_of("msg_id"))
    seen = lag_across(rows, [A], ["_block"], ["msg_id"], {"_before": "ts"})
    return _per_archive(seen.where("ts < _before"))


def bad_session_starts(messages: DataFrame) -> DataFrame:
    starts = messages.where("msg_type <> 'system'").groupBy(A, "session_id").agg(F.count_if("is_session_start").alias("_n"))
    return _per_archive(starts.where("_n <> 1"))


def negative_gaps(messages: DataFrame) -> DataFrame:
    return _per_archive(messages.where("gap_seconds < 0"))


def self_replies(messages: DataFrame) -> DataFrame:
    return _per_archive(messages.where("reply_gap_seconds IS NOT NULL AND prev_participant_id = participant_id"))


def media_count_mismatch(messages: DataFrame, media: DataFrame) -> DataFrame:
    """Archives with media rows whose number differs from the attachments named."""
    named = messages.where("attachment IS NOT NULL").groupBy(A).agg(F.count(F.lit(1)).alias("_named"))
    rows = media.groupBy(A).agg(F.count(F.lit(1)).alias("_rows"))
    both = rows.join(named, A, "left").fillna(0, ["_named"])
    return both.where("_named <> _rows").select(A, F.abs(F.col("_named") - F.col("_rows")).alias("n"))


def dangling_media(messages: DataFrame, media: DataFrame) -> DataFrame:
    return _per_archive(media.join(messages.select(A, "msg_id"), [A, "msg_id"], "left_anti"))


def missing_files(media: DataFrame, existing: DataFrame) -> DataFrame:
    return _per_archive(media.join(existing.select(A, "path").distinct(), [A, "path"], "left_anti"))


def chunk_coverage(archives: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per archive: chunks, vectors and the state of retrieval."""
    c = chunks.groupBy(A).agg(F.count(F.lit(1)).alias("chunks"))
    v = vectors.groupBy(A).agg(F.count(F.lit(1)).alias("vectors"))
    both = archives.select(A).distinct().join(c, A, "left").join(v, A, "left").fillna(0, ["chunks", "vectors"])
    state = (F.when(F.col("chunks") == 0, "no chunks").when(F.col("vectors") == 0, "no vectors")
             .when(F.col("vectors") < F.col("chunks"), "partial vectors").otherwise("complete"))
    return both.withColumn("state", state)


def uncovered_messages(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Messages in no chunk; a chunk names its few message ids, so this is an equi anti join."""
    covered = chunks.select(A, F.explode(F.sequence("start_msg_id", "end_msg_id")).alias("msg_id"))
    rows = messages.where("msg_type <> 'system'").select(A, "msg_id")
    return _per_archive(rows.join(covered, [A, "msg_id"], "left_anti"))


def duplicate_keys(messages: DataFrame) -> DataFrame:
    keys = messages.where("dedup_key IS NOT NULL").groupBy(A, "dedup_key").agg(F.count(F.lit(1)).alias("_n"))
    return _per_archive(keys.where("_n > 1"))


def future_dates(messages: DataFrame, as_of: str | None = None) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()
    return _per_archive(messages.where(F.col("ts") > now))


def ancient_dates(messages: DataFrame) -> DataFrame:
    return _per_archive(messages.where(F.col("ts") < F.lit(OLDEST).cast("timestamp_ntz")))


def reconcile(raw: DataFrame, messages: DataFrame) -> DataFrame:
    """Nothing may get lost on the way in: counts of both sides and the difference per archive."""
    before = raw.where("msg_type <> 'system'").groupBy(A).agg(
        F.count(F.lit(1)).alias("prepared"), F.count("attachment").alias("attachments_named"))
    after = messages.groupBy(A).agg(
        F.count(F.lit(1)).alias("stored"), F.count("attachment").alias("attachments_linked"),
        F.count_if(F.col("participant_id").isNull() & (F.col("msg_type") != "system")).alias("orphans"))
    counts = ["prepared", "stored", "attachments_named", "attachments_linked", "orphans"]
    both = before.join(after, A, "full").fillna(0, counts)
    ok = (F.col("prepared") == F.col("stored")) & (F.col("attachments_named") == F.col("attachments_linked")) & (F.col("orphans") == 0)
    return both.select(A, *counts, ok.alias("ok"))


def doctor(messages: DataFrame, people: DataFrame, media: DataFrame, chunks: DataFrame, vectors: DataFrame,
           files: DataFrame | None = None, archives: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """All findings as (archive_id, level, check, n); an archive without errors is sound."""
    archives = messages if archives is None else archives
    coverage = chunk_coverage(messages, chunks, vectors)
    checks = [
        ("error", "orphan_senders", orphan_senders(messages)),
        ("error", "unknown_participants", unknown_participants(messages, people)),
        ("warning", "message_counts", wrong_message_counts(messages, people)),
        ("error", "time_order", out_of_order(messages)),
        ("error", "session_starts", bad_session_starts(messages)),
        ("error", "negative_gaps", negative_gaps(messages)),
        ("error", "self_replies", self_replies(messages)),
        ("warning", "media_counts", media_count_mismatch(messages, media)),
        ("error", "dangling_media", dangling_media(messages, media)),
        ("warning", "no_chunks", coverage.where("state = 'no chunks'").select(A, F.lit(0).alias("n"))),
        ("note", "no_vectors", coverage.where("state = 'no vectors'").select(A, F.col("chunks").alias("n"))),
        ("note", "partial_vectors", coverage.where("state = 'partial vectors'").select(A, (F.col("chunks") - F.col("vectors")).alias("n"))),
        ("warning", "uncovered_messages", uncovered_messages(messages, chunks)),
        ("error", "duplicate_keys", duplicate_keys(messages)),
        ("warning", "future_dates", future_dates(messages, as_of)),
        ("warning", "ancient_dates", ancient_dates(messages)),
        ("note", "empty", archives.select(A).distinct().join(messages.select(A), A, "left_anti").select(A, F.lit(0).alias("n"))),
    ]
    if files is not None:
        checks.append(("warning", "missing_files", missing_files(media, files)))
    out = None
    for level, check, found in checks:
        part = found.select(A, F.lit(level).alias("level"), F.lit(check).alias("check"), F.col("n").cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def is_sound(findings: DataFrame, archives: DataFrame) -> DataFrame:
    errors = findings.where("level = 'error'").select(A).distinct().withColumn("_bad", F.lit(True))
    return archives.select(A).distinct().join(errors, A, "left").select(A, F.col("_bad").isNull().alias("ok"))
