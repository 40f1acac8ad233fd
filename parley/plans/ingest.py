"""From raw messages to the stored tables of an archive set."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.linkage import (
    assign_keys, merge_counts, merge_exports, participant_overlap, reload_existing, resolve_participants, sender_counts,
    tag_participants,
)
from parley.operators.sessions import GAP_HOURS, drop_system, enrich
from parley.operators.skew import spread_join
from parley.sources.store import materialise, replace_archive

_KEYED = ["archive_id", "dedup_key", "line_no", "ts", "sender", "text", "msg_type", "attachment"]


@dataclass
class Tables:
    """Stored tables of a set of archives."""

    raw: DataFrame
    messages: DataFrame
    participants: DataFrame


def prepare(raw: DataFrame, gap_hours: float = GAP_HOURS, manual: DataFrame | None = None) -> Tables:
    """Lazy tables: key, enrich and resolve, nothing written."""
    kept = drop_system(raw)
    people = resolve_participants(sender_counts(kept), manual)
    return Tables(raw, enrich(kept, gap_hours, manual), people)


def load(raw: DataFrame, name: str, gap_hours: float = GAP_HOURS, manual: DataFrame | None = None) -> Tables:
    """Write the derived tables once; every report then reads columns from Parquet.

    The parsed messages are written first: enriching scans them a few times, with fewer
    columns each, and parsing is the dearest step.
    """
    parsed = materialise(tag_participants(drop_system(raw), manual), f"{name}-parsed")
    lazy = prepare(parsed, gap_hours, manual)
    messages = materialise(lazy.messages, f"{name}-messages", ["archive_id", "msg_id"])
    people = materialise(lazy.participants, f"{name}-participants", ["archive_id", "participant_id"])
    return Tables(raw, messages, people)


def gate(stored: DataFrame, raw: DataFrame) -> DataFrame:
    """(archive_id, overlap, verdict) of every archive an export brings: taken, other chat, or notices only."""
    seen = raw.groupBy("archive_id").agg(F.count_if(F.col("msg_type") != "system").alias("_said"))
    overlap = participant_overlap(stored, drop_system(raw))
    verdict = F.when(F.col("_said") == 0, "notices only").when(F.col("refused"), "other chat").otherwise("taken")
    return seen.join(overlap, "archive_id", "left").select("archive_id", "overlap", verdict.alias("verdict"))


def merge_into(path: str, raw: DataFrame, name: str, gap_hours: float = GAP_HOURS,
               manual: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """Merge a further export into the messages stored by archive under ``path``.

    Gives the tables of the archives that changed, and for every archive of the export what ``gate`` said and what was
    added, skipped and upgraded. Only the folders of changed archives are written again, after all their rows are
    stored elsewhere; the export of another chat, or one of notices only, changes nothing.
    """
    stored = raw.sparkSession.read.parquet(path)
    raw = materialise(raw, f"{name}-raw")
    judged = materialise(gate(stored, raw), f"{name}-gate")
    taken = judged.where("verdict = 'taken'").select("archive_id")
    said = spread_join(drop_system(raw), taken, ["archive_id"], ["line_no"], "left_semi")
    incoming = materialise(assign_keys(said, ["archive_id"]).select(*_KEYED), f"{name}-incoming")
    # of equal stamps the stored rows come first, in their order
    existing = reload_existing(spread_join(stored, taken, ["archive_id"], ["msg_id"], "left_semi"))
    existing = materialise(existing.select(*_KEYED).withColumn("line_no", F.col("line_no") - (1 << 40)), f"{name}-existing")
    merged = materialise(merge_exports(existing, incoming).select(*_KEYED), f"{name}-merged")
    messages = enrich(merged, gap_hours, manual).withColumn("line_no", F.col("msg_id"))
    messages = materialise(messages.select(*stored.columns), f"{name}-messages")
    replace_archive(messages, path)
    people = materialise(resolve_participants(sender_counts(merged), manual), f"{name}-participants")
    report = judged.join(merge_counts(existing, incoming), "archive_id", "left").fillna(0, ["added", "skipped", "upgraded"])
    return Tables(raw, messages, people), report
