"""Message ids, silences, sessions and reply gaps of the ordered stream."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.linkage import assign_keys, assign_small_keys, tag_participants
from parley.operators.ordered import (
    SLICE_ROWS, block_of, count_across, dense_ids, micros, with_time_slices,
)
from parley.operators.skew import spread

GAP_HOURS = 4.0


def drop_system(messages: DataFrame) -> DataFrame:
    return messages.where("msg_type <> 'system'")


def order_messages(messages: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Dense ``msg_id`` from 0 per archive by (ts, line_no)."""
    sliced, keys, _ = with_time_slices(messages, ["archive_id"], rows=slice_rows)
    return dense_ids(sliced, ["archive_id"], keys[1:], ["ts", "line_no"], "msg_id").drop(*keys[1:])


def text_features() -> dict[str, Column]:
    return {
        "char_count": X.char_count("text"),
        "word_count": X.word_count("text"),
        "emoji_count": X.emoji_count("text"),
        "has_url": X.has_url("text"),
        "is_question": F.when(F.col("msg_type") == "text", X.is_question("text")).otherwise(False),
    }


def temporal_parts() -> dict[str, Column]:
    return {
        "date": F.to_date("ts"),
        "hour": F.hour("ts"),
        "weekday": F.weekday("ts"),
        "year_month": F.date_format("ts", "yyyy-MM"),
    }


def stream_features(messages: DataFrame, gap_hours: float = GAP_HOURS,
                    slice_rows: int = SLICE_ROWS, dedup: bool = False) -> DataFrame:
    """Ids, gaps, sessions and reply gaps for messages that carry ``participant_id``.

    One shuffle of the rows by (archive, time slice); what crosses a slice border is one
    summary row per slice: how many messages, the last stamp and speaker, session starts.
    With ``dedup`` the rows also get their ``dedup_key``: equal messages share a minute, so
    the same shuffle serves.
    """
    part = ["archive_id"]
    sliced, keys, any_cut = with_time_slices(messages, part, rows=slice_rows)
    slices = keys[1:]
    if not any_cut:
        # whole hours, which hold all equal messages; cut hours must not meet again in one task
        sliced = spread(sliced, [*part, "_hour"], "text")
    limit = gap_hours * 3600.0
    within = Window.partitionBy(*keys).orderBy("ts", "line_no")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def gap(now, before):
        return (micros(now) - micros(before)).cast("double") / F.lit(1_000_000)

    def steps(rows):
        return (
            rows.withColumn("_rn", F.row_number().over(within))
            .withColumn("_pts", F.lag("ts").over(within))
            .withColumn("_pid", F.lag("participant_id").over(within))
            .withColumn("_cut", F.when(F.col("_rn") > 1, gap("ts", "_pts") > limit).otherwise(False).cast("long"))
            .withColumn("_cuts", F.sum("_cut").over(running))
        )

    between = Window.partitionBy(*part).orderBy(*slices)
    before = between.rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        steps(sliced).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_first"), F.max("ts").alias("_last"),
            F.max_by("participant_id", "_rn").alias("_speaker"), F.sum("_cut").alias("_inner"),
        )
        .withColumn("_e_ts", F.lag("_last").over(between))
        .withColumn("_e_pid", F.lag("_speaker").over(between))
        .withColumn("_e_start", F.coalesce(gap("_first", "_e_ts") > limit, F.lit(True)).cast("long"))
        .withColumn("_e_rows", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_e_sessions", F.coalesce(F.sum(F.col("_inner") + F.col("_e_start")).over(before), F.lit(0)))
        .select(*keys, "_e_ts", "_e_pid", "_e_start", "_e_rows", "_e_sessions")
    )
    if dedup:
        name = assign_keys if any_cut else assign_small_keys
        sliced = name(sliced, [*part, "_hour"]).drop("base_key", "occurrence")
    local = steps(sliced)
    first = F.col("_rn") == 1
    out = (
        local.join(edges, keys)
        .withColumn("msg_id", F.col("_e_rows") + F.col("_rn") - 1)
        .withColumn("gap_seconds", gap("ts", F.when(first, F.col("_e_ts")).otherwise(F.col("_pts"))))
        .withColumn("prev_participant_id", F.when(first, F.col("_e_pid")).otherwise(F.col("_pid")))
        .withColumn("is_session_start", F.when(first, F.col("_e_start") == 1).otherwise(F.col("_cut") == 1))
        .withColumn("session_id", F.col("_e_sessions") + F.col("_e_start") + F.col("_cuts"))
    )
    answered = ~F.col("is_session_start") & ~F.equal_null("prev_participant_id", "participant_id")
    return (
        out.withColumn("reply_gap_seconds", F.when(answered, F.col("gap_seconds")))
        .drop(*slices, "_rn", "_pts", "_pid", "_cut", "_cuts",
              "_e_ts", "_e_pid", "_e_start", "_e_rows", "_e_sessions")
    )


def enrich(messages: DataFrame, gap_hours: float = GAP_HOURS, manual: DataFrame | None = None,
           slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Raw messages to the stored ``messages`` table (system notices are never stored).

    What the messages bring already is kept: the ``participant_id`` of tagged messages, the
    ``dedup_key`` of merged ones.
    """
    tagged = drop_system(messages)
    if "participant_id" not in messages.columns:
        tagged = tag_participants(tagged, manual)
    streamed = stream_features(tagged, gap_hours, slice_rows, dedup="dedup_key" not in messages.columns)
    return streamed.withColumns({**text_features(), **temporal_parts()})


def sessions_at(messages: DataFrame, gap_hours: float) -> DataFrame:
    """Re-segment stored messages at another threshold, from the stored gaps alone."""
    start = F.coalesce(F.col("gap_seconds") > F.lit(gap_hours * 3600.0), F.lit(True))
    flagged = (
        messages.where("msg_type <> 'system'")
        .select("archive_id", "msg_id", "ts", "participant_id", "msg_type", start.alias("is_start"))
        .withColumn("_block", block_of("msg_id"))
    )
    return count_across(
        flagged, ["archive_id"], ["_block"], ["msg_id"], {"session_no": F.col("is_start")}
    ).drop("_block")


# The same as a SQL table function over the temporary view ``messages``.
SESSIONS_AT_SQL = """
CREATE OR REPLACE TEMPORARY FUNCTION sessions_at(gap_hours DOUBLE)
RETURNS TABLE (archive_id INT, msg_id BIGINT, ts TIMESTAMP_NTZ, participant_id STRING,
               msg_type STRING, is_start BOOLEAN, session_no BIGINT)
RETURN
WITH flagged AS (
    SELECT archive_id, msg_id, ts, participant_id, msg_type,
           gap_seconds IS NULL OR gap_seconds > sessions_at.gap_hours * 3600 AS is_start,
           msg_id DIV 262144 AS block
    FROM messages WHERE msg_type <> 'system'
), edges AS (
    SELECT archive_id, block,
           COALESCE(SUM(n) OVER (PARTITION BY archive_id ORDER BY block
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM (SELECT archive_id, block, COUNT_IF(is_start) AS n FROM flagged GROUP BY archive_id, block)
)
SELECT archive_id, msg_id, ts, participant_id, msg_type, is_start,
       earlier + SUM(CAST(is_start AS BIGINT)) OVER (
           PARTITION BY archive_id, block ORDER BY msg_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no
FROM flagged JOIN edges USING (archive_id, block)
"""
