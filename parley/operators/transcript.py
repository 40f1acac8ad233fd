"""Transcripts as text: attachment runs collapse to one line, all words typed are kept.

Lines are found by ordered scans over blocks of message ids, so neither a long session nor
a long archive is gathered; only the lines that are shown get joined into one string.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import display_date, strip
from parley.operators.ordered import block_of, count_across, lag_across, totals_across
from parley.operators.skew import checked_broadcast

EXCERPT_LINES = 24
# Longest shown window, marker of a cut one.
WINDOW_CHARS = 5500
OMITTED = "[earlier messages omitted]\n"


def _spoken(content: DataFrame) -> DataFrame:
    """Rows that say something; a placeholder is a text in square brackets."""
    text = strip(F.coalesce("content", F.lit("")))
    return (
        content.withColumn("_text", text).where(F.col("_text") != "")
        .withColumn("_held", F.col("_text").startswith("[") & F.col("_text").endswith("]"))
    )


def transcript_lines(content: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, line, time, text, n_text, n_held): attachment runs of one sender are one line.

    ``content`` needs msg_id, ts, sender and content; ``scope`` names the transcript a row
    belongs to (an archive, or an archive and a session).
    """
    rows = _spoken(content).withColumn("_block", block_of("msg_id"))
    seen = lag_across(rows, scope, ["_block"], ["msg_id"], {"_was_held": "_held", "_before": "sender"})
    goes_on = F.coalesce(F.col("_held") & F.col("_was_held") & (F.col("_before") == F.col("sender")), F.lit(False))
    numbered = count_across(
        seen.withColumn("_new", ~goes_on), scope, ["_block"], ["msg_id"], {"line": F.col("_new")}
    )
    first = F.struct("msg_id")
    lines = numbered.groupBy(*scope, "line").agg(
        F.min("ts").alias("ts"), F.first("sender").alias("sender"),
        F.min_by("_text", first).alias("_text"), F.count_if("_held").alias("n_held"),
        F.count_if(~F.col("_held")).alias("n_text"),
    )
    noun = F.when(F.col("n_held") == 1, " attachment)").otherwise(" attachments)")
    said = F.when(F.col("n_held") > 0, F.concat(F.lit("("), F.col("n_held").cast("string"), noun)).otherwise(F.col("_text"))
    return lines.select(
        *scope, "line", "ts", "n_held", "n_text",
        F.concat(F.date_format("ts", "HH:mm"), F.lit(" "), "sender", F.lit(": "), said).alias("text"),
    )


def _joined(order: str = "line") -> Column:
    """The collected lines of one transcript in order, one per row."""
    rows = F.sort_array(F.collect_list(F.struct(order, "text")))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "\n")


def session_excerpts(content: DataFrame, sessions: DataFrame, limit: int = EXCERPT_LINES) -> DataFrame:
    """Excerpts of all chosen (archive_id, session_id) in one job: head, count, tail."""
    scope = ["archive_id", "session_id"]
    blocked = content.withColumn("_block", block_of("msg_id"))
    spans = blocked.select(*scope, "_block").distinct().join(sessions.select(*scope).distinct(), scope, "left_semi")
    chosen = blocked.join(checked_broadcast(spans), [*scope, "_block"], "left_semi").drop("_block")
    lines = transcript_lines(chosen, scope).withColumn("_block", block_of("line"))
    half = limit // 2
    long = F.col("_n") > limit
    middle = F.concat(F.lit("... "), (F.col("_n") - limit).cast("string"), F.lit(" more messages ..."))
    shown = (
        totals_across(lines, scope, ["_block"], {"_n": (F.count(F.lit(1)), F.sum)})
        .where(~long | (F.col("line") <= half + 1) | (F.col("line") > F.col("_n") - half))
        .withColumn("text", F.when(long & (F.col("line") == half + 1), middle).otherwise(F.col("text")))
    )
    return shown.groupBy(*scope).agg(_joined().alias("excerpt"))


def read_window(content: DataFrame, scope: list[str] = ("archive_id",), limit: int = WINDOW_CHARS) -> DataFrame:
    """Transcript and counts per scope of an already filtered window.

    Only the tail that fits is joined: running text lengths from the end are kept per line,
    and lines wholly beyond ``limit`` characters never reach the collected list.
    """
    scope = list(scope)
    told = content.where("msg_type <> 'system'")
    totals = told.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min("ts").alias("_first"), F.max("ts").alias("_last"),
    )
    lines = transcript_lines(told, scope).withColumn("_block", block_of("line")).withColumn(
        "_chars", F.length("text") + 1)
    sizes = lines.groupBy(*scope).agg(
        F.sum("_chars").alias("_all"), F.sum("n_text").alias("messages_with_text"),
        F.sum("n_held").alias("attachments"),
    )
    upto = count_across(lines, scope, ["_block"], ["line"], {"_end": F.col("_chars")})
    same_day = F.to_date("_first") == F.to_date("_last")
    header = F.when(same_day, F.concat(F.lit("["), display_date("_first"), F.lit("]"))).otherwise(
        F.concat(F.lit("["), F.date_format("_first", "dd MMM yyyy"), F.lit(" to "),
                 F.date_format("_last", "dd MMM yyyy"), F.lit("]")))
    tail = (
        totals_across(upto, scope, ["_block"], {"_all": (F.sum("_chars"), F.sum)})
        .where(F.col("_all") - F.col("_end") <= limit)
        .groupBy(*scope).agg(_joined().alias("_tail"))
    )
    # The header and all lines, joined by line ends.
    size = F.length("_header") + F.coalesce("_all", F.lit(0))
    body = F.when(F.col("_tail").isNull(), F.col("_header")).otherwise(
        F.concat("_header", F.lit("\n"), F.col("_tail")))
    cut = F.concat(F.lit(OMITTED), F.right(body, F.lit(limit)))
    return (
        totals.withColumn("_header", header)
        .join(sizes, scope, "left").join(tail, scope, "left")
        .withColumn("truncated", size > limit)
        .withColumn("transcript", F.when(F.col("truncated"), cut).otherwise(body))
        .fillna(0, ["messages_with_text", "attachments"])
        .withColumn("empty_messages", F.col("message_count") - F.col("messages_with_text") - F.col("attachments"))
        .select(*scope, "transcript", "message_count", "messages_with_text", "attachments",
                "empty_messages", "truncated")
    )
