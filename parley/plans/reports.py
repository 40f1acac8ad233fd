"""The dashboard reports, for every archive at once.

Counts are taken per (archive, participant) first, so that names are joined to a few
summary rows instead of to every message; equal names then merge, as they do on screen.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ordered import micros
from parley.operators.quantile import exact_median
from parley.operators.views import with_name

A = "archive_id"


def talk(messages: DataFrame) -> DataFrame:
    return messages.where("msg_type <> 'system'")


def count() -> Column:
    return F.count(F.lit(1))


def gap_micros() -> Column:
    """Reply gaps as whole microseconds: integer sums do not depend on the order."""
    return F.round(F.col("reply_gap_seconds") * 1_000_000).cast("long")


def per_sender(df: DataFrame, people: DataFrame, measures: dict, extra: list[str] = ()) -> DataFrame:
    """``measures`` maps a column to (aggregate over rows, aggregate that merges partials)."""
    extra = list(extra)
    partial = df.groupBy(A, "participant_id", *extra).agg(*[first.alias(n) for n, (first, _) in measures.items()])
    return with_name(partial, people).groupBy(A, "sender", *extra).agg(
        *[merge(n).alias(n) for n, (_, merge) in measures.items()]
    )


def median_per_sender(df: DataFrame, people: DataFrame, out: str, pid: str = "participant_id") -> DataFrame:
    """Median reply minutes per display name."""
    gaps = (
        df.where("reply_gap_seconds IS NOT NULL").groupBy(A, pid, "reply_gap_seconds").agg(count().alias("_w"))
    )
    med = exact_median(with_name(gaps, people, pid), [A, "sender"], "reply_gap_seconds", "_m", weight="_w")
    return med.select(A, "sender", (F.col("_m") / 60.0).alias(out))


def top(df: DataFrame, k: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every archive; Spark limits each task before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(A).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def minutes_between(start, end) -> Column:
    """Minute borders crossed, not whole minutes."""
    minute = F.lit(60_000_000)
    return (F.floor(micros(end) / minute) - F.floor(micros(start) / minute)).cast("long")


def leaderboard(messages: DataFrame, people: DataFrame) -> DataFrame:
    rows = talk(messages)
    totals = per_sender(rows, people, {
        "messages": (count(), F.sum),
        "words": (F.sum("word_count"), F.sum),
        "initiations": (F.count_if("is_session_start"), F.sum),
        "media_sent": (F.count_if(F.col("msg_type") == "media"), F.sum),
        "questions": (F.count_if("is_question"), F.sum),
        "emojis": (F.sum("emoji_count"), F.sum),
        "links": (F.count_if("has_url"), F.sum),
        "_gaps": (F.sum(gap_micros()), F.sum),
        "_replies": (F.count("reply_gap_seconds"), F.sum),
        "first_seen": (F.min("ts"), F.min),
        "last_seen": (F.max("ts"), F.max),
    })
    everyone = rows.groupBy(A).agg(count().alias("_all"))
    return (
        totals.join(everyone, A)
        .join(median_per_sender(rows, people, "median_reply_min"), [A, "sender"], "left")
        .select(
            A, "sender", "messages", (100.0 * F.col("messages") / F.col("_all")).alias("pct"), "words",
            (F.col("words") / F.col("messages")).alias("avg_words"), "initiations", "media_sent",
            "questions", "emojis", "links",
            (F.col("_gaps") / F.nullif("_replies", F.lit(0)) / 1_000_000 / 60.0).alias("avg_reply_min"),
            "median_reply_min", "first_seen", "last_seen",
        )
    )


def activity_heatmap(messages: DataFrame) -> DataFrame:
    return talk(messages).groupBy(A, "weekday", "hour").agg(count().alias("messages"))


def heatmap_grid(messages: DataFrame) -> DataFrame:
    """Every one of the 7 x 24 cells, with its share of the archive's fullest cell."""
    counts = activity_heatmap(messages)
    cells = (
        counts.groupBy(A).agg(F.max("messages").alias("_max"))
        .withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    )
    filled = cells.join(counts, [A, "weekday", "hour"], "left").fillna(0, ["messages"])
    return filled.withColumn("share", F.col("messages") / F.greatest("_max", F.lit(1))).drop("_max")


def timeline(messages: DataFrame, people: DataFrame, granularity: str = "month") -> DataFrame:
    unit = granularity if granularity in ("day", "week", "month") else "month"
    rows = talk(messages).withColumn("period", F.date_trunc(unit, "date").cast("date"))
    return per_sender(rows, people, {"messages": (count(), F.sum)}, ["period"])


def hourly_distribution(messages: DataFrame, people: DataFrame) -> DataFrame:
    return per_sender(talk(messages), people, {"messages": (count(), F.sum)}, ["hour"])


def pivot_senders(counts: DataFrame, axis: str, senders: list[str] | None = None) -> DataFrame:
    """One row per ``axis`` value: a column per given sender, or a sender -> count map."""
    grouped = counts.groupBy(A, axis)
    if senders is not None:
        return grouped.pivot("sender", senders).agg(F.sum("messages"))
    entries = F.sort_array(F.collect_list(F.struct("sender", "messages")))
    return grouped.agg(F.map_from_entries(entries).alias("by_sender"))


def timeline_pivot(messages: DataFrame, people: DataFrame, granularity: str = "month",
                   senders: list[str] | None = None) -> DataFrame:
    return pivot_senders(timeline(messages, people, granularity), "period", senders)


def hourly_pivot(messages: DataFrame, people: DataFrame, senders: list[str] | None = None) -> DataFrame:
    """All 24 hours of every archive; hours without messages have no counts."""
    wide = pivot_senders(hourly_distribution(messages, people), "hour", senders)
    hours = (
        messages.select(A).distinct()
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    )
    return hours.join(wide, [A, "hour"], "left")


def initiators(messages: DataFrame, people: DataFrame) -> DataFrame:
    return per_sender(talk(messages).where("is_session_start"), people, {"initiations": (count(), F.sum)})


def initiators_at(segmented: DataFrame, people: DataFrame) -> DataFrame:
    """``segmented`` comes from ``sessions_at``."""
    return per_sender(segmented.where("is_start"), people, {"initiations": (count(), F.sum)})


def enders(messages: DataFrame, people: DataFrame) -> DataFrame:
    last = talk(messages).groupBy(A, "session_id").agg(
        F.max_by("participant_id", F.struct("ts", "msg_id")).alias("participant_id")
    )
    return per_sender(last, people, {"conversations_ended": (count(), F.sum)})


def longest_conversations(messages: DataFrame, k: int = 10) -> DataFrame:
    sizes = talk(messages).groupBy(A, "session_id").agg(
        count().alias("n"), F.min("ts").alias("started"), F.max("ts").alias("_ended")
    )
    return top(sizes, k, [F.desc("n"), F.asc("session_id")]).select(
        A, "rank", "session_id", "n", "started", minutes_between("started", "_ended").alias("duration_min")
    )


def response_matrix(messages: DataFrame, people: DataFrame, min_replies: int = 3, k: int = 100) -> DataFrame:
    gaps = (
        talk(messages).where("reply_gap_seconds IS NOT NULL")
        .groupBy(A, "prev_participant_id", "participant_id", "reply_gap_seconds").agg(count().alias("_w"))
    )
    named = with_name(with_name(gaps, people, "prev_participant_id", "responding_to"),
                      people, "participant_id", "responder")
    pair = [A, "responding_to", "responder"]
    often = named.groupBy(*pair).agg(F.sum("_w").alias("replies")).where(F.col("replies") >= min_replies)
    listed = top(often, k, [F.desc("replies"), F.asc("responding_to"), F.asc("responder")])
    med = exact_median(named, pair, "reply_gap_seconds", "_m", weight="_w")
    return listed.join(med, pair).select(*pair, "replies", (F.col("_m") / 60.0).alias("median_min"))


def media_by_kind(media: DataFrame) -> DataFrame:
    status = F.col("status")
    return media.groupBy(A, "kind").agg(
        count().alias("files"), F.count_if(status == "done").alias("described"),
        F.count_if(status == "error").alias("failed"), F.count_if(status == "skipped").alias("skipped"),
        (F.sum("size_bytes") / 1048576.0).alias("total_mb"),
    )


def media_by_sender(named_media: DataFrame) -> DataFrame:
    return named_media.where("sender IS NOT NULL").groupBy(A, "sender", "kind").agg(count().alias("files"))


def top_words(messages: DataFrame, people: DataFrame, k: int = 60, min_length: int = 4,
              min_uses: int = 5) -> DataFrame:
    # ASCII white space splits, then only a-z, 0-9 and the apostrophe stay.
    words = talk(messages).where("msg_type = 'text'").select(
        A, "participant_id", F.explode(F.split(F.lower("text"), r"[\t\n\f\r ]+")).alias("w")
    )
    per_person = (
        words.select(A, "participant_id", F.regexp_replace("w", "[^a-z0-9']", "").alias("word"))
        .where(F.length("word") >= min_length)
        .groupBy(A, "participant_id", "word").agg(count().alias("uses"))
    )
    merged = with_name(per_person, people).groupBy(A, "word", "sender").agg(F.sum("uses").alias("uses"))
    uses = (
        merged.groupBy(A, "word").agg(F.sum("uses").alias("uses"), count().alias("used_by"))
        .where(F.col("uses") >= min_uses)
    )
    return top(uses, k, [F.desc("uses"), F.asc("word")])


def longest_messages(messages: DataFrame, people: DataFrame, k: int = 10, preview: int = 300) -> DataFrame:
    """The longest texts by words: their first ``preview`` characters, and ``chars``, how many there are."""
    texts = talk(messages).where("msg_type = 'text'").select(
        A, "participant_id", "msg_id", "ts", "word_count", F.substring("text", 1, preview).alias("preview"),
        F.length("text").cast("long").alias("chars")
    )
    best = top(texts, k, [F.desc("word_count"), F.asc("msg_id")])
    return with_name(best, people).drop("participant_id")


def busiest_days(messages: DataFrame, k: int = 10) -> DataFrame:
    days = talk(messages).groupBy(A, "date").agg(count().alias("messages"))
    return top(days, k, [F.desc("messages"), F.asc("date")])


def longest_streaks(messages: DataFrame, k: int = 5) -> DataFrame:
    """Runs of consecutive active dates: such dates share (date - rank)."""
    days = talk(messages).select(A, "date").distinct()
    by_date = Window.partitionBy(A).orderBy("date")  # a few hundred rows per year and archive
    runs = days.withColumn("_run", F.date_sub("date", F.row_number().over(by_date)))
    streaks = runs.groupBy(A, "_run").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), count().alias("days")
    ).drop("_run")
    return top(streaks, k, [F.desc("days"), F.asc("start_date")])


def longest_silences(messages: DataFrame, people: DataFrame, k: int = 10) -> DataFrame:
    gaps = talk(messages).where("gap_seconds IS NOT NULL").select(
        A, "participant_id", "msg_id", F.col("ts").alias("resumed_at"), "gap_seconds"
    )
    best = top(gaps, k, [F.desc("gap_seconds"), F.asc("msg_id")])
    return with_name(best, people).select(
        A, "rank", "resumed_at", "sender", (F.col("gap_seconds") / 86400.0).alias("silent_days")
    )


def emoji_stats(messages: DataFrame, people: DataFrame) -> DataFrame:
    sums = per_sender(talk(messages), people, {
        "emojis": (F.sum("emoji_count"), F.sum), "messages": (count(), F.sum),
    })
    return sums.withColumn("per_message", F.col("emojis") / F.col("messages"))


def overview(messages: DataFrame) -> DataFrame:
    """Headline numbers per archive; distinct values are counted from small groups."""
    rows = talk(messages)
    head = rows.groupBy(A).agg(count().alias("total_messages"), F.min("ts").alias("first_message"),
                               F.max("ts").alias("last_message"))

    def distinct(col, name):
        seen = rows.where(F.col(col).isNotNull()).groupBy(A, col).agg(F.lit(1).alias("_one"))
        return seen.groupBy(A).agg(F.count(F.lit(1)).alias(name))

    for col, name in (("participant_id", "participant_count"), ("date", "active_days"),
                      ("session_id", "session_count")):
        head = head.join(distinct(col, name), A, "left")
    return head.fillna(0, ["participant_count", "active_days", "session_count"])


def overview_people(messages: DataFrame, people: DataFrame) -> DataFrame:
    sums = per_sender(talk(messages), people, {
        "messages": (count(), F.sum), "initiations": (F.count_if("is_session_start"), F.sum),
        "media_sent": (F.count_if(F.col("msg_type") == "media"), F.sum), "_words": (F.sum("word_count"), F.sum),
    })
    return sums.withColumn("avg_words", F.col("_words") / F.col("messages")).drop("_words")


def overview_media(media: DataFrame) -> DataFrame:
    return media.groupBy(A, "kind").agg(
        count().alias("files"), F.count_if(F.col("status") == "done").alias("described")
    )


def dashboard(messages: DataFrame, people: DataFrame, media: DataFrame, named_media: DataFrame) -> dict[str, DataFrame]:
    """All reports by name, lazily; ask for the ones you show."""
    return {
        "leaderboard": leaderboard(messages, people),
        "heatmap": activity_heatmap(messages),
        "timeline": timeline(messages, people),
        "hourly": hourly_distribution(messages, people),
        "initiators": initiators(messages, people),
        "enders": enders(messages, people),
        "longest_conversations": longest_conversations(messages),
        "responses": response_matrix(messages, people),
        "media_by_kind": media_by_kind(media),
        "media_by_sender": media_by_sender(named_media),
        "top_words": top_words(messages, people),
        "longest_messages": longest_messages(messages, people),
        "busiest_days": busiest_days(messages),
        "longest_streaks": longest_streaks(messages),
        "longest_silences": longest_silences(messages, people),
        "emoji": emoji_stats(messages, people),
    }


def as_long_table(sections: dict[str, tuple[DataFrame, Column, str]]) -> DataFrame:
    """Union of (section, archive, key, value) rows, one numeric value per section."""
    out = None
    for name, (df, key, value) in sections.items():
        part = df.select(F.lit(name).alias("section"), A, key.cast("string").alias("key"),
                         F.col(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
