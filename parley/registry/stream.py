"""Ordered stream, views and dashboard reports, with their SQL twins."""

from pyspark.sql import functions as F

from parley.operators import sessions as S
from parley.operators.ordered import with_time_slices
from parley.operators.views import v_media, v_messages, v_searchable
from parley.plans import adhoc
from parley.plans import reports as P
from parley.registry import sqltext as Q
from parley.registry.core import query
from parley.sources import adapters

A = "archive_id"

# --- ordered stream -------------------------------------------------------------------


@query("order_messages", f"WITH {Q.RAW_E} SELECT archive_id, line_no, row_number() OVER (PARTITION BY archive_id ORDER BY ts, line_no) - 1 AS msg_id FROM raw")
def _(w):
    raw = adapters.events_as_messages(w.spark, w.dir)
    return S.order_messages(raw).select(A, "line_no", "msg_id")


def _streamed(w, *cols):
    raw = adapters.events_as_messages(w.spark, w.dir)
    return S.stream_features(S.tag_participants(raw), 1.0).select(A, "msg_id", *cols)


@query("gap_seconds", Q.E + "SELECT archive_id, msg_id, gap AS gap_seconds FROM m")
def _(w):
    return _streamed(w, "gap_seconds")


@query("sessionize", Q.E + "SELECT archive_id, msg_id, session_id, is_start AS is_session_start FROM m")
def _(w):
    return _streamed(w, "session_id", "is_session_start")


@query("reply_gap", Q.E + "SELECT archive_id, msg_id, ppid AS prev_participant_id, reply AS reply_gap_seconds FROM m")
def _(w):
    return _streamed(w, "prev_participant_id", "reply_gap_seconds")


_SESSIONS_AT = Q.E + """SELECT archive_id, msg_id, gap IS NULL OR gap > 7200 AS is_start,
    CAST(sum(CASE WHEN gap IS NULL OR gap > 7200 THEN 1 ELSE 0 END) OVER (
        PARTITION BY archive_id ORDER BY msg_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM m"""


@query("sessions_at", _SESSIONS_AT)
def _(w):
    return S.sessions_at(w.events.messages, 2.0).select(A, "msg_id", "is_start", "session_no")


@query("sessions_at_sql", _SESSIONS_AT)
def _(w):
    # a session of its own: the caller's views and functions stay as they are
    session = adhoc.publish(w.spark, None, {"messages": w.events.messages})
    return session.sql("SELECT archive_id, msg_id, is_start, session_no FROM sessions_at(2.0D)")


@query("time_slices", f"""WITH {Q.RAW_E} SELECT archive_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS slice_hour, count(*) AS messages
    FROM raw GROUP BY ALL""")
def _(w):
    raw = adapters.events_as_messages(w.spark, w.dir)
    sliced, keys, _ = with_time_slices(raw, [A])
    return sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("messages")).groupBy(
        A, F.col("_hour").alias("slice_hour")).agg(F.sum("messages").alias("messages"))


# --- views ----------------------------------------------------------------------------


@query("v_messages", Q.E + """SELECT archive_id, msg_id, ts, sender, sender AS sender_raw, pid AS participant_id, text, msg_type,
    attachment, char_count, word_count, emoji_count, has_url, is_question, d AS date, hour, weekday, year_month,
    session_id, is_start AS is_session_start, gap AS gap_seconds, ppid AS prev_participant_id, reply AS reply_gap_seconds FROM m""")
def _(w):
    return w.named(w.events).drop("dedup_key", "line_no")


@query("v_media", Q.E_MEDIA + "SELECT archive_id, media_id, msg_id, filename, kind, size_bytes, status, description, ts, d AS date, sender, caption FROM media")
def _(w):
    return w.named_media.select(A, "media_id", "msg_id", "filename", "kind", "size_bytes", "status", "description", "ts", "date", "sender", "caption")


@query("v_searchable", Q.CONTENT + "SELECT archive_id, msg_id, ts, d AS date, hour, weekday, sender, msg_type, content FROM content")
def _(w):
    return v_searchable(w.events.messages, w.events.participants, w.media).drop("session_id")


# --- dashboard reports ----------------------------------------------------------------

_LEADERBOARD = """SELECT archive_id, sender, count(*) AS messages,
    100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY archive_id) AS pct,
    CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(word_count) AS DOUBLE) / count(*) AS avg_words,
    count(*) FILTER (is_start) AS initiations, count(*) FILTER (msg_type = 'media') AS media_sent,
    count(*) FILTER (is_question) AS questions, CAST(sum(emoji_count) AS BIGINT) AS emojis,
    count(*) FILTER (has_url) AS links,
    CAST(sum(CAST(round(reply * 1000000) AS BIGINT)) AS DOUBLE) / count(reply) / 1000000 / 60.0::DOUBLE AS avg_reply_min,
    median(reply) / 60.0::DOUBLE AS median_reply_min, min(ts) AS first_seen, max(ts) AS last_seen
FROM m GROUP BY archive_id, sender"""


@query("leaderboard", Q.E + _LEADERBOARD)
def _(w):
    return P.leaderboard(w.events.messages, w.events.participants)


@query("activity_heatmap", Q.E + "SELECT archive_id, weekday, hour, count(*) AS messages FROM m GROUP BY ALL")
def _(w):
    return P.activity_heatmap(w.events.messages)


@query("heatmap_grid", Q.E + """, c AS (SELECT archive_id, weekday, hour, count(*) AS n FROM m GROUP BY ALL),
top AS (SELECT archive_id, max(n) AS mx FROM c GROUP BY ALL),
cells AS (SELECT archive_id, mx, CAST(wd AS INT) AS weekday, CAST(h AS INT) AS hour FROM top, range(7) a(wd), range(24) b(h))
SELECT archive_id, weekday, hour, coalesce(n, 0) AS messages, CAST(coalesce(n, 0) AS DOUBLE) / mx AS share
FROM cells LEFT JOIN c USING (archive_id, weekday, hour)""")
def _(w):
    return P.heatmap_grid(w.events.messages)


def _timeline_sql(unit):
    return Q.E + f"SELECT archive_id, CAST(date_trunc('{unit}', ts) AS DATE) AS period, sender, count(*) AS messages FROM m GROUP BY ALL"


@query("timeline", _timeline_sql("month"))
def _(w):
    return P.timeline(w.events.messages, w.events.participants, "fortnight")


@query("timeline_week", _timeline_sql("week"))
def _(w):
    return P.timeline(w.events.messages, w.events.participants, "week")


@query("timeline_day", _timeline_sql("day"))
def _(w):
    return P.timeline(w.events.messages, w.events.participants, "day")


def _flat(df):
    pairs = F.transform(F.array_sort(F.map_entries("by_sender")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.withColumn("by_sender", F.coalesce(F.array_join(pairs, ";"), F.lit("")))


_FLAT = "coalesce(string_agg(sender || '=' || messages, ';' ORDER BY sender), '') AS by_sender"


@query("timeline_pivot", Q.E + f""", t AS (SELECT archive_id, CAST(date_trunc('week', ts) AS DATE) AS period, sender, count(*) AS messages FROM m GROUP BY ALL)
SELECT archive_id, period, {_FLAT} FROM t GROUP BY ALL""")
def _(w):
    return _flat(P.timeline_pivot(w.events.messages, w.events.participants, "week"))


@query("timeline_pivot_wide", Q.DL + """SELECT archive_id, CAST(date_trunc('week', ts) AS DATE) AS period,
    nullif(count(*) FILTER (sender = 'de'), 0) AS de, nullif(count(*) FILTER (sender = 'en'), 0) AS en,
    nullif(count(*) FILTER (sender = 'es'), 0) AS es, nullif(count(*) FILTER (sender = 'fr'), 0) AS fr
FROM m GROUP BY ALL""")
def _(w):
    return P.timeline_pivot(w.by_lang.messages, w.by_lang.participants, "week", ["de", "en", "es", "fr"])


@query("hourly_distribution", Q.E + "SELECT archive_id, hour, sender, count(*) AS messages FROM m GROUP BY ALL")
def _(w):
    return P.hourly_distribution(w.events.messages, w.events.participants)


@query("hourly_pivot", Q.DL + f""", t AS (SELECT archive_id, hour, sender, count(*) AS messages FROM m GROUP BY ALL),
hours AS (SELECT DISTINCT archive_id, CAST(h AS INT) AS hour FROM m, range(24) r(h))
SELECT archive_id, hour, {_FLAT} FROM hours LEFT JOIN t USING (archive_id, hour) GROUP BY ALL""")
def _(w):
    return _flat(P.hourly_pivot(w.by_lang.messages, w.by_lang.participants))


@query("initiators", Q.E + "SELECT archive_id, sender, count(*) AS initiations FROM m WHERE is_start GROUP BY ALL")
def _(w):
    return P.initiators(w.events.messages, w.events.participants)


@query("initiators_at", Q.E + "SELECT archive_id, sender, count(*) AS initiations FROM m WHERE gap IS NULL OR gap > 7200 GROUP BY ALL")
def _(w):
    return P.initiators_at(S.sessions_at(w.events.messages, 2.0), w.events.participants)


@query("enders", Q.E + """SELECT archive_id, sender, count(*) AS conversations_ended FROM (
    SELECT archive_id, sender, row_number() OVER (PARTITION BY archive_id, session_id ORDER BY ts DESC, msg_id DESC) AS rn FROM m)
    WHERE rn = 1 GROUP BY ALL""")
def _(w):
    return P.enders(w.events.messages, w.events.participants)


@query("longest_conversations", Q.E + Q.top("""SELECT archive_id, session_id, count(*) AS n, min(ts) AS started,
    date_diff('minute', min(ts), max(ts)) AS duration_min FROM m GROUP BY ALL""", 10, "n DESC, session_id",
    "archive_id, rank, session_id, n, started, duration_min"))
def _(w):
    return P.longest_conversations(w.events.messages)


@query("response_matrix", Q.E + Q.top("""SELECT archive_id, substr(ppid, 6) AS responding_to, sender AS responder, count(*) AS replies,
    median(reply) / 60.0::DOUBLE AS median_min FROM m WHERE reply IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""", 100,
    "replies DESC, responding_to, responder", "archive_id, responding_to, responder, replies, median_min"))
def _(w):
    return P.response_matrix(w.events.messages, w.events.participants)


@query("media_by_kind", Q.E_MEDIA + """SELECT archive_id, kind, count(*) AS files, count(*) FILTER (status = 'done') AS described,
    count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
    CAST(sum(size_bytes) AS DOUBLE) / 1048576.0::DOUBLE AS total_mb FROM media GROUP BY ALL""")
def _(w):
    return P.media_by_kind(w.media)


@query("media_by_sender", Q.E_MEDIA + "SELECT archive_id, sender, kind, count(*) AS files FROM media GROUP BY ALL")
def _(w):
    return P.media_by_sender(w.named_media)


@query("top_words", Q.DM + Q.top("""SELECT archive_id, w AS word, count(*) AS uses, count(DISTINCT sender) AS used_by FROM (
    SELECT archive_id, sender, regexp_replace(w0, '[^a-z0-9'']', '', 'g') AS w FROM (
        SELECT archive_id, sender, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w0 FROM m))
    WHERE length(w) >= 4 GROUP BY ALL HAVING count(*) >= 5""", 60, "uses DESC, word"))
def _(w):
    return P.top_words(w.by_source.messages, w.by_source.participants)


@query("longest_messages", Q.DM + Q.top("""SELECT archive_id, msg_id, ts, word_count, left(text, 300) AS preview, length(text) AS chars, sender FROM m""",
    10, "word_count DESC, msg_id"))
def _(w):
    return P.longest_messages(w.by_source.messages, w.by_source.participants)


@query("busiest_days", Q.E + Q.top("SELECT archive_id, d AS date, count(*) AS messages FROM m GROUP BY ALL", 10, "messages DESC, date"))
def _(w):
    return P.busiest_days(w.events.messages)


@query("longest_streaks", Q.E + Q.top("""SELECT archive_id, min(d) AS start_date, max(d) AS end_date, count(*) AS days FROM (
    SELECT archive_id, d, d - CAST(row_number() OVER (PARTITION BY archive_id ORDER BY d) AS INT) AS grp
    FROM (SELECT DISTINCT archive_id, d FROM m)) GROUP BY archive_id, grp""", 5, "days DESC, start_date"))
def _(w):
    return P.longest_streaks(w.events.messages)


_SILENCES = """SELECT archive_id, ts AS resumed_at, sender, gap / 86400.0::DOUBLE AS silent_days, gap, msg_id FROM m WHERE gap IS NOT NULL"""


@query("longest_silences", Q.E + Q.top(_SILENCES, 10, "gap DESC, msg_id", "archive_id, rank, resumed_at, sender, silent_days"))
def _(w):
    return P.longest_silences(w.events.messages, w.events.participants)


@query("emoji_stats", Q.DM + """SELECT archive_id, sender, CAST(sum(emoji_count) AS BIGINT) AS emojis, count(*) AS messages,
    CAST(sum(emoji_count) AS DOUBLE) / count(*) AS per_message FROM m GROUP BY ALL""")
def _(w):
    return P.emoji_stats(w.by_source.messages, w.by_source.participants)


@query("overview", Q.E + """SELECT archive_id, count(*) AS total_messages, min(ts) AS first_message, max(ts) AS last_message,
    count(DISTINCT pid) AS participant_count, count(DISTINCT d) AS active_days, count(DISTINCT session_id) AS session_count
FROM m GROUP BY ALL""")
def _(w):
    return P.overview(w.events.messages)


@query("overview_people", Q.E + """SELECT archive_id, sender, count(*) AS messages, count(*) FILTER (is_start) AS initiations,
    count(*) FILTER (msg_type = 'media') AS media_sent, CAST(sum(word_count) AS DOUBLE) / count(*) AS avg_words FROM m GROUP BY ALL""")
def _(w):
    return P.overview_people(w.events.messages, w.events.participants)


@query("overview_media", Q.E_MEDIA + "SELECT archive_id, kind, count(*) AS files, count(*) FILTER (status = 'done') AS described FROM media GROUP BY ALL")
def _(w):
    return P.overview_media(w.media)




_DASHBOARD = f""", lead AS ({_LEADERBOARD}),
silence AS ({Q.top(_SILENCES, 10, "gap DESC, msg_id")}),
conv AS ({Q.top("SELECT archive_id, session_id, count(*) AS n FROM m GROUP BY ALL", 10, "n DESC, session_id")}),
days AS ({Q.top("SELECT archive_id, d, count(*) AS n FROM m GROUP BY ALL", 10, "n DESC, d")})
SELECT 'leaderboard' AS section, archive_id, sender AS key, CAST(messages AS DOUBLE) AS value FROM lead
UNION ALL SELECT 'reply_minutes', archive_id, sender, median_reply_min FROM lead
UNION ALL SELECT 'heatmap', archive_id, weekday || ' ' || hour, CAST(count(*) AS DOUBLE) FROM m GROUP BY archive_id, weekday, hour
UNION ALL SELECT 'timeline', archive_id, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) || ' ' || sender, CAST(count(*) AS DOUBLE) FROM m GROUP BY archive_id, date_trunc('month', ts), sender
UNION ALL SELECT 'hourly', archive_id, hour || ' ' || sender, CAST(count(*) AS DOUBLE) FROM m GROUP BY archive_id, hour, sender
UNION ALL SELECT 'initiators', archive_id, sender, CAST(count(*) AS DOUBLE) FROM m WHERE is_start GROUP BY archive_id, sender
UNION ALL SELECT 'longest_conversations', archive_id, CAST(session_id AS VARCHAR), CAST(n AS DOUBLE) FROM conv
UNION ALL SELECT 'media_by_kind', archive_id, kind, CAST(count(*) AS DOUBLE) FROM media GROUP BY archive_id, kind
UNION ALL SELECT 'busiest_days', archive_id, CAST(d AS VARCHAR), CAST(n AS DOUBLE) FROM days
UNION ALL SELECT 'longest_silences', archive_id, sender || ' ' || rank, silent_days FROM silence
UNION ALL SELECT 'emoji', archive_id, sender, CAST(sum(emoji_count) AS DOUBLE) FROM m GROUP BY archive_id, sender"""


@query("dashboard", Q.E_MEDIA + _DASHBOARD)
def _(w):
    d = P.dashboard(w.events.messages, w.events.participants, w.media, w.named_media)
    both = lambda a, b: F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string"))
    return P.as_long_table({
        "leaderboard": (d["leaderboard"], F.col("sender"), "messages"),
        "reply_minutes": (d["leaderboard"], F.col("sender"), "median_reply_min"),
        "heatmap": (d["heatmap"], both("weekday", "hour"), "messages"),
        "timeline": (d["timeline"], both("period", "sender"), "messages"),
        "hourly": (d["hourly"], both("hour", "sender"), "messages"),
        "initiators": (d["initiators"], F.col("sender"), "initiations"),
        "longest_conversations": (d["longest_conversations"], F.col("session_id"), "n"),
        "media_by_kind": (d["media_by_kind"], F.col("kind"), "files"),
        "busiest_days": (d["busiest_days"], F.col("date"), "messages"),
        "longest_silences": (d["longest_silences"], both("sender", "rank"), "silent_days"),
        "emoji": (d["emoji"], F.col("sender"), "emojis"),
    })
