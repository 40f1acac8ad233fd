"""Scored sessions, awards and rhythms, with their SQL twins."""

from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.transcript import session_excerpts
from parley.plans import insights as I
from parley.plans import reports as P
from parley.registry import sqltext as Q
from parley.registry.core import PROSE_RULES, PROSE_WORDS, query

A = "archive_id"


def _stats_sql(words):
    hit = {n: Q.contains_any("text", w) for n, w in words.items()}
    return f""", st AS (SELECT archive_id, session_id, count(DISTINCT pid) AS people, min(ts) AS started, max(ts) AS ended,
    max(word_count) AS longest_message, count(*) AS messages, CAST(sum(emoji_count) AS BIGINT) AS emojis,
    count(*) FILTER (msg_type = 'text') AS text_messages, count(*) FILTER (is_question) AS questions,
    count(*) FILTER ({hit['laugh']}) AS laughs, count(*) FILTER ({hit['heat']}) AS heat,
    count(*) FILTER ({hit['apology']}) AS apologies, count(*) FILTER ({hit['reflective']}) AS reflective,
    count(*) FILTER (hour < 5) AS night_messages, date_diff('minute', min(ts), max(ts)) AS minutes,
    CAST(sum(word_count) AS DOUBLE) / count(*) AS avg_words, median(reply) AS median_reply_seconds
    FROM m GROUP BY archive_id, session_id)
"""


def _base_sql(words):
    return f""", base AS (SELECT archive_id, coalesce(nullif(CAST(sum(word_count) AS DOUBLE) / count(*), 0), 1.0) AS avg_words,
    greatest(CAST(count(*) FILTER ({Q.contains_any('text', words['laugh'])}) AS DOUBLE) / count(*), 0.01::DOUBLE) AS laugh_rate,
    CAST(sum(emoji_count) AS DOUBLE) / count(*) AS emoji_rate, count(*) AS text_messages
    FROM m WHERE msg_type = 'text' GROUP BY archive_id)
"""


_STATS = _stats_sql(PROSE_WORDS)
_BASE = _base_sql(PROSE_WORDS)
_SCORED = _STATS + _BASE + """, sc AS (SELECT st.*, base.avg_words AS nw, base.laugh_rate AS nl, CAST(laughs AS DOUBLE) / messages AS laugh_rate,
    CAST(heat AS DOUBLE) / messages AS heat_rate, st.avg_words / base.avg_words AS wordiness FROM st JOIN base USING (archive_id))
"""


@query("session_stats", Q.DL + _STATS + "SELECT * FROM st")
def _(w):
    return I.with_median_reply(I.session_stats(w.by_lang.messages, PROSE_WORDS), w.by_lang.messages)


_EVENT_WORDS = {k: v for k, v in I.VOCABULARY.items()}


@query("session_stats_events", Q.E + _stats_sql(_EVENT_WORDS) + "SELECT * FROM st")
def _(w):
    return I.with_median_reply(I.session_stats(w.events.messages), w.events.messages)


@query("baseline", Q.DL + _BASE + "SELECT * FROM base")
def _(w):
    return I.baseline(w.by_lang.messages, PROSE_WORDS["laugh"])


_HEAD = "archive_id, rank, session_id, messages, people, started, minutes"
MOMENT_SQL = {
    "funny": lambda k: Q.top("SELECT *, laugh_rate / nl AS times_normal FROM sc WHERE messages >= 5 AND laughs >= 1 AND laugh_rate > nl * 1.0::DOUBLE",
                             k, "times_normal DESC, laughs DESC, session_id", _HEAD + ", laughs, emojis, laugh_rate, times_normal"),
    "argument": lambda k: Q.top("""SELECT *, heat_rate * 10 + apologies * 1.5::DOUBLE + wordiness - laugh_rate * 12 AS tension FROM sc
        WHERE messages >= 5 AND people BETWEEN 2 AND 5 AND (heat >= 2 OR apologies >= 2) AND laugh_rate < nl""", k, "tension DESC, session_id",
        _HEAD + ", heat, apologies, laughs, avg_words, longest_message, heat_rate, wordiness AS wordiness_vs_normal, tension"),
    "deep": lambda k: Q.top("""SELECT *, wordiness * 3 + reflective * 1.5::DOUBLE + longest_message / 20.0::DOUBLE - laugh_rate * 15 AS depth FROM sc
        WHERE messages >= 8 AND people <= 5 AND avg_words > nw * 1.0::DOUBLE AND laugh_rate < nl * 1.0::DOUBLE""", k, "depth DESC, session_id",
        _HEAD + ", avg_words, longest_message, reflective, night_messages, wordiness AS wordiness_vs_normal, laugh_rate, depth"),
    "late_night": lambda k: Q.top("SELECT * FROM st WHERE night_messages >= 3", k, "night_messages DESC, messages DESC, session_id",
                                  _HEAD + ", night_messages, avg_words, laughs"),
    "busiest": lambda k: Q.top("SELECT * FROM st", k, "messages DESC, session_id", _HEAD + ", avg_words, laughs, questions"),
}


def _moments(w, kind, tables, k=5):
    rows = tables.messages
    return I.find_moments(kind, I.session_stats(rows, PROSE_WORDS), I.baseline(rows, PROSE_WORDS["laugh"]), k, rules=PROSE_RULES.get(kind))


for _kind in ("funny", "argument", "deep"):
    query(f"moments_{_kind}", Q.DL + _SCORED + MOMENT_SQL[_kind](5))(lambda w, kind=_kind: _moments(w, kind, w.by_lang))
for _kind in ("late_night", "busiest"):
    query(f"moments_{_kind}", Q.E + _STATS + MOMENT_SQL[_kind](5))(lambda w, kind=_kind: _moments(w, kind, w.events))

# Runs of placeholders by one sender become one line; long transcripts keep head and tail.
_LINES = """, t AS (SELECT archive_id, {scope} AS scope, msg_id, ts, sender, trim(content) AS tx,
    starts_with(trim(content), '[') AND ends_with(trim(content), ']') AS held FROM {src} WHERE trim(content) <> ''),
r AS (SELECT *, CASE WHEN held AND lag(held) OVER q AND lag(sender) OVER q = sender THEN 0 ELSE 1 END AS fresh
      FROM t WINDOW q AS (PARTITION BY archive_id, scope ORDER BY msg_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY archive_id, scope ORDER BY msg_id ROWS UNBOUNDED PRECEDING) AS line FROM r),
ln AS (SELECT archive_id, scope, CAST(line AS BIGINT) AS line, min(ts) AS ts, any_value(sender) AS sender, arg_min(tx, msg_id) AS tx,
       count(*) FILTER (held) AS held, count(*) FILTER (NOT held) AS said FROM n GROUP BY archive_id, scope, line),
lt AS (SELECT *, strftime(ts, '%H:%M') || ' ' || sender || ': ' || CASE WHEN held = 1 THEN '(1 attachment)'
       WHEN held > 1 THEN '(' || held || ' attachments)' ELSE tx END AS txt,
       count(*) OVER (PARTITION BY archive_id, scope) AS total FROM ln)
"""
_EXCERPT = """, ex AS (SELECT archive_id, scope AS session_id, string_agg(CASE WHEN total > {lim} AND line = {half} + 1
    THEN '... ' || (total - {lim}) || ' more messages ...' ELSE txt END, chr(10) ORDER BY line) AS excerpt
    FROM lt WHERE total <= {lim} OR line <= {half} + 1 OR line > total - {half} GROUP BY archive_id, scope)
"""


@query("session_excerpt", Q.CONTENT + _LINES.format(scope="session_id", src="content") + _EXCERPT.format(lim=6, half=3) + "SELECT * FROM ex")
def _(w):
    return session_excerpts(w.content, w.content, limit=6)


@query("find_moments", Q.DL + _SCORED + ", found AS (" + MOMENT_SQL["funny"](10) + "), c AS (SELECT *, text AS content FROM m)"
       + _LINES.format(scope="session_id", src="c").replace("trim(content)", Q.stripped("content")) + _EXCERPT.format(lim=24, half=12)
       + "SELECT archive_id, rank, session_id, messages, times_normal, md5(excerpt) AS excerpt_md5 FROM found LEFT JOIN ex USING (archive_id, session_id)")
def _(w):
    rows = w.by_lang.messages
    found = I.find_moments("funny", I.session_stats(rows, PROSE_WORDS), I.baseline(rows, PROSE_WORDS["laugh"]), 10,
                           w.content_of(w.by_lang), PROSE_RULES["funny"])
    return found.select(A, "rank", "session_id", "messages", "times_normal", F.md5("excerpt").alias("excerpt_md5"))


@query("moment_summary", Q.DL + _SCORED + """, f AS (SELECT archive_id, count(*) AS found FROM sc WHERE messages >= 5 AND laughs >= 3
    AND laugh_rate > nl * 1.5::DOUBLE GROUP BY ALL)
    SELECT archive_id, least(coalesce(found, 0), 5) AS found, CASE WHEN coalesce(found, 0) = 0 THEN 'none' ELSE 'some' END AS outcome
    FROM (SELECT DISTINCT archive_id FROM m) LEFT JOIN f USING (archive_id)""")
def _(w):
    found = I.moments_funny(I.session_stats(w.by_lang.messages, PROSE_WORDS), I.baseline(w.by_lang.messages, PROSE_WORDS["laugh"]))
    s = I.moment_summary("funny", found, w.by_lang.messages)
    return s.select(A, "found", F.when(F.col("empty_reason").isNull(), "some").otherwise("none").alias("outcome"))


# --- awards ---------------------------------------------------------------------------


def _award_sql(value, expr, where="true", least=None, direction="DESC", extra="", who="sender"):
    having = f" HAVING count(*) >= {least}" if least else ""
    cols = "archive_id, rank, sender, " + value + "".join(", " + e.rsplit(" AS ", 1)[1] for e in extra.split(" | ") if e)
    more = "".join(", " + e for e in extra.split(" | ") if e)
    return Q.top(f"SELECT archive_id, {who} AS sender, {expr} AS {value}{more} FROM m WHERE {where} GROUP BY archive_id, {who}{having}",
                 3, f"{value} {direction}, sender", cols)


_MEDIAN = "median(reply) / 60.0::DOUBLE"
AWARD_SQL = {
    "night_owl": (Q.E, _award_sql("messages_after_midnight", "count(*)", "hour < 5")),
    "early_bird": (Q.E, _award_sql("messages_before_8am", "count(*)", "hour >= 5 AND hour < 8")),
    "fastest_replier": (Q.E, _award_sql("median_minutes", _MEDIAN, "reply IS NOT NULL", 20, "ASC", "count(*) AS replies")),
    "slowest_replier": (Q.E, _award_sql("median_minutes", _MEDIAN, "reply IS NOT NULL", 20, "DESC", "count(*) AS replies")),
    "biggest_texter": (Q.DM, _award_sql("avg_words", "CAST(sum(word_count) AS DOUBLE) / count(*)", "msg_type = 'text'", 20, extra="max(word_count) AS longest")),
    "emoji_lover": (Q.DM, _award_sql("per_message", "CAST(sum(emoji_count) AS DOUBLE) / count(*)", least=20, extra="CAST(sum(emoji_count) AS BIGINT) AS emojis")),
    "media_sharer": (Q.E, _award_sql("attachments", "count(*)", "msg_type = 'media'")),
    "question_asker": (Q.E, _award_sql("pct_of_their_messages", "100.0::DOUBLE * count(*) FILTER (is_question) / count(*)", least=20, extra="count(*) FILTER (is_question) AS questions")),
    "conversation_starter": (Q.E, _award_sql("conversations_started", "count(*)", "is_start")),
    "longest_monologue": (Q.E, Q.top("""SELECT archive_id, sender, count(*) AS messages_in_a_row, min(ts) AS started FROM (
        SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY msg_id) - row_number() OVER (PARTITION BY archive_id, sender ORDER BY msg_id) AS run FROM m)
        GROUP BY archive_id, sender, run""", 3, "messages_in_a_row DESC, started", "archive_id, rank, sender, messages_in_a_row, started")),
    "link_sharer": (Q.P, _award_sql("links", "count(*)", "has_url")),
    "ghosted_most": (Q.E, _award_sql("median_wait_minutes", _MEDIAN, "reply IS NOT NULL", 20, "DESC", "count(*) AS times", "substr(ppid, 6)")),
}
_AWARD_DATA = {"biggest_texter": "by_source", "emoji_lover": "by_source", "link_sharer": "pages"}

for _name, (_with, _sql) in AWARD_SQL.items():
    def _run(w, name=_name):
        tables = getattr(w, _AWARD_DATA.get(name, "events"))
        return I.AWARDS[name][0](tables.messages, tables.participants)
    query(f"award_{_name}", _with + _sql)(_run)


@query("superlatives", Q.E + " UNION ALL ".join(
    f"SELECT archive_id, '{n}' AS award, rank, sender, CAST({v} AS DOUBLE) AS value FROM ({AWARD_SQL[n][1]})" for n, (_, v) in I.AWARDS.items()))
def _(w):
    return I.superlatives(w.events.messages, w.events.participants)


# --- rhythms --------------------------------------------------------------------------


@query("rhythm_weekday", Q.E + "SELECT archive_id, weekday, count(*) AS messages FROM m GROUP BY ALL")
def _(w):
    return I.rhythm_weekday(w.events.messages)


_QUIET = Q.top("SELECT archive_id, d AS date, count(*) AS messages FROM m GROUP BY ALL", 5, "messages, date")


@query("rhythm_quietest_days", Q.E + _QUIET)
def _(w):
    return I.rhythm_quietest_days(w.events.messages)


@query("rhythm_longest_silences", Q.E + Q.top("""SELECT archive_id, ts AS broken_at, sender, gap / 86400.0::DOUBLE AS days_of_silence, gap, msg_id
    FROM m WHERE gap IS NOT NULL""", 5, "gap DESC, msg_id", "archive_id, rank, broken_at, sender, days_of_silence"))
def _(w):
    return I.rhythm_longest_silences(w.events.messages, w.events.participants)


_MONTHS = Q.top("SELECT archive_id, year_month, count(*) AS messages, count(DISTINCT pid) AS active_people FROM m GROUP BY ALL", 5, "messages DESC, year_month")


@query("rhythm_busiest_months", Q.DM + _MONTHS)
def _(w):
    return I.rhythm_busiest_months(w.by_source.messages)


_REPORT = {"funny": "times_normal", "argument": "tension", "deep": "depth", "late_night": "night_messages", "busiest": "messages"}


@query("insights_report", Q.DL + _SCORED + """SELECT 'baseline' AS section, archive_id, 'avg_words' AS key, avg_words AS value FROM base
    UNION ALL SELECT 'weekday', archive_id, CAST(weekday AS VARCHAR), CAST(count(*) AS DOUBLE) FROM m GROUP BY archive_id, weekday
    UNION ALL SELECT 'quietest_days', archive_id, CAST(date AS VARCHAR), CAST(messages AS DOUBLE) FROM (""" + _QUIET + """)
    UNION ALL SELECT 'busiest_months', archive_id, year_month, CAST(messages AS DOUBLE) FROM (""" + _MONTHS + ") " + " ".join(
    f"UNION ALL SELECT '{kind}', archive_id, CAST(session_id AS VARCHAR), CAST({value} AS DOUBLE) FROM ({MOMENT_SQL[kind](3)})" for kind, value in _REPORT.items()))
def _(w):
    r = I.insights_report(w.by_lang.messages, w.by_lang.participants, PROSE_WORDS, PROSE_RULES)
    session = F.col("session_id")
    return P.as_long_table({
        "baseline": (r["baseline"], F.lit("avg_words"), "avg_words"),
        "weekday": (r["weekday"], F.col("weekday"), "messages"),
        "quietest_days": (r["quietest_days"], F.col("date"), "messages"),
        "busiest_months": (r["busiest_months"], F.col("year_month"), "messages"),
        **{kind: (r[kind], session, value) for kind, value in _REPORT.items()},
    })


# --- scalar features ------------------------------------------------------------------

_TEXTS = "SELECT 'c' AS src, conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 'd', doc_id, text FROM documents"


def _texts(w):
    c = w.table("conversations").selectExpr("'c' AS src", "conv_id * 1000 + turn AS id", "text")
    return c.unionByName(w.table("documents").selectExpr("'d' AS src", "doc_id AS id", "text"))


def _feature(name, column, sql):
    @query(name, f"SELECT src, id, {sql} AS {name} FROM ({_TEXTS})")
    def _(w):
        return _texts(w).select("src", "id", column().alias(name))


_feature("char_count", lambda: X.char_count("text"), "length(text)")
_feature("word_count", lambda: X.word_count("text"), Q.word_count())
_feature("emoji_count", lambda: X.emoji_count("text"), f"len(regexp_extract_all(text, '{Q.EMOJI}'))")
_feature("is_question", lambda: X.is_question("text"), Q.question())
_feature("contains_any", lambda: X.contains_any("text", X.DEEP + X.PLAN + X.ARGUMENT), Q.contains_any("text", X.DEEP + X.PLAN + X.ARGUMENT))


# The table has few emoji of its own, so every page id also writes some.
@query("emoji_count_pages", f"""SELECT page_id, len(regexp_extract_all(t, '{Q.EMOJI}')) AS emojis FROM (
    SELECT page_id, html || repeat('😂', CAST(page_id % 7 AS INT)) || '☎ ✈ ❤ ⭐ ¦ ©' AS t FROM pages)""")
def _(w):
    told = w.table("pages").select("page_id", F.concat("html", F.expr("repeat('😂', CAST(page_id % 7 AS INT))"), F.lit("☎ ✈ ❤ ⭐ ¦ ©")).alias("t"))
    return told.select("page_id", X.emoji_count("t").alias("emojis"))


@query("has_url", "SELECT page_id, regexp_matches(html, 'https?://\\S+|www\\.\\S+') AS in_html, regexp_matches(regexp_replace(url, '^https?:', ''), 'https?://\\S+|www\\.\\S+') AS in_rest FROM pages")
def _(w):
    return w.table("pages").select("page_id", X.has_url("html").alias("in_html"),
                                   X.has_url(F.regexp_replace("url", "^https?:", "")).alias("in_rest"))


@query("temporal_parts", """SELECT event_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday,
    strftime(ts, '%Y-%m') AS year_month FROM events""")
def _(w):
    from parley.operators.sessions import temporal_parts

    return w.table("events").withColumns(temporal_parts()).select("event_id", "date", "hour", "weekday", "year_month")


@query("filter_time_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-09 00:00:00' AND ts <= TIMESTAMP '2024-01-11 23:59:59'")
def _(w):
    from parley.plans.adhoc import filter_time_range

    return filter_time_range(w.table("events"), "2024-01-09", "2024-01-11").select("event_id", "ts")


@query("sha_fingerprints", f"""SELECT src, id, substr(sha1(lower({Q.stripped("regexp_replace(text, '[" + Q.SPACE + "]+', ' ', 'g')")})), 1, 16) AS fingerprint,
    sha256(text) AS body_hash FROM ({_TEXTS})""")
def _(w):
    return _texts(w).select("src", "id", X.text_fingerprint("text").alias("fingerprint"), X.body_hash("text").alias("body_hash"))


@query("message_features", Q.C + """SELECT archive_id, msg_id, char_count, word_count, emoji_count, has_url, is_question, d AS date, hour, weekday, year_month FROM m""")
def _(w):
    return w.chats.messages.select(A, "msg_id", "char_count", "word_count", "emoji_count", "has_url", "is_question", "date", "hour", "weekday", "year_month")
