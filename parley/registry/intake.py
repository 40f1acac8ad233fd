"""Sources, parsing and record linkage, with their SQL twins."""

import pandas as pd
from pyspark.sql import functions as F

from parley.operators import linkage as L
from parley.operators import parse as T
from parley.operators.media import catalog_columns
from parley.operators.sessions import drop_system
from parley.plans import ingest
from parley.registry import sqltext as Q
from parley.registry.core import query
from parley.sources import adapters, exports, store, zips

A = "archive_id"

# --- exports --------------------------------------------------------------------------


def _zip_exports(batches):
    """One export zip per message: a transcript, an attachment, an entry that tries to escape."""
    import io
    import zipfile

    import pyarrow as pa

    names = ["_chat.txt", "WhatsApp Chat with X.txt", "group.txt"]

    def rows():
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c) for c in ("conv_id", "turn", "role", "text"))):
                conv, turn, role, text = conv.as_py(), turn.as_py(), role.as_py(), text.as_py()
                buffer = io.BytesIO()
                body = f"12/08/2023, 21:14 - {role}: {text}\n"
                encoding = ("utf-8", "utf-8-sig", "utf-16")[turn % 3]
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr(f"export\\{names[turn % 3]}", body.encode(encoding))
                    z.writestr("a.txt", "x")
                    z.writestr("media/IMG-1.jpg", b"x" * (turn + 1))
                    z.writestr("../evil.txt", "x" * 5000)
                    z.writestr("/abs.txt", "x")
                yield f"{conv}-{turn}", buffer.getvalue()

    yield from exports.in_pieces(rows(), pa.schema([("path", pa.string()), ("content", pa.binary())]), lambda r: len(r[1]))


def _exports(w):
    return exports.zip_members(w.table("conversations").mapInArrow(_zip_exports, "path string, content binary"))


_TRANSCRIPT = """CASE turn % 3 WHEN 0 THEN '_chat.txt' WHEN 1 THEN 'WhatsApp Chat with X.txt' ELSE 'group.txt' END"""
_CHAT = "'12/08/2023, 21:14 - ' || role || ': ' || text || chr(10)"
# UTF-16 takes two bytes per code point of this prose, plus the mark.
_SIZE = f"CASE turn % 3 WHEN 0 THEN strlen({_CHAT}) WHEN 1 THEN strlen({_CHAT}) + 3 ELSE 2 * length({_CHAT}) + 2 END"


@query("read_exports", f"""SELECT conv_id || '-' || turn AS export, unnest([{{'name': 'export\\' || {_TRANSCRIPT}, 'member': 'export/' || {_TRANSCRIPT}, 'size': CAST({_SIZE} AS BIGINT)}},
    {{'name': 'a.txt', 'member': 'a.txt', 'size': 1}}, {{'name': 'media/IMG-1.jpg', 'member': 'media/IMG-1.jpg', 'size': turn + 1}},
    {{'name': '../evil.txt', 'member': NULL, 'size': 5000}}, {{'name': '/abs.txt', 'member': NULL, 'size': 1}}], recursive := true) FROM conversations""")
def _(w):
    # Zip writers turn backslashes into slashes on some systems; compare the given name loosely.
    return _exports(w).select("export", "name", "member", "size")


@query("pick_transcript", f"SELECT conv_id || '-' || turn AS export, 'export/' || {_TRANSCRIPT} AS member, CAST(turn % 3 + 1 AS INT) AS tier FROM conversations")
def _(w):
    return exports.pick_transcript(_exports(w).where("NOT unsafe")).select("export", "member", "tier")


@query("decode_transcript", f"""SELECT conv_id || '-' || turn AS file, {_CHAT} AS text,
    CASE turn % 3 WHEN 2 THEN 'utf-16' ELSE 'utf-8-sig' END AS encoding FROM conversations""")
def _(w):
    picked = exports.pick_transcript(_exports(w).where("NOT unsafe")).withColumnRenamed("export", "file")
    return exports.decode_transcript(picked)


@query("export_messages", "SELECT conv_id || '-' || turn AS file, TIMESTAMP '2023-08-12 21:14:00' AS ts, role AS sender, trim(text, ' ' || chr(10)) AS text FROM conversations")
def _(w):
    """From zip to messages in one job."""
    picked = exports.pick_transcript(_exports(w).where("NOT unsafe")).withColumnRenamed("export", "file")
    lines = exports.transcript_lines(exports.decode_transcript(picked))
    return T.parse_lines(lines).select("file", "ts", "sender", "text")


def _bundles(w) -> str:
    """A folder of zips written from the conversations, 25 to each: a transcript, attachments, an entry that tries to escape; some zips are cut off."""
    folder = store.new_table_path(w.spark, "bundles")

    def write(group):
        import io
        import zipfile

        group = group.sort_values(["conv_id", "turn"])
        bundle = int(group["conv_id"].iloc[0]) // 25
        chat = "".join(f"12/08/2023, 21:14 - {role}: {text}\n" for role, text in zip(group["role"], group["text"]))
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("export/_chat.txt", chat.encode("utf-16" if bundle % 3 == 2 else "utf-8"))
            z.writestr("notes.txt", "x")
            for conv, turns in group.groupby("conv_id").size().items():
                z.writestr(f"media/IMG-{conv}.jpg", b"x" * turns)
            z.writestr("../evil.txt", "x" * 5000)
        system, place = exports.file_system(folder)
        system.create_dir(place, recursive=True)
        for name, data in ((f"bundle-{bundle}.zip", buffer.getvalue()), (f"broken-{bundle}.zip", buffer.getvalue()[:40] if bundle % 4 == 1 else None)):
            if data is not None:
                with system.open_output_stream(f"{place}/{name}") as out:
                    out.write(data)
        return pd.DataFrame({"bundle": [bundle]})

    rows = w.table("conversations").where("conv_id is not null").withColumn("bundle", F.expr("conv_id DIV 25"))
    store.materialise(rows.groupBy("bundle").applyInPandas(write, "bundle long"), "written-bundles")
    return folder


_TALK = "'12/08/2023, 21:14 - ' || role || ': ' || text || chr(10)"
_BUNDLED = f"""WITH talk AS (SELECT conv_id // 25 AS bundle, string_agg({_TALK}, '' ORDER BY conv_id, turn) AS chat FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL)"""


@query("read_zip_files", _BUNDLED + """, entries AS (
    SELECT bundle, 'export/_chat.txt' AS name, 'export/_chat.txt' AS member, CASE WHEN bundle % 3 = 2 THEN 2 * length(chat) + 2 ELSE strlen(chat) END AS size FROM talk
    UNION ALL SELECT bundle, 'notes.txt', 'notes.txt', 1 FROM talk UNION ALL SELECT bundle, '../evil.txt', NULL, 5000 FROM talk
    UNION ALL SELECT conv_id // 25, 'media/IMG-' || conv_id || '.jpg', 'media/IMG-' || conv_id || '.jpg', count(*) FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
    SELECT 'bundle-' || bundle || '.zip' AS export, name, member, CAST(size AS BIGINT) AS size, member IS NULL AS unsafe, false AS broken FROM entries
    UNION ALL SELECT 'broken-' || bundle || '.zip', NULL, NULL, NULL, false, true FROM talk WHERE bundle % 4 = 1""")
def _(w):
    """Zips in a folder, listed from their central directories."""
    listed = zips.list_members(w.spark, _bundles(w))
    return listed.select(F.substring_index("export", "/", -1).alias("export"), "name", "member", "size", "unsafe", F.col("error").isNotNull().alias("broken"))


@query("zip_transcripts", _BUNDLED + """, parts AS (SELECT bundle, string_split(rtrim(chat, chr(10)), chr(10)) AS lines FROM talk)
    SELECT 'bundle-' || bundle || '.zip' AS file, CAST(unnest(range(1, len(lines) + 1)) AS BIGINT) AS line_no, unnest(lines) AS line,
        CASE WHEN bundle % 3 = 2 THEN 'utf-16' ELSE 'utf-8-sig' END AS encoding FROM parts
    UNION ALL SELECT 'broken-' || bundle || '.zip', 0, NULL, NULL FROM talk WHERE bundle % 4 = 1""")
def _(w):
    """The transcript lines of zips in a folder; no attachment is unpacked."""
    lines = zips.read_transcripts(w.spark, _bundles(w))
    return lines.select(F.substring_index("file", "/", -1).alias("file"), "line_no", "line", "encoding")


_MEMBER = """CASE length(url) % 4 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN replace(url, '/', '\\\\')
    WHEN 2 THEN regexp_replace(url, '^https?:/', '') ELSE 'x/./../' || url END"""


@query("safe_member_path", """SELECT page_id, CASE length(url) % 4 WHEN 0 THEN rtrim(regexp_replace(url, '^https?://', ''), '/')
    WHEN 1 THEN rtrim(regexp_replace(url, '//', '/'), '/') END AS member FROM pages""")
def _(w):
    return w.table("pages").selectExpr("page_id", f"{_MEMBER} AS name").select("page_id", exports.safe_member_path("name").alias("member"))


_LINES_SQL = f"""SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM (
    SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}])$', ''),
           '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS parts FROM documents WHERE text <> '')"""


@query("scan_text_lines", _LINES_SQL)
def _(w):
    return T.split_lines(w.table("documents").select("doc_id", "text"), ["doc_id"])


@query("scan_media_files", f"""WITH {Q.FILES} SELECT archive_id, path, filename, ext, kind, size_bytes, kind <> 'other' AS readable,
    size_bytes > 18874368 AS needs_upload FROM files""")
def _(w):
    return catalog_columns(adapters.media_files(w.spark, w.dir)).drop("content_hash")


def _attachments(w) -> str:
    """A folder of files written from the pages: some beyond two MiB, some hidden, and a transcript."""
    folder = store.new_table_path(w.spark, "attachments")

    def write(batches):
        system, place = exports.file_system(folder)
        for rows in batches:
            for page, url in zip(rows["page_id"], rows["url"]):
                name = f".hidden-{page}" if page % 100 == 7 else (f"IMG-{page}.jpg", f"VID-{page}.mp4", f"notes-{page}.xyz")[page % 3]
                body = f"{page}|{url}\n".encode() * (60_000 if page % 200 == 0 else 1 + page % 7)
                system.create_dir(f"{place}/{page % 16}", recursive=True)
                with system.open_output_stream(f"{place}/{page % 16}/{name}") as out:
                    out.write(body)
                if page == 0:
                    with system.open_output_stream(f"{place}/_chat.txt") as out:
                        out.write(b"a transcript")
            yield rows[["page_id"]]

    rows = w.table("pages").where("page_id is not null and url is not null").select("page_id", "url")
    store.materialise(rows.mapInPandas(write, "page_id long"), "written-attachments")
    return folder


@query("content_hash", """WITH bodies AS (SELECT page_id, repeat(page_id || '|' || url || chr(10), CASE WHEN page_id % 200 = 0 THEN 60000 ELSE 1 + page_id % 7 END) AS body FROM pages
        WHERE page_id % 100 <> 7 AND url IS NOT NULL)
    SELECT CASE page_id % 3 WHEN 0 THEN 'IMG-' || page_id || '.jpg' WHEN 1 THEN 'VID-' || page_id || '.mp4' ELSE 'notes-' || page_id || '.xyz' END AS filename,
        CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' ELSE 'other' END AS kind, CAST(strlen(body) AS BIGINT) AS size_bytes, page_id % 3 < 2 AS readable,
        sha256(strlen(body) || substr(body, 1, 1048576) || CASE WHEN strlen(body) > 2097152 THEN right(body, 1048576) ELSE '' END) AS content_hash FROM bodies""")
def _(w):
    """Files in a folder, hashed at both ends; the transcript is left out."""
    folder = _attachments(w)
    return exports.scan_media_files(w.spark, folder, f"{folder}/_chat.txt").select("filename", "kind", "size_bytes", "readable", "content_hash")


# --- store ----------------------------------------------------------------------------


@query("write_messages", Q.E + "SELECT archive_id, msg_id, ts, sender, text, session_id FROM m")
def _(w):
    path = store.new_table_path(w.spark, "written")
    cols = w.events.messages.select(A, "msg_id", "ts", "sender", "text", "session_id")
    store.write_messages(cols, path)
    return store.read_messages(w.spark, path, cols.schema)


@query("replace_archive", Q.E + "SELECT archive_id, msg_id, CASE WHEN archive_id = 3 THEN upper(text) ELSE text END AS text FROM m")
def _(w):
    path = store.new_table_path(w.spark, "replaced")
    cols = w.events.messages.select(A, "msg_id", "text")
    store.write_messages(cols, path)
    store.replace_archive(cols.where("archive_id = 3").withColumn("text", F.upper("text")), path)
    return store.read_messages(w.spark, path, cols.schema)


@query("upsert_latest", """SELECT archive_id, key, arg_max(value, ts) AS value, max(ts) AS ts FROM (
    SELECT CAST(user_id % 10 AS INT) AS archive_id, event_type AS key, props AS value, ts FROM events) GROUP BY ALL""")
def _(w):
    rows = w.table("events").selectExpr("CAST(user_id % 10 AS INT) AS archive_id", "event_type AS key", "props AS value", "ts")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return store.upsert_latest(rows.where(early), rows.where(~early), [A, "key"], "ts")


@query("list_archives", Q.E + "SELECT archive_id, count(*) AS messages, count(DISTINCT pid) AS people, min(ts) AS first_message, max(ts) AS last_message FROM m GROUP BY ALL")
def _(w):
    return store.list_archives(w.events.messages)


# --- parsing --------------------------------------------------------------------------


def _lines(w, mixed=False):
    return adapters.export_lines(w.spark, w.dir, mixed=True) if mixed else w.lines


_X = f"""WITH x AS (SELECT *, {Q.K} AS k, user_id % 10 % 4 AS layout, 'user ' || user_id AS who, 'chat-' || (user_id % 10) AS file FROM events),
parsed AS (
    SELECT file, event_id * 8 AS line_no, CASE WHEN layout = 1 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS ts,
        CASE WHEN event_type = 'error' AND k % 3 > 0 THEN NULL ELSE who END AS sender,
        CASE event_type WHEN 'view' THEN 'what is item ' || k || '?'
            WHEN 'click' THEN 'click ' || k || chr(10) || '  second line' || chr(10) || chr(10) || 'third: line'
            WHEN 'purchase' THEN 'see https://shop.example/' || k
            WHEN 'signup' THEN CASE WHEN k % 3 = 1 THEN 'caption ' || k ELSE '' END
            ELSE CASE k % 3 WHEN 0 THEN 'This message was deleted' WHEN 1 THEN who || ' added user ' || k
                 ELSE who || ' changed the subject from "a" to: trip ' || k END END AS text,
        CASE event_type WHEN 'signup' THEN 'media' WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'deleted' ELSE 'system' END ELSE 'text' END AS msg_type,
        CASE WHEN event_type = 'signup' AND k % 3 = 1 THEN 'IMG-' || event_id || '.jpg'
             WHEN event_type = 'signup' AND k % 3 = 2 THEN event_id || '-PHOTO-' || k || '.jpg' END AS attachment,
        CASE WHEN event_type = 'click' THEN 3 WHEN event_type = 'signup' AND k % 3 = 1 THEN 1 ELSE 0 END AS continuation_lines,
        layout, event_type, k
    FROM x)
"""


@query("parse_messages", _X + "SELECT file, line_no, ts, sender, text, msg_type, attachment, continuation_lines FROM parsed")
def _(w):
    return T.parse_lines(_lines(w))


@query("parse_header", _X + """SELECT file, line_no, CAST(CASE layout WHEN 1 THEN month(ts) WHEN 2 THEN year(ts) ELSE day(ts) END AS INT) AS d1,
    CAST(CASE layout WHEN 1 THEN day(ts) WHEN 2 THEN month(ts) ELSE month(ts) END AS INT) AS d2,
    CAST(CASE layout WHEN 2 THEN day(ts) WHEN 3 THEN year(ts) % 100 ELSE year(ts) END AS INT) AS d3,
    CAST(hour(ts) AS INT) AS hour, CAST(minute(ts) AS INT) AS minute, CAST(CASE WHEN layout = 1 THEN second(ts) ELSE 0 END AS INT) AS second FROM parsed""")
def _(w):
    return T.parse_headers(_lines(w)).where("h IS NOT NULL").select("file", "line_no", "h.d1", "h.d2", "h.d3", "h.hour", "h.minute", "h.second")


@query("clean_lines", """SELECT page_id, url || ' a b' || html AS line FROM pages""")
def _(w):
    noisy = F.concat(F.lit("‎﻿"), "url", F.lit(" a b⁨"), "html", F.lit("\r\n"))
    return w.table("pages").select("page_id", noisy.alias("line")).withColumn("line", T.clean_line("line"))


@query("detect_date_order", _X + """SELECT file, count(*) AS headers, CASE layout WHEN 1 THEN 'MDY' WHEN 2 THEN 'YMD' ELSE 'DMY' END AS detected_order,
    CASE WHEN layout = 2 OR max(day(ts)) > 12 THEN 'certain' ELSE 'assumed' END AS detected_confidence,
    CASE WHEN layout = 1 THEN 0 WHEN layout = 2 THEN count(*) ELSE count(*) FILTER (day(ts) > 12) END AS first_gt12 FROM parsed GROUP BY file, layout""")
def _(w):
    return T.detect_date_order(T.parse_headers(_lines(w))).select("file", "headers", "detected_order", "detected_confidence", "first_gt12")


@query("resolve_date_order", _X + """, mixed AS (SELECT file, ts, event_type = 'error' AND k < 10 AS dmy FROM parsed),
    counted AS (SELECT file, count(*) AS headers, count(*) FILTER (dmy OR day(ts) <= 12) AS fits_dmy, count(*) FILTER (NOT dmy OR day(ts) <= 12) AS fits_mdy,
        count(*) FILTER (dmy AND day(ts) > 12) AS f, count(*) FILTER (NOT dmy AND day(ts) > 12) AS s FROM mixed GROUP BY file)
    SELECT file, CASE WHEN f = 0 AND s > 0 OR fits_mdy > fits_dmy THEN 'MDY' ELSE 'DMY' END AS date_order,
        CASE WHEN f > 0 AND s > 0 THEN CASE WHEN fits_mdy > fits_dmy THEN 'corrected' ELSE 'conflicting' END WHEN f + s > 0 THEN 'certain' ELSE 'assumed' END AS confidence,
        headers, fits_dmy, fits_mdy FROM counted""")
def _(w):
    found = T.resolve_date_order(T.detect_date_order(T.parse_headers(_lines(w, mixed=True))))
    return found.select("file", "date_order", "confidence", "headers", "fits_dmy", "fits_mdy")


@query("build_timestamp", _X + "SELECT file, line_no, ts FROM parsed")
def _(w):
    return T.with_stamps(T.parse_headers(_lines(w))).where("ts IS NOT NULL").select("file", "line_no", "ts")


@query("split_sender", _X + "SELECT file, line_no, sender FROM parsed")
def _(w):
    headed = T.parse_headers(_lines(w)).where("h IS NOT NULL").withColumn("body", F.col("h.body"))
    return headed.select("file", "line_no", T.sender_of("body").alias("sender"))


def _stamped(w):
    return T.with_stamps(T.parse_headers(_lines(w)))


@query("stitch_messages", _X + "SELECT file, line_no, continuation_lines FROM parsed")
def _(w):
    return T.stitch_messages(_stamped(w)).select("file", "line_no", "continuation_lines")


@query("classify_message", _X + "SELECT file, msg_type, count(*) AS messages FROM parsed GROUP BY ALL")
def _(w):
    return T.classify_messages(T.stitch_messages(_stamped(w))).groupBy("file", "msg_type").agg(F.count(F.lit(1)).alias("messages"))


@query("extract_attachment", _X + "SELECT file, line_no, attachment, text AS caption FROM parsed WHERE attachment IS NOT NULL")
def _(w):
    stitched = T.stitch_messages(_stamped(w)).withColumn("attachment", T.attachment_of("text")).where("attachment IS NOT NULL")
    return stitched.select("file", "line_no", "attachment", T.after_first_line("text").alias("caption"))


@query("parse_report", _X + """, p AS (SELECT file, sender, count(*) AS n FROM parsed WHERE sender IS NOT NULL GROUP BY ALL),
sp AS (SELECT file, string_agg(sender || '=' || n, ';' ORDER BY sender) AS senders, count(*) AS distinct_senders FROM p GROUP BY file)
SELECT file, CAST(count(*) + sum(continuation_lines) + 1 AS BIGINT) AS total_lines, count(*) AS parsed_messages,
    count(*) FILTER (msg_type = 'system') AS system_messages, count(*) FILTER (msg_type = 'media') AS media_messages,
    count(*) FILTER (msg_type = 'deleted') AS deleted_messages, count(attachment) AS attached_files,
    CAST(sum(continuation_lines) AS BIGINT) AS continuation_lines, any_value(distinct_senders) AS distinct_senders, 1 AS unparsed_lines,
    CASE layout WHEN 1 THEN 'MDY' WHEN 2 THEN 'YMD' ELSE 'DMY' END AS date_order,
    CASE WHEN layout = 2 OR max(day(ts)) > 12 THEN 'certain' ELSE 'assumed' END AS confidence, any_value(senders) AS senders,
    CASE WHEN layout = 2 OR max(day(ts)) > 12 THEN 0 ELSE 1 END AS warnings
FROM parsed JOIN sp USING (file) GROUP BY file, layout""")
def _(w):
    pairs = F.transform(F.array_sort(F.map_entries("senders")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return T.parse_report(_lines(w)).withColumn("senders", F.array_join(pairs, ";")).withColumn("warnings", F.size("warnings"))


@query("drop_system", f"WITH {Q.RAW_C} SELECT line_no, sender, msg_type FROM raw WHERE msg_type <> 'system'")
def _(w):
    return drop_system(adapters.conversations_as_messages(w.spark, w.dir)).select("line_no", "sender", "msg_type")


# --- people ---------------------------------------------------------------------------

_O = """WITH raw AS (SELECT CAST(o_custkey % 10 AS INT) AS archive_id, o_orderkey AS line_no, o_orderdate AS ts, o_custkey,
    o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS phone, CAST(9000000000 + o_custkey AS VARCHAR) AS num,
    CASE o_orderpriority WHEN '1-URGENT' THEN '+91 ' || substr(CAST(9000000000 + o_custkey AS VARCHAR), 1, 5) || ' ' || substr(CAST(9000000000 + o_custkey AS VARCHAR), 6, 5)
        WHEN '2-HIGH' THEN '+91' || (9000000000 + o_custkey) WHEN '3-MEDIUM' THEN '~ ' || (9000000000 + o_custkey)
        WHEN '4-NOT SPECIFIED' THEN '~Customer ' || o_custkey ELSE 'CUSTOMER  ' || o_custkey || ' Smith' END AS sender,
    CASE o_orderpriority WHEN '1-URGENT' THEN '+91 ' || substr(CAST(9000000000 + o_custkey AS VARCHAR), 1, 5) || ' ' || substr(CAST(9000000000 + o_custkey AS VARCHAR), 6, 5)
        WHEN '2-HIGH' THEN '+91' || (9000000000 + o_custkey) WHEN '3-MEDIUM' THEN CAST(9000000000 + o_custkey AS VARCHAR)
        WHEN '4-NOT SPECIFIED' THEN 'Customer ' || o_custkey ELSE 'CUSTOMER  ' || o_custkey || ' Smith' END AS label,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'phone:' || (9000000000 + o_custkey)
        WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'name:customer ' || o_custkey ELSE 'name:customer ' || o_custkey || ' smith' END AS pid,
    CASE WHEN o_orderstatus = 'P' THEN 'system' ELSE 'text' END AS msg_type, o_orderstatus AS text FROM orders),
kept AS (SELECT * FROM raw WHERE msg_type <> 'system'),
people AS (SELECT archive_id, pid AS participant_id, arg_max(label, lpad(CAST(length(label) AS VARCHAR), 3, '0') || label) AS display_name,
    string_agg(DISTINCT sender, ';' ORDER BY sender) AS aliases, bool_and(phone) AS is_phone_only, count(*) AS message_count
    FROM kept GROUP BY archive_id, pid)
"""


def _orders(w):
    return adapters.orders_as_senders(w.spark, w.dir)


def _people(w, manual=None):
    return L.resolve_participants(L.sender_counts(_orders(w)), manual)


def _flat_people(df):
    return df.withColumn("aliases", F.array_join("aliases", ";"))


@query("is_phone_number", _O + "SELECT line_no, phone AS is_phone FROM raw")
def _(w):
    return _orders(w).select("line_no", L.is_phone_number("sender").alias("is_phone"))


@query("canonical_key", _O + "SELECT line_no, pid AS key FROM raw")
def _(w):
    return _orders(w).select("line_no", L.canonical_key("sender").alias("key"))


@query("sender_counts", _O + "SELECT archive_id, sender, count(*) AS n FROM kept GROUP BY ALL")
def _(w):
    return L.sender_counts(_orders(w))


@query("resolve_participants", _O + "SELECT * FROM people")
def _(w):
    return _flat_people(_people(w))


# Every "~Customer n" is linked by hand to the number of that customer.
@query("manual_aliases", _O + """SELECT archive_id, CASE WHEN starts_with(sender, '~C') THEN 'phone:' || num ELSE pid END AS participant_id,
    count(*) AS message_count, count(DISTINCT sender) AS aliases FROM kept GROUP BY 1, 2""")
def _(w):
    links = _orders(w).where("sender LIKE '~C%'").select(A, "sender").distinct().withColumn(
        "participant_id", F.concat(F.lit("phone:"), (F.regexp_extract("sender", r"(\d+)", 1).cast("long") + 9000000000).cast("string")))
    return _people(w, links).select(A, "participant_id", "message_count", F.size("aliases").alias("aliases"))


@query("tag_participants", _O + "SELECT archive_id, line_no, pid AS participant_id FROM kept")
def _(w):
    return L.tag_participants(drop_system(_orders(w))).select(A, "line_no", "participant_id")


# "Customer 5" is a word prefix of "CUSTOMER  5 Smith" only after its double space is cut.
@query("suggest_merges", _O + """, tidy AS (SELECT archive_id, replace(display_name, '  ', ' ') AS name, message_count FROM people WHERE NOT is_phone_only)
    SELECT a.archive_id, a.name AS short_name, a.message_count AS short_messages, b.name AS long_name, b.message_count AS long_messages
    FROM tidy a JOIN tidy b ON a.archive_id = b.archive_id AND starts_with(lower(b.name), lower(a.name) || ' ')""")
def _(w):
    return L.suggest_merges(_people(w).withColumn("display_name", F.replace("display_name", F.lit("  "), F.lit(" "))))


@query("phone_only_count", _O + "SELECT archive_id, count(*) FILTER (is_phone_only) AS phone_only FROM people GROUP BY ALL")
def _(w):
    return L.phone_only_count(_people(w))


@query("participants_list", Q.E + "SELECT archive_id, pid AS participant_id, sender AS display_name, sender AS aliases, false AS is_phone_only, count(*) AS message_count FROM m GROUP BY ALL")
def _(w):
    return _flat_people(w.events.participants).orderBy(F.desc("message_count"), A, "participant_id")


@query("rename_participant", Q.E + "SELECT archive_id, CASE WHEN sender LIKE 'user 1%' THEN 'Member ' || substr(sender, 6) ELSE sender END AS sender, count(*) AS messages FROM m GROUP BY ALL")
def _(w):
    from parley.plans.reports import leaderboard

    names = w.events.participants.where("display_name LIKE 'user 1%'").select(
        A, "participant_id", F.concat(F.lit("Member "), F.substring("display_name", 6, 99)).alias("new_name"))
    renamed = L.rename_participants(w.events.participants, names)
    return leaderboard(w.events.messages, renamed).select(A, "sender", "messages")


# --- identity of messages -------------------------------------------------------------

_KEYS = f"""WITH {Q.RAW_E}, keyed AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M') || '|' || lower(sender) || '|' || CASE WHEN msg_type = 'media' THEN 'media'
    WHEN msg_type = 'deleted' THEN 'deleted' ELSE substr(sha1(lower(text)), 1, 16) END AS base_key FROM raw)
"""


def _events(w):
    return adapters.events_as_messages(w.spark, w.dir)


@query("base_key", _KEYS + "SELECT archive_id, line_no, base_key FROM keyed")
def _(w):
    return _events(w).select(A, "line_no", L.base_key().alias("base_key"))


# Stamps cut to the hour, so that equal messages really repeat.
@query("assign_keys", f"""WITH {Q.RAW_E}, keyed AS (SELECT *, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M') || '|' || lower(sender) || '|' || CASE WHEN msg_type = 'media' THEN 'media'
    WHEN msg_type = 'deleted' THEN 'deleted' ELSE substr(sha1(lower(text)), 1, 16) END AS base_key FROM raw)
    SELECT archive_id, line_no, base_key || '#' || (row_number() OVER (PARTITION BY archive_id, base_key ORDER BY line_no) - 1) AS dedup_key FROM keyed""")
def _(w):
    daily = _events(w).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return L.assign_keys(daily, [A]).select(A, "line_no", "dedup_key")


@query("richness", f"""WITH {Q.RAW_E} SELECT archive_id, line_no, CAST(attachment IS NOT NULL AS INT) AS file,
    CAST(1 AS INT) AS said, length(text) AS size FROM raw""")
def _(w):
    return _events(w).select(A, "line_no", L.richness().alias("r")).select(A, "line_no", "r.*")


def _slices(w):
    """Two overlapping exports: the stored one without media to the 20th, the new one with media from the 10th."""
    rows = _events(w)
    until, since = F.lit("2024-01-20").cast("timestamp_ntz"), F.lit("2024-01-10").cast("timestamp_ntz")
    media = F.col("msg_type") == "media"
    old = rows.where(F.col("ts") < until).withColumn("attachment", F.lit(None).cast("string")).withColumn(
        "text", F.when(media, "").otherwise(F.col("text")))
    new = rows.where(F.col("ts") >= since)
    return L.assign_keys(old, [A]), L.assign_keys(new, [A])


_SLICES = _KEYS.rstrip() + """,
old AS (SELECT *, base_key || '#' || (row_number() OVER (PARTITION BY archive_id, base_key ORDER BY line_no) - 1) AS dedup_key
    FROM keyed WHERE ts < TIMESTAMP '2024-01-20 00:00:00'),
new AS (SELECT *, base_key || '#' || (row_number() OVER (PARTITION BY archive_id, base_key ORDER BY line_no) - 1) AS dedup_key
    FROM keyed WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')
"""


@query("merge_exports", _SLICES + """SELECT archive_id, dedup_key, coalesce(old.ts, new.ts) AS ts, coalesce(new.attachment, NULL) AS attachment,
    CASE WHEN new.dedup_key IS NULL AND old.msg_type = 'media' THEN '' ELSE coalesce(new.text, old.text) END AS text
    FROM old FULL JOIN new USING (archive_id, dedup_key)""")
def _(w):
    old, new = _slices(w)
    return L.merge_exports(old, new).select(A, "dedup_key", "ts", "attachment", "text")


_COUNTS = """SELECT archive_id, count(*) AS total, count(*) FILTER (old.dedup_key IS NULL) AS added,
    count(*) FILTER (old.dedup_key IS NOT NULL AND new.dedup_key IS NOT NULL) AS skipped,
    count(*) FILTER (old.dedup_key IS NOT NULL AND new.dedup_key IS NOT NULL AND new.msg_type = 'media') AS upgraded
    FROM old FULL JOIN new USING (archive_id, dedup_key) GROUP BY archive_id"""


@query("merge_counts", _SLICES + _COUNTS)
def _(w):
    return L.merge_counts(*_slices(w))


@query("ingest_log", _SLICES + f"""SELECT archive_id, filename, mode, messages_added, messages_skipped, media_added FROM (
    SELECT archive_id, 'first.txt' AS filename, 'replace' AS mode, count(*) AS messages_added, 0 AS messages_skipped, 0 AS media_added FROM old GROUP BY archive_id
    UNION ALL SELECT c.archive_id, 'second.zip', 'merge', added, skipped, files FROM ({_COUNTS}) c
    JOIN (SELECT archive_id, count(*) AS files FROM new WHERE attachment IS NOT NULL GROUP BY archive_id) USING (archive_id))""")
def _(w):
    old, new = _slices(w)
    path = store.new_table_path(w.spark, "ingest-log")
    nothing = old.limit(0)
    store.append_log(store.ingest_record(L.merge_counts(nothing, old), old.where("attachment IS NOT NULL"), "first.txt", "replace"), path)
    store.append_log(store.ingest_record(L.merge_counts(old, new), new.where("attachment IS NOT NULL"), "second.zip", "merge"), path)
    return w.spark.read.parquet(path)


# Archive 3 is offered the chat of strangers, archive 4 nothing but notices: both stay as they were stored.
@query("ingest_merge", Q.E + """SELECT archive_id, msg_id, ts, session_id,
    CASE WHEN archive_id NOT IN (3, 4) AND ts >= TIMESTAMP '2024-01-10 00:00:00' THEN attachment END AS attachment,
    CASE WHEN msg_type = 'media' AND (archive_id IN (3, 4) OR ts < TIMESTAMP '2024-01-10 00:00:00') THEN '' ELSE text END AS text
    FROM m WHERE archive_id NOT IN (3, 4) OR ts < TIMESTAMP '2024-01-20 00:00:00'""")
def _(w):
    rows = _events(w)
    old = rows.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).withColumn("attachment", F.lit(None).cast("string")).withColumn(
        "text", F.when(F.col("msg_type") == "media", "").otherwise(F.col("text")))
    new = rows.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).withColumns({
        "sender": F.when(F.col(A) == 3, F.concat(F.lit("stranger "), "sender")).otherwise(F.col("sender")),
        "msg_type": F.when(F.col(A) == 4, "system").otherwise(F.col("msg_type"))})
    path = store.new_table_path(w.spark, "archives")
    store.write_messages(ingest.prepare(old, gap_hours=1.0).messages, path)
    ingest.merge_into(path, new, "merge", gap_hours=1.0)
    return w.spark.read.parquet(path).select(A, "msg_id", "ts", "session_id", "attachment", "text")


# The incoming export of an archive also holds people of the next archive.
@query("participant_overlap", f"""WITH {Q.RAW_E}, old AS (SELECT DISTINCT archive_id, sender FROM raw WHERE ts < TIMESTAMP '2024-01-03 00:00:00'),
new AS (SELECT archive_id, sender FROM raw UNION SELECT (archive_id + 1) % 10, sender FROM raw WHERE msg_type = 'media'),
b AS (SELECT new.archive_id, count(*) AS people, count(old.sender) AS shared
      FROM new LEFT JOIN old ON old.archive_id = new.archive_id AND old.sender = new.sender GROUP BY new.archive_id)
SELECT archive_id, CAST(shared AS DOUBLE) / people AS overlap, CAST(shared AS DOUBLE) / people < 0.2 AS refused FROM b""")
def _(w):
    rows = _events(w)
    old = rows.where(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"))
    moved = rows.where("msg_type = 'media'").withColumn("archive_id", ((F.col(A) + 1) % 10).cast("int"))
    return L.participant_overlap(old, rows.unionByName(moved))


# Archives 0 to 4 lost the keys of their deleted messages; all their keys are made anew.
@query("reload_existing", Q.E + """, keyed AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M') || '|' || lower(sender) || '|' || CASE WHEN msg_type = 'media' THEN 'media'
    WHEN msg_type = 'deleted' THEN 'deleted' ELSE substr(sha1(lower(text)), 1, 16) END AS base_key FROM m)
    SELECT archive_id, line_no, ts, CASE WHEN archive_id < 5 THEN base_key || '#' || (row_number() OVER (PARTITION BY archive_id, base_key ORDER BY msg_id) - 1)
        ELSE 'kept ' || msg_id END AS dedup_key FROM (SELECT * REPLACE (msg_id AS line_no) FROM keyed)""")
def _(w):
    lost = (F.col(A) < 5) & (F.col("msg_type") == "deleted")
    stored = w.events.messages.withColumn("dedup_key", F.when(~lost, F.concat(F.lit("kept "), F.col("msg_id").cast("string"))))
    return L.reload_existing(stored).select(A, "line_no", "ts", "dedup_key")
