"""Transcript lines to typed messages, as one job over any number of files.

Input is a table of lines (file, line_no, line). Nothing gathers a file: the date order is a
per-file aggregate, and a line finds its message through blocks of line numbers.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import WS, clean_line, contains_any, is_ascii, strip
from parley.operators.ordered import block_of

# The header of a message line in all export layouts. Groups: three date
# parts, hour, minute, second, am/pm, body.
HEADER = (
    r"(?d)^\[?(\p{Nd}{1,4})[/.\-](\p{Nd}{1,2})[/.\-](\p{Nd}{2,4}),?"
    rf"{WS}+(\p{{Nd}}{{1,2}}):(\p{{Nd}}{{2}})(?::(\p{{Nd}}{{2}}))?"
    rf"(?:{WS}*([APap]\.?[Mm]\.?))?{WS}*(?:\]{WS}*|{WS}-{WS})(.*)$"
)
MAY_BE_HEADER = r"^\[?\p{Nd}"
# Fixed values: "Name: text".
SENDER = rf"(?s)^([^:\n]{{1,60}}?):{WS}(.*)$"
# Phrases that mark a prefix as a system notice, not a name.
NOTICES = [
    r"messages and calls are end-to-end encrypted",
    r"messages to this (chat and call|group) are now secured",
    r"created (this )?group",
    r"created group",
    r"added [^\n]+$",
    r"\badded you\b",
    r"\bleft\b$",
    r"removed [^\n]+$",
    r"joined using this group.s invite link",
    r"joined from the community",
    r"changed the subject (from|to)",
    r"changed this group.s (icon|description|settings)",
    r"changed their phone number",
    r"changed to \+?\d",
    r"is now an admin",
    r"you.re now an admin",
    r"no longer an admin",
    r"turned on disappearing messages",
    r"turned off disappearing messages",
    r"pinned a message",
    r"unpinned a message",
    r"deleted this group",
    r"security code changed",
    r"missed (voice|video|group) call",
    r"blocked this contact",
    r"you were added",
    r"this group was upgraded",
    r"only admins can",
    r"waiting for this message",
    r"tap to learn more",
]
# A notice holds one of these words, which are cheap to look for.
NOTICE_WORDS = ["messages", "created", "added", "left", "removed", "joined", "changed", "admin", "turned", "pinned",
                "deleted", "missed", "blocked", "upgraded", "waiting", "tap to"]
# Bodies that stand for a file that was not exported.
PLACEHOLDERS = [
    r"^<media omitted>$",
    r"^(image|video|audio|sticker|document|gif|contact card|photo) omitted$",
    r"^(voice call|video call|missed voice call|missed video call)$",
    r"^live location shared$",
    r"^location: https?://",
    r"^null$",
]
# Bodies that name an exported file, and a deleted message.
ATTACHED_IOS = r"(?iU)^<attached:\s*([^>]+?)\s*>$"
ATTACHED_ANDROID = r"(?iU)^(\S[^\n]*?)\s*\((?:file attached|archivo adjunto)\)$"
DELETED = r"(?iU)^(this message was deleted|you deleted this message)\.?$"

_NOTICE_RE = "(?iU)" + "|".join(NOTICES)
_PLACEHOLDER_RE = "(?iU)" + "|".join(PLACEHOLDERS)
# Line ends beyond \n and \r\n at which a transcript splits as well.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
ORDERS = ("DMY", "MDY", "YMD")

# Digits of other scripts, each a run of ten code points.
_DIGIT_ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xFF10)
_OTHER_DIGITS = "".join(chr(z + i) for z in _DIGIT_ZEROS for i in range(10))


def split_lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line of a text column; a final line end opens no further line."""
    parts = F.split(F.regexp_replace(text, f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS)
    nonempty = texts.where(F.length(text) > 0)
    return nonempty.select(*keys, F.posexplode(parts).alias("_i", "line")).withColumn(
        "line_no", (F.col("_i") + 1).cast("long")).drop("_i")


def parse_headers(lines: DataFrame) -> DataFrame:
    """Add ``h``: the header parts of a line, null where the line is no header."""
    clean = clean_line("line")
    # One match per line: a header comes back as its parts behind a mark no header starts with.
    mark = "\x02"
    marked = F.when(F.col("line").rlike(MAY_BE_HEADER),
                    F.regexp_replace("line", HEADER, mark + "$1\x01$2\x01$3\x01$4\x01$5\x01$6\x01$7\x01$8"))

    def num(i):
        part = F.col("_p")[i]
        plain = F.translate(part, _OTHER_DIGITS, "0123456789" * len(_DIGIT_ZEROS))
        return F.when(part == "", None).when(is_ascii(part), part.try_cast("int")).otherwise(plain.try_cast("int"))

    half, hour = F.col("_half"), F.col("_hour")
    h24 = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    flat = {
        "_d1": num(0), "_d2": num(1), "_d3": num(2), "_hour": num(3), "_minute": num(4), "_second": num(5),
        "_half": F.lower(F.replace(F.col("_p")[6], F.lit("."), F.lit(""))),
        "_len": F.length(F.col("_p")[0]), "_body": F.col("_p")[7],
    }
    return (
        lines.withColumn("line", clean)
        .withColumn("_m", marked)
        .withColumn("_p", F.when(F.col("_m").startswith(mark), F.split(F.substring("_m", 2, 1 << 30), "\x01", 8)))
        .withColumns(flat)
        .withColumn("h", F.when(F.col("_p").isNotNull(), F.struct(
            F.col("_d1").alias("d1"), F.col("_d2").alias("d2"), F.col("_d3").alias("d3"), h24.alias("hour"),
            F.col("_minute").alias("minute"), F.coalesce("_second", F.lit(0)).alias("second"),
            F.col("_len").alias("d1_len"), F.col("_body").alias("body"))))
        .drop("_p", "_m", *flat)
    )


def build_timestamp(order: str) -> Column:
    """Stamp of header ``h`` under a date order, null where there is no such moment."""
    d1, d2, d3 = F.col("h.d1"), F.col("h.d2"), F.col("h.d3")
    first = {"DMY": (d3, d2, d1), "MDY": (d3, d1, d2), "YMD": (d1, d2, d3)}[order]
    iso = (F.col("h.d1_len") == 4)
    year, month, day = [F.when(iso, a).otherwise(b) for a, b in zip((d1, d2, d3), first)]
    year = F.when(year < 100, year + 2000).otherwise(year)
    stamp = F.try_make_timestamp_ntz(year, month, day, F.col("h.hour"), F.col("h.minute"), F.col("h.second"))
    return F.when((F.col("h.second") < 60) & (F.col("h.minute") < 60) & (F.col("h.hour") < 24), stamp)


def _evidence() -> dict[str, Column]:
    """What the headers of some lines say about their date order."""
    h = F.col("h")
    return {
        "total_lines": F.count(F.lit(1)), "headers": F.count("h"),
        "iso": F.count_if(h.isNotNull() & (F.col("h.d1_len") == 4)),
        "first_gt12": F.count_if(F.col("h.d1") > 12), "second_gt12": F.count_if(F.col("h.d2") > 12),
        **{f"fits_{o.lower()}": F.count(build_timestamp(o)) for o in ORDERS},
    }


def _infer(counted: DataFrame) -> DataFrame:
    first, second = F.col("first_gt12") > 0, F.col("second_gt12") > 0
    return (
        counted.withColumn("detected_order", F.when(F.col("iso") > 0, "YMD").when(second & ~first, "MDY").otherwise("DMY"))
        .withColumn("detected_confidence", F.when((F.col("iso") > 0) | (first != second), "certain")
                    .when(first & second, "conflicting").otherwise("assumed"))
    )


def detect_date_order(headed: DataFrame, keys: list[str] = ("file",)) -> DataFrame:
    """Per file: counts, inferred order and how sure it is."""
    return _infer(headed.groupBy(*keys).agg(*[c.alias(n) for n, c in _evidence().items()]))


def resolve_date_order(detected: DataFrame) -> DataFrame:
    """Flip to the other order where strictly more stamps are valid under it."""
    order = F.col("detected_order")
    fits = F.when(order == "YMD", F.col("fits_ymd")).when(order == "MDY", F.col("fits_mdy")).otherwise(F.col("fits_dmy"))
    other = F.when(order == "DMY", F.col("fits_mdy")).otherwise(F.col("fits_dmy"))
    flipped = (fits < F.col("headers")) & (other > fits)
    return (
        detected.withColumn("date_order", F.when(flipped, F.when(order == "DMY", "MDY").otherwise("DMY")).otherwise(order))
        .withColumn("confidence", F.when(flipped, "corrected").otherwise(F.col("detected_confidence")))
    )


def block_guide(headed: DataFrame, keys: list[str] = ("file",)) -> DataFrame:
    """Per (file, block of lines): the file's date order and the last header before the block.

    One small row per block answers both, so the lines themselves are parsed for it only once
    more, with nothing but counts and line numbers leaving the tasks.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = {o: F.max(F.when(build_timestamp(o).isNotNull(), F.col("line_no"))).alias(f"_last_{o}") for o in ORDERS}
    evidence = _evidence()
    blocks = headed.withColumn("_block", block_of("line_no")).groupBy(*keys, "_block").agg(
        *[c.alias(n) for n, c in evidence.items()], *last.values())
    files = blocks.select(*keys, "_block", *[f"_last_{o}" for o in ORDERS], *[F.sum(n).over(whole).alias(n) for n in evidence])
    guide = resolve_date_order(_infer(files))
    order = F.col("date_order")
    chosen = F.when(order == "YMD", F.col("_last_YMD")).when(order == "MDY", F.col("_last_MDY")).otherwise(F.col("_last_DMY"))
    return guide.select(*keys, "_block", "date_order", F.max(chosen).over(before).alias("_carried"))


def with_stamps(headed: DataFrame, keys: list[str] = ("file",)) -> DataFrame:
    """Add ``ts`` and ``body``; a header without a valid stamp is an ordinary line.

    Rows keep their block and what its guide says, so that the shuffle also serves the stitching.
    """
    order = F.col("date_order")
    ts = (F.when(order == "YMD", build_timestamp("YMD")).when(order == "MDY", build_timestamp("MDY"))
          .otherwise(build_timestamp("DMY")))
    guided = headed.withColumn("_block", block_of("line_no")).join(block_guide(headed, keys), [*keys, "_block"])
    return guided.withColumn("ts", ts).withColumn(
        "body", F.when(F.col("ts").isNotNull(), F.col("h.body"))).drop("h", "date_order")


def sender_of(body) -> Column:
    """The name before the first colon, unless it reads as a system notice."""
    name = strip(F.regexp_extract(body, SENDER, 1))
    return F.when((name != "") & ~(contains_any(name, NOTICE_WORDS) & name.rlike(_NOTICE_RE)), name)


def text_of(body, sender) -> Column:
    return F.when(F.col(sender).isNull(), F.col(body)).otherwise(F.regexp_extract(body, SENDER, 2))


def stitch_messages(stamped: DataFrame, keys: list[str] = ("file",)) -> DataFrame:
    """Attach continuation lines to the message above; lines before any header drop out.

    ``stamped`` comes from ``with_stamps``.
    """
    keys = list(keys)
    is_head = F.col("ts").isNotNull()
    lines = (
        stamped.withColumn("_head", F.when(is_head, F.col("line_no")))
        .withColumn("sender", sender_of("body"))
        .withColumn("_text", F.when(is_head, text_of("body", "sender"))
                    .when(strip("line") == "", F.lit("")).otherwise(F.col("line")))
    )
    upto = Window.partitionBy(*keys, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    owned = lines.withColumn("_own", F.coalesce(F.max("_head").over(upto), "_carried")).where(F.col("_own").isNotNull())
    parts = F.sort_array(F.collect_list(F.struct("line_no", "_text")))
    return owned.groupBy(*keys, F.col("_own").alias("line_no")).agg(
        F.max("ts").alias("ts"), F.max("sender").alias("sender"),
        strip(F.array_join(F.transform(parts, lambda p: p["_text"]), "\n")).alias("text"),
        (F.count(F.lit(1)) - 1).alias("continuation_lines"),
    )


def first_line(text) -> Column:
    return strip(F.substring_index(text, "\n", 1))


def after_first_line(text) -> Column:
    t = F.col(text)
    return F.when(t.contains("\n"), strip(t.substr(F.instr(t, "\n") + 1, F.length(t)))).otherwise("")


def attachment_of(text) -> Column:
    """File named on the first line of a stripped text, or null."""
    head = first_line(text)
    ios, android = F.regexp_extract(head, ATTACHED_IOS, 1), F.regexp_extract(head, ATTACHED_ANDROID, 1)
    name = strip(F.when(ios != "", ios).otherwise(android))
    return F.when(name != "", name)


def classify_messages(stitched: DataFrame) -> DataFrame:
    """Add type and attachment; media messages keep only their caption as text."""
    placeholder = first_line("text").rlike(_PLACEHOLDER_RE)
    kind = (
        F.when(F.col("sender").isNull(), "system").when(F.col("text").rlike(DELETED), "deleted")
        .when(placeholder | F.col("_file").isNotNull(), "media").otherwise("text")
    )
    media = F.col("msg_type") == "media"
    return (
        stitched.withColumn("_file", attachment_of("text")).withColumn("msg_type", kind)
        .withColumn("attachment", F.when(media, F.col("_file"))).drop("_file")
        .withColumn("text", F.when(media, after_first_line("text")).otherwise(F.col("text")))
    )


def parse_lines(lines: DataFrame, keys: list[str] = ("file",)) -> DataFrame:
    """(file, line_no, line) to (file, line_no, ts, sender, text, msg_type, attachment, ...)."""
    return classify_messages(stitch_messages(with_stamps(parse_headers(lines), keys), keys))


def parse_report(lines: DataFrame, keys: list[str] = ("file",), messages: DataFrame | None = None) -> DataFrame:
    """What the parser saw, per file. The senders come as a map.

    Pass the stored ``messages`` of ``parse_lines`` to spare a second parse.
    """
    keys = list(keys)
    orders = resolve_date_order(detect_date_order(parse_headers(lines), keys))
    messages = parse_lines(lines, keys) if messages is None else messages
    kind = F.col("msg_type")
    by_sender = messages.groupBy(*keys, "sender").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kind == "system").alias("system_messages"),
        F.count_if(kind == "media").alias("media_messages"),
        F.count_if(kind == "deleted").alias("deleted_messages"),
        F.count("attachment").alias("attached_files"), F.sum("continuation_lines").alias("continuation_lines"),
    )
    sums = ["system_messages", "media_messages", "deleted_messages", "attached_files", "continuation_lines"]
    named = F.col("sender").isNotNull()
    seen = by_sender.groupBy(*keys).agg(
        F.sum("n").alias("parsed_messages"), *[F.sum(c).alias(c) for c in sums],
        F.count("sender").alias("distinct_senders"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(named, F.struct("sender", "n"))))).alias("senders"),
    )
    counted = ["parsed_messages", *sums, "distinct_senders"]
    # A stamp that no order can read.
    invalid = F.col("headers") - F.greatest("fits_dmy", "fits_mdy", "fits_ymd")
    warnings = F.array_compact(F.array(
        F.when(F.col("detected_confidence") == "assumed", F.lit("day/month order is ambiguous, D/M/Y assumed")),
        F.when(F.col("detected_confidence") == "conflicting", F.lit("dates conflict, D/M/Y assumed")),
        F.when(F.col("confidence") == "corrected", F.lit("inferred date order did not fit, the other is used")),
        F.when((F.col("confidence") != "corrected") & (invalid > 0), F.lit("some timestamps fit no date order")),
        F.when(F.col("parsed_messages") == 0, F.lit("no messages parsed")),
    ))
    return (
        orders.join(seen, keys, "left").fillna(0, counted)
        .withColumn("unparsed_lines", F.col("total_lines") - F.col("parsed_messages") - F.col("continuation_lines"))
        .withColumn("warnings", warnings)
        .select(*keys, "total_lines", *counted, "unparsed_lines", "date_order", "confidence", "senders", "warnings")
    )
