"""The given tables read as raw messages, one adapter per shape of chat."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Stamps are local phone time without a zone; UTC keeps their arithmetic plain.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(expr: str) -> str:
    """That many minutes after the first of January 2024, without a zone."""
    return f"CAST(timestamp_seconds(1704067200 + 60 * ({expr})) AS TIMESTAMP_NTZ) AS ts"


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
# Attachment names follow the naming habits of phone exports; k is the number in ``props``.
_ATTACHMENT = f"""
CASE {_K} % 8
    WHEN 0 THEN concat('IMG-20240101-WA', lpad(CAST(event_id AS STRING), 9, '0'), '.jpg')
    WHEN 1 THEN concat('VID-20240101-WA', lpad(CAST(event_id AS STRING), 9, '0'), '.mp4')
    WHEN 2 THEN concat('PTT-20240101-WA', lpad(CAST(event_id AS STRING), 9, '0'), '.opus')
    WHEN 3 THEN concat('STK-20240101-WA', lpad(CAST(event_id AS STRING), 9, '0'), '.webp')
    WHEN 4 THEN concat('DOC-20240101-WA', lpad(CAST(event_id AS STRING), 9, '0'), '.pdf')
    WHEN 5 THEN concat(lpad(CAST(event_id AS STRING), 9, '0'), '-PHOTO-2024-01-01.jpg')
    WHEN 6 THEN concat('contact ', CAST(event_id AS STRING), '.vcf')
    ELSE concat('archive-', CAST(event_id AS STRING), '.xyz') END"""


def events_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten archives of short messages; signups carry attachments, errors read as deleted."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id % 10 AS INT) AS archive_id", "event_id AS line_no", "ts",
        "concat('user ', CAST(user_id AS STRING)) AS sender",
        "CASE event_type WHEN 'signup' THEN 'media' WHEN 'error' THEN 'deleted' ELSE 'text' END AS msg_type",
        "concat(CASE event_type WHEN 'view' THEN 'what' ELSE event_type END, ' ', props) AS text",
        f"CASE WHEN event_type = 'signup' THEN {_ATTACHMENT} END AS attachment",
    )


def conversations_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive, one session per conversation, with system rows."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "0 AS archive_id",
        "conv_id * 1000 + turn AS line_no",
        _minutes("conv_id * 360 + turn * 7"),
        "role AS sender",
        "CASE WHEN role = 'system' THEN 'system' ELSE 'text' END AS msg_type", "text",
        "CAST(NULL AS STRING) AS attachment",
    )


def documents_as_messages(spark: SparkSession, sf_dir: str, sender: str = "source") -> DataFrame:
    """One archive of long messages, 25 per session; the sender is the source or the language."""
    return table(spark, sf_dir, "documents").selectExpr(
        "0 AS archive_id", "doc_id AS line_no",
        _minutes("doc_id * 17 + (doc_id DIV 25) * 300"),
        f"{sender} AS sender", "'text' AS msg_type", "text", "CAST(NULL AS STRING) AS attachment",
    )


def pages_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as messages that quote their address; the sender is the language in the URL."""
    return table(spark, sf_dir, "pages").selectExpr(
        "0 AS archive_id", "page_id AS line_no",
        _minutes("page_id"),
        "regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS sender",
        "'text' AS msg_type",
        "CASE WHEN url LIKE 'https%' THEN concat('see ', url) ELSE substring_index(url, '://', -1) END AS text",
        "CAST(NULL AS STRING) AS attachment",
    )


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that came with the events chats: most attachments, some renamed, and stray ones."""
    ev = table(spark, sf_dir, "events").selectExpr("*", f"{_K} AS k", f"{_ATTACHMENT} AS name")
    named = ev.where("event_type = 'signup' AND k >= 10").selectExpr(
        "*",
        """CASE WHEN k < 30 THEN upper(name) WHEN k < 50 THEN concat('sub/', name)
                WHEN k < 70 THEN replace(name, '.opus', '.ogg') ELSE name END AS stored""",
    )
    stray = ev.where("event_type = 'purchase' AND k >= 95").selectExpr(
        "*", "concat('extra-', CAST(event_id AS STRING), '.png') AS stored"
    )
    return named.unionByName(stray).selectExpr(
        "CAST(user_id % 10 AS INT) AS archive_id",
        "concat('media/', stored) AS path",
        "CAST(k AS BIGINT) * 3000000 AS size_bytes",
        "sha2(CAST(concat(event_type, ' ', CAST(k AS STRING)) AS BINARY), 256) AS content_hash",
    )


def orders_as_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages of customers who appear under several names and number spellings."""
    number = "CAST(9000000000 + o_custkey AS STRING)"
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey % 10 AS INT) AS archive_id", "o_orderkey AS line_no", "o_orderdate AS ts",
        f"""CASE o_orderpriority
            WHEN '1-URGENT' THEN concat('+91 ', substring({number}, 1, 5), ' ', substring({number}, 6, 5))
            WHEN '2-HIGH' THEN concat('+91', {number})
            WHEN '3-MEDIUM' THEN concat('~ ', {number})
            WHEN '4-NOT SPECIFIED' THEN concat('~Customer ', CAST(o_custkey AS STRING))
            ELSE concat('CUSTOMER  ', CAST(o_custkey AS STRING), ' Smith') END AS sender""",
        "o_orderstatus AS text",
        "CASE WHEN o_orderstatus = 'P' THEN 'system' ELSE 'text' END AS msg_type",
        "CAST(NULL AS STRING) AS attachment",
    )


_STAMP = """CASE {layout}
    WHEN 0 THEN concat(date_format(ts, 'dd/MM/yyyy, HH:mm'), ' - ')
    WHEN 1 THEN concat('\\u200e[', date_format(ts, 'MM/dd/yyyy, h:mm:ss a'), '] ')
    WHEN 2 THEN concat(date_format(ts, 'yyyy-MM-dd, HH:mm'), ' - ')
    ELSE concat(date_format(ts, 'dd/MM/yy, h:mm'), '\\u202f', lower(date_format(ts, 'a')), ' - ') END"""
_BODY = """CASE event_type
    WHEN 'view' THEN array(concat(who, ': what is item ', k, '?'))
    WHEN 'click' THEN array(concat(who, ': click ', k), '  second line', '', 'third: line')
    WHEN 'purchase' THEN array(concat(who, ': see https://shop.example/', k))
    WHEN 'signup' THEN CASE k % 3
        WHEN 0 THEN array(concat(who, ': <Media omitted>'))
        WHEN 1 THEN array(concat(who, ': IMG-', event_id, '.jpg (file attached)'), concat('caption ', k))
        ELSE array(concat(who, ': <attached: ', event_id, '-PHOTO-', k, '.jpg>')) END
    ELSE CASE k % 3
        WHEN 0 THEN array(concat(who, ': This message was deleted'))
        WHEN 1 THEN array(concat(who, ' added user ', k))
        ELSE array(concat(who, ' changed the subject from \\"a\\" to: trip ', k)) END END"""


def export_lines(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    """Transcript lines (file, line_no, line) written from the events, one file per archive.

    Four layouts take turns. With ``mixed`` every file is month first except for some errors
    that are day first, as in two exports pasted together.
    """
    layout = f"CASE WHEN event_type = 'error' AND {_K} < 10 THEN 0 ELSE 1 END" if mixed else "user_id % 10 % 4"
    events = table(spark, sf_dir, "events").selectExpr(
        "*", f"{_K} AS k", "concat('user ', CAST(user_id AS STRING)) AS who", "user_id % 10 AS a")
    lines = events.selectExpr(
        "concat('chat-', CAST(a AS STRING)) AS file", "event_id",
        f"posexplode({_BODY}) AS (i, body)", f"{_STAMP.format(layout=layout)} AS stamp",
    ).selectExpr("file", "event_id * 8 + i AS line_no", "CASE WHEN i = 0 THEN concat(stamp, body) ELSE body END AS line")
    preface = events.selectExpr("concat('chat-', CAST(a AS STRING)) AS file", "CAST(-1 AS BIGINT) AS line_no",
                                "'Chat history' AS line").distinct()
    return lines.unionByName(preface)
