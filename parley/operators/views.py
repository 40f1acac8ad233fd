"""The published views: messages, media and searchable content with readable names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(people: DataFrame, pid: str = "participant_id", out: str = "display_name") -> DataFrame:
    return people.select("archive_id", F.col("participant_id").alias(pid), F.col("display_name").alias(out))


def with_name(df: DataFrame, people: DataFrame, pid: str = "participant_id", out: str = "sender") -> DataFrame:
    """Attach the display name of ``pid``; the id itself where the person is unknown."""
    return (
        df.join(_names(people, pid, "_name"), ["archive_id", pid], "left")
        .withColumn(out, F.coalesce("_name", pid)).drop("_name")
    )


def v_messages(messages: DataFrame, people: DataFrame) -> DataFrame:
    return (
        messages.withColumnRenamed("sender", "sender_raw")
        .join(_names(people), ["archive_id", "participant_id"], "left")
        .withColumn("sender", F.coalesce("display_name", "sender_raw", F.lit("(system)")))
        .drop("display_name")
    )


def v_media(media: DataFrame, messages: DataFrame, people: DataFrame) -> DataFrame:
    told = messages.select("archive_id", "msg_id", "ts", "date", "participant_id",
                           F.col("sender").alias("_raw"), F.col("text").alias("caption"))
    return (
        media.join(told, ["archive_id", "msg_id"], "left")
        .join(_names(people), ["archive_id", "participant_id"], "left")
        .withColumn("sender", F.coalesce("display_name", "_raw")).drop("display_name", "_raw")
    )


def searchable_content() -> Column:
    """Text plus what is inside the attachment, so that nothing sent is invisible.

    The bracketed texts are fixed values.
    """
    text = F.coalesce("text", F.lit(""))

    def part(col, before):
        return F.when(F.coalesce(F.col(col), F.lit("")) != "",
                      F.concat(F.lit(before), F.col(col), F.lit("]"))).otherwise("")

    described = F.when(
        F.coalesce("description", F.lit("")) != "",
        F.concat(F.lit(" ["), "kind", F.lit(": "), "description", F.lit("]")),
    ).otherwise(F.concat(F.lit(" ["), "kind", F.lit(" sent, not yet described]")))
    with_file = F.trim(F.concat(text, described, part("transcript", " [said: "), part("ocr_text", " [text in image: ")))
    without_file = (
        F.when((F.col("msg_type") == "media") & (text == ""), F.lit("[attachment, not included in the export]"))
        .when(F.col("msg_type") == "deleted", F.lit("[message deleted]"))
        .otherwise(F.col("text"))
    )
    return F.when(F.col("media_id").isNull(), without_file).otherwise(with_file)


def v_searchable(messages: DataFrame, people: DataFrame, media: DataFrame | None = None) -> DataFrame:
    named = v_messages(messages, people).select(
        "archive_id", "msg_id", "ts", "date", "hour", "weekday", "sender", "msg_type", "text", "session_id"
    )
    details = ["media_id", "kind", "description", "transcript", "ocr_text"]
    if media is None:
        full = named
        for name in details:
            full = full.withColumn(name, F.lit(None).cast("bigint" if name == "media_id" else "string"))
    else:
        full = named.join(media.select("archive_id", "msg_id", *details), ["archive_id", "msg_id"], "left")
    return full.withColumn("content", searchable_content()).drop("text", *details)
