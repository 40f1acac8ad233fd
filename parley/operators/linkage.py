"""Who is who, and which rows of overlapping exports are the same message."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import SPACE_CLASS, WS, collapse_spaces, strip, text_fingerprint
from parley.operators.ordered import block_of
from parley.operators.skew import skew_join, spread_join

# Shape of a phone number, prefix of an unsaved contact, merge gate.
# The look-ahead asks for the least number of digits.
PHONE = rf"^(?=(?:\P{{Nd}}*\p{{Nd}}){{7}})(?:~{WS}*)?\+?[\p{{Nd}}{SPACE_CLASS}\-()]{{7,20}}$"
PHONE_KEY_DIGITS = 10
MIN_OVERLAP = 0.2


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_push_prefix(name) -> Column:
    n = _col(name)
    return strip(F.when(n.startswith("~"), F.substring(n, 2, 1 << 30)).otherwise(n))


def digits_of(name) -> Column:
    return F.regexp_replace(_col(name), r"\P{Nd}", "")


def is_phone_number(name) -> Column:
    return without_push_prefix(name).rlike(PHONE)


def canonical_key(name) -> Column:
    bare = without_push_prefix(name)
    return F.when(
        bare.rlike(PHONE), F.concat(F.lit("phone:"), F.right(digits_of(bare), F.lit(PHONE_KEY_DIGITS)))
    ).otherwise(F.concat(F.lit("name:"), F.lower(collapse_spaces(bare))))


def sender_counts(messages: DataFrame) -> DataFrame:
    return (
        messages.where("msg_type <> 'system' AND sender IS NOT NULL AND sender <> ''")
        .groupBy("archive_id", "sender").agg(F.count(F.lit(1)).alias("n"))
    )


def _with_manual(df: DataFrame, sender: str, manual: DataFrame | None) -> DataFrame:
    """Add ``participant_id``: a user-given link (archive_id, sender, participant_id) wins."""
    key = canonical_key(sender)
    if manual is None:
        return df.withColumn("participant_id", F.when(F.col(sender) != "", key))
    links = manual.select("archive_id", F.col("sender").alias(sender), F.col("participant_id").alias("_manual"))
    return (
        skew_join(df, links, ["archive_id", sender], df.columns, "left")
        .withColumn("participant_id", F.when(F.col(sender) != "", F.coalesce("_manual", key)))
        .drop("_manual")
    )


def resolve_participants(counts: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(archive_id, sender, n) to one row per person with aliases and the nicest label."""
    label = without_push_prefix("sender")
    phone = is_phone_number("sender")
    return (
        _with_manual(counts, "sender", manual)
        .groupBy("archive_id", "participant_id")
        .agg(
            F.max_by(label, F.struct(~is_phone_number(label), F.length(label), label)).alias("display_name"),
            F.sort_array(F.collect_set("sender")).alias("aliases"),
            F.bool_and(phone).alias("is_phone_only"),
            F.sum("n").alias("message_count"),
        )
    )


def tag_participants(messages: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """The alias lookup is a function of the sender, so only manual links need a join."""
    return _with_manual(messages, "sender", manual)


def suggest_merges(people: DataFrame) -> DataFrame:
    """Pairs where one name is another plus further words, as an equi join on word prefixes."""
    named = people.where(~F.col("is_phone_only")).select(
        "archive_id", "participant_id", F.col("display_name").alias("name"),
        F.lower("display_name").alias("folded"), "message_count",
    )
    words = F.split("folded", " ")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, F.lit(1), k), " ")
    )
    longer = named.where(F.size(words) > 1).select(
        "archive_id", F.col("name").alias("long_name"), F.col("message_count").alias("long_messages"),
        F.explode(prefixes).alias("folded"),
    )
    shorter = named.select(
        "archive_id", "folded", F.col("name").alias("short_name"),
        F.col("message_count").alias("short_messages"),
    )
    return skew_join(longer, shorter, ["archive_id", "folded"], ["long_name"]).drop("folded")


def phone_only_count(people: DataFrame) -> DataFrame:
    return people.groupBy("archive_id").agg(F.count_if("is_phone_only").alias("phone_only"))


def rename_participants(people: DataFrame, names: DataFrame) -> DataFrame:
    """Set display names given as (archive_id, participant_id, new_name)."""
    return (
        people.join(names, ["archive_id", "participant_id"], "left")
        .withColumn("display_name", F.coalesce("new_name", "display_name")).drop("new_name")
    )


# --- message identity ---------------------------------------------------------------


def base_key() -> Column:
    """Identity of a message whichever export it came from.

    Exports are minute precise, and the same attachment reads differently with and without
    media, so an attachment is keyed by its minute and sender alone.
    """
    who = F.lower(strip(F.coalesce(F.when(F.col("sender") != "", F.col("sender")), F.lit("~system~"))))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    attached = F.col("attachment").isNotNull() & (F.col("attachment") != "")
    what = (
        F.when((F.col("msg_type") == "media") | attached, F.lit("media"))
        .when(F.col("msg_type") == "deleted", F.lit("deleted"))
        .otherwise(text_fingerprint("text"))
    )
    return F.concat_ws("|", stamp, who, what)


def assign_keys(messages: DataFrame, export: list[str]) -> DataFrame:
    """Add ``base_key``, ``occurrence`` and ``dedup_key`` (the n-th equal message of an export).

    A group is one minute of one sender with one text. In case it is huge, it is counted in
    blocks of lines. ``export`` may name further columns that are functions of the minute:
    rows already shuffled by them are not shuffled again.
    """
    part = [*export, "base_key"]
    keyed = messages.withColumn("base_key", base_key()).withColumn("_block", block_of("line_no"))
    within = Window.partitionBy(*part, "_block").orderBy("line_no")
    local = keyed.withColumn("_rn", F.row_number().over(within) - 1)
    before = (Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    edges = (
        keyed.groupBy(*part, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .select(*part, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        local.join(edges, [*part, "_block"])
        .withColumn("occurrence", F.col("_rn") + F.col("_before"))
        .withColumn("dedup_key", F.concat_ws("#", "base_key", F.col("occurrence").cast("string")))
        .drop("_rn", "_before", "_block")
    )


def assign_small_keys(messages: DataFrame, export: list[str]) -> DataFrame:
    """``assign_keys`` where no group is known to be huge: one window, no join."""
    keyed = messages.withColumn("base_key", base_key())
    within = Window.partitionBy(*export, "base_key").orderBy("line_no")
    return keyed.withColumn("occurrence", F.row_number().over(within) - 1).withColumn(
        "dedup_key", F.concat_ws("#", "base_key", F.col("occurrence").cast("string")))


def richness() -> Column:
    """Orderable: a named file beats a caption, a caption beats an empty placeholder."""
    attached = F.coalesce(F.col("attachment") != "", F.lit(False))
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(
        attached.cast("int").alias("file"),
        ((F.col("msg_type") != "media") | (text != "")).cast("int").alias("said"),
        F.length(text).alias("size"),
    )


def merge_exports(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keyed union of two keyed streams; the richer version survives, ties keep the stored one."""
    both = existing.withColumn("_old", F.lit(1)).unionByName(incoming.withColumn("_old", F.lit(0)))
    cols = [c for c in both.columns if c not in ("archive_id", "dedup_key", "_old")]
    kept = both.groupBy("archive_id", "dedup_key").agg(
        F.max_by(F.struct(*cols), F.struct(richness(), F.col("_old"))).alias("m")
    )
    return kept.select("archive_id", "dedup_key", "m.*")


def merge_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per archive: total, added, skipped, upgraded (an upgrade also counts as skipped)."""
    old = existing.select("archive_id", "dedup_key", richness().alias("old"))
    new = incoming.select("archive_id", "dedup_key", richness().alias("new"))
    both = old.join(new, ["archive_id", "dedup_key"], "full")
    return both.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("old").isNull()).alias("added"),
        F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("skipped"),
        F.count_if(F.col("new") > F.col("old")).alias("upgraded"),
    )


def participant_overlap(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Share of the incoming people the archive already knows; null without evidence."""

    def people(df, side):
        return (
            df.where("sender IS NOT NULL AND sender <> ''")
            .select("archive_id", canonical_key("sender").alias("who")).distinct()
            .withColumn(side, F.lit(True))
        )

    both = people(existing, "old").join(people(incoming, "new"), ["archive_id", "who"], "full")
    n_old, n_new = F.count("old"), F.count("new")
    shared = F.count_if(F.col("old") & F.col("new"))
    return both.groupBy("archive_id").agg(
        F.when((n_old > 0) & (n_new > 0), shared / n_new).alias("overlap"),
        ((n_old > 0) & (n_new > 0) & (shared / F.greatest(n_new, F.lit(1)) < MIN_OVERLAP)).alias("refused"),
    )


def reload_existing(stored: DataFrame) -> DataFrame:
    """Stored rows as raw messages; an archive with any missing key gets all keys anew."""
    raw = stored.withColumn("line_no", F.col("msg_id")).withColumn("text", F.coalesce("text", F.lit("")))
    broken = (
        stored.groupBy("archive_id").agg(F.bool_or(F.col("dedup_key").isNull()).alias("_rekey"))
        .where("_rekey").select("archive_id")
    )  # one row per damaged archive
    keyed = raw.withColumnRenamed("dedup_key", "_stored_key")
    kept = spread_join(keyed, broken, ["archive_id"], ["msg_id"], "left_anti").withColumn("dedup_key", F.col("_stored_key"))
    redone = assign_keys(spread_join(keyed, broken, ["archive_id"], ["msg_id"], "left_semi"), ["archive_id"])
    cols = ["archive_id", "dedup_key", "line_no", "ts", "sender", "text", "msg_type", "attachment"]
    return kept.select(*cols).unionByName(redone.select(*cols))
