"""Attachments: what they are, which message they belong to, what is left to describe."""

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.answers import remember
from parley.operators.ordered import block_of, dense_ids
from parley.operators.skew import skew_join

# Kind by name prefix, by role in the name, by extension.
PREFIX_KIND = {
    "IMG-": "image", "VID-": "video", "AUD-": "audio", "PTT-": "voice",
    "STK-": "sticker", "DOC-": "document", "GIF-": "video",
}
ROLE_KIND = {"PHOTO": "image", "VIDEO": "video", "AUDIO": "voice", "STICKER": "sticker", "DOCUMENT": "document"}
EXT_KIND = {
    "image": [".jpg", ".jpeg", ".png", ".heic", ".heif", ".bmp", ".gif", ".webp"],
    "video": [".mp4", ".mov", ".3gp", ".3gpp", ".mkv", ".avi", ".webm", ".wmv"],
    "audio": [".opus", ".ogg", ".m4a", ".mp3", ".aac", ".wav", ".amr", ".flac"],
    "document": [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".csv", ".rtf"],
    "contact": [".vcf"],
}
# Extensions that can be described, per kind.
READABLE = {
    "image": [".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif", ".gif"],
    "sticker": [".webp", ".png"],
    "video": [".mp4", ".mov", ".3gp", ".3gpp", ".webm", ".avi", ".wmv", ".mkv"],
    "audio": [".opus", ".ogg", ".m4a", ".mp3", ".aac", ".wav", ".flac"],
    "voice": [".opus", ".ogg", ".m4a", ".mp3", ".aac", ".wav", ".flac"],
    "document": [".pdf", ".txt", ".csv"],
    "contact": [".vcf"],
}
UPLOAD_BYTES = 18 * 1024 * 1024
MAX_VIDEO_MB = 200
EMBED_BATCH = 64
# Kinds that are read without a vision request.
FREE_KINDS = ("voice", "audio", "contact")


def base_name(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.substring_index(F.regexp_replace(p, "/+$", ""), "/", -1)


def suffix(name) -> Column:
    """Extension with its dot, lower case; a leading dot is no extension."""
    n = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_extract(n, r"^.+(\.[^.]+)$", 1))


def stem(name) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(n, r"(?<=.)\.[^.]+$", "")


def classify_media(path) -> Column:
    name = base_name(path)
    upper, ext = F.upper(name), suffix(name)
    kind = None
    for prefix, label in PREFIX_KIND.items():
        value = F.when(ext == ".webp", "sticker").otherwise(label) if label == "image" else F.lit(label)
        test = upper.startswith(prefix)
        kind = F.when(test, value) if kind is None else kind.when(test, value)
    for role, label in ROLE_KIND.items():
        kind = kind.when(upper.contains(f"-{role}-"), label)
    for label, extensions in EXT_KIND.items():
        kind = kind.when(ext.isin(extensions), label)
    return kind.otherwise("other")


def media_readable(kind, ext) -> Column:
    # One reference to each column: the optimiser inlines the long kind expression per use.
    return F.concat(kind, ext).isin([label + e for label, extensions in READABLE.items() for e in extensions])


def catalog_columns(files: DataFrame) -> DataFrame:
    """Name, extension, kind and readability of files given by path and size."""
    return (
        files.withColumn("filename", base_name("path")).withColumn("ext", suffix("filename"))
        .withColumn("kind", classify_media("filename")).withColumn("readable", media_readable("kind", "ext"))
        .withColumn("needs_upload", F.col("size_bytes") > UPLOAD_BYTES)
    )


FILE = ["filename", "path", "kind", "ext", "size_bytes", "content_hash", "readable", "needs_upload"]


def resolve_attachments(references: DataFrame, files: DataFrame) -> DataFrame:
    """(archive_id, reference) to its file: exact name, base name, any case, without extension.

    All four ways are keys of one lookup table, so one equi join and one minimum answer them.
    """
    file = F.struct(*FILE)
    by_name = files.groupBy("archive_id", F.col("filename").alias("key")).agg(F.max_by(file, "path").alias("file"))
    by_lower = files.groupBy("archive_id", F.lower("filename").alias("key")).agg(
        F.max_by(file, "path").alias("file"), F.min("path").alias("_first"))
    by_stem = by_lower.groupBy("archive_id", stem("key").alias("key")).agg(F.min_by("file", "_first").alias("file"))
    lookup = (
        by_name.withColumn("how", F.lit("name")).unionByName(by_lower.drop("_first").withColumn("how", F.lit("lower")))
        .unionByName(by_stem.withColumn("how", F.lit("stem")))
    )
    base = base_name("reference")
    ways = F.array(*[
        F.struct(F.lit(tier).alias("tier"), F.lit(how).alias("how"), key.alias("key"))
        for tier, how, key in (
            (1, "name", F.col("reference")), (2, "name", base), (3, "lower", F.lower(base)),
            (4, "stem", F.lower(stem(base))),
        )
    ])
    asked = references.select("archive_id", "reference").distinct().select(
        "archive_id", "reference", F.inline(ways))
    found = asked.join(lookup, ["archive_id", "how", "key"])
    best = found.groupBy("archive_id", "reference").agg(
        F.min("tier").alias("tier"), F.min_by("file", "tier").alias("file"))
    return best.select("archive_id", "reference", "tier", "file.*")


def references_of(messages: DataFrame) -> DataFrame:
    return messages.where("attachment IS NOT NULL").select("archive_id", F.col("attachment").alias("reference"))


def catalog_report(references: DataFrame, files: DataFrame) -> DataFrame:
    """Per archive: files, bytes, matches, references without file and files without reference."""
    resolved = resolve_attachments(references, files)
    refs = references.select("archive_id", "reference").distinct()
    seen = refs.join(resolved.select("archive_id", "reference", "path"), ["archive_id", "reference"], "left")
    by_ref = seen.groupBy("archive_id").agg(
        F.count("path").alias("matched"), F.count_if(F.col("path").isNull()).alias("unmatched_references"))
    # Only the file a name leads to can be an orphan, like in the lookup itself.
    named = files.groupBy("archive_id", "filename").agg(F.max("path").alias("path"))
    orphans = named.join(resolved.select("archive_id", "path").distinct(), ["archive_id", "path"], "left_anti")
    by_file = files.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("files_found"), F.sum("size_bytes").alias("total_bytes"),
        F.count_if(~F.col("readable")).alias("unreadable"))
    lost = orphans.groupBy("archive_id").agg(F.count(F.lit(1)).alias("orphan_files"))
    counts = ["files_found", "total_bytes", "unreadable", "matched", "unmatched_references", "orphan_files"]
    return (
        by_file.join(by_ref, "archive_id", "full").join(lost, "archive_id", "full").fillna(0, counts)
        .select("archive_id", *counts)
    )


def files_by_kind(files: DataFrame) -> DataFrame:
    return files.groupBy("archive_id", "kind").agg(F.count(F.lit(1)).alias("files"))


def unreadable_by_ext(files: DataFrame) -> DataFrame:
    ext = F.when(F.col("ext") == "", "(none)").otherwise(F.col("ext"))
    return files.where(~F.col("readable")).groupBy("archive_id", ext.alias("ext")).agg(F.count(F.lit(1)).alias("files"))


def media_rows(messages: DataFrame, files: DataFrame) -> DataFrame:
    """One row per message whose attachment resolves, numbered from 0 in message order."""
    told = messages.where("attachment IS NOT NULL").select(
        "archive_id", "msg_id", F.col("attachment").alias("reference"))
    linked = skew_join(told, resolve_attachments(told, files), ["archive_id", "reference"], ["msg_id"]).drop("reference", "tier")
    numbered = dense_ids(linked.withColumn("_block", block_of("msg_id")), ["archive_id"], ["_block"], ["msg_id"], "media_id")
    nothing = F.lit(None).cast("string")
    return numbered.drop("_block", "needs_upload").withColumns({
        "description": nothing, "transcript": nothing, "ocr_text": nothing,
        "detected_objects": F.lit(None).cast("array<string>"),
        "status": F.when(F.col("readable"), "pending").otherwise("skipped"),
        "error": F.when(~F.col("readable"), F.concat(F.lit("unsupported format "), "ext")),
        "model_used": nothing,
    })


def files_to_process(media: DataFrame) -> DataFrame:
    """Every distinct readable content once."""
    return media.where("readable").groupBy("archive_id", "content_hash").agg(
        F.min_by(F.struct("filename", "path", "kind", "ext", "size_bytes"), "media_id").alias("f")
    ).select("archive_id", "content_hash", "f.*")


def skip_reason(transcribe_audio: bool = True, max_video_mb: int = MAX_VIDEO_MB) -> Column:
    """Why a file is not sent to a model, null where it is."""
    ext = F.when(F.col("ext") == "", "no extension").otherwise(F.col("ext"))
    reason = F.when(~F.col("readable") & (F.col("kind") != "contact"),
                    F.concat(ext, F.lit(" is not a readable format")))
    reason = reason.when((F.col("kind") == "video") & (F.col("size_bytes") > max_video_mb * 1024 * 1024),
                         F.lit(f"video larger than {max_video_mb} MB"))
    if not transcribe_audio:
        reason = reason.when(F.col("kind").isin("voice", "audio"), F.lit("audio transcription is off"))
    return reason


UNDERSTANDING = "description string, transcript string, ocr_text string, detected_objects array<string>, status string, error string, model_used string"
_TOLD = ["description", "transcript", "ocr_text", "detected_objects", "model_used"]
#: Files in one call of the model.
DESCRIBE_BATCH = 64


def describe_files(files: DataFrame, describe: Callable) -> DataFrame:
    """Run the pluggable model over distinct files; ``describe`` maps a pandas frame to one
    with the UNDERSTANDING columns in the same row order. A call that fails is repeated file by
    file; a file that fails again gets the status ``error`` and its message."""

    def run(batches):
        import pandas as pd

        def told(part):
            try:
                out = describe(part)
            except Exception as problem:
                if len(part) > 1:
                    return pd.concat([told(part.iloc[i:i + 1].reset_index(drop=True)) for i in range(len(part))])
                out = pd.DataFrame({c: [None] for c in _TOLD} | {"status": ["error"], "error": [f"{type(problem).__name__}: {problem}"]})
            out.insert(0, "content_hash", part["content_hash"].to_numpy())
            return out

        for pdf in batches:
            for at in range(0, len(pdf), DESCRIBE_BATCH):
                yield told(pdf.iloc[at:at + DESCRIBE_BATCH].reset_index(drop=True))

    return files.mapInPandas(run, f"content_hash string, {UNDERSTANDING}")


def enrich_media(media: DataFrame, cache: DataFrame, describe: Callable, path: str | None = None,
                 **rules) -> tuple[DataFrame, DataFrame]:
    """(media with what is in it, new cache rows), both read from the stored answers.

    Each distinct content is described once: a cache hit, else the model, else the reason to
    skip. Failures reach the rows but not the cache, so they are tried again. A rerun with the
    same ``path`` asks only what has no answer there.
    """
    todo = media.where("readable AND status = 'pending'")
    distinct = todo.groupBy("content_hash").agg(
        F.min_by(F.struct("filename", "path", "kind", "ext", "size_bytes", "readable"), F.struct("archive_id", "media_id")).alias("f")
    ).select("content_hash", "f.*")
    hits = cache.select("content_hash", *_TOLD)
    known = distinct.select("content_hash").join(hits, "content_hash").select(
        "content_hash", *_TOLD, F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"),
        F.lit("cached").alias("outcome"))
    missing = distinct.join(hits.select("content_hash"), "content_hash", "left_anti").withColumn("_skip", skip_reason(**rules))
    skipped = missing.where("_skip IS NOT NULL").select(
        "content_hash", *[F.lit(None).cast("array<string>" if c == "detected_objects" else "string").alias(c) for c in _TOLD],
        F.lit("skipped").alias("status"), F.col("_skip").alias("error"), F.lit("skipped").alias("outcome"))
    asked = missing.where("_skip IS NULL").drop("_skip")
    described = remember(asked, "content_hash", lambda rows: describe_files(rows, describe), path).withColumn(
        "outcome", F.when(F.col("status") == "done", "described").otherwise(F.col("status")))
    told = known.unionByName(skipped).unionByName(described)
    plain = media.withColumnsRenamed({c: f"_{c}" for c in ("status", "error", *_TOLD)})
    joined = skew_join(plain, told, ["content_hash"], ["archive_id", "media_id"], "left")
    touched = F.col("outcome").isNotNull() & F.col("_readable_pending")
    joined = joined.withColumn("_readable_pending", F.col("readable") & (F.col("_status") == "pending"))
    for c in ("status", "error", *_TOLD):
        joined = joined.withColumn(c, F.when(touched, F.col(c)).otherwise(F.col(f"_{c}"))).drop(f"_{c}")
    result = joined.withColumn("outcome", F.when(F.col("_readable_pending"), F.col("outcome"))).drop("_readable_pending")
    new_cache = described.where("status = 'done'").select("content_hash", *_TOLD)
    return result, new_cache


def parse_contact_cards(cards: DataFrame, text: str = "text") -> DataFrame:
    """Names and numbers of vCard texts. The wording of the description is a fixed value."""
    from parley.operators.parse import LINE_ENDS
    from parley.functions.text import strip

    lines = F.split(text, LINE_ENDS)
    names = F.transform(F.filter(lines, lambda x: F.upper(x).startswith("FN:")),
                        lambda x: strip(F.substring(x, 4, 1 << 30)))
    phones = F.transform(
        F.filter(lines, lambda x: F.upper(x).startswith("TEL")),
        lambda x: F.when(F.instr(x, ":") > 0, strip(x.substr(F.instr(x, ":") + 1, F.length(x)))).otherwise(""))
    who = F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise("an unnamed contact")
    number = F.when(F.size("phones") > 0, F.concat(F.lit(" Phone: "), F.array_join("phones", ", "), F.lit("."))).otherwise("")
    return cards.withColumn("names", names).withColumn("phones", phones).withColumns({
        "description": F.concat(F.lit("Shared contact card for "), who, F.lit("."), number),
        "ocr_text": F.col(text),
        "detected_objects": F.concat(F.array(F.lit("contact card")), F.col("names")),
    })


def estimate_cost(files: DataFrame) -> DataFrame:
    """Per archive and kind: files, bytes, readable ones and a rough token count."""
    size = F.col("size_bytes")
    tokens = (
        F.when(~F.col("readable"), 0).when(F.col("kind").isin("image", "sticker"), 300)
        .when(F.col("kind").isin("voice", "audio"), F.floor(size / 2000 * 32))
        .when(F.col("kind") == "video", F.floor(size / 250_000 * 300))
        .when(F.col("kind") == "document", 3000).otherwise(0)
    )
    return files.groupBy("archive_id", "kind").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"),
        F.count_if("readable").alias("readable"), F.sum(tokens.cast("long")).alias("estimated_tokens"))


def undescribed(media: DataFrame) -> DataFrame:
    return media.where("readable AND coalesce(description, '') = '' AND coalesce(transcript, '') = ''")


def pending_media_by_kind(media: DataFrame) -> DataFrame:
    """Work left per kind, by distinct content: a forwarded photo is one request."""
    files = undescribed(media).groupBy("archive_id", "kind", "content_hash").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size_bytes").alias("bytes"),
        F.max((F.col("size_bytes") > UPLOAD_BYTES).cast("int")).alias("large"))
    return files.groupBy("archive_id", "kind").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), (F.sum("bytes") / 1048576.0).alias("mb"),
        F.sum("large").alias("large"),
    ).withColumn("requests", F.when(F.col("kind").isin(*FREE_KINDS), 0).otherwise(F.col("files") + F.col("large")))


def pending_media_files(media: DataFrame, existing: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One row per pending (content, kind) whose file is still there (archive_id, path)."""
    left = undescribed(media)
    if kinds:
        left = left.where(F.col("kind").isin(kinds))
    files = left.groupBy("archive_id", "content_hash", "kind").agg(
        F.min_by(F.struct("filename", "path", "ext"), "media_id").alias("f"), F.max("size_bytes").alias("size_bytes"))
    return (
        files.select("archive_id", "content_hash", "kind", "f.*", "size_bytes")
        .withColumn("needs_upload", F.col("size_bytes") > UPLOAD_BYTES)
        .join(existing.select("archive_id", "path").distinct(), ["archive_id", "path"], "left_semi")
    )


def pending_embeddings(chunks: DataFrame, vectors: DataFrame, batch: int = EMBED_BATCH) -> DataFrame:
    have = vectors.select("archive_id", "chunk_id", F.lit(1).alias("_v"))
    counted = chunks.select("archive_id", "chunk_id").join(have, ["archive_id", "chunk_id"], "left").groupBy("archive_id").agg(
        F.count_if(F.col("_v").isNull()).alias("pending"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("requests", F.ceil(F.col("pending") / batch))


def pending_work(media: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(archive_id, task, pending, total, requests, complete) of both kinds of work."""
    embed = pending_embeddings(chunks, vectors).withColumn("task", F.lit("embed"))
    kinds = pending_media_by_kind(media).groupBy("archive_id").agg(
        F.sum("files").alias("pending"), F.sum("requests").alias("requests"))
    done = media.where("coalesce(description, '') <> '' OR coalesce(transcript, '') <> ''").groupBy(
        "archive_id", "content_hash").agg(F.lit(1).alias("_one")).groupBy("archive_id").agg(F.count(F.lit(1)).alias("_done"))
    describe = kinds.join(done, "archive_id", "left").select(
        "archive_id", "pending", (F.col("pending") + F.coalesce("_done", F.lit(0))).alias("total"), "requests",
        F.lit("describe_media").alias("task"))
    return embed.unionByName(describe).withColumn("complete", F.col("pending") == 0)
