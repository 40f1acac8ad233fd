"""Export files: zips, transcripts in any encoding, attachments."""

import hashlib
import re
import zipfile
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators.media import base_name, catalog_columns
from parley.operators.parse import HEADER, LINE_ENDS, split_lines

# Encodings in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "utf-16", "latin-1")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark spells it, and the place within it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(uri)


def safe_member_path(name) -> Column:
    """Archive-relative path with plain slashes; null where the entry tries to escape."""
    slashed = F.translate(F.col(name) if isinstance(name, str) else name, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = slashed.rlike("^/|^[A-Za-z]:") | F.exists(parts, lambda p: p == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


# Members are handed on in batches of about this many bytes, which bounds the memory of a task.
BATCH_BYTES = 4 * 1024 * 1024


def in_pieces(rows, schema: pa.Schema, size: Callable):
    """Record batches of ``rows`` (tuples), each of about ``BATCH_BYTES`` by ``size`` of a row."""
    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= BATCH_BYTES or len(held) >= 10_000:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


_MEMBERS = pa.schema([("export", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


def _members(batches):
    """One zip at a time is a Python value."""
    def rows():
        for files in batches:
            for path, content in zip(files.column("path"), files.column("content")):
                path, name = path.as_py(), None
                try:
                    with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                        for info in archive.infolist():
                            if info.is_dir():
                                continue
                            name = info.filename
                            yield path, name, info.file_size, archive.read(info), None
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError) as e:
                    yield path, name, None, None, f"{type(e).__name__}: {e}"

    yield from in_pieces(rows(), _MEMBERS, lambda r: len(r[3] or b""))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """The members of all zip files under ``path``."""
    return zip_members(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option(
        "recursiveFileLookup", "true").load(path))


def zip_members(zips: DataFrame) -> DataFrame:
    """Members of zips (path, content) as (export, name, member, size, content, unsafe, error).

    Unsafe entries stay as rows without content, so they can be counted. A zip that breaks off gives a row with its error behind
    the members before it. Zips lie whole in their rows here; ``zips.py`` reads them in pieces.
    """
    members = zips.select("path", "content").mapInArrow(
        _members, "export string, name string, size bigint, content binary, error string")
    member = safe_member_path("name")
    return (
        members.withColumn("member", member).withColumn("unsafe", F.col("member").isNull() & F.col("error").isNull())
        .withColumn("content", F.when(F.col("member").isNotNull(), F.col("content")))
    )


def pick_transcript(members: DataFrame, keys: list[str] = ("export",)) -> DataFrame:
    """The transcript among the text members of every export."""
    name = F.lower(base_name("member"))
    tier = (F.when(name.isin("_chat.txt", "chat.txt"), 1).when(name.contains("whatsapp chat"), 2).otherwise(3))
    texts = members.where(F.col("member").endswith(".txt") & F.col("size").isNotNull()).withColumn("tier", tier)
    # Conventional names by path; otherwise the largest, the first by path among equals.
    order = F.struct(F.col("tier"), F.when(F.col("tier") == 3, -F.col("size")).otherwise(0), F.col("member"))
    keep = [c for c in members.columns if c not in keys]
    return texts.groupBy(*keys).agg(F.min_by(F.struct(*keep, "tier"), order).alias("m")).select(*keys, "m.*")


def _decode(batches):
    import regex

    # The flag is for Java only; its pattern is otherwise common ground.
    header = regex.compile(HEADER.replace("(?d)", ""), regex.MULTILINE)

    def decoded(content):
        for encoding in ENCODINGS:
            try:
                text = content.decode(encoding)
            except UnicodeError:
                continue
            if header.search(text) or encoding == "latin-1":
                return text, encoding

    for files in batches:
        key = files.schema.field(0)
        schema = pa.schema([key, ("text", pa.string()), ("encoding", pa.string())])
        rows = ((k.as_py(), *decoded(c.as_py())) for k, c in zip(*files.columns))
        yield from in_pieces(rows, schema, lambda r: 2 * len(r[1]))


def decode_transcript(files: DataFrame, key: str = "file") -> DataFrame:
    """Binary transcripts (file, content) as text: the first decoding that shows a header. One text at a time is decoded."""
    return files.select(key, "content").mapInArrow(_decode, f"{key} string, text string, encoding string")


def transcript_lines(decoded: DataFrame, key: str = "file") -> DataFrame:
    return split_lines(decoded, [key])


def scan_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines (file, line_no, line) of UTF-8 transcripts of any size.

    Spark splits big files at line ends. Rows of one split keep their order, so a line number
    is its position in the split plus the lines of the earlier splits of that file.
    """
    raw = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
        "value", F.monotonically_increasing_id().alias("_id"),
    )
    # The reader cuts at \n, \r\n and \r; the remaining line ends are cut here.
    parts = raw.select("file", "_at", "_id", F.posexplode(F.split("value", LINE_ENDS)).alias("_i", "line"))
    within = Window.partitionBy("file", "_at").orderBy("_id", "_i")
    numbered = parts.withColumn("_rn", F.row_number().over(within))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        parts.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"))
        .select("file", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return numbered.join(edges, ["file", "_at"]).select(
        "file", (F.col("_before") + F.col("_rn")).alias("line_no"), "line")


#: Bytes hashed at either end of a file.
HASHED = 1 << 20


def scan_media_files(spark: SparkSession, path: str, transcript: str | None = None) -> DataFrame:
    """Catalogue of the files under ``path`` with their hashes; dot files and the file at ``transcript`` are left out.

    Files are listed without contents; a hash reads the two ends of a file by its file system, so files of any size pass. A file
    that cannot be read has a null hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size_bytes"))
    listed = catalog_columns(files).where(~F.col("filename").startswith("."))
    if transcript is not None:
        plain = F.regexp_replace("path", "^file:/+", "/")
        listed = listed.where(plain != re.sub("^file:/+", "/", transcript))
    hashed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema) + ", content_hash string"

    def run(batches):
        for batch in batches:
            hashes = [content_hash(p, n) for p, n in zip(batch.column("path").to_pylist(), batch.column("size_bytes").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], [*batch.schema.names, "content_hash"])

    return listed.mapInArrow(run, hashed)


def content_hash(path: str, size: int) -> str | None:
    """sha256 over the size in digits, the first MiB and, in files of more than two, the last one."""
    digest = hashlib.sha256(str(size).encode())
    try:
        system, place = file_system(path)
        with system.open_input_file(place) as file:
            digest.update(file.read(HASHED))
            if size > 2 * HASHED:
                file.seek(size - HASHED)
                digest.update(file.read(HASHED))
    except OSError:
        return None
    return digest.hexdigest()
