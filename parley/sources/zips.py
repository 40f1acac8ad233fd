"""Zip files as a Spark data source: listed from their central directories, members unpacked in pieces only where asked for.

Files are opened by ranged reads through their file system, so a listing reads the end of each zip and no member; a member of any size is unpacked
in pieces of bounded size. What cannot be read is told in rows: a broken zip is one row with its error, so is a broken member.
"""

from __future__ import annotations

import codecs
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parley.operators.parse import HEADER
from parley.sources.exports import ENCODINGS, file_system, pick_transcript, safe_member_path

#: Zips of a task, in bytes, each counted with the cost of opening it.
TASK_BYTES = 128 << 20
OPEN_COST = 1 << 20
#: Bytes unpacked at once.
PIECE = 4 << 20
#: What reading a zip or a member raises when it is broken, encrypted, cut short or packed by an unknown method.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError)

_LISTED = "export string, name string, size long, error string"


def _members(path: str) -> Iterator[tuple]:
    """(export, name, size, error) of the entries of a zip; folders are left out."""
    try:
        system, place = file_system(path)
        with system.open_input_file(place) as file, zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield path, info.filename, info.file_size, None
    except BROKEN as e:
        yield path, None, None, f"{type(e).__name__}: {e}"


class Zips(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Zips]:
        """Zips below the folder, small ones together."""
        system, place = file_system(self.folder)
        prefix = self.folder[: len(self.folder) - len(place)] if self.folder.endswith(place) else ""
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(place, recursive=True))
                       if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))
        out: list[Zips] = []
        room = 0
        for path, size in found:
            if room < size + OPEN_COST:
                out.append(Zips([]))
                room = TASK_BYTES
            out[-1].paths.append(prefix + path)
            room -= size + OPEN_COST
        return out or [Zips([])]

    def read(self, partition: Zips) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("export", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("error", pa.string())])
        rows: list[tuple] = []
        for path in partition.paths:
            for row in _members(path):
                rows.append(row)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


class ZipListing(DataSource):
    """``spark.read.format("parley_zips").load(folder)``: the entries of all zips below a folder."""

    @classmethod
    def name(cls) -> str:
        return "parley_zips"

    def schema(self) -> str:
        return _LISTED

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def list_members(spark: SparkSession, folder: str) -> DataFrame:
    """Entries (export, name, member, size, unsafe, error) of all zips below ``folder``, without contents.

    ``member`` is the safe path, null where an entry tries to escape. A zip that cannot be read is one row with its ``error``. An empty folder gives no rows.
    """
    spark.dataSource.register(ZipListing)
    listed = spark.read.format("parley_zips").load(folder)
    member = safe_member_path("name")
    return listed.select("export", "name", member.alias("member"), "size", (member.isNull() & F.col("error").isNull()).alias("unsafe"), "error")


class _Failed(NamedTuple):
    error: str


def _pieces(path: str, name: str, piece: int) -> Iterator[bytes | _Failed]:
    try:
        system, place = file_system(path)
        with system.open_input_file(place) as file, zipfile.ZipFile(file) as archive, archive.open(name) as member:
            while data := member.read(piece):
                yield data
    except (*BROKEN, KeyError) as e:
        yield _Failed(f"{type(e).__name__}: {e}")


def unpack(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """Pieces (export, name, piece, content, error) of the members (export, name), in order from 0; nothing else of their zips is unpacked.

    A member that breaks off gives its error behind the pieces before it. Empty members give no piece.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for export, name in zip(batch.column("export").to_pylist(), batch.column("name").to_pylist()):
                for n, data in enumerate(_pieces(export, name, piece)):
                    failed = isinstance(data, _Failed)
                    yield pa.record_batch([
                        pa.array([export]), pa.array([name]), pa.array([n], pa.int32()), pa.array([None if failed else data], pa.binary()),
                        pa.array([data.error if failed else None], pa.string())], ["export", "name", "piece", "content", "error"])

    return members.select("export", "name").mapInArrow(run, "export string, name string, piece int, content binary, error string")


def _texts(path: str, name: str, encoding: str, piece: int) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder(encoding)()
    for data in _pieces(path, name, piece):
        if isinstance(data, _Failed):
            raise OSError(data.error)
        yield decoder.decode(data)
    yield decoder.decode(b"", True)


def _lines(texts: Iterator[str]) -> Iterator[str]:
    """The lines of a text that comes in pieces, without their ends; no line after the last end."""
    held = ""
    for text in texts:
        parts = (held + text).splitlines(keepends=True)
        # the last one may go on, and a return may be half of a line end
        held = parts.pop() if parts and (parts[-1].splitlines()[0] == parts[-1] or parts[-1].endswith("\r")) else ""
        for part in parts:
            yield part.splitlines()[0]
    yield from held.splitlines()


def transcript_lines(picked: DataFrame, piece: int = PIECE) -> DataFrame:
    """Numbered lines (file, line_no, line, encoding, error) of the members (export, name), decoded as they are unpacked.

    The encoding is the first that decodes the whole member and shows a header, which takes a pass over it; the last one always does. A member that cannot be read
    gives one row with its error and no lines. A task holds a piece and a line, whatever the size of the member.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        header = regex.compile(HEADER.replace("(?d)", ""))

        def fits(export: str, name: str, encoding: str) -> bool:
            found = False
            try:
                for line in _lines(_texts(export, name, encoding, piece)):
                    found = found or header.search(line) is not None
            except UnicodeError:
                return False
            return found or encoding == ENCODINGS[-1]

        def rows(export: str, number: int, lines: list, encoding: str | None, error: str | None) -> pa.RecordBatch:
            n = len(lines)
            return pa.record_batch([
                pa.array([export] * n, pa.string()), pa.array(range(number, number + n), pa.int64()), pa.array(lines, pa.string()),
                pa.array([encoding] * n, pa.string()), pa.array([error] * n, pa.string())], ["file", "line_no", "line", "encoding", "error"])

        for batch in batches:
            for export, name in zip(batch.column("export").to_pylist(), batch.column("name").to_pylist()):
                try:
                    encoding = next(e for e in ENCODINGS if fits(export, name, e))
                except OSError as e:
                    yield rows(export, 0, [None], None, str(e))
                    continue
                held, size, number = [], 0, 1
                for line in _lines(_texts(export, name, encoding, piece)):
                    held.append(line)
                    size += len(line)
                    if size > piece or len(held) == 10_000:
                        yield rows(export, number, held, encoding, None)
                        number, held, size = number + len(held), [], 0
                if held:
                    yield rows(export, number, held, encoding, None)

    return picked.select("export", "name").mapInArrow(run, "file string, line_no long, line string, encoding string, error string")


def read_transcripts(spark: SparkSession, folder: str, piece: int = PIECE) -> DataFrame:
    """The lines of the transcript of each zip below ``folder``, as ``transcript_lines``; a zip that cannot be read is one row with its error.

    Transcripts are picked from the listing alone, so no attachment is unpacked. Zips without a text give no rows.
    """
    listed = list_members(spark, folder)
    picked = pick_transcript(listed.where("member is not null").select("export", "name", "member", "size"))
    broken = listed.where("error is not null").select(
        F.col("export").alias("file"), F.lit(0).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line"),
        F.lit(None).cast("string").alias("encoding"), "error")
    return transcript_lines(picked, piece).unionByName(broken)
