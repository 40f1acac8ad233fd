"""WARC archives: writing with revisits and segments, reading with reassembly.

The writer stores each distinct payload once, as a chunked HTTP response, and cuts blocks beyond ``segment_bytes`` into
continuation records. The reader streams every archive record by record, groups continuation records by the id of the
record they go on from, orders them by segment number, checks the total length, undoes the chunks and checks the digest.
A task holds one segment at a time while it reads; one payload is the largest value anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import files
from parley.sources.store import materialise, new_table_path

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _chunked(payload: bytes, size: int) -> Iterator[bytes]:
    for lo in range(0, len(payload), size):
        part = payload[lo: lo + size]
        yield b"%x\r\n" % len(part)
        yield part
        yield b"\r\n"
    yield b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = body[end + 2: end + 2 + size]
        if len(part) != size or body[end + 2 + size: end + 4 + size] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(part)
        at = end + 4 + size


def _record(fields: dict[str, object], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(head.encode()) + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


def mark_revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload) with the payload's SHA-1 and ``first``: for equal payloads of at least ``at_least`` bytes the
    least page_id, else null."""
    hashed = pages.select("page_id", "url", "payload", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("size"))
    firsts = hashed.where(F.col("size") >= at_least).groupBy("sha", "size").agg(F.min("page_id").alias("first"))
    return hashed.join(firsts, ["sha", "size"], "left")


def write(marked: DataFrame, folder: str, segment_bytes: int = 1 << 16, chunk_bytes: int = 1 << 13, level: int = 6) -> DataFrame:
    """One archive per task, each record its own gzip member; returns the stored list (path, records)."""
    if segment_bytes < 1 or chunk_bytes < 1:
        raise ValueError("segments and chunks need a length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        path = f"{folder}/part-{part:06d}.warc.gz"

        def fill(out) -> None:
            nonlocal count
            for batch in batches:
                for row in batch.to_pylist():
                    page, first = row["page_id"], row["first"]
                    revisit = first is not None and page != first
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{folder}/{part}/{count}").urn
                    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n".encode()
                    block = head if revisit else head + b"".join(_chunked(row["payload"], chunk_bytes))
                    pieces = [block[lo: lo + segment_bytes] for lo in range(0, len(block), segment_bytes)]
                    uri = None if row["url"] is None else " ".join(row["url"].split())
                    fields = {
                        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{name}>", "WARC-Date": _DATE, "WARC-Target-URI": uri,
                        "WARC-Profile": _PROFILE if revisit else None, "Content-Type": "application/http; msgtype=response",
                        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["sha"])).decode(),
                        "Parley-Page": page, "Parley-Refers-To-Page": first if revisit else None,
                        "WARC-Segment-Number": 1 if len(pieces) > 1 else None}
                    out.write(_record(fields, pieces[0], level))
                    for k, piece in enumerate(pieces[1:], 2):
                        own = uuid.uuid5(uuid.NAMESPACE_URL, f"{folder}/{part}/{count}/{k}").urn
                        out.write(_record({
                            "WARC-Type": "continuation", "WARC-Record-ID": f"<{own}>", "WARC-Date": _DATE, "WARC-Target-URI": uri,
                            "WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": k,
                            "WARC-Segment-Total-Length": len(block) if k == len(pieces) else None}, piece, level))
                    count += 1

        files.write_whole(path, fill)
        yield pa.record_batch([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

    return materialise(marked.mapInArrow(run, "path string, records long"), "archives")


def _records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, gzip member by gzip member, in pieces of a megabyte."""
    held, press = b"", zlib.decompressobj(31)

    def more(source) -> bytes:
        nonlocal press
        while True:
            data = press.unused_data if press.eof else source.read(1 << 20)
            if press.eof:
                press = zlib.decompressobj(31)
                data = data or source.read(1 << 20)
            if not data:
                return b""
            plain = press.decompress(data)
            if plain:
                return plain

    with files.stream(path) as source:
        while True:
            while (end := held.find(b"\r\n\r\n")) < 0:
                plain = more(source)
                if not plain:
                    if held.strip():
                        raise ValueError(f"{path} ends within a record")
                    return
                held += plain
            lines = held[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"{path} holds something that is no record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(fields["content-length"])
            parts, have = [held[end + 4:]], len(held) - end - 4
            while have < size + 4:
                plain = more(source)
                if not plain:
                    raise ValueError(f"{path} ends within a record")
                parts.append(plain)
                have += len(plain)
            body = b"".join(parts)
            yield fields, body[:size]
            held = body[size + 4:]


_RECORD = ("record_id string, type string, origin_id string, segment int, total long, page_id long, refers_to long, uri string, "
           "digest string, block binary")


def records(archives: DataFrame) -> DataFrame:
    """Every record of the archives listed in ``path``, as it stands in the file."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()),
                        ("total", pa.int64()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("uri", pa.string()),
                        ("digest", pa.string()), ("block", pa.binary())])

    def whole(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for f, block in _records(path):
                    rows.append({
                        "record_id": f["warc-record-id"], "type": f["warc-type"], "origin_id": f.get("warc-segment-origin-id"),
                        "segment": whole(f.get("warc-segment-number")), "total": whole(f.get("warc-segment-total-length")),
                        "page_id": whole(f.get("parley-page")), "refers_to": whole(f.get("parley-refers-to-page")),
                        "uri": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest"), "block": block})
                    held += len(block)
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n).mapInArrow(run, _RECORD)


def payloads(found: DataFrame) -> DataFrame:
    """Whole records with their payload: segments put together, lengths and digests checked, chunks undone.

    A missing, doubled or short segment and a wrong digest raise an error.
    """
    head = ["record_id", "type", "page_id", "refers_to", "uri", "digest"]
    blocks = F.col("blocks")
    whole = found.where("segment is null").select(
        *head, F.array(F.struct(F.lit(1).alias("segment"), F.octet_length("block").cast("long").alias("total"), "block")).alias("blocks"))
    parts = found.where("segment is not null").groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(
        F.max(F.when(F.col("segment") == 1, F.struct(*head[1:]))).alias("head"),
        F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("blocks"))
    parts = parts.select("record_id", "head.*", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                pieces = row.pop("blocks")
                block = b"".join(p["block"] for p in pieces)
                if [p["segment"] for p in pieces] != list(range(1, len(pieces) + 1)) or pieces[-1]["total"] != len(block):
                    raise ValueError(f"{row['record_id']}: segments are missing or their length is wrong")
                payload = None
                if row["type"] == "response":
                    http, _, body = block.partition(b"\r\n\r\n")
                    payload = unchunk(body) if b"\r\ntransfer-encoding: chunked" in http.lower() else body
                    if row["digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
                        raise ValueError(f"{row['record_id']}: the payload does not match its digest")
                rows.append(row | {"segments": len(pieces), "payload": payload})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
                ("uri", pa.string()), ("digest", pa.string()), ("segments", pa.int32()), ("payload", pa.binary())]))

    return whole.unionByName(parts).mapInArrow(
        run, "record_id string, type string, page_id long, refers_to long, uri string, digest string, segments int, payload binary")


def archive(pages: DataFrame, at_least: int = 0, segment_bytes: int = 1 << 16, chunk_bytes: int = 1 << 13) -> DataFrame:
    """The stored list of archives of ``pages`` (page_id, url, html); a null html is an empty payload, a null url is left out.

    Rows that repeat the least page_id of a payload are responses all; an empty table gives empty archives; other columns are not read.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return write(mark_revisits(rows, at_least), new_table_path(pages.sparkSession, "warc"), segment_bytes, chunk_bytes)


def summary(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, segments) of every record, all from the archives."""
    read = payloads(records(archives)).select(
        "page_id", "type", "refers_to", F.octet_length("payload").cast("long").alias("size"), F.substring("digest", 6, 32).alias("sha"), "segments")
    read = materialise(read, "records")
    responses = read.where("type = 'response'")
    # rows may repeat a page_id with other payloads: the digest tells which response is meant
    known = responses.groupBy(F.col("page_id").alias("refers_to"), "sha").agg(F.max("size").alias("first_size"))
    revisits = read.where("type = 'revisit'").join(known, ["refers_to", "sha"], "left").withColumn("size", F.col("first_size"))
    both = responses.select("page_id", "type", "refers_to", "size", "sha", "segments").unionByName(
        revisits.select("page_id", "type", "refers_to", "size", "sha", "segments"))
    return both.select("page_id", F.col("size").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"),
                       "refers_to", "segments")
