"""Files: zips, encodings, lines of split files, attachments, stored tables."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from parley.sources import exports, store

CHAT = "13/08/2023, 21:14 - Ann: héllo\n13/08/2023, 21:15 - Bob: दो\n"


def test_zip_members_stay_inside(spark, tmp_path):
    names = ["a/_chat.txt", "b\\c.jpg", "/abs.txt", "C:/x.txt", "../up.txt", "a/../../up.txt", "./ok .jpg", "😀.png", "a/..", "लंबा/नाम.mp4"]
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for n in names:
            z.writestr(zipfile.ZipInfo(n), n.encode())
        z.writestr("folder/", "")
    got = {r.name: (r.member, r.unsafe, r.content) for r in exports.read_exports(spark, str(tmp_path)).collect()}
    assert {n for n, (_, unsafe, _) in got.items() if unsafe} == {"/abs.txt", "C:/x.txt", "../up.txt", "a/../../up.txt", "a/.."}
    assert got["b\\c.jpg"][0] == "b/c.jpg" and got["./ok .jpg"][0] == "ok .jpg" and got["😀.png"][2] == "😀.png".encode()
    assert "folder/" not in got


@pytest.mark.parametrize("members,want", [
    ([("x/z.txt", 9), ("x/_chat.txt", 1)], "x/_chat.txt"),
    ([("b/Chat.txt", 1), ("a/chat.txt", 5), ("big.txt", 99)], "a/chat.txt"),
    ([("big.txt", 99), ("WhatsApp Chat with A.txt", 1)], "WhatsApp Chat with A.txt"),
    ([("b.txt", 5), ("a.txt", 5), ("c.txt", 4)], "a.txt"),
])
def test_pick_transcript(spark, members, want):
    df = spark.createDataFrame([("e", m, s) for m, s in members], "export string, member string, size long")
    assert exports.pick_transcript(df).first().member == want


def test_decodings(spark):
    want = {"utf-8": "utf-8-sig", "utf-8-sig": "utf-8-sig", "utf-16": "utf-16"}
    df = spark.createDataFrame([(e, CHAT.encode(e)) for e in want], "file string, content binary")
    got = {r.file: (r.text, r.encoding) for r in exports.decode_transcript(df).collect()}
    assert got == {e: (CHAT, d) for e, d in want.items()}
    odd = spark.createDataFrame([("x", "13/08/2023, 21:14 - Ann: caf\xe9".encode("latin-1"))], "file string, content binary")
    assert exports.decode_transcript(odd).first().text.endswith("café")


def test_line_numbers_of_split_files(spark, tmp_path):
    texts = {"a.txt": "\n".join(f"line {i}" + ("\u2028part" if i % 5 == 0 else "") for i in range(400)) + "\n", "b.txt": "one\r\ntwo"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = exports.scan_text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in texts.items():
        mine = sorted((r.line_no, r.line) for r in got if r.file.endswith(name))
        assert mine == list(enumerate(text.splitlines(), 1))


def test_media_files_and_hash(spark, tmp_path):
    big = bytes(range(256)) * 4096 * 3
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "IMG-1.webp").write_bytes(b"abc")
    (tmp_path / "VID-2.mp4").write_bytes(big)
    (tmp_path / ".hidden").write_bytes(b"x")
    got = {r.filename: r for r in exports.scan_media_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"IMG-1.webp", "VID-2.mp4"} and got["IMG-1.webp"].kind == "sticker" and got["VID-2.mp4"].readable
    assert got["IMG-1.webp"].content_hash == hashlib.sha256(b"3" + b"abc").hexdigest()
    ends = big[: 1 << 20] + big[-(1 << 20):]
    assert got["VID-2.mp4"].content_hash == hashlib.sha256(str(len(big)).encode() + ends).hexdigest()
    left = exports.scan_media_files(spark, str(tmp_path), str(tmp_path / "VID-2.mp4")).collect()
    assert [r.filename for r in left] == ["IMG-1.webp"]


def test_hash_of_files_beyond_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12345
    with open(tmp_path / "VID-9.mp4", "wb") as f:
        f.write(b"head")
        f.truncate(size - 4)  # a hole on disk
        f.seek(size - 4)
        f.write(b"tail")
    got = exports.scan_media_files(spark, str(tmp_path)).first()
    ends = b"head" + bytes((1 << 20) - 4) + bytes((1 << 20) - 4) + b"tail"
    assert got.size_bytes == size and got.content_hash == hashlib.sha256(str(size).encode() + ends).hexdigest()


def test_replace_touches_one_archive(spark, tmp_path):
    path = str(tmp_path / "messages")
    rows = spark.range(30).select((F.col("id") % 3).cast("int").alias("archive_id"), F.col("id").alias("msg_id"), F.lit("old").alias("text"))
    store.write_messages(rows, path)
    kept = {p for p in (tmp_path / "messages" / "archive_id=1").iterdir()}
    store.replace_archive(rows.where("archive_id = 2 AND msg_id < 9").withColumn("text", F.lit("new")), path)
    got = store.read_messages(spark, path, rows.schema)
    assert {tuple(r) for r in got.groupBy("archive_id", "text").count().collect()} == {(0, "old", 10), (1, "old", 10), (2, "new", 3)}
    assert {p for p in (tmp_path / "messages" / "archive_id=1").iterdir()} == kept


def test_upsert_latest(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], "key string, value string, version int")
    new = spark.createDataFrame([("a", "2", 2), ("c", "3", 2)], "key string, value string, version int")
    assert {r.key: r.value for r in store.upsert_latest(old, new, ["key"], "version").collect()} == {"a": "2", "b": "1", "c": "3"}


def test_members_are_handed_on_in_small_pieces(monkeypatch):
    import io

    import pyarrow as pa

    def zipped(n):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for i in range(n):
                z.writestr(f"{i}.txt", b"x" * 100)
        return held.getvalue()

    monkeypatch.setattr(exports, "BATCH_BYTES", 250)
    given = pa.RecordBatch.from_pydict({"path": ["a", "b", "c"], "content": [zipped(2), zipped(5), b"no zip"]})
    got = list(exports._members([given]))
    assert max(b.num_rows for b in got) == 3
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["export"] for r in rows] == ["a"] * 2 + ["b"] * 5 + ["c"] and rows[0]["content"] == b"x" * 100 and "BadZipFile" in rows[-1]["error"]
    texts = pa.RecordBatch.from_pydict({"file": list("abcdefg"), "content": [CHAT.encode("utf-16")] * 7})
    told = list(exports._decode([texts]))
    assert len(told) > 1 and [t for b in told for t in b.column("text").to_pylist()] == [CHAT] * 7


def test_a_task_writes_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    rows = spark.range(3000).selectExpr("0 AS archive_id", "id AS msg_id", "concat('t', id) AS text")
    store.write_messages(rows, f"{tmp_path}/m")
    stored = spark.read.parquet(f"{tmp_path}/m")
    most = stored.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert stored.count() == 3000 and most < 1000
