"""Zips read through the data source: listing, pieces, encodings, broken files."""

import random
import zipfile

import pytest

from parley.sources import zips

CHAT = "13/08/2023, 21:14 - Ann: héllo\n13/08/2023, 21:15 - Bob: दो\r\nthird fourth\n\nlast"


def write(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data)


def test_listing_tells_unsafe_entries_and_broken_zips(spark, tmp_path):
    write(tmp_path / "a.zip", {"x/_chat.txt": CHAT.encode(), "../up.txt": "x", "/abs.txt": "x", "b\\c.jpg": "yy", "d/": ""})
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "broken.ZIP").write_bytes(b"PK\x03\x04 no zip at all")
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no zip")
    found = zips.list_members(spark, str(tmp_path)).collect()
    good = {r.name: (r.member, r.size, r.unsafe) for r in found if not r.error}
    assert good == {"x/_chat.txt": ("x/_chat.txt", len(CHAT.encode()), False), "../up.txt": (None, 1, True), "/abs.txt": (None, 1, True),
                    "b\\c.jpg": ("b/c.jpg", 2, False)}
    broken = {r.export.rsplit("/", 1)[1]: r for r in found if r.error}
    assert set(broken) == {"broken.ZIP", "empty.zip"} and all(r.name is None and not r.unsafe and r.member is None for r in broken.values())


def test_listing_of_an_empty_folder(spark, tmp_path):
    assert zips.list_members(spark, str(tmp_path)).collect() == [] and zips.read_transcripts(spark, str(tmp_path)).collect() == []


def test_only_what_is_asked_for_is_unpacked_in_pieces(spark, tmp_path):
    body = random.Random(1).randbytes(100_000)
    write(tmp_path / "a.zip", {"big.bin": body, "other.bin": b"z" * 50_000, "none.bin": b""})
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    spoilt = raw.find(b"other.bin") + 12
    raw[spoilt: spoilt + 20] = b"\xff" * 20
    (tmp_path / "a.zip").write_bytes(raw)
    listed = zips.list_members(spark, str(tmp_path))
    pieces = zips.unpack(listed.where("name = 'big.bin'"), piece=999).orderBy("piece").collect()
    assert b"".join(bytes(r.content) for r in pieces) == body and [r.piece for r in pieces] == list(range(len(pieces))) and max(len(r.content) for r in pieces) == 999
    other = zips.unpack(listed.where("name = 'other.bin'")).collect()
    assert other[-1].error and other[-1].content is None and zips.unpack(listed.where("name = 'none.bin'")).collect() == []


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 20])
def test_transcripts_in_any_encoding_and_piece(spark, tmp_path, piece):
    plain = "13/08/2023, 21:14 - Ann: café\r\r\nx\r"
    write(tmp_path / "a.zip", {"x/_chat.txt": CHAT.encode(), "y.jpg": b"\x00" * 99})
    write(tmp_path / "b.zip", {"_chat.txt": CHAT.encode("utf-16"), "long.txt": b"z" * 9999})
    write(tmp_path / "c.zip", {"any.txt": plain.encode("latin-1")})
    write(tmp_path / "d.zip", {"only.jpg": b"x"})
    (tmp_path / "e.zip").write_bytes(b"broken")
    found = zips.read_transcripts(spark, str(tmp_path), piece).collect()
    by = {k: sorted((r.line_no, r.line) for r in found if r.file.endswith(f"{k}.zip")) for k in "abcde"}
    assert by["a"] == by["b"] == list(enumerate(CHAT.splitlines(), 1)) and by["c"] == list(enumerate(plain.splitlines(), 1))
    assert by["d"] == [] and by["e"] == [(0, None)]
    assert {r.file[-5]: r.encoding for r in found} == {"a": "utf-8-sig", "b": "utf-16", "c": "latin-1", "e": None}
