"""The parser on small written transcripts."""

import datetime as dt
import itertools

import pytest

from parley.operators import parse as P


def lines_of(spark, **files):
    df = spark.createDataFrame(list(files.items()), "file string, text string")
    return P.split_lines(df, ["file"])


def parsed(spark, text):
    return [r.asDict() for r in P.parse_lines(lines_of(spark, f=text)).orderBy("line_no").collect()]


def report(spark, text):
    return P.parse_report(lines_of(spark, f=text)).first()


def test_android_with_continuation_and_notice(spark):
    got = parsed(spark, "hello\n13/08/2023, 21:14 - Ann: first\nsecond\n\n  third\n13/08/2023, 21:15 - Bob added Cy\n13/08/2023, 21:16 - Bob: at 5: ok\n")
    assert [(m["sender"], m["text"], m["msg_type"]) for m in got] == [
        ("Ann", "first\nsecond\n\n  third", "text"), (None, "Bob added Cy", "system"), ("Bob", "at 5: ok", "text")]
    assert got[0]["ts"] == dt.datetime(2023, 8, 13, 21, 14) and got[0]["line_no"] == 2


def test_ios_clock_and_marks(spark):
    got = parsed(spark, "‎[13/08/2023, 12:05:03 AM] Ann: midnight\n[13/08/2023, 12:05:03 PM] Ann: noon\n[13/08/2023, 9:05:03 p.m.] Ann: late")
    assert [m["ts"].hour for m in got] == [0, 12, 21] and got[0]["ts"].second == 3


STAMPS = {"%d/%m/%Y": "DMY", "%d.%m.%y": "DMY", "%Y-%m-%d": "YMD", "%m/%d/%Y": "MDY", "%d-%m-%Y": "DMY"}
TIMES = ["%H:%M", "%H:%M:%S", "%I:%M %p", "%I:%M:%S %p", "%I:%M %p"]


def test_all_layouts(spark):
    at = [dt.datetime(2024, 3, 25, 0, 7), dt.datetime(2024, 3, 25, 12, 30), dt.datetime(2024, 4, 1, 23, 59)]
    files, want = {}, {}
    for i, (date, time, bracket) in enumerate(itertools.product(STAMPS, TIMES, (True, False))):
        form = f"[{date}, {time}] " if bracket else f"{date}, {time} - "
        files[f"f{i}"] = "".join(f"{t.strftime(form)}Ann: hi\n" for t in at)
        want[f"f{i}"] = at
    got = {}
    for r in P.parse_lines(lines_of(spark, **files)).orderBy("file", "line_no").collect():
        got.setdefault(r.file, []).append(r.ts)
    assert got == want


@pytest.mark.parametrize("text,order,confidence", [
    ("05/06/2024, 10:00 - A: x", "DMY", "assumed"),
    ("05/16/2024, 10:00 - A: x", "MDY", "certain"),
    ("16/05/2024, 10:00 - A: x", "DMY", "certain"),
    ("16/05/2024, 10:00 - A: x\n05/16/2024, 10:00 - A: x\n05/17/2024, 10:00 - A: x", "MDY", "corrected"),
    ("16/05/2024, 10:00 - A: x\n05/16/2024, 10:00 - A: x", "DMY", "conflicting"),
    ("2024-05-16, 10:00 - A: x", "YMD", "certain"),
])
def test_date_order(spark, text, order, confidence):
    r = report(spark, text)
    assert (r.date_order, r.confidence) == (order, confidence)


@pytest.mark.parametrize("body,kind,attachment,text", [
    ("<Media omitted>", "media", None, ""),
    ("<Media omitted>\ncaption", "media", None, "caption"),
    ("IMG-1.jpg (file attached)\nlook\nhere", "media", "IMG-1.jpg", "look\nhere"),
    ("IMG 2.jpg (archivo adjunto)", "media", "IMG 2.jpg", ""),
    ("<attached: 0001-PHOTO.jpg>", "media", "0001-PHOTO.jpg", ""),
    ("GIF omitted", "media", None, ""),
    ("null", "media", None, ""),
    ("location: https://maps.example/1", "media", None, ""),
    ("You deleted this message", "deleted", None, "You deleted this message"),
    ("This message was deleted.", "deleted", None, "This message was deleted."),
    ("nullable", "text", None, "nullable"),
    ("see <attached: x> there", "text", None, "see <attached: x> there"),
])
def test_bodies(spark, body, kind, attachment, text):
    (m,) = parsed(spark, f"13/08/2023, 21:14 - Ann: {body}")
    assert (m["msg_type"], m["attachment"], m["text"]) == (kind, attachment, text)


SENDERS = ["Ann", "Ann Lee", "~Rohit", "+91 98765 43210", "प्रिया शर्मा", "محمد", "😀 Zed", "A" * 60, "Dr. O'Neil-Smith", "left wing"]


def test_senders(spark):
    text = "\n".join(f"13/08/2023, 21:14 - {s}: hello" for s in SENDERS)
    assert [m["sender"] for m in parsed(spark, text)] == SENDERS
    (m,) = parsed(spark, f"13/08/2023, 21:14 - {'A' * 61}: hello")
    assert m["sender"] is None


NOTICES = ['Ann changed the subject from "a" to: b', "Messages and calls are end-to-end encrypted. Tap to learn more.",
           "Ann created group \"x: y\"", "Ann left", "Missed voice call", "You were added"]


def test_notices(spark):
    got = parsed(spark, "\n".join(f"13/08/2023, 21:14 - {n}" for n in NOTICES))
    assert [m["msg_type"] for m in got] == ["system"] * len(NOTICES)


@pytest.mark.parametrize("text", [
    "", "\n\n\n", "no header here", "13/08/2023, 21:14 - ", "13/08/2023, 21:14 - Ann:", "99/99/2023, 21:14 - Ann: x",
    "13/08/2023, 25:61 - Ann: x", "[13/08/2023, 21:14:60] Ann: x", "31/02/2024, 10:00 - A: x", " ", ": : :",
    "13/08/2023, 21:14 - Ann: x\r\n13/08/2023, 21:15 - Ann: y\r", "13/08/2023, 21:14 - A: x\x0b13/08/2023, 21:15 - B: y",
])
def test_degenerate_input_adds_up(spark, text):
    lines = lines_of(spark, f=text)
    n = lines.count()
    assert n == len(text.splitlines())
    got = P.parse_lines(lines).collect()
    if n:
        r = P.parse_report(lines).first()
        assert r.total_lines == n == r.parsed_messages + r.continuation_lines + r.unparsed_lines
        assert r.parsed_messages == len(got)


def test_report_of_empty_and_notices(spark):
    r = report(spark, "13/08/2023, 21:14 - Ann: a\n13/08/2023, 21:14 - Bob: b\n13/08/2023, 21:14 - Ann: c")
    assert r.senders == {"Ann": 2, "Bob": 1} and r.distinct_senders == 2 and r.warnings == []
    assert report(spark, "nothing").warnings[-1] == "no messages parsed"


def test_other_digits(spark):
    (m,) = parsed(spark, "١٣/٠٨/٢٠٢٣, ٢١:١٤ - Ann: x")
    assert m["ts"] == dt.datetime(2023, 8, 13, 21, 14)
