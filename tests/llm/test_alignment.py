"""Cross-tokenizer alignment against plain Python."""

import hashlib
import random

import public_tokenizers
import pytest

from parley.llm import alignment, units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(3)
    words = ["the", "Haus", "l'été", "don't", "x1y22", "…", "naïve", "日本", "🙂", "foo.\nBar", "\tq", "<|endoftext|>", "<0x0A>", "</s>", "U V", "a　", "ß", "###", "ﬁ"]
    gaps = [" ", " ", " ", "  ", "\n", " \n ", "  ", "\u0085 ", "\x1c "]
    out = ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    out += ["", None, " ", "  ", "\n", " a", "a ", "plain ▁ mark", "▁", "x" * 3000, "é" * 500 + " " + "the " * 2000, "the end", "the end", "\x00 nul"]
    return list(enumerate(out))


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    spelt = {}
    for b in range(256):
        spelt[b] = b if b in {*range(33, 127), *range(161, 173), *range(174, 256)} else None
    extra = iter(range(256, 512))
    chars = {chr(v if v is not None else next(extra)): b for b, v in spelt.items()}
    vocab = {i: t for t, i in tok.get_vocab().items()}

    def bytes_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    found, held = [], {}
    for doc, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            ba, bb = [bytes(chars[c] for c in vocab[i]) for i in a], [bytes_b(i) for i in b]
            if b"".join(ba) == raw == b"".join(bb):
                ends, ea, eb = set(), [], []
                for parts, e in ((ba, ea), (bb, eb)):
                    n = 0
                    for p in parts:
                        n += len(p)
                        e.append(n)
                lo = 0
                for end in sorted(set(ea) & set(eb)):
                    groups.append(([i for i, e in zip(a, ea) if lo < e <= end], [i for i, e in zip(b, eb) if lo < e <= end]))
                    lo = end
        links = [(x, y) for left, right in groups for x in left for y in right]
        for link in set(links):
            held[link] = held.get(link, 0) + 1
        found.append((doc, groups, links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc, groups, links in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("block", [1 << 10, 1 << 23])
def test_alignment(spark, block):
    rows = texts()
    documents = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block long, pair string").repartition(3)
    found = alignment.aligned_tokens(documents, A, B, block).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_alignment_of_rows_without_id_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "same text"), (None, "same text"), (1, None)], "doc_id long, text string")
    found = sorted(map(tuple, alignment.aligned_tokens(rows, A, B).collect()), key=str)
    assert found[0] == (1, 0, 0, 0, 0, 0, 0, "") and found[1] == found[2] and found[1][0] is None
    assert found[1][6] == 2 * found[1][4]  # every link stands in two documents
    assert alignment.aligned_tokens(rows.where("false"), A, B).collect() == []


def test_units_are_encoded_as_in_their_text():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    vocabulary = units.ByteLevel(A)
    import numpy as np

    for _, text in texts():
        if text:
            raw = np.frombuffer(text.encode(), np.uint8)
            different, code = units.coded(raw, units.cuts(raw, np.array([0, len(raw)])))
            rows, whole = vocabulary.units(different)
            assert all(whole)
            assert [i for c in code for i in rows[c]] == plain.encode(text, add_special_tokens=False).ids


def test_units_whose_tokens_run_on_or_lose_bytes_are_encoded_alone():
    import numpy as np

    spelt = [bytes([k]) for k in range(256)] + [b"n w"]  # one id crosses from a unit into the next

    def batch(texts):
        return [[256 if c == "_" else ord(c) for c in text.replace("n w", "_") if c != "q"] for text in texts]

    def plain(unit):
        return [256 if c == "_" else ord(c) for c in unit.decode().replace("n w", "_") if c != "q"]

    many = [b" u%d" % k for k in range(250)]
    for wanted in ([], [b" n", b" w"], [b" q"], [b"", b" a"], many, many[:130] + [b" n", b" w"] + many[130:], many[:50] + [b" xq"] + many[50:] + [b"end", b" n", b" w"]):
        ids, counts, whole = units.encode(wanted, batch, units.Spelling(spelt))
        ends = np.cumsum(counts)
        assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends)] == [plain(u) for u in wanted]
        assert whole.tolist() == [b"q" not in u for u in wanted]
