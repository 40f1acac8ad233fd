"""Texts cut into units that tokenizers treat alike wherever they stand, so that each different unit is encoded once.

A byte-level tokenizer splits before a space that follows something else than white space, and no piece of a sentence-piece vocabulary goes
on from a character into a space. A text may therefore be cut there, and units that begin and end so may be laid end to end
in any order and encoded as one text.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

#: Units laid end to end for one call of a tokenizer.
_TOGETHER = 100


def _solid(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte at each place ends a character that is surely no white space. Characters whose bytes begin like those of a white one are not."""
    last = raw[at]
    before, first = raw[np.maximum(at - 1, 0)], raw[np.maximum(at - 2, 0)]
    return ((last > 32) & (last < 127)) | ((last >= 128) & (before != 0xC2) & ((first < 0xE1) | (first > 0xE3)))


def cuts(raw: np.ndarray, at: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Where the units of texts laid end to end begin. Texts marked in ``whole`` are one unit; empty ones have none."""
    found = np.flatnonzero(raw[1:] == 32) + 1
    found = found[_solid(raw, found - 1)]
    if whole is not None and whole.any():
        found = found[~whole[np.searchsorted(at, found, side="right") - 1]]
    begin = np.zeros(len(raw), bool)
    begin[found] = True
    begin[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(begin)


def coded(raw: np.ndarray, begins: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different units, and a code for each unit."""
    edges = np.append(begins, len(raw)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [
        None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    return units.dictionary.to_pylist(), units.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``begin .. begin + length`` of each entry, end to end."""
    out = np.cumsum(lengths)
    return np.arange(int(out[-1]) if len(out) else 0) + np.repeat(begins - (out - lengths), lengths)


class Spelling:
    """The bytes of every id of a vocabulary, end to end."""

    def __init__(self, spelt: list[bytes]):
        self.sizes = np.array(list(map(len, spelt)), np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(spelt), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.letters[_spans(self.begins[ids], self.sizes[ids])]


def _ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts end to end, and how many each has."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of so many neighbours each."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _like(ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, lengths: np.ndarray, spelling: Spelling) -> np.ndarray:
    """Which of some texts laid end to end have ids that spell out just their bytes."""
    like = _sums(spelling.sizes[ids], counts) == lengths
    if not like.all():
        ids, raw = ids[np.repeat(like, counts)], raw[np.repeat(like, lengths)]
    like[like] = _sums(spelling.of(ids) != raw, lengths[like]) == 0
    return like


def encode(units: list[bytes], batch: Callable[[list[str]], list[list[int]]], spelling: Spelling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the units end to end, how many each unit has, and whether their bytes are those of the unit.

    Units that join are encoded together; where the bytes of a call are not those of its units, each is encoded alone.
    """
    n = len(units)
    lengths = np.fromiter(map(len, units), np.int64, n)
    raw, ends = np.frombuffer(b"".join(units), np.uint8), np.cumsum(lengths)
    begins, counts, whole = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    # whether another unit may follow this one, and this one another
    joins = (lengths > 0) & (lengths < 4096)
    last = raw[ends[joins] - 1]
    solid = (last > 32) & (last < 127) | (lengths[joins] > 2) & (last > 127) & _solid(raw, ends[joins] - 1)
    joins[joins] = solid & (raw[ends[joins] - lengths[joins]] == 32)
    run = np.flatnonzero(joins)
    out = np.zeros(0, np.int64)
    if len(run):
        edges = np.concatenate(([0], np.cumsum(lengths[run])))
        first = np.arange(0, len(run), _TOGETHER)
        joined, at = raw[np.repeat(joins, lengths)], edges[np.append(first, len(run))]
        text = joined.tobytes()
        ids, tokens = _ids(batch([text[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]))
        good = _like(ids, tokens, joined, np.diff(at), spelling)
        # where the units end among the tokens, for texts of the right bytes
        right = np.repeat(good, tokens)
        sizes = _sums(spelling.sizes[ids], tokens)
        stops = np.cumsum(spelling.sizes[ids]) + np.repeat(at[:-1] - (np.cumsum(sizes) - sizes), tokens)
        stops, out = stops[right], ids[right]
        part = np.arange(len(run)) // _TOGETHER
        fits = good[part]
        wanted = edges[1:][fits]
        place = np.searchsorted(stops, wanted)
        missed = stops[np.minimum(place, len(stops) - 1)] != wanted if len(stops) else np.zeros(0, bool)
        good[part[fits][missed]] = False
        lo = np.concatenate(([0], place[:-1] + 1)) if len(place) else place
        begins[run[fits]], counts[run[fits]] = lo, place + 1 - lo
        joins[run] = good[part]
    again = np.flatnonzero(~joins)
    if len(again):
        ids, tokens = _ids(batch([units[k].decode() for k in again.tolist()]))
        whole[again] = _like(ids, tokens, raw[np.repeat(~joins, lengths)], lengths[again], spelling)
        begins[again], counts[again] = len(out) + np.cumsum(tokens) - tokens, tokens
        out = np.concatenate((out, ids))
    return out[_spans(begins, counts)], counts, whole


def _lists(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[list[list[int]], list[bool]]:
    ids, counts, whole = found
    ids, ends = ids.tolist(), np.cumsum(counts)
    return [ids[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist())], whole.tolist()


#: How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others as the characters from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELT = {chr(b if b in _PRINTED else 256 + sum(c not in _PRINTED for c in range(b))): b for b in range(256)}


class ByteLevel:
    """A byte-level vocabulary file of the tokenizers library; special tokens spelt out in a text are plain text unless ``special``."""

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, n in self.tokenizer.get_vocab().items():
            self.bytes[n] = bytes(_SPELT[c] for c in token) if all(c in _SPELT for c in token) else token.encode()
        self.spelling = Spelling(self.bytes)
        self.sizes = self.spelling.sizes

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, units: list[bytes]) -> tuple[list[list[int]], list[bool]]:
        return _lists(self.flat(units))

    def flat(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return encode(units, self.batch, self.spelling)


class Pieces:
    """A sentence-piece model that puts a space before a text; units come with it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(self.model.id_to_piece(list(range(n))))]
        self.spelling = Spelling(self.bytes)
        self.sizes = self.spelling.sizes

    def batch(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)

    def units(self, units: list[bytes]) -> tuple[list[list[int]], list[bool]]:
        return _lists(encode(units, self.batch, self.spelling))
