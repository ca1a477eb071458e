"""Cutting text into independently encodable chunks, with a bounded memo.

A tokenizer whose first step is a splitting pattern encodes every match of the
pattern by itself. A chunk is a run of whole matches, so the ids of a text are
the ids of its chunks one after the other. Chunks recur (they are words), so
their packed ids are kept in a bounded memo per worker. All patterns used here
match letters apart from punctuation, so a word's final stop or comma is a
match of its own.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

MEMO_LIMIT = 500_000
MEMO_CHUNK = 64  # longer chunks are not kept
SLICE_BYTES = 4 << 20  # of text that is encoded at a time; one longer text makes a slice of its own

# white space other than space and line feed, and the mark used below
_ODD = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"] + ["\x01"]
_RUNS = ["  ", " \n", "\n ", "\n\n"]
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]")
_OTHER_SPACE = re.compile("[" + "".join(c for c in _ODD[:-1] if c not in "\t\x0b\x0c\r") + "]")


def pack(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[int, str]:
    """Translation of bytes (as Latin-1 text) to the letters that byte-level
    vocabularies are written in: printable bytes stand for themselves, the
    others take the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = byte_letters()


def as_letters(word: str) -> str:
    return word.encode("utf-8").decode("latin-1").translate(_LETTERS)


class ChunkMemo:
    """chunk -> packed ids. ``encode_many`` turns a list of unseen chunks into
    the packed ids of each. The memo is emptied at ``MEMO_LIMIT`` entries."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]]):
        self.encode_many = encode_many
        self.ids: dict[str, bytes] = {}

    def _learn(self, chunks: Iterable[str]) -> set[str]:
        """Brings ``chunks`` into the memo; those that were not in it."""
        if len(self.ids) > MEMO_LIMIT:
            self.ids.clear()
        memo = self.ids
        unseen = set(chunks).difference(memo)
        # a full stop or comma after a letter is a match of its own
        ended = [c for c in unseen if c[-1:] in (".", ",") and c[-2:-1].isalpha()]
        todo = list(unseen.union((c[:-1] for c in ended), (".", ",")).difference(ended).difference(memo))
        if todo:
            memo.update(zip(todo, self.encode_many(todo), strict=True))
        for chunk in ended:
            memo[chunk] = memo[chunk[:-1]] + memo[chunk[-1]]
        return unseen

    def _forget_long(self, unseen: set[str]) -> None:
        for chunk in unseen:
            if len(chunk) > MEMO_CHUNK:
                del self.ids[chunk]

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """Packed ids of each text, given as its chunks."""
        unseen = self._learn(chain.from_iterable(texts))
        out = [b"".join(map(self.ids.__getitem__, chunks)) for chunks in texts]
        self._forget_long(unseen)
        return out

    def encode_cut(self, texts: list[str], edges: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        """Packed ids of each text. ``edges`` marks the bytes of joined texts
        that start a chunk; every text starts one as well. Chunks are counted
        and looked up once per call, their ids gathered by index."""
        raw = [t.encode("utf-8") for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if not len(data):
            return [b""] * len(texts)
        ends = np.cumsum([len(x) for x in raw])
        data, starts = edges(data, ends)
        starts[0] = True
        starts[ends[ends < len(data)]] = True
        begin = np.append(np.flatnonzero(starts), len(data)).astype(np.int64)
        cut = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(data)).dictionary_encode()
        chunks, index = cut.dictionary.to_pylist(), cut.indices
        unseen = self._learn(chunks)
        packed = pa.array([self.ids[c] for c in chunks], pa.large_binary())
        self._forget_long(unseen)
        _, after, flat = packed.take(index).buffers()
        # bytes before each text: those before its first chunk
        first = np.searchsorted(begin, np.concatenate([[0], ends]))
        upto = np.frombuffer(after, dtype=np.int64)[first].tolist()
        return [flat[a:b].to_pybytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]


def text_slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``SLICE_BYTES`` of text in ``column``, one row
    at least."""
    for batch in batches:
        size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], dtype=np.int64)
        turn = (np.cumsum(size) - size) // SLICE_BYTES
        edge = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _stops(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Full stops and commas between an ASCII letter and white space or the
    end of a text: matches of their own."""
    stop = (data == 46) | (data == 44)
    stop[0] = False
    stop[1:] &= _LETTER[data[:-1]]
    last = np.zeros(len(data), dtype=bool)
    last[ends[ends > 0] - 1] = True
    after = np.append(_BLANK[data[1:]], True)
    return stop & (after | last)


def space_edges(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts for texts that `plain_spaces` holds for: spaces, line feeds
    and what follows a line feed, final stops and commas."""
    feed = data == 10
    starts = (data == 32) | feed | _stops(data, ends)
    starts[1:] |= feed[:-1]
    return data, starts


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_BLANK] = 32


def word_edges(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts for tokenizers that drop white space and case: every word's
    with the (now plain) spaces before it, final stops and commas. A-Z come as
    a-z, so spellings of a word share a chunk."""
    blank = _BLANK[data]
    starts = _stops(data, ends)
    starts |= blank
    starts[1:] &= ~(blank[1:] & blank[:-1])
    return _LOWER[data], starts


def plain_spaces(text: str) -> bool:
    """Whether the only white space of ``text`` is single spaces and line feeds
    between other characters."""
    return not (text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _RUNS) or any(x in text for x in _ODD))


def space_chunks(text: str, findall: Callable[[str], list[str]]) -> list[str]:
    """Chunks for the pattern family `` ?letters| ?digits| ?others|spaces``.

    A single space before a non-space always starts a match, and a single line
    feed between non-spaces is a match of its own, so a text without runs of
    white space is cut by plain string search; any other text goes through the
    pattern itself.
    """
    if not text:
        return []
    if not plain_spaces(text):
        return findall(text)
    return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")


def plain_words(text: str) -> bool:
    """Whether all white space of ``text`` is ASCII and seen alike by all."""
    return not (_ODD_SPACE if text.isascii() else _OTHER_SPACE).search(text)
