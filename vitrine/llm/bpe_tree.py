"""Operator 10: byte-level BPE encoding and decoding by monoid tree reduction.

A text's encoding is reduced over a binary tree: halves are encoded on their
own and neighbours are joined at the boundary only. Two levels use the same
idea:

* **Text**: the split pattern has no look-behind, so a scan that starts at a
  match start yields the same matches as the scan of the whole text. Of a left
  half only the last two matches can change when text follows (the longest
  alternative of fixed length has three characters). The join rescans a window
  that begins at the left half's last two chunks and grows chunk by chunk to
  the right until a match boundary meets a chunk boundary of the right half;
  from there on both scans are equal.
* **Match**: a long match is cut into byte halves. A token sequence is the BPE
  encoding of its bytes when every adjacent pair is (each pair re-encodes to
  itself). The join re-encodes the tokens around the boundary and grows the
  window to a side until the pair at its edge holds.

Leaves go to ``tiktoken``'s piece encoder. Decoding concatenates token bytes up
the same kind of tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.chunks import ChunkMemo, pack, space_chunks
from vitrine.llm.common import keyed_text, slices

TEXT_LEAF = 8192   # characters
PIECE_LEAF = 128   # bytes
DECODE_LEAF = 4096  # ids


class TreeBpe:
    """Encoder and decoder for a rank file (``path``) and its split pattern."""

    def __init__(self, path: str, pattern: str, text_leaf: int = TEXT_LEAF, piece_leaf: int = PIECE_LEAF):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                      special_tokens={})._encode_single_piece
        self.findall = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer
        self.text_leaf, self.piece_leaf = max(2, text_leaf), max(2, piece_leaf)
        self.memo = ChunkMemo(lambda chunks: [pack(self._chunk(c)) for c in chunks])

    # -- one match of the pattern ------------------------------------------
    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _stable(self, left: int, right: int) -> bool:
        return self.leaf(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def _join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self._stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of either side inside the window
        while True:
            window = self.encode_piece(self._bytes(left[-i:] + right[:j]), whole=True)
            left_ok = i == len(left) or self._stable(left[-i - 1], window[0])
            right_ok = j == len(right) or self._stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + window + right[j:]
            i = i if left_ok else min(len(left), 2 * i)
            j = j if right_ok else min(len(right), 2 * j)

    def encode_piece(self, piece: bytes, whole: bool = False) -> list[int]:
        """Ids of one match. ``whole``: no halving (boundary windows)."""
        if whole or len(piece) <= self.piece_leaf:
            return list(self.leaf(piece))
        half = len(piece) // 2
        return self._join_pieces(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    # -- one text ----------------------------------------------------------
    def _chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for match in self.findall(chunk):
            ids += self.encode_piece(match.encode("utf-8"))
        return ids

    def _join_texts(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        left, window = left[:-2], "".join(left[-2:])
        for j, chunk in enumerate(right):
            window += chunk
            ahead = right[j + 1] if j + 1 < len(right) else ""
            matches, end = [], 0
            for m in self.finditer(window + ahead):
                if m.start() >= len(window):
                    break
                matches.append(m.group())
                end = m.end()
            if end == len(window):  # a match ends where the right half's next chunk begins
                return left + matches + right[j + 1:]
        raise AssertionError("the last chunk of a text always ends a match")

    def chunks(self, text: str) -> list[str]:
        """Whole matches, several per item where they are safely separable."""
        if len(text) <= self.text_leaf:
            return [c for c in space_chunks(text, self.findall) if c]
        half = len(text) // 2
        return self._join_texts(self.chunks(text[:half]), self.chunks(text[half:]))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        return self.memo.encode([self.chunks(t) for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[tuple[str, str], TreeBpe] = {}


def codec(path: str, pattern: str) -> TreeBpe:
    """One codec per worker process: the rank file is read once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TreeBpe(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens long, ids binary`` (little-endian unsigned 32-bit ids)
    of every whole text; no shuffle.

    Null text counts as empty and gives no ids. Rows are independent: repeated
    rows and null ids give one row each; an empty table gives an empty one.
    ``path`` must exist on every executor (it belongs to an installed package).
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for part in slices(batches):
            ids = bpe.encode_packed(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids"])

    return keyed_text(df, id_col, text_col, empty_for_null=True).mapInArrow(
        encode, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` plus ``decoded binary``, the bytes that the ids stand for
    (null ids: empty)."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for part in slices(batches):
            out = [bpe.decode(np.frombuffer(x, "<u4")) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())],
                                             names=["doc_id", "n_tokens", "ids", "decoded"])

    cols = encoded.select("doc_id", "n_tokens", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return cols.mapInArrow(decode, "doc_id long, n_tokens long, ids binary, decoded binary")
