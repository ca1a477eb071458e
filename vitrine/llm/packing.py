"""Operator 6: best-fit packing by large-item matching.

Documents become token sequences of at most ``capacity`` ids. A longer document
is cut into full pieces, its first piece taking the remainder, so only first
pieces leave gaps. The plan needs just the number of pieces of each length (at
most ``capacity`` counters, whatever the corpus size):

1. Pieces above a third of the capacity fit at most twice into a sequence. They
   are matched greedily: the longest one takes the longest partner that fits.
2. Smaller pieces, longest first, go to the open sequence with the smallest gap
   that holds them; a new sequence is opened only when no gap does.

The plan is a table of runs "the n-th to m-th piece of length L go to sequences
b, b+1, ... at offset o". Each piece finds its run by its rank within its
length, which Spark computes in two levels (rank inside a hash bucket, plus the
running total of the buckets before it), so a length that many pieces share is
spread over all buckets.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrine.llm.chunks import ChunkMemo, as_letters, pack, plain_spaces, space_edges, text_slices
from vitrine.llm.common import apart, keyed_text, shuffle_partitions
from vitrine.session import materialize

# The byte-level split pattern of the tokenizer file, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_MEMOS: dict[str, tuple] = {}
RUN = 64  # unseen chunks that are encoded as one text


def memo_for(path: str):
    """(memo, matcher) of a byte-level tokenizer file, one per worker process."""
    if path not in _MEMOS:
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        findall = regex.compile(SPLIT).findall

        letter = as_letters(" ")
        vocabulary = tokenizer.get_vocab()
        opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids that begin with a space
        opens[[i for token, i in vocabulary.items() if token.startswith(letter)]] = True

        def encode_many(chunks: list[str]) -> list[bytes]:
            """A space before a non-space starts a match, so chunks that start
            with their only white space are encoded in runs, and each begins at
            an id that opens with a space."""
            spaced = [c for c in chunks if c[:1] == " " and c.split() == [c[1:]]]
            out: dict[str, bytes] = {}
            runs = [spaced[i:i + RUN] for i in range(0, len(spaced), RUN)]
            for run, found in zip(runs, tokenizer.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False), strict=True):
                packed = pack(found.ids)
                at = (4 * np.flatnonzero(opens[np.frombuffer(packed, "<u4")])).tolist()
                if len(at) == len(run):
                    out.update(zip(run, (packed[i:j] for i, j in zip(at, [*at[1:], len(packed)], strict=True)), strict=True))
            rest = [c for c in chunks if c not in out]
            out.update(zip(rest, (pack(e.ids) for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
            return [out[c] for c in chunks]

        _MEMOS[path] = ChunkMemo(encode_many), findall
    return _MEMOS[path]


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Packed ids of whole texts, by chunks where white space is plain."""
    memo, findall = memo_for(path)
    plain = [plain_spaces(t) for t in texts]
    cut = iter(memo.encode_cut([t for t, p in zip(texts, plain, strict=True) if p], space_edges))
    matched = iter(memo.encode([findall(t) for t, p in zip(texts, plain, strict=True) if not p]))
    return [next(cut) if p else next(matched) for p in plain]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first takes the rest."""
    if n <= 0:
        return []
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """One row per piece of every document (null text: empty, so just the end
    id): ``doc_id, piece, start, length, ids_crc32`` and, on request, the
    packed ``ids``. No shuffle."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = pack([end_id])
        for part in text_slices(batches, 1):
            doc_ids, rows = part.column(0).to_pylist(), []
            packed = encode_texts(path, part.column(1).to_pylist())
            for doc_id, ids in zip(doc_ids, packed, strict=True):
                ids += end
                for piece, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    own = ids[4 * start:4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), own))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()),
                                                     strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(arrays[:keep], names=names[:keep])

    return keyed_text(df, id_col, text_col, empty_for_null=True).mapInArrow(
        cut, PIECES + (", ids binary" if with_ids else ""))


def plan_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs ``(length, first rank, n, first sequence, offset)`` for ``counts``
    (pieces of each length), and the number of sequences. Work and size depend
    on ``capacity`` only."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first sequence, n)
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, offset))
        used[length] += n
        left[length] -= n

    # 1. matching of the pieces above a third of the capacity
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in (x for x in large if x <= a and a + x <= capacity):
            if not left[a]:
                break
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            if pairs:
                put(a, pairs, sequences, 0)
                put(b, pairs, sequences, a)
                open_bins[capacity - a - b].append((sequences, pairs))
                sequences += pairs
        if left[a]:
            alone = left[a]
            put(a, alone, sequences, 0)
            open_bins[capacity - a].append((sequences, alone))
            sequences += alone

    # 2. best fit of the smaller ones, longest first
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        gap = length
        while left[length]:
            while gap <= capacity and not open_bins[gap]:
                gap += 1
            if gap > capacity:  # no gap is left: new sequences, filled with this length
                per = capacity // length
                fresh = -(-left[length] // per)
                open_bins[capacity].append((sequences, fresh))
                sequences += fresh
                gap = capacity
            first, n = open_bins[gap].pop()
            take = min(n, left[length])
            if take < n:
                open_bins[gap].append((first + take, n - take))
            put(length, take, first, capacity - gap)
            rest = gap - length
            open_bins[rest].append((first, take))
            if rest >= length:
                gap = length  # the gap just made may be the best one now
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), sequences


def pack_documents(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` plus ``sequence_id long`` and ``offset long``.

    Needs ``doc_id, piece, length, ids_crc32``; further columns pass through,
    whatever their names (columns named as the two new ones are replaced).
    Every length must lie in 1..capacity. Pieces that are equal in all four
    (repeated rows) are told apart by their place only; null ids are ids like
    any other. An empty table gives an empty one. ``pieces`` is read twice:
    pass a written table.
    """
    spark = pieces.sparkSession
    buckets = shuffle_partitions(spark)
    pieces = pieces.drop("sequence_id", "offset")
    n_bucket, n_before, n_rank = apart(pieces, "_bucket", "_before", "_rank")
    keyed = pieces.withColumn(n_bucket, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", n_bucket).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_runs(counts, capacity)
    # both sides are few: at most capacity x buckets rows
    before = sizes.withColumn(n_before, F.sum("n").over(
        Window.partitionBy("length").orderBy(n_bucket).rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", n_bucket, F.coalesce(n_before, F.lit(0)).alias(n_before))
    local = F.row_number().over(Window.partitionBy("length", n_bucket).orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (keyed.withColumn(n_rank, local - 1).join(before, ["length", n_bucket])
              .withColumn(n_rank, F.col(n_rank) + F.col(n_before)).drop(n_bucket, n_before))
    # runs are sorted by (length, first rank): one key finds a piece's run
    span = int(runs[:, 1].max()) + 1 if len(runs) else 1
    span = max(span, max(counts.values(), default=0) + 1)
    keys = runs[:, 0] * span + runs[:, 1]
    at = ranked.schema.names.index("length"), ranked.schema.names.index(n_rank)
    fields = [f for f in ranked.schema.fields if f.name != n_rank]
    names = [f"c{i}" for i in range(len(fields) + 2)]  # a column name with a dot cannot pass a Python step

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            run = runs[np.searchsorted(keys, length * span + rank, side="right") - 1] if len(runs) else np.zeros((0, 5), np.int64)
            kept = [c for i, c in enumerate(batch.columns) if i != at[1]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(run[:, 3] + rank - run[:, 1], pa.int64()), pa.array(run[:, 4], pa.int64())], names=names)

    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, [*(f.dataType for f in fields), T.LongType(), T.LongType()], strict=True)])
    placed = ranked.toDF(*[f"c{i}" for i in range(len(ranked.columns))]).mapInArrow(place, schema).toDF(
        *[f.name for f in fields], "sequence_id", "offset")
    return placed.select(*[F.col(f"`{c}`") for c in pieces.columns], "sequence_id", "offset")


def pack_texts(df: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id",
               text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut and pack whole documents: ``doc_id, piece, start, length, ids_crc32
    [, ids], sequence_id, offset``. Null or empty text is a document of the end
    id alone; an empty table gives an empty one."""
    pieces = materialize(cut_pieces(df, path, end_id, capacity, id_col, text_col, with_ids), "pieces")
    return pack_documents(pieces, capacity)
