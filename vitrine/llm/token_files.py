"""Operator 7: token-id files in Simple-8b word-aligned coding.

A file row ("record") holds the ids of consecutive documents. Ids are coded in
blocks of ``BLOCK_IDS``; a block is a run of 64-bit words, each with a 4-bit
selector above 60 payload bits. A selector says how many ids of which width the
word packs; selector 0 is the escape: the next word is one raw 64-bit id. Every
block starts at a word boundary and its first word is listed, so blocks decode
independently and all words of a record decode at once by selector.

Record bytes, little-endian: magic ``S8B1``, u32 number of ids, u32 number of
blocks, u32 first word of each block, then the words. Which documents a record
holds, and how many ids each of them has, stands beside the bytes in the file's
row. Files are Parquet containers, so every store Spark writes to will do.

Order: documents are dealt to shards by ranges of their id, shards are sorted,
and a running total over the shards gives each document its global start.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrine.llm.chunks import ChunkMemo, pack, plain_words, text_slices, word_edges
from vitrine.llm.common import keyed_text, shuffle_partitions, slices

MAGIC = b"S8B1"
BLOCK_IDS = 1024
RECORD_IDS = 1 << 18

# selector -> (ids in the word, bits of each); selector 0 is the escape
SELECTORS = [(1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15),
             (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([c for c, _ in SELECTORS], dtype=np.int64)
_BITS = np.array([b for _, b in SELECTORS], dtype=np.uint64)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs (0 needs 0)."""
    if int(ids.max(initial=0)) < 1 << 53:  # exact as a double, whose exponent is the width
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    width = np.zeros(len(ids), dtype=np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= (np.uint64(1) << np.uint64(step))
        width[high] += step
        rest[high] >>= np.uint64(step)
    return width + (rest > 0).astype(np.uint8)


def encode_record(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """Record bytes of ``ids`` (unsigned 64-bit). The widest-reaching selector
    is taken at every position; all blocks advance together, one word a step."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // block_ids) if n else 0
    ends = np.minimum((np.arange(blocks, dtype=np.int64) + 1) * block_ids, n)
    # choice[i]: the selector of a word that starts at id i. A run may reach
    # over the end of its block only as padding, so widths past an end are 0.
    grid = np.zeros((blocks, block_ids + 60), dtype=np.uint8)
    padded = np.zeros(blocks * block_ids, dtype=np.uint8)
    padded[:n] = _widths(ids)
    grid[:, :block_ids] = padded.reshape(blocks, block_ids)
    choice = np.zeros((blocks, block_ids), dtype=np.uint8)
    reach = {1: grid}
    while 2 * max(reach) <= 60:  # reach[c][:, i]: the widest of the c ids from i
        c = max(reach)
        wide = reach[c].copy()
        wide[:, :-c] = np.maximum(wide[:, :-c], reach[c][:, c:])
        reach[2 * c] = wide
    for selector in range(len(SELECTORS) - 1, 0, -1):
        count, bits = SELECTORS[selector]
        c = 1 << (count.bit_length() - 1)
        widest = np.maximum(reach[c][:, :block_ids], reach[c][:, count - c:count - c + block_ids])
        choice[widest <= bits] = selector
    # every block follows its own chain of words
    at = np.arange(blocks, dtype=np.int64) * block_ids
    flat = choice.reshape(-1)
    word_block, word_at = [], []
    live = np.arange(blocks)
    while len(live):
        word_block.append(live)
        word_at.append(at[live])
        at[live] += _COUNT[flat[at[live]]]
        live = live[at[live] < ends[live]]
    if not blocks:
        return MAGIC + struct.pack("<II", 0, 0)
    owner, start = np.concatenate(word_block), np.concatenate(word_at)
    order = np.argsort(start, kind="stable")
    owner, start = owner[order], start[order]
    selector = flat[start]
    slots = 1 + (selector == 0)  # an escape takes two words
    place = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), dtype=np.uint64)
    source = np.concatenate([ids, np.zeros(60, dtype=np.uint64)])
    for s in np.unique(selector):
        mine = np.nonzero(selector == s)[0]
        if s == 0:
            words[place[mine] + 1] = ids[start[mine]]
            continue
        count, bits = SELECTORS[s]
        take = start[mine][:, None] + np.arange(count)
        values = np.where(take < ends[owner[mine]][:, None], source[take], np.uint64(0))
        shifted = values << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
        words[place[mine]] = np.bitwise_or.reduce(shifted, axis=1) | (np.uint64(s) << np.uint64(60))
    first_word = place[np.searchsorted(owner, np.arange(blocks))]
    return MAGIC + struct.pack("<II", n, blocks) + first_word.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def decode_record(data: bytes, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """Ids of a record, all blocks and words at once."""
    if data[:4] != MAGIC:
        raise ValueError("not a token record")
    n, blocks = struct.unpack_from("<II", data, 4)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    first_word = np.frombuffer(data, "<u4", blocks, 12).astype(np.int64)
    words = np.frombuffer(data, "<u8", -1, 12 + 4 * blocks)
    raw = np.zeros(len(words), dtype=bool)  # words that an escape announces
    zero = np.nonzero((words >> np.uint64(60)) == 0)[0]
    last = -1
    for w in zero.tolist():  # only escapes and their raw words get here
        if w != last:
            raw[w + 1] = True
            last = w + 1
    # a raw word may look like any selector, also like an escape
    heads = np.nonzero(~raw)[0]
    selector = (words[heads] >> np.uint64(60)).astype(np.int64)
    block = np.searchsorted(first_word, heads, side="right") - 1
    counts = _COUNT[selector]
    before = np.cumsum(counts) - counts
    first_head = np.searchsorted(heads, first_word)
    inside = before - before[first_head][block]  # ids before this word in its block
    start = block * block_ids + inside
    ends = np.minimum((block + 1) * block_ids, n)
    out = np.zeros(n, dtype=np.uint64)
    for s in np.unique(selector):
        mine = np.nonzero(selector == s)[0]
        if s == 0:
            out[start[mine]] = words[heads[mine] + 1]
            continue
        count, bits = SELECTORS[s]
        values = (words[heads[mine]][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        to = start[mine][:, None] + np.arange(count)
        real = to < ends[mine][:, None]
        out[to[real]] = values[real]
    return out


_MEMOS: dict[str, tuple] = {}
RUN = 64  # unseen words that are encoded as one text


def memo_for(path: str):
    """(memo, tokenizer) of a tokenizer file that drops white space, one per
    worker process."""
    if path not in _MEMOS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids that end a match
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

        def plain(word: str) -> bool:
            """Whether the word surely is one match (no final sigma, where the
            lower case depends on the neighbours)."""
            return word.isalpha() and (word.isascii() or "\u03a3" not in word and is_normalized("NFC", word.lower())
                                       and is_normalized("NFC", word))

        def encode_many(chunks: list[str]) -> list[bytes]:
            """Words of one match are encoded in runs, each up to an id that ends
            a match; any other chunk by itself."""
            stripped = [c.strip(" ") for c in chunks]
            words = [w for w in set(stripped) if plain(w)]
            out: dict[str, bytes] = {}
            runs = [words[i:i + RUN] for i in range(0, len(words), RUN)]
            for run, found in zip(runs, tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
                packed = pack(found.ids)
                at = (4 * (np.flatnonzero(ends[np.frombuffer(packed, "<u4")]) + 1)).tolist()
                if len(at) == len(run):
                    out.update(zip(run, (packed[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)), strict=True))
            rest = list(set(stripped).difference(out))
            out.update(zip(rest, (pack(e.ids) for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
            return [out[w] for w in stripped]

        _MEMOS[path] = ChunkMemo(encode_many), tokenizer
    return _MEMOS[path]


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Packed ids of whole texts, word by word where words are safe to cut."""
    memo, tokenizer = memo_for(path)
    plain = [plain_words(t) for t in texts]
    cut = iter(memo.encode_cut([t for t, p in zip(texts, plain, strict=True) if p], word_edges))
    return [next(cut) if p else pack(tokenizer.encode(t, add_special_tokens=False).ids) for t, p in zip(texts, plain, strict=True)]


FILE = "shard int, record int, doc_ids array<long>, lengths array<long>, n_ids long, data binary"


def write_token_files(df: DataFrame, path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                      shards: int | None = None) -> None:
    """Encodes whole texts and writes them to ``out`` in ascending id order.

    Null text is empty (the end id alone); null ids come first; rows that share
    an id are ordered by text. An empty table writes no record. ``shards``
    (ranges of ids of about equal numbers of rows) defaults to the number of
    shuffle partitions; records are cut at ``RECORD_IDS`` ids, so a task holds
    no more than one record, however large its shard is.
    """
    spark = df.sparkSession
    shards = shards or shuffle_partitions(spark)
    rows = keyed_text(df, id_col, text_col, empty_for_null=True)
    first = F.col("doc_id").asc_nulls_first()
    ordered = (rows.repartitionByRange(shards, first).withColumn("shard", F.spark_partition_id())
               .sortWithinPartitions(first, "text").select("shard", "doc_id", "text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, open_shard, record, ids, doc_ids, lengths = pack([end_id]), None, 0, [], [], []
        size = 0
        types = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
        names = ["shard", "record", "doc_ids", "lengths", "n_ids", "data"]

        def row() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4")
            values = (open_shard, record, doc_ids, lengths, len(flat), encode_record(flat))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for part in text_slices(batches, 2):
            packed = encode_texts(path, part.column(2).to_pylist())
            for own, doc_id, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), packed, strict=True):
                if doc_ids and (own != open_shard or size >= RECORD_IDS):
                    yield row()
                    record = record + 1 if own == open_shard else 0
                    ids, doc_ids, lengths, size = [], [], [], 0
                open_shard = own
                ids += [x, end]
                doc_ids.append(doc_id)
                lengths.append(len(x) // 4 + 1)
                size += lengths[-1]
        if doc_ids:
            yield row()

    ordered.mapInArrow(encode, FILE).write.mode("overwrite").option("compression", "none").parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids binary`` (little-endian unsigned 32-bit)
    of every document of the files, decoded from their records."""
    files = spark.read.schema(FILE).parquet(path)
    # running totals over one row per shard, and inside a shard per record
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", F.coalesce(F.sum("n").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = files.select("shard", "record", F.coalesce(F.sum("n_ids").over(
        Window.partitionBy("shard").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    starts = inside.join(base, "shard").select("shard", "record", (F.col("base") + F.col("inside")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            shard, record, doc_ids, lengths, _, data = (c.to_pylist()[0] for c in part.columns)
            ids = decode_record(data).astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            begins = ends - lengths
            own = [ids[4 * a:4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(own), pa.int32()), pa.array([record] * len(own), pa.int32()),
                 pa.array(doc_ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())],
                names=["shard", "record", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"])

    docs = files.mapInArrow(decode, "shard int, record int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary")
    return docs.join(starts, ["shard", "record"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens",
                                                         "ids_crc32", "ids")
