"""Operator 3: language identification by averaged hashed subword embeddings.

A text's subwords are the byte 3- and 4-grams of its letter runs (with one
space as the edge mark), hashed into ``BUCKETS`` rows of an embedding table.
The mean of its rows goes through one linear layer and a softmax. Both are
trained together by minibatch stochastic gradient descent in numpy on a bounded
sample of labelled rows. As all layers are linear, prediction needs only the
table times the layer: one row of class scores for each bucket.

Scores are calibrated on rows of the sample that training leaves out: one
temperature, fitted by likelihood, and the lowest score at which predictions
reach ``ACCEPT_ACCURACY`` there. Predictions below it are marked ``rejected``.

Training bound: ``rows_per_language`` documents of each language, drawn by
hashes of their id; of each, the whole text and one short window become
examples. What reaches the driver is at most two sparse rows of ``BUCKETS``
counts for each of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import slices

BUCKETS = 1 << 13
DIM = 16
ROWS_PER_LANGUAGE = 800
WINDOW = 160           # bytes of the short example
ACCEPT_ACCURACY = 0.99
MANY_LANGUAGES = 10_000  # rows (language, count) that may be broadcast; more are joined by shuffle

_HAS_LETTER = regex.compile(r"\p{L}")
# bytes: A-Z lowered, other ASCII that is no letter becomes the edge mark
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_EDGES = re.compile(rb"  +")


def subwords(text: str | bytes) -> np.ndarray:
    """Bucket of every subword of the text, repeats included."""
    raw = text.encode("utf-8") if isinstance(text, str) else text
    raw = b" " + _EDGES.sub(b" ", raw.translate(_FOLD)).strip() + b" "
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    inner = b[1:-1] != 32
    three = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) + np.uint32(3)
    out = [three[inner]]
    if len(b) > 3:
        four = (three[:-1] * np.uint32(5) ^ b[3:] * np.uint32(0x27D4EB2F)) + np.uint32(4)
        out.append(four[inner[:-1] & inner[1:]])
    h = np.concatenate(out)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class Model:
    """``languages`` in alphabetical order; ``scores``: BUCKETS x languages."""

    languages: list[str] = field(default_factory=list)
    scores: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """None for a text without letters, or if no language was learned."""
        if not self.languages or not text or not _HAS_LETTER.search(text):
            return None
        grams = subwords(text)
        logits = self.bias + (self.scores[grams].mean(axis=0) if len(grams) else 0)
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _dense(examples: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(examples), BUCKETS), dtype=np.float32)
    for i, (bucket, count) in enumerate(examples):
        x[i, bucket] = count / max(1, count.sum())
    return x


def train(examples: list[tuple[str, np.ndarray, np.ndarray, bool]], epochs: int = 6, rate: float = 60.0, batch: int = 32,
          seed: int = 11) -> Model:
    """``examples``: (language, buckets, counts, whether it only calibrates)."""
    languages = sorted({e[0] for e in examples})
    if not languages:
        return Model()
    rng = np.random.default_rng(seed)
    held = [e for e in examples if e[3]]
    rest = [e for e in examples if not e[3]]
    index = {x: i for i, x in enumerate(languages)}
    table = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    layer = (rng.standard_normal((DIM, len(languages))) * 0.1).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    steps = max(1, epochs * -(-len(rest) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rest))
        for at in range(0, len(order), batch):
            own = [rest[i] for i in order[at:at + batch]]
            x = _dense([e[1:3] for e in own])
            hidden = x @ table
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(own)), [index[e[0]] for e in own]] -= 1
            error /= len(own)
            lr = rate * (1 - step / steps)
            table_step = x.T @ (error @ layer.T)
            layer -= min(lr, 1.0) * (hidden.T @ error)
            table -= lr * table_step
            bias -= 0.1 * min(lr, 1.0) * error.sum(axis=0)
            step += 1
    model = Model(languages, (table @ layer).astype(np.float32), bias)
    if held:
        logits = np.concatenate([_dense([e[1:3]]) @ model.scores + bias for e in held])
        truth = np.array([index[e[0]] for e in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
        loss = [-np.log(softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / model.temperature)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = (p.argmax(axis=1) == truth)[order]
        accuracy = np.cumsum(right) / np.arange(1, len(right) + 1)
        good = np.nonzero(accuracy >= ACCEPT_ACCURACY)[0]
        model.threshold = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see (null id: neither seen nor held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_examples(df: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, np.ndarray, np.ndarray, bool]]:
    """Examples of the bounded sample, from (doc_id, text, lang) rows. Rows
    without id, text or lang and held-out rows are no candidates."""
    fit = df.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
                    & ~held_out(F.col("doc_id")))
    # about twice as many as needed by a hash of the id, so that the ranking below is small for any language
    sizes = fit.groupBy("lang").agg(F.count(F.lit(1)).alias("_size"))
    few = sizes.limit(MANY_LANGUAGES + 1).count() <= MANY_LANGUAGES
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1 << 30)) / F.lit(1 << 30)
    drawn = fit.select("doc_id", "lang").join(F.broadcast(sizes) if few else sizes, "lang").filter(
        part * F.col("_size") < 2 * rows_per_language + 100)
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = drawn.select("doc_id", "lang").withColumn("_n", first).filter(F.col("_n") <= rows_per_language)
    # at most rows_per_language rows of each language
    rows = fit.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").select("doc_id", "lang", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = text.encode("utf-8")
                start = zlib.crc32(str(doc_id).encode()) % max(1, len(raw) - WINDOW)
                for k, piece in enumerate((raw, raw[start:start + WINDOW])):
                    grams = subwords(piece)
                    if len(grams) and _HAS_LETTER.search(text):
                        bucket, count = np.unique(grams, return_counts=True)
                        out.append((doc_id, k, lang, bucket.astype("<u2").tobytes(), count.astype("<u4").tobytes()))
            if out:
                doc_ids, ks, langs, buckets, counts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(ks, pa.int32()), pa.array(langs, pa.string()),
                     pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())],
                    names=["doc_id", "k", "lang", "buckets", "counts"])

    found = rows.mapInArrow(featurise, "doc_id long, k int, lang string, buckets binary, counts binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.k, r.lang, r.buckets))
    # a fifth of the documents calibrates, with both examples of each
    return [(r.lang, np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.counts, "<u4"),
             zlib.crc32(b"fifth %d" % r.doc_id) % 5 == 0) for r in found]


def predict(df: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of (doc_id, text) rows;
    reads nothing but the whole text. Null text or text without a letter gives
    ``und`` with score 0, rejected; so does a model without languages."""
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names, scores = [], []
            for text in part.column(2).to_pylist():
                p = model.probabilities(text)
                names.append("und" if p is None else model.languages[int(p.argmax())])
                scores.append(0.0 if p is None else float(min(1.0, p.max())))
            refused = [n == "und" or s < model.threshold for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(refused, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(classify, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Trains on the labelled rows of ``df`` and predicts every row of it.
    Repeated rows get equal predictions; an empty table gives an empty one."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                     F.col(f"`{lang_col}`").cast("string").alias("lang"))
    return predict(rows.select("doc_id", "text"), train(training_examples(rows, rows_per_language)))
