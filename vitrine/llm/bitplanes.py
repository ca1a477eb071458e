"""Operator 11: centroid clustering on bit planes.

A vector of 64 integers in two's complement is written as bit planes: plane p
packs bit p of all 64 components into one 64-bit word, and the top plane weighs
-2**p. A dot product is then a weighted sum of popcounts, one AND-popcount for
each pair of a vector plane and a centroid plane, and distances follow exactly:
|x|^2 - 2 x.c + |c|^2. Vectors are turned into planes once and written (8 bytes
a plane; 8 planes hold components of -128..127); every round reads only planes.

A round is one narrow pass: each task assigns its vectors and counts, for each
centroid and plane, the vectors with a 1 in each component. The counts of all
tasks are added by one small aggregate, and the driver turns them into new
centroids in exact integers (at most k x planes rows, whatever the input).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import slices
from vitrine.session import materialize

DIM = 64
LONG_MAX = 2**63 - 1
_NARROW = 2.0**52  # components below it are exact in floating point and in 64-bit integers
_ONE = np.uint64(1)


def to_integers(vectors: list[list[float]], scale: int) -> list[list[int]]:
    """floor(scale * x), exactly, also where the product leaves a double."""
    def one(x: float) -> int:
        return math.floor(x * scale) if abs(x) < _NARROW else int(x) * scale

    return [[one(x) for x in v] for v in vectors]


def _width(low: int, high: int) -> int:
    """Planes that two's complement needs for low..high."""
    return max((~low if low < 0 else low).bit_length(), (~high if high < 0 else high).bit_length()) + 1


def planes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, width): the plane words of integer rows (n, 64), lowest plane
    first, one row after the other, and the number of planes of each row."""
    if values.dtype == object:
        width = [_width(min(row), max(row)) for row in values.tolist()]
        words = [sum((int(x) >> p & 1) << i for i, x in enumerate(row)) for row, w in zip(values.tolist(), width, strict=True) for p in range(w)]
        return np.array(words, dtype=np.uint64), np.array(width, dtype=np.int64)
    magnitude = np.where(values < 0, ~values, values).max(axis=1)
    width = np.ones(len(values), dtype=np.int64)
    most = _width(0, int(magnitude.max(initial=0)))
    for p in range(most):
        width += magnitude >> p > 0
    bits = (values[:, None, :] >> np.arange(most)[None, :, None] & 1).astype(np.uint8)
    words = np.packbits(bits, axis=-1, bitorder="little").view("<u8")[..., 0]
    return words[np.arange(most)[None, :] < width[:, None]].astype(np.uint64), width


def unpacked(words: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Plane matrix (n, widest): shorter rows repeat their top plane, which
    leaves the value of two's complement as it is."""
    most = int(width.max(initial=1))
    at = np.minimum(np.arange(most)[None, :], width[:, None] - 1) + (np.cumsum(width) - width)[:, None]
    return words[at]


def _weights(planes: int) -> list[int]:
    return [1 << p for p in range(planes - 1)] + [-(1 << planes - 1)]


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products (n, k) of plane matrices (n, W) and (k, V)."""
    fits = x.shape[1] + c.shape[1] + 6 < 62
    out = np.zeros((len(x), len(c)), dtype=np.int64 if fits else object)
    for i, wi in enumerate(_weights(x.shape[1])):
        for j, wj in enumerate(_weights(c.shape[1])):
            hits = np.bitwise_count(x[:, i, None] & c[None, :, j])
            out += hits.astype(out.dtype) * (wi * wj)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """|x|^2 of each row of a plane matrix."""
    w = _weights(x.shape[1])
    out = np.zeros(len(x), dtype=np.int64 if 2 * x.shape[1] + 6 < 62 else object)
    for i, wi in enumerate(w):
        for j in range(i + 1):
            hits = np.bitwise_count(x[:, i] & x[:, j])
            out += hits.astype(out.dtype) * (wi * w[j] * (2 if i > j else 1))
    return out


class Centroids:
    """Centroids as exact integers, with their planes and squares."""

    def __init__(self, values: list[list[int]]):
        self.values = values
        words, width = planes_of(np.array(values, dtype=object).reshape(len(values), DIM))
        self.planes = unpacked(words, width)
        self.squares = [sum(x * x for x in row) for row in values]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of a
        plane matrix; ties go to the smaller number."""
        dot, own = dots(x, self.planes), squares(x)
        wide = dot.dtype == object or own.dtype == object or max(self.squares) >= 2**60
        if wide:
            dot, own = dot.astype(object), own.astype(object)
        far = own[:, None] - 2 * dot + np.array(self.squares, dtype=object if wide else np.int64)[None, :]
        number = np.argmin(far, axis=1)
        return number, far[np.arange(len(far)), number]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.values]


def _plane_rows(part: pa.RecordBatch, at: int) -> np.ndarray:
    column = part.column(at)
    offsets = column.offsets.to_numpy()
    words = column.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0]:offsets[-1]]
    return unpacked(words, np.diff(offsets).astype(np.int64))


def to_planes(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, planes array<long>`` of the rows whose vector has exactly 64
    components, none null or non-finite."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("v")).filter((F.size("v") == DIM) & good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            if not len(x):
                continue
            if np.abs(x).max() * scale < _NARROW:
                values = np.floor(x * scale).astype(np.int64)
            else:
                values = np.array(to_integers(x.tolist(), scale), dtype=object).reshape(-1, DIM)
            words, width = planes_of(values)
            offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, words.view(np.int64))], names=["vec_id", "planes"])

    return kept.mapInArrow(run, "vec_id long, planes array<long>")


def _integers(words: list[int]) -> list[int]:
    """The 64 integers that planes (signed words, lowest first) stand for."""
    return [sum((word >> i & 1) * w for word, w in zip(words, _weights(len(words)), strict=True)) for i in range(DIM)]


def first_centroids(planes: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest lowercase-hex SHA-256 of ``salt:id``, in
    hash order (equal ids: by their planes; null ids last)."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return [_integers(r.planes) for r in planes.orderBy(order, "planes").limit(k).collect()]


def _tallies(planes: DataFrame, centroids: Centroids) -> DataFrame:
    """``cluster, plane, lanes``: for each centroid and plane, how many of its
    vectors have a 1 in each component. A vector's top plane p, of weight -2**p,
    is counted as plane -p - 1; its last lane counts the vectors themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for part in slices(batches, 4096):
            if not part.num_rows:
                continue
            x = _plane_rows(part, 0)
            number, _ = centroids.nearest(x)
            bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(*x.shape, 8), axis=-1, bitorder="little")
            top = x.shape[1] - 1
            for c in np.unique(number).tolist():
                own = bits[number == c]
                for p, ones in enumerate(own.sum(axis=0, dtype=np.int64)):
                    lanes = total.setdefault((c, p if p < top else -p - 1), np.zeros(DIM + 1, dtype=np.int64))
                    lanes[:DIM] += ones
                    lanes[DIM] += len(own) if p == top else 0
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in total], pa.int32()), pa.array([p for _, p in total], pa.int32()),
                 pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["cluster", "plane", "lanes"])

    rows = planes.select("planes").mapInArrow(run, "cluster int, plane int, lanes array<long>")
    return rows.groupBy("cluster", "plane").agg(F.array(*[F.sum(F.col("lanes")[i]) for i in range(DIM + 1)]).alias("lanes"))


def moved(planes: DataFrame, centroids: Centroids) -> Centroids:
    """One round: every vector to its nearest centroid, then every centroid
    that has vectors to their componentwise floor(sum / count)."""
    sums: dict[int, list[int]] = {}
    for r in _tallies(planes, centroids).collect():
        weight = 1 << r.plane if r.plane >= 0 else -(1 << -r.plane - 1)
        own = sums.setdefault(r.cluster, [0] * (DIM + 1))
        for i in range(DIM):
            own[i] += weight * r.lanes[i]
        own[DIM] += r.lanes[DIM]
    return Centroids([[s // sums[c][DIM] for s in sums[c][:DIM]] if c in sums else old for c, old in enumerate(centroids.values)])


def assign(planes: DataFrame, centroids: Centroids) -> DataFrame:
    """``vec_id, cluster, distance`` (a narrow pass)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            if not part.num_rows:
                continue
            number, far = centroids.nearest(_plane_rows(part, 1))
            if far.dtype == object:
                far = np.array([min(int(d), LONG_MAX) for d in far], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), pa.array(far, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return planes.select("vec_id", "planes").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64,
            salt: str = "1") -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): for every kept vector ``vec_id, cluster, distance`` (squared)
    ``, cluster_inertia, inertia, centroid_sha256``, and the final centroids as integers.

    A vector is kept if it has exactly 64 components, none null, NaN or infinite;
    component x counts as floor(scale * x). The k starting centroids are the kept
    vectors with the smallest SHA-256 of ``salt:id``; fewer vectors give fewer
    centroids, none give no rows. Repeated rows count each; rows with a null id
    are clustered too, and start a centroid only after all others. Ties go to the
    smaller centroid; a centroid without vectors stays. Distances and sums beyond a
    long (components over about 10**8) are exact inside and given as 2**63 - 1.
    Further columns are not read.
    """
    if not 1 <= k <= 1024:
        raise ValueError("k must lie in 1..1024: centroids travel with every task")
    planes = materialize(to_planes(df, id_col, vec_col, scale), "planes")
    start = first_centroids(planes, k, salt)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return df.sparkSession.createDataFrame([], schema), []
    centroids = Centroids(start)
    for _ in range(rounds):
        centroids = moved(planes, centroids)
    rows = materialize(assign(planes, centroids), "assigned")
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(sum(sums.values()), LONG_MAX)
    digests = centroids.digests()
    facts = df.sparkSession.createDataFrame([(c, min(s, LONG_MAX), whole, digests[c]) for c, s in sums.items()],
                                            "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = rows.join(F.broadcast(facts), "cluster")  # k rows at most
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids.values
