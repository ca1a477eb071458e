"""A stored IVF index for exact cosine top-k.

The index is a folder, written once and appended to:

    centres/            list_id, centre               n_lists rows, fitted once
    items/part=<p>/     list_id, item_id, vec, dist   every vector, in its nearest list
    bounds/             list_id, n, radius            one row per list and batch

Vectors are compared by direction. ``dist`` is the distance of an item's unit
vector to its list's centre and ``radius`` the largest of them, so for a query at
distance d from a centre no item of the list is nearer than d - radius. A search
visits each query's lists in the order of that bound: first a few, then all the
others whose bound is below the query's k-th best distance among those. A list beyond it cannot hold a better item, so the answer is exact at any
number of visited lists, and far lists are never read (their folders are left out
by partition filters).

Appending assigns new vectors to the centres there are; nothing is fitted or
rewritten. The centres come from a sample of about ``SAMPLE_PER_LIST`` vectors a
list, the only thing that is bounded; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.topk import top_n_per_group
from vitrine.session import materialize

SAMPLE_PER_LIST = 64      # vectors a list that the centres are fitted on
FIT_ROUNDS = 8
PARTS = 16                # folders that hold the lists
BLOCK_ROWS = 2_000        # most items and most queries that one task compares at a time
MAX_CENTRE_VALUES = 20_000_000  # n_lists x dim that may travel with every task
FIRST_LISTS = 6           # lists of a query visited before the others are judged
_SLACK = 1e-6             # scores are rounded to six digits: equal ones may hide a nearer item


def _unit(vecs: np.ndarray) -> np.ndarray:
    """Unit vectors; rows without a direction (norm 0 or not finite) become NaN."""
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(vecs, axis=1, keepdims=True)
        return np.where(np.isfinite(norm) & (norm > 0), vecs / norm, np.nan)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(vec, dim: int):
    """Vectors of ``dim`` entries without nulls."""
    return F.coalesce((F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull()), F.lit(False))


def fit_centres(sample: np.ndarray, n_lists: int, seed: int) -> np.ndarray:
    """k-means centres of unit vectors: far-apart starts, then Lloyd rounds."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    far = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < n_lists and far.max() > 1e-12:
        centres.append(sample[rng.choice(len(sample), p=far / far.sum())])
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(FIT_ROUNDS):
        own = np.argmax(sample @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(axis=0)
    return centres


class IvfIndex:
    """One index in one folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        rows = spark.read.parquet(f"{self.root}/centres").orderBy("list_id").collect()  # n_lists rows, bounded at build
        self.centres = np.array([r.centre for r in rows], dtype=np.float64)
        self._listed: DataFrame | None = None  # the files of the items, listed once

    @classmethod
    def build(cls, items: DataFrame, root: str, id_col: str, vec_col: str, dim: int, n_lists: int = 100, seed: int = 7) -> IvfIndex:
        """Fits the centres on a sample, then writes every vector of ``items``.

        Left out, because they have no cosine: vectors that are null, of another
        length, hold a null, or have a norm of 0 or none. An index over no vectors
        is valid and empty."""
        if n_lists * dim > MAX_CENTRE_VALUES:
            raise ValueError(f"{n_lists} centres of {dim} values are too many to travel with every task")
        spark = items.sparkSession
        vecs = items.select(F.col(vec_col).cast("array<double>").alias("v")).where(_usable(F.col("v"), dim))
        wanted = SAMPLE_PER_LIST * n_lists
        drawn = vecs.sample(min(1.0, wanted / max(1, vecs.count())), seed).limit(2 * wanted)
        sample = _unit(np.array([r.v for r in drawn.collect()], dtype=np.float64).reshape(-1, dim))
        sample = sample[~np.isnan(sample[:, 0])]
        centres = fit_centres(sample, n_lists, seed) if len(sample) else np.eye(1, dim)
        (spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list_id int, centre array<double>")
         .coalesce(1).write.parquet(f"{root.rstrip('/')}/centres"))
        index = cls(spark, root)
        index.append(items, id_col, vec_col)
        return index

    # ------------------------------------------------------------- writing
    def _assigned(self, items: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        centres, dim = self.centres, self.centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                unit = _unit(_matrix(part.column(1), dim))
                good = ~np.isnan(unit).any(axis=1)
                part, unit = part.filter(pa.array(good)), unit[good]
                own = np.argmax(unit @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1) if len(unit) else np.zeros(0, dtype=int)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.linalg.norm(unit - centres[own], axis=1)),
                                                  pa.array(own, pa.int32())], names=["item_id", "vec", "dist", "list_id"])

        vec = F.col(vec_col).cast("array<double>")
        good = items.select(F.col(id_col).cast("long").alias("item_id"), vec.alias("vec")).where(_usable(F.col("vec"), dim))
        return good.mapInArrow(run, "item_id long, vec array<double>, dist double, list_id int")

    def append(self, items: DataFrame, id_col: str, vec_col: str) -> None:
        """Adds vectors without refitting: only new files are written. The
        rebalance hint lets adaptive execution cut a large list into several files."""
        rows = materialize(self._assigned(items, id_col, vec_col), "ivf-assigned")
        part = (F.col("list_id") % PARTS).alias("part")
        dealt = rows.select("list_id", "item_id", "vec", "dist", part).hint("rebalance", "part")
        dealt.sortWithinPartitions("part", "list_id").write.mode("append").partitionBy("part").parquet(f"{self.root}/items")
        self._listed = None
        # after the items: a search never trusts a radius whose items it cannot see
        (rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
         .coalesce(1).write.mode("append").parquet(f"{self.root}/bounds"))

    # ------------------------------------------------------------- reading
    def lists(self) -> DataFrame:
        """``list_id, n, radius`` of every list that holds an item."""
        rows = self.spark.read.schema("list_id int, n long, radius double").parquet(f"{self.root}/bounds")
        return rows.groupBy("list_id").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))

    def items(self, list_ids: list[int]) -> DataFrame:
        """The items of some lists; other folders and row groups are not read."""
        if self._listed is None:
            schema = "list_id int, item_id long, vec array<double>, dist double, part int"
            self._listed = self.spark.read.schema(schema).parquet(f"{self.root}/items")
        parts = sorted({c % PARTS for c in list_ids})
        return self._listed.where(F.col("part").isin(parts) & F.col("list_id").isin(list_ids))

    def search(self, queries: DataFrame, query_id: str, query_vec: str, k: int) -> tuple[DataFrame, dict]:
        """(rows, visits): ``query_id, item_id, score, rank``, for each query the
        ``k`` items of highest cosine (rounded to six digits; ties: smaller id),
        exactly; and how many (query, list) pairs there were and were read.

        Queries without a direction find nothing. Ids of queries should differ;
        rows that repeat one share its k places."""
        dim = self.centres.shape[1]
        bounds = {r.list_id: (r.n, r.radius) for r in self.lists().collect()}  # n_lists rows
        asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).cast("array<double>").alias("q_vec"))
        asked = materialize(asked.where(_usable(F.col("q_vec"), dim)), "ivf-queries")
        best = self.spark.createDataFrame([], "query_id long, item_id long, score double")
        visits = {"read": 0, "all": asked.count() * len(bounds)}
        done = 0
        for upto in (FIRST_LISTS, len(bounds)):
            upto = min(upto, len(bounds))
            if upto <= done:
                continue
            probes = self._probes(asked, best, bounds, k, done, upto)
            wanted = {r.list_id: r["count"] for r in probes.groupBy("list_id").count().collect()}  # n_lists rows
            done = upto
            if not wanted:
                break
            visits["read"] += sum(wanted.values())
            found = self._compared(probes, {c: (bounds[c][0], q) for c, q in wanted.items()}, k)
            ranked = top_n_per_group(best.unionByName(found), ["query_id"], [F.col("score").desc(), F.col("item_id")], k)
            best = materialize(ranked.select("query_id", "item_id", "score"), "ivf-best")
        return top_n_per_group(best, ["query_id"], [F.col("score").desc(), F.col("item_id")], k), visits

    def _probes(self, asked: DataFrame, best: DataFrame, bounds: dict, k: int, start: int, stop: int) -> DataFrame:
        """``list_id, query_id, q_vec, q_dist, reach``: each query's lists at places
        start..stop of its bound order that may still hold a better item."""
        order = np.array(sorted(bounds), dtype=np.int64)
        centres, radius = self.centres[order], np.array([bounds[c][1] for c in order.tolist()])
        squares, dim = (centres ** 2).sum(axis=1), self.centres.shape[1]
        # the k-th best cosine s so far: unit vectors of a higher cosine are nearer than sqrt(2 - 2s)
        kth = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("query_id", "s")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    part = whole.slice(at, 512)
                    unit = _unit(_matrix(part.column(1), dim))
                    worst = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = np.where(np.isnan(worst), np.inf, np.sqrt(np.maximum(0, 2 - 2 * (worst - _SLACK))) + _SLACK)
                    far = np.sqrt(np.maximum(0, 1 - 2 * unit @ centres.T + squares))
                    low = far - radius - _SLACK
                    places = np.lexsort((far, np.maximum(low, 0)), axis=1)[:, start:stop]
                    rows = np.arange(len(unit))[:, None]
                    take = (low[rows, places] <= reach[:, None]) & ~np.isnan(unit[:, :1])
                    who, place = np.nonzero(take)
                    col = places[who, place]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(order[col], pa.int32()), part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)),
                         pa.array(far[who, col]), pa.array(reach[who])], names=["list_id", "query_id", "q_vec", "q_dist", "reach"])

        rows = asked.join(kth, "query_id", "left").select("query_id", "q_vec", "s")
        return rows.mapInArrow(run, "list_id int, query_id long, q_vec array<double>, q_dist double, reach double")

    def _compared(self, probes: DataFrame, sizes: dict, k: int) -> DataFrame:
        """The k best items of each query in each block of a list. A list is cut
        into blocks of about ``BLOCK_ROWS`` items and queries, so one that holds
        most of the rows is no single task."""
        dim = self.centres.shape[1]
        cuts = F.broadcast(self.spark.createDataFrame([(c, -(-n // BLOCK_ROWS), -(-q // BLOCK_ROWS)) for c, (n, q) in sizes.items()],
                                                      "list_id int, i int, q int"))  # n_lists rows at most

        def dealt(df: DataFrame, own: str, own_id: str, other: str, *columns: str) -> DataFrame:
            mine = F.pmod(F.xxhash64(own_id), F.col(own)).cast("int").alias(own)
            return df.join(cuts, "list_id").select("list_id", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), own_id, *columns)

        schema = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])

        def nearest(held: pa.Table, asked: pa.Table) -> pa.Table:
            if not held.num_rows or not asked.num_rows:
                return schema.empty_table()
            held = held.combine_chunks().sort_by("item_id")
            asked = asked.combine_chunks()
            ids, dist = held.column("item_id").to_numpy(), held.column("dist").to_numpy()
            x = _unit(_matrix(held.column("vec").chunk(0), dim))
            q_ids, q = asked.column("query_id").to_numpy(), _unit(_matrix(asked.column("q_vec").chunk(0), dim))
            q_dist, reach = asked.column("q_dist").to_numpy(), asked.column("reach").to_numpy()
            out = []
            for at in range(0, len(q), 256):
                some = slice(at, at + 256)
                # an item nearer than `reach` to the query is about as far from the centre as the query
                ring = (dist >= (q_dist[some] - reach[some]).min() - _SLACK) & (dist <= (q_dist[some] + reach[some]).max() + _SLACK)
                scores = np.round(q[some] @ x[ring].T, 6)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out.append(pa.table([pa.array(np.repeat(q_ids[some], order.shape[1])), pa.array(ids[ring][order].ravel()),
                                     pa.array(np.take_along_axis(scores, order, 1).ravel())], schema=schema))
            return pa.concat_tables(out)

        key = ["list_id", "i", "q"]
        left = dealt(self.items(sorted(sizes)), "i", "item_id", "q", "vec", "dist").groupBy(*key)
        return left.cogroup(dealt(probes, "q", "query_id", "i", "q_vec", "q_dist", "reach").groupBy(*key)).applyInArrow(
            nearest, "query_id long, item_id long, score double")
