"""Operator 1: n-gram Jaccard join by PartEnum signatures.

A document is the set of its word n-gram hashes. Two sets link when their
Jaccard similarity is at least ``percent``/100 (tested in integers).

Signatures. Sets fall into size bands; a set signs for its own band and for
the next ones as far as a partner there is possible. Inside a band with
largest size u, linked sets differ in at most k = floor(2u(1-s)/(1+s))
elements. The hash domain is cut into ``n1`` first-level parts, each into ``n2``
second-level parts. Spread over n1 > k/(k2+1) parts, k differences leave one
part with at most ``k2`` of them, where some n2-k2 second-level parts agree: so
a part signs once for every subset of n2-k2 second-level parts (a sum of mixed
element hashes), and linked sets share a signature.

An empty subset would sign alike in unrelated sets, and so would the one or two
shingles of a passage that many sets quote. Bands therefore have ``slack`` and
``spare`` more parts than needed, so linked sets agree in slack+spare+1 parts.
A set leaves its empty signatures out unless more than ``slack`` of its parts
have any: of two linked sets either both sign them, or one has at most slack
such parts, so spare+1 agreeing signatures are left in any case. Of those that
it has in a band, each set then leaves out the ``spare`` most frequent ones
(ties: larger signature). The rarest of the spare+1 that two linked sets share
has spare others above it, so neither set leaves it out: no link is lost, while
sets that share just a passage mostly have no signature left.

Sketches. A set's sketch is the parity of its hashes in ``64 * LONGS`` buckets: two
sketches differ in no more bits than the sets in elements, so a pair with more
differing bits than linked sets of these sizes can have is no link, whatever the
sets hold. Signatures of a band carry the sketch, folded to the length the band's
differences need, and the join on signatures makes only pairs that pass this test.
Of sets too large for it (`_beyond`), a pair must share spare+1 signatures in the
larger one's band before whole texts are compared. The lists for this hold 16 bits of
each signature and travel for a bounded number of pairs at a time.

Pairs. Equal sets collapse first (all their signatures agree). Signatures are
dealt out once; those of one set only go. In the others each set is tested against one hub, on whole texts, and verified links form classes;
pairs inside a class need no further test. What is left, pairs that share a
signature and lie in different classes, is tested in rounds: a hash of
(signature, set) makes about 4, then 8 times as many members hubs of a
signature, until all are; after each round classes are formed anew, so a large
group of near copies merges before its pairs are listed. Every pair of sets
that share a signature thus ends in one class or is tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import apart, drop_written, keyed_text, release_finished, slices, written
from vitrine.session import materialize

BAND = 1.25  # largest size over smallest size of a band
HUBS, GROWTH = 4, 8  # expected hubs of a signature in the first round, and their growth

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95                    # odd, so its powers have inverses mod 2**64
_BYTE = np.random.default_rng(4).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, grown to the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = [np.full(size, x, dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64))]
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s, dtype=np.uint64) for s in steps)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(text: str) -> np.ndarray:
    """Hash of every word (run of bytes other than ASCII white space), A-Z
    taken as a-z."""
    data = np.frombuffer(text.encode("utf-8").lower(), dtype=np.uint8)  # bytes.lower: A-Z only
    space = np.empty(len(data) + 2, dtype=bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    if not len(edge):
        return np.zeros(0, dtype=np.uint64)
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64, out=total[1:])
    return _mix((total[end] - total[start]) * down[start])


def shingles(text: str | None, n: int = 4) -> np.ndarray:
    """Distinct hashes of the n-word shingles of (lower-cased) ``text``; of
    fewer words the whole sequence is one; without words there is none."""
    h = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(h):
        return h
    take = min(n, len(h))
    out = np.zeros(len(h) - take + 1, dtype=np.uint64)
    for j in range(take):
        out = _mix(out * _MIX + h[j:j + len(out)] + np.uint64(j + 1))
    return np.unique(out)


def band_of(size: int) -> int:
    return int(np.floor(np.log(size) / np.log(BAND) + 1e-9))


@cache
def band_plan(band: int, percent: int) -> tuple[int, int, int, int, int, int]:
    """(smallest size, n1, k2, n2, slack, spare) of a band; n1 = 0 if its sets
    link only when equal."""
    lo, hi = (max(1, int(np.ceil(BAND ** b - 1e-6))) for b in (band, band + 1))
    # sizes a, b < hi with 100*i >= percent*(a+b-i) differ in a+b-2i elements
    k = 2 * (hi - 1) * (100 - percent) // (100 + percent)
    if k <= 0:
        return lo, 0, 0, 0, 0, 0
    if k <= 3:
        return lo, 1, k, 2 * k + 1, 0, 0
    if k < 30:
        slack, spare = 1 + -(-k // 100), 1
        return lo, k // 2 + 1 + slack + spare, 1, 3, slack, spare
    slack, spare = 2 + -(-3 * k // 100), 1 + k // 20
    return lo, k // 2 + 1 + slack + spare, 1, 2, slack, spare


BANDS = 128  # more than any text can reach (1.25 ** 128 shingles)


def spare_of(band: Column, percent: int) -> Column:
    """``spare`` of a band."""
    return F.element_at(F.array(*[F.lit(band_plan(b, percent)[5]) for b in range(BANDS)]), (band + 1).cast("int"))


@cache
def _tags(band: int, n1: int) -> np.ndarray:
    return _mix(np.arange(n1, dtype=np.uint64) + np.uint64(band * 1_000_003 + 17))


def signatures(sh: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a shingle set (without repeats); the lowest seven bits
    name the band."""
    size = len(sh)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    own = band_of(size)
    bands = [own]
    while 100 * size >= percent * band_plan(bands[-1] + 1, percent)[0]:
        bands.append(bands[-1] + 1)  # a partner in the next band is possible
    out = []
    for band in bands:
        _, n1, k2, n2, slack, _ = band_plan(band, percent)
        if not n1:
            continue
        part = (sh % np.uint64(n1 * n2)).astype(np.int64)  # hashes are mixed already
        sums = np.zeros(n1 * n2, dtype=np.uint64)
        np.add.at(sums, part, sh)
        sums = sums.reshape(n1, n2)
        filled = np.bincount(part, minlength=n1 * n2).reshape(n1, n2) > 0
        tag = _tags(band, n1)
        sigs, full = [], []
        for number, subset in enumerate(combinations(range(n2), n2 - k2)):
            chosen = list(subset)
            own = sums[:, chosen[0]] if len(chosen) == 1 else sums[:, chosen].sum(axis=1, dtype=np.uint64)
            sigs.append(_mix((own ^ tag) + np.uint64((number + 1) * int(_MIX) % 2**64)))
            full.append(filled[:, chosen[0]] if len(chosen) == 1 else filled[:, chosen].any(axis=1))
        sigs, full = np.array(sigs), np.array(full)
        leave_out = (~full.all(axis=0)).sum() <= slack
        out.append(((sigs[full] if leave_out else sigs.ravel()) & ~np.uint64(BANDS - 1)) | np.uint64(band))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


LONGS = 16  # longs of a whole sketch; in a band it is folded to 4 or 8 of them while bits are this many times the differences:
SPARSE = 3.2


def differences(size: int, percent: int) -> int:
    """Elements in which linked sets of at most ``size`` elements may differ."""
    return 2 * size * (100 - percent) // (100 + percent)


def sketch(sh: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes in ``64 * LONGS`` buckets, as longs."""
    bucket = (sh >> np.uint64(64 - 10)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=64 * LONGS) & 1).astype(np.uint8)).view(np.int64)


def _folded(whole: Column, band: Column, percent: int) -> Column:
    """A sketch as short as its band's differences allow: parities of joined
    buckets are the parities' sums."""
    def half(bits: Column, n: int) -> Column:
        return F.array(*[F.get(bits, F.lit(i)).bitwiseXOR(F.get(bits, F.lit(i + n // 2))) for i in range(n // 2)])

    def last(longs: int) -> int:
        """Last band whose differences are few enough for so many longs."""
        return max((b for b in range(BANDS) if SPARSE * differences(int(np.ceil(BAND ** (b + 1))), percent) <= 64 * longs), default=-1)

    return F.when(band <= last(4), half(half(whole, 16), 8)).when(band <= last(8), half(whole, 16)).otherwise(whole)


def _beyond(percent: int) -> int:
    """Size from which sets may differ in more elements than sketches tell apart."""
    return next(x for x in range(1, 1 << 30, 16) if SPARSE * differences(x, percent) > 64 * LONGS)


def _may_link(percent: int) -> Column:
    """No linked pair (n_a, bits_a), (n_b, bits_b) fails: by sizes, and by the
    elements that differ, of which there are at least as many as differing bits."""
    # a sum of plain terms is compiled, functions over arrays are not; a shorter sketch has no later longs
    differ = (F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(LONGS))
    apart = reduce(add, (F.coalesce(x, F.lit(0)) for x in differ))
    alike = percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")
    return alike & ((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def set_key(sh: np.ndarray) -> int:
    """Signed 63-bit key of a set; equal for equal sets."""
    return int(xxhash.xxh3_64_intdigest(sh.tobytes()) >> 1)


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key, sketch`` (the last two null without shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(t, n) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_key", "sketch"])

    return rows.select("doc_id", "text_key", "text").mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, set_key long, sketch array<long>")


SEEN_LIMIT = 200_000


def _signed(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``sig, set_key`` of every text; a task signs for equal sets once (as far
    as its bounded memory of sets reaches)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            keys, sigs = [], []
            for text in part.column(0).to_pylist():
                sh = shingles(text, n)
                key = set_key(sh)
                if len(sh) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sigs.append(signatures(sh, percent))
            if len(seen) > SEEN_LIMIT:
                seen.clear()
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), [len(x) for x in sigs]))],
                    names=["sig", "set_key"])

    return rows.select("text").mapInArrow(run, "sig long, set_key long")


def _lists(live: DataFrame, large: DataFrame) -> DataFrame:
    """``set_key, band, sigs, hidden`` of the large sets: 16 bits of each signature of
    a band, and how many signatures another one with the same bits hides."""
    found = live.join(large, "set_key").groupBy("set_key", F.col("sig").bitwiseAND(F.lit(BANDS - 1)).alias("band")).agg(
        F.collect_set(F.shiftright("sig", 48).cast("smallint")).alias("sigs"), F.count(F.lit(1)).alias("n"))
    return found.select("set_key", "band", "sigs", (F.col("n") - F.size("sigs")).cast("int").alias("hidden"))


PAIRS = 2  # pairs of large sets, for each row of the input, that lists are sent for at a time


def _close(pairs: DataFrame, lists: DataFrame, percent: int, rows: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The pairs (a, b) of (a, b, low, high), keys and sizes of their sets, that are small enough
    for sketches, or share spare+1 signatures in the larger set's band, as all linked sets do.
    Lists hold only signatures that another set has too. As a list goes out for each pair, pairs
    are taken in parts of bounded size, so disk does not grow with all of them."""
    large = pairs.filter(F.col("low") >= _beyond(percent)).withColumn(
        "band", F.floor(F.log("high") / np.log(BAND) + F.lit(1e-9)))
    sides = {x: lists.select(F.col("set_key").alias(x), "band", F.col("sigs").alias(f"sigs_{x}"), F.col("hidden").alias(f"hidden_{x}"))
             for x in ("a", "b")}
    # what is hidden in both lists may be alike
    common = F.size(F.array_intersect("sigs_a", "sigs_b")) + F.least("hidden_a", "hidden_b")
    out, parts = pairs.filter(F.col("low") < _beyond(percent)).select("a", "b"), -(-large.count() // max(1, PAIRS * rows))
    for i in range(parts):
        some = large.filter(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i)
        near = some.join(sides["b"], ["b", "band"]).join(sides["a"], ["a", "band"]).filter(common > spare_of(F.col("band"), percent))
        out = out.unionByName(keep(near.select("a", "b"), f"close-{i}"))
    return out


CACHED_SETS = 2_000


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in sets:
                if len(sets) >= CACHED_SETS:
                    sets.clear()
                sets[key] = shingles(text, n)
            return sets[key]

        for part in slices(batches, 64):
            kept = [(a, b) for a, b, text_a, text_b in zip(*(c.to_pylist() for c in part.columns), strict=True)
                    if linked(of(a, text_a), of(b, text_b), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    # only texts that occur in a pair travel; a hub with many members is split by adaptive execution
    sides = {x: texts.select(F.col("set_key").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b")}
    both = pairs.join(sides["b"], "b").join(sides["a"], "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def classes(links: DataFrame) -> DataFrame:
    """``node, class``: the smallest node that links (a, b) reach, for every
    node of a link. Rounds of star contraction: every node points to the
    smallest of its neighbours and itself, then pointers are followed; written
    after each round, and over when no link joins two classes."""
    spark = links.sparkSession
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = None
    while True:
        live = edges.filter("a <> b")
        if not live.take(1):
            break
        both = live.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(
            live.select(F.col("a").alias("node"), F.col("b").alias("to")))
        point = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        point = materialize(point, "pointers")
        while True:  # pointer jumping to the local minimum
            up = point.select(F.col("node").alias("to"), F.col("to").alias("up"))
            jumped = materialize(point.join(up, "to").select("node", "to", "up"), "pointers")
            moved = jumped.filter("up <> to").take(1)
            point = jumped.select("node", F.col("up").alias("to"))
            if not moved:
                break
        if label is None:
            label = point.select("node", F.col("to").alias("class"))
        else:
            label = materialize(label.join(point.select(F.col("node").alias("class"), "to"), "class", "left").select(
                "node", F.coalesce("to", "class").alias("class")), "classes")
        pa_, pb = (point.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in ("a", "b"))
        edges = materialize(live.join(pa_, "a").join(pb, "b").select(F.least("to_a", "to_b").alias("a"),
                                                                     F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if label is None:
        return spark.createDataFrame([], "node long, class long")
    return label


def _live(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``sig, set_key, n`` of the signatures that two sets have; one exchange serves
    the count and the join; a set that several tasks signed counts more often."""
    dealt = _signed(rows, n, percent).repartition("sig")
    counted = dealt.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("set_key").alias("lo"), F.max("set_key").alias("hi"))
    return dealt.join(counted.filter("lo < hi").select("sig", "n"), "sig").distinct()


def similar_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4,
                 percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, links, classes): ``doc_id, n_shingles, set_key`` of every row,
    verified links ``a, b`` between set keys that connect exactly the sets which
    links connect, and the class of every set that has a link."""
    spark, made = df.sparkSession, {}

    def keep(step: DataFrame, name: str) -> DataFrame:
        """Written once; the step's shuffle files go, and so does what was kept under its name."""
        again, path = written(step, name)
        drop_written(spark, [made[name]] if name in made else [])
        made[name] = path
        release_finished(spark)
        return again

    rows = keyed_text(df, id_col, text_col)
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    sets = materialize(_sets(rows, n), "sets")
    live = keep(_live(rows, n, percent), "live")
    band = F.col("sig").bitwiseAND(F.lit(BANDS - 1))
    frequent = F.row_number().over(Window.partitionBy("set_key", band).orderBy(F.desc("n"), F.desc("sig")))
    shared = keep(live.withColumn("nth", frequent).filter(F.col("nth") > spare_of(band, percent)).select("sig", "set_key"), "shared")
    hubs = shared.groupBy("sig").agg(F.min("set_key").alias("hub"), F.max("set_key").alias("top"), F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("sig", "set_key"), F.lit(1 << 30)) / F.lit(1 << 30) * F.col("n")
    turn = F.when(part < HUBS, 0).otherwise(1 + F.floor(F.log(part / HUBS) / np.log(GROWTH))).cast("int")
    grouped = keep(shared.join(hubs.filter("hub < top"), "sig").select("sig", "set_key", "hub", turn.alias("turn")), "grouped")
    drop_written(spark, [made.pop("shared")])
    marks = sets.filter("set_key is not null").select("set_key", F.col("n_shingles").alias("n"), "sketch").join(
        grouped.select("set_key").distinct(), "set_key").dropDuplicates(["set_key"])
    marks = keep(marks, "marks")
    large = marks.filter(F.col("n") >= _beyond(percent)).select("set_key")
    lists = keep(_lists(live, large), "lists")
    drop_written(spark, [made.pop("live")])
    members = keep(grouped.join(marks, "set_key").select("sig", "set_key", "hub", "turn", "n", _folded(F.col("sketch"), band, percent).alias("bits")),
                   "members")
    drop_written(spark, [made.pop("grouped"), made.pop("marks")])
    # the texts of sets that share a signature, once for all rounds
    involved = members.select("set_key").distinct()
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    reps = sets.join(involved, "set_key").groupBy("set_key").agg(first).select(
        "set_key", F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("text_key"))
    same = rows["doc_id"].eqNullSafe(F.col("d")) & (rows["text_key"] == reps["text_key"])
    texts = keep(rows.join(reps, same).select("set_key", "text").dropDuplicates(["set_key"]), "texts")

    def side(rows: DataFrame, x: str, *more: Column | str) -> DataFrame:
        return rows.select("sig", F.col("set_key").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"), *more)

    low, high = F.least("n_a", "n_b").alias("low"), F.greatest("n_a", "n_b").alias("high")
    n_rows = sets.count()
    first_hub, others = (side(members.filter(which), x) for x, which in (("a", "set_key = hub"), ("b", "set_key <> hub")))
    fresh = keep(first_hub.join(others, "sig").filter(_may_link(percent)).select("a", "b", low, high).distinct(), "pairs")
    links = materialize(_verified(_close(fresh, lists, percent, n_rows, keep), texts, n, percent), "verified")
    tested = keep(fresh.select("a", "b"), "tested")
    kept = ("sig", "set_key", "turn", "n", "bits")
    rest, turn_now, label = members.select(*kept), 0, classes(links)
    while True:
        # members of signatures that hold two classes or more, and still have hubs to come
        named = rest.join(label.select(F.col("node").alias("set_key"), "class"), "set_key", "left").withColumn("class", F.coalesce("class", "set_key"))
        mixed = named.groupBy("sig").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max("turn").alias("last")).filter(
            (F.col("lo") < F.col("hi")) & (F.col("last") >= turn_now)).select("sig")
        named = keep(named.join(mixed, "sig"), "mixed")
        rest = named.select(*kept)
        if not named.take(1):
            drop_written(spark, made.values())
            return sets.drop("sketch"), links, label
        hub = side(named.filter(F.col("turn") == turn_now), "a", F.col("class").alias("class_a"))
        other = side(named.filter(F.col("turn") >= turn_now), "b", F.col("class").alias("class_b"), "turn")
        once = (F.col("turn") > turn_now) | (F.col("a") < F.col("b"))
        pairs = (hub.join(other, "sig").filter("class_a <> class_b").filter(once).filter(_may_link(percent))
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), low, high).distinct())
        fresh = keep(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = keep(_verified(_close(fresh, lists, percent, n_rows, keep), texts, n, percent), "found")
        if found.take(1):
            links = materialize(links.unionByName(found), "verified")
            label = classes(links)
        tested = keep(tested.unionByName(fresh.select("a", "b")), "tested")
        turn_now += 1


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id`` (smallest id
    reachable over links, its own included).

    Null, empty and blank texts have an empty set and link with nothing. Equal
    sets link, also those of repeated rows. A null id takes part in links but
    names no component; alone, its component is null. Empty table: no rows.
    """
    sets, _, label = similar_sets(df, id_col, text_col, n, percent)
    label = label.select(F.col("node").alias("set_key"), "class")
    # smallest id of each set, then of each class; both combine map-side
    first = sets.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"))
    named = first.join(label, "set_key", "left").withColumn("class", F.coalesce("class", "set_key"))
    smallest = named.groupBy("class").agg(F.min("first").alias("component_id"))
    component = named.join(smallest, "class").select("set_key", "component_id")
    return sets.join(component, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, all columns, that represent their group of linked
    documents (smallest id). Rows without an id stay, they represent
    themselves; rows that repeat an id stay together."""
    found = components(df, id_col, text_col, n, percent)
    name, = apart(df, "_gone")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
