"""Operator 12: spelling variants by a trie of letter-group counts.

Letters fall into 16 groups (code point mod 16). A word's frequency vector
counts its letters by group; one inserted, deleted or replaced letter changes
it by a surplus of at most one and a deficit of at most one. The trie holds the
distinct vectors of a vocabulary, one level for each group. A search walks down
from the root depth first: at each level it takes the word's own count, or
spends its surplus (count + 1) or its deficit (count - 1); leaf words are
verified letter by letter. The surplus must be spent at an earlier level than
the deficit, so a pair of equal length is found from one of its words only, and
a pair of different length from the shorter one.

On Spark the top of the trie deals the words. A node of depth 4 that holds at
most ``NODE_WORDS`` words is searched as one piece, a larger one goes 4 levels
deeper. Searches descend the same way as rows (word, node, spent), joined at each
step with the nodes that exist, so dead branches end there; the many searches
that reach one node are cut into parts of about ``ASKED_WORDS`` words. Inside a
piece the walk is the trie's depth-first search over blocks of searches: arrays
of (search, node, spent) on a stack, the deepest first. Words of one and the
same vector (letters rearranged within the groups) are compared with each other;
where over ``NODE_WORDS`` words share a vector they are held in several parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import keyed_text, slices
from vitrine.session import materialize

GROUPS = 16        # levels of the trie
STEP = 4           # levels that one dealing step descends
NODE_WORDS = 50_000
ASKED_WORDS = 25_000
BLOCK = 40_000     # searches, trie states or word pairs handled at a time
LETTERS = 48       # longer words are verified one by one
HELD_WORDS = 300_000  # different words that a task counts before it gives them on


# ---------------------------------------------------------------- vocabulary

def run_pattern(least: int) -> re.Pattern:
    """Maximal runs of letters, those below ``least`` left out."""
    return re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")


def document_words(doc_id: int | None, text: str, pattern: re.Pattern, every: int) -> Counter:
    """Occurrences of the words of a text: A-Z lower-cased; a run whose
    crc32 (of ``doc_id:run``) divides by ``every`` loses one letter."""
    runs = Counter(pattern.findall(text.encode("utf-8").lower().decode("utf-8")))
    if doc_id is None or not every:
        return runs
    prefix = zlib.crc32(b"%d:" % doc_id)
    hashes = [(run, zlib.crc32(run.encode("utf-8"), prefix)) for run in runs]
    hit = [(run, h % len(run), runs[run]) for run, h in hashes if h % every == 0]
    for run, _, _ in hit:
        del runs[run]
    for run, at, n in hit:
        runs[run[:at] + run[at + 1:]] += n
    return runs


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_n: int = 5,
               every: int = 199) -> DataFrame:
    """``word, n``: the words of at least ``least_letters`` letters that occur
    ``least_n`` times or more in the whole corpus. Tasks count before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held, size = run_pattern(least_letters), Counter(), 0

        def counted() -> pa.RecordBatch:
            kept = {w: n for w, n in held.items() if len(w) >= least_letters}
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

        for part in slices(batches, 64):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if text:
                    before = len(held)
                    words = document_words(doc_id, text, pattern, every)
                    held.update(words)
                    size += (len(held) - before) * 10 + max(map(len, words), default=0)
                if size > 10 * HELD_WORDS:
                    yield counted()
                    held.clear()
                    size = 0
        yield counted()

    counts = keyed_text(df, id_col, text_col).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


# ------------------------------------------------------------ words as arrays

def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters one after the other, row of each letter, lengths)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.repeat(np.arange(len(words)), lengths), lengths


def vectors(words: list[bytes]) -> np.ndarray:
    """Frequency vectors (n, 16), counts mod 256 (so are their changes by one)."""
    letters, row, _ = _flat(words)
    counts = np.bincount(row * GROUPS + (letters & (GROUPS - 1)), minlength=len(words) * GROUPS)
    return counts.reshape(len(words), GROUPS).astype(np.uint8)


def letter_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(first ``LETTERS`` letters of each word, zero beyond its end; lengths)."""
    letters, row, lengths = _flat(words)
    at = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(words), LETTERS + 1), dtype=np.uint8)
    inside = at < LETTERS
    out[row[inside], at[inside]] = letters[inside]
    return out, lengths


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def verified(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """`one_edit` for rows of letters with len_b - len_a in (0, 1)."""
    differ = a != b
    replaced = differ.sum(axis=1) == 1
    shifted = (a[:, :-1] != b[:, 1:]) & (np.arange(LETTERS)[None, :] < len_a[:, None])
    first = np.argmax(differ, axis=1)                      # b's extra letter differs from a's end
    last = np.where(shifted.any(axis=1), LETTERS - 1 - np.argmax(shifted[:, ::-1], axis=1), -1)
    return np.where(len_a == len_b, replaced, first > last)


# ----------------------------------------------------------------------- trie

class Trie:
    """The distinct frequency vectors of a list of words, a level for each
    letter group; node ids of a level follow the order of the vectors."""

    def __init__(self, words: list[bytes]):
        vec = vectors(words)
        self.order = np.lexsort(vec.T[::-1])
        vec = vec[self.order]
        new = np.ones(len(vec), dtype=bool)
        new[1:] = (vec[1:] != vec[:-1]).any(axis=1)
        leaf_start = np.flatnonzero(new)
        self.leaf_start, self.leaf_size = leaf_start, np.diff(np.append(leaf_start, len(vec)))
        distinct = vec[leaf_start].astype(np.int64)
        # children of level d: (parent node, count), sorted; a child's node id is its place
        self.children, node = [], np.zeros(len(distinct), dtype=np.int64)
        for level in range(GROUPS):
            key = node * 256 + distinct[:, level]
            kids, node = np.unique(key, return_inverse=True)
            self.children.append(kids)

    def step(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Child of each node with that count; -1 where there is none."""
        kids = self.children[level]
        key = node * 256 + (count & 255)
        at = np.minimum(np.searchsorted(kids, key), len(kids) - 1)
        return np.where(kids[at] == key, at, -1)

    def search(self, vec: np.ndarray, spent: np.ndarray, known: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(search, leaf, spent) in blocks, for searches whose first ``known``
        levels are given (as the held words', which all share them) and have
        spent so much: 0 nothing, 1 the surplus, 2 the surplus and the deficit."""
        vec = vec.astype(np.int64)
        start = np.zeros(len(vec), dtype=np.int64)  # one node a level down to `known`
        stack = [(known, np.arange(len(vec))[at:at + BLOCK], start[at:at + BLOCK], spent[at:at + BLOCK]) for at in range(0, len(vec), BLOCK)]
        while stack:
            level, who, node, used = stack.pop()
            if level == GROUPS:
                yield who, node, used
                continue
            own = vec[who, level]
            may = used < 2
            change = np.where(used == 0, 1, -1)
            same, other = self.step(level, node, own), self.step(level, node[may], own[may] + change[may])
            on, off = same >= 0, other >= 0
            who = np.concatenate([who[on], who[may][off]])
            used = np.concatenate([used[on], used[may][off] + 1])
            node = np.concatenate([same[on], other[off]])
            for at in range(0, len(who), BLOCK):
                stack.append((level + 1, who[at:at + BLOCK], node[at:at + BLOCK], used[at:at + BLOCK]))

    def near(self, asked: list[bytes], held: list[bytes], spent: np.ndarray, known: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asked, held) index pairs, in blocks, that differ by one letter."""
        held_rows, held_len = letter_rows(held)
        asked_rows, asked_len = letter_rows(asked)
        for who, leaf, used in self.search(vectors(asked), spent, known):
            size = self.leaf_size[leaf]
            for some in _blocks(size):
                n = size[some]
                a = np.repeat(who[some], n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                b = self.order[np.repeat(self.leaf_start[leaf[some]], n) + place]
                more = held_len[b] - asked_len[a]
                fits = more == (np.repeat(used[some], n) == 1)
                a, b = a[fits], b[fits]
                short = held_len[b] <= LETTERS
                good = np.zeros(len(a), dtype=bool)
                good[short] = verified(asked_rows[a[short]], held_rows[b[short]], asked_len[a[short]], held_len[b[short]])
                for i in np.flatnonzero(~short).tolist():
                    good[i] = one_edit(asked[a[i]], held[b[i]])
                # a pair of one vector is met from both of its words: the smaller one counts
                level = np.repeat(used[some], n)[fits] == 0
                for i in np.flatnonzero(good & level).tolist():
                    good[i] = asked[a[i]] < held[b[i]]
                yield a[good], b[good]


def _blocks(size: np.ndarray) -> Iterator[slice]:
    """Slices of rows that stand for about ``BLOCK`` pairs each, one row at least."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        yield slice(at, to)
        at = to


# -------------------------------------------------------------------- dealing

def _choices(spent: int, levels: int) -> list[tuple[np.ndarray, int]]:
    """(change of the next ``levels`` counts, spent after it)."""
    eye = np.eye(levels, dtype=np.int64)
    out = [(np.zeros(levels, dtype=np.int64), spent)]
    if spent < 2:
        out += [(eye[i] if spent == 0 else -eye[i], spent + 1) for i in range(levels)]
    if spent == 0:
        out += [(eye[i] - eye[j], 2) for i in range(levels) for j in range(i + 1, levels)]
    return out


def _descended(rows: DataFrame, depth: int) -> DataFrame:
    """Searches ``node, word, n, spent`` of depth - STEP, taken STEP levels on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            if not part.num_rows:
                continue
            nodes, words, used = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_numpy()
            vec = vectors(words)[:, depth - STEP:depth].astype(np.int64)
            for spent in np.unique(used).tolist():
                own = np.flatnonzero(used == spent)
                for change, after in _choices(spent, STEP):
                    tails = (vec[own] + change).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([nodes[i] + t.tobytes() for i, t in zip(own.tolist(), tails, strict=True)], pa.binary()),
                         part.column(1).take(pa.array(own)), part.column(2).take(pa.array(own)),
                         pa.array(np.full(len(own), after, dtype=np.int32))], names=["node", "word", "n", "spent"])

    return rows.select("node", "word", "n", "spent").mapInArrow(run, "node binary, word binary, n long, spent int")


def _with_vectors(words: DataFrame) -> DataFrame:
    """``word, n`` as ``word binary`` (one byte a letter), ``n, vec binary``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            own = [w.encode("latin-1") for w in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), part.column(1), pa.array([v.tobytes() for v in vectors(own)], pa.binary())],
                                             names=["word", "n", "vec"])

    return words.select("word", "n").mapInArrow(run, "word binary, n long, vec binary")


def _searched(held: pa.Table, asked: pa.Table) -> pa.Table:
    """Both directions of the near pairs of one piece of the trie."""
    schema = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])
    if not held.num_rows or not asked.num_rows:
        return schema.empty_table()
    known = held.column("depth")[0].as_py()
    h, a = held.column("word").to_pylist(), asked.column("word").to_pylist()
    h_n, a_n = held.column("n").to_numpy(), asked.column("n").to_numpy()
    spent = asked.column("spent").to_numpy().astype(np.int64)
    h_text = pa.array([w.decode("latin-1") for w in h], pa.string())
    a_text = pa.array([w.decode("latin-1") for w in a], pa.string())
    out = []
    for i, j in Trie(h).near(a, h, spent, known):
        left, right = a_text.take(pa.array(i)), h_text.take(pa.array(j))
        out.append(pa.Table.from_arrays([left, right, pa.array(h_n[j])], schema=schema))
        out.append(pa.Table.from_arrays([right, left, pa.array(a_n[i])], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def near_words(words: DataFrame) -> DataFrame:
    """``word, other, other_n``, once for every ordered pair of near words of a
    written frame ``word, n`` (distinct words of letters up to U+00FF)."""
    held = materialize(_with_vectors(words), "word-vectors")
    asked = held.select(F.lit(b"").alias("node"), "word", "n", F.lit(0).alias("spent"))
    pieces = []
    for depth in range(STEP, GROUPS + 1, STEP):
        held = held.withColumn("node", F.substring("vec", 1, depth))
        nodes = materialize(held.groupBy("node").agg(F.count(F.lit(1)).alias("words")), "nodes")
        asked = materialize(_descended(asked, depth).join(nodes.select("node"), "node"), "searches")
        last = depth == GROUPS
        here = nodes if last else nodes.filter(F.col("words") <= NODE_WORDS)
        searches = asked.groupBy("node").agg(F.count(F.lit(1)).alias("searches"))
        cut = materialize(here.join(searches, "node").select(
            "node", F.ceil(F.col("words") / NODE_WORDS).cast("int").alias("held_parts"),
            F.ceil(F.col("searches") / ASKED_WORDS).cast("int").alias("asked_parts")), "pieces")
        pieces.append(_piece_pairs(held.join(cut, "node"), asked.join(cut, "node"), depth))
        if last:
            break
        deeper = nodes.filter(F.col("words") > NODE_WORDS).select("node")
        if not deeper.take(1):
            break
        held, asked = held.join(deeper, "node").select("word", "n", "vec"), asked.join(deeper, "node")
    out = pieces[0]
    for more in pieces[1:]:
        out = out.unionByName(more)
    return out


def _piece_pairs(held: DataFrame, asked: DataFrame, depth: int) -> DataFrame:
    def dealt(df: DataFrame, own: str, other: str, *columns) -> DataFrame:
        mine = F.pmod(F.xxhash64("word"), F.col(own)).cast("int").alias(own)
        return df.select("node", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "word", "n", *columns)

    key = ["node", "held_parts", "asked_parts"]
    left = dealt(held, "held_parts", "asked_parts", F.lit(depth).alias("depth")).groupBy(*key)
    right = dealt(asked, "asked_parts", "held_parts", "spent").groupBy(*key)
    return left.cogroup(right).applyInArrow(_searched, "word string, other string, other_n long")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for a written vocabulary ``word, n``.

    ``form`` is the near word of largest n (ties: smallest in code-point order)
    if that n >= ratio * n, else null; ``root`` follows forms to the last, and is
    the word itself where there is none. An empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms must become more frequent")
    pairs = near_words(words)
    # UTF-8 order is code-point order; the smallest word of the largest n, by one aggregate
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other"))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    near = near.select("word", "n_near", F.col("b.other").alias("other"), (-F.col("b.m")).alias("other_n"))
    all_words = words.select("word", "n").join(near, "word", "left")
    strong = F.col("other_n") >= ratio * F.col("n")
    found = materialize(all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                         F.when(strong, F.col("other")).alias("form"), F.when(strong, F.col("other_n")).alias("form_n")), "forms")
    # pointer doubling: n grows ratio-fold at each step, so chains are short
    up = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "roots")
        up = jumped.select("word", "root")
        if not jumped.filter("moved").take(1):
            break
    return found.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def group_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_n: int = 5,
                   ratio: int = 5, every: int = 199) -> DataFrame:
    """The spelling variants of a corpus: `variants` of its `vocabulary`.

    Null and empty texts have no words. A document without an id loses no letters. Repeated
    rows count again, each under its own id. Runs of any length are words; an
    empty table, or one without frequent words, gives no rows. Further columns are not read.
    """
    return variants(materialize(vocabulary(df, id_col, text_col, least_letters, least_n, every), "vocabulary"), ratio)
