"""Operator 5: quality rules by cross-document line frequency (DataFrame only).

Lines are normalised (white space dropped, lower case) and hashed. For every
host, the distinct documents that hold a line are counted; a line above the
limits is boilerplate and is removed, and a document that the removal depletes
is rejected. What counts as distinct documents:

* exact copies on a host count once (by a hash of the text);
* near copies belong to one family. A line of whose documents more than
  ``MAX_FAMILY_SHARE`` repeat a family that is counted already is that text's
  own prose, not boilerplate, so a widely copied clean document is not depleted
  by its copies. The family comes from a document's own lines, those below
  ``min_docs``, so pages of shared headers, notices and footers are no family: it
  is named by the smallest hash of their 8-word windows. A document with fewer
  than ``WINDOW`` own words is a family of its own, unless it shares
  ``PROSE_LINES`` lines of ``WINDOW`` words or more, more than a page's frame has:
  then it is a copy of that text, told by its other shared lines. Where every
  line is shared, the windows of the whole text name the family.

All counting is by aggregates with a map-side part, so a line, host or group of
copies with a third of all rows is one row for each task before a shuffle. One
pass over the texts writes a narrow table (line hashes, no text); everything
else reads that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import WS, apart
from vitrine.session import materialize

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

MIN_DOCS = 20            # a line in fewer distinct documents of a host stays
MIN_HOST_SHARE = 0.0     # a share asked for on top would let a line pass as its host grows
MAX_FAMILY_SHARE = 0.5
PROSE_LINES = 6          # shared long lines that are a text; headers, notices and footers are fewer
MIN_LEFT_SHARE = 0.5     # of the words, and MIN_WORDS of them, must be left

_SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def line_hash(line: Column) -> Column:
    """Hash of the normalised line."""
    return F.xxhash64(F.lower(F.translate(line, WS, "")))


def has_word(line: Column) -> Column:
    return line.rlike("[^ \\t\\n\\x0B\\f\\r]")


def windows(words: Column) -> Column:
    """Hash of every window of WINDOW words."""
    n = F.size(words)
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                           lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>"))


def base_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, text_key, family, lines array<struct<h, n, m>>``; ``m`` is
    the smallest window hash of the line, of all its words if it is shorter."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"),
                     text.alias("text"))
    worded = rows.withColumn("words", split_words(F.col("text"))).withColumn(
        "lines", F.filter(F.split("text", "\n"), has_word))
    hashed = worded.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", WS, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sha2("text", 256).alias("text_key"), windows(F.col("words")).alias("w"),
        F.transform("lines", lambda x: F.struct(line_hash(x).alias("h"), split_words(x).alias("w"))).alias("lines"))
    hashed = hashed.withColumn("lines", F.transform("lines", lambda x: F.struct(
        x["h"].alias("h"), F.size(x["w"]).alias("n"), F.coalesce(F.array_min(windows(x["w"])), F.xxhash64(x["w"])).alias("m"))))
    # windows found twice: neighbours in hash order; only for texts that have any
    repeats = F.size(F.array_distinct("w")) < F.size("w")
    sorted_w = F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    paired = hashed.withColumn("pairs", F.when(repeats, sorted_w))
    twice = F.filter("pairs", lambda p, j: (F.get(F.col("pairs"), j - 1)["x"] == p["x"]) | (F.get(F.col("pairs"), j + 1)["x"] == p["x"]))
    placed = paired.withColumn("at", F.when(F.col("pairs").isNotNull(), F.array_sort(F.transform(twice, lambda p: p["i"]))))

    def cover(acc: Column, i: Column) -> Column:
        fresh = F.lit(WINDOW) - F.greatest(F.lit(0), acc["until"] - i)
        return F.struct((i + WINDOW).alias("until"), (acc["total"] + fresh).alias("total"))

    covered = F.aggregate("at", F.struct(F.lit(0).alias("until"), F.lit(0).alias("total")), cover, lambda acc: acc["total"])
    return placed.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "text_key",
        F.coalesce(F.array_min("w"), F.xxhash64("text_key")).alias("family"), "lines")


def line_families(stats: DataFrame, shared: DataFrame) -> DataFrame:
    """``host, h, family``: one row per distinct document of a host and line of
    ``shared`` that it holds. A document's copies are one row of sums for each
    task, which are all multiples of the same document's."""
    lines = stats.select("host", "t", "family", F.size("lines").alias("n_lines"), F.explode("lines").alias("l")).select(
        "host", "t", "family", "n_lines", F.col("l.h").alias("h"), F.col("l.n").alias("n"), F.col("l.m").alias("m"))
    marked = lines.join(shared.select("host", "h", F.lit(True).alias("is_shared")), ["host", "h"], "left")
    own = F.col("is_shared").isNull()
    docs = marked.groupBy("host", "t", "family", "n_lines").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(own, F.col("n"))).alias("own_words"), F.min(F.when(own, F.col("m"))).alias("own"),
        F.collect_set(F.when(~own, F.struct("h", "n", "m"))).alias("held"))
    few = F.col("own_words") * F.col("n_lines") < WINDOW * F.col("n_rows")
    long = F.array_sort(F.array_distinct(F.transform(F.filter("held", lambda x: x["n"] >= WINDOW), lambda x: x["m"])))
    prose = docs.withColumn("few", few).withColumn("long", long).withColumn("prose", F.size("long") >= PROSE_LINES)
    each = prose.select("host", "t", "family", "own_words", "own", "few", "prose", F.slice("long", 1, 2).alias("long"), F.explode("held").alias("l"))
    other = F.get(F.filter("long", lambda m: m != F.col("l.m")), F.lit(0))
    family = F.when(F.col("own_words").isNull(), F.col("family")).when(~F.col("few"), F.col("own")).when(F.col("prose"), other).otherwise(F.col("t"))
    return each.select("host", F.col("l.h").alias("h"), family.alias("family"))


def boilerplate_lines(stats: DataFrame, min_docs: int = MIN_DOCS, min_host_share: float = MIN_HOST_SHARE,
                      max_family_share: float = MAX_FAMILY_SHARE) -> DataFrame:
    """``host, h, n_docs``: lines above the limits. Null hosts are one host.
    ``min_host_share`` is a further limit for callers that want one."""
    host = F.coalesce("host", F.lit("")).alias("host")
    keyed = stats.select(host, F.xxhash64("text_key").alias("t"), "family", "lines")
    held = keyed.select("host", "t", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    shared = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    by_family = line_families(keyed, shared).groupBy("host", "h", "family").agg(F.count(F.lit(1)).alias("n"))
    by_line = by_family.groupBy("host", "h").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("families"))
    found = by_line.filter(F.col("n_docs") - F.col("families") <= max_family_share * F.col("n_docs"))
    if min_host_share > 0:
        texts = keyed.select("host", "t").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
        found = found.join(texts, "host").filter(F.col("n_docs") >= min_host_share * F.col("host_docs"))
    return found.select("host", "h", "n_docs")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words, removed
    array<long>, text_key``; ``removed`` holds the hashes of the document's
    boilerplate lines.

    Null text is empty: it has no words and fails. Null hosts count as one
    host of their own. Repeated rows (same id, host and text) get equal
    results, also for null ids. An empty table gives an empty one.
    """
    stats = materialize(base_statistics(df, id_col, text_col, host_col), "quality")
    keyed = stats.withColumn("host", F.coalesce("host", F.lit("")))
    doc = ["doc_id", "host", "text_key"]
    # one row per document and line; repeats of a document's line add up
    held = keyed.dropDuplicates(doc).select(*doc, F.explode("lines").alias("l")).select(
        *doc, F.col("l.h").alias("h"), F.col("l.n").alias("n"))
    hit = held.join(boilerplate_lines(stats, **limits), ["host", "h"])
    lost = hit.groupBy(*doc).agg(F.sum("n").alias("lost"), F.collect_set("h").alias("removed")).select(
        F.col("doc_id").alias("d"), F.col("host").alias("s"), F.col("text_key").alias("k"), "lost", "removed")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("host") == F.col("s")) & (F.col("text_key") == F.col("k"))
    removed_words = F.coalesce("lost", F.lit(0)).cast("long")
    left = F.col("n_words") - removed_words
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (left < MIN_WORDS) | (left < MIN_LEFT_SHARE * F.col("n_words"))
    return keyed.join(lost, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"), removed_words.alias("n_removed_words"),
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"), "text_key")


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          chars_col: str | None = "n_chars") -> DataFrame:
    """The kept rows of ``df``, all columns, without their boilerplate lines;
    ``chars_col``, where the table has it, is set to the new length."""
    own_id, key, removed = apart(df, "_id", "_key", "_removed")
    kept = judge(df, id_col, text_col, host_col).filter("kept").select(
        F.col("doc_id").alias(own_id), F.col("text_key").alias(key), F.col("removed").alias(removed)).dropDuplicates([own_id, key])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own_id)) & (F.sha2(text, 256) == F.col(key))
    rows = df.join(kept, same)
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~has_word(x) | ~F.array_contains(F.col(removed), line_hash(x))), "\n")
    new = rows.withColumn(text_col, F.when(F.size(removed) > 0, rest).otherwise(text))
    if chars_col and chars_col in df.columns:
        new = new.withColumn(chars_col, F.char_length(F.col(f"`{text_col}`")).cast("long"))
    return new.select(*[F.col(f"`{c}`") for c in df.columns])
