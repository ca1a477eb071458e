"""Registered queries of the training-data operators: thin digests over the
operators' own outputs, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (bitplanes, bpe_tree, exact_dedup, language, licenses, main_text, ngram_join, packing, quality, simhash,
                         spelling, suffix_dedup, token_files)
from vitrine.llm.common import read_table, scratch_path


def op1_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(read_table(spark, sf_dir, "documents"))


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.deduplicate(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP4_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "n_removed_words")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return token_files.read_token_files(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_lyndon_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.cut_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe_tree.encode_documents(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    decoded = bpe_tree.decode_documents(encoded, path, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.cluster(read_table(spark, sf_dir, "embeddings"))[0]


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """The same rounds unrolled: a{i} assigns to the centroids c{i}."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k})
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, r, v, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS nth FROM (
      SELECT k.vec_id, k.r, k.v, c.c,
        CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
      FROM kept k CROSS JOIN c{i} c)) WHERE nth = 1
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c) m ON c.c = m.c
)""")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(read_table(spark, sf_dir, "documents"))


# crc32 bit by bit over the bytes of ``doc_id:run`` (256 marks a bit's step); near
# words share a word with one letter left out, at one place or in either of them
OP12_SQL = """
WITH runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'),
      lambda b: [CAST('0x' || b AS BIGINT), 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h
  FROM runs
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS MATERIALIZED (
  SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word)
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n,
    row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS nth FROM near
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form,
    CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.nth = 1
), walk AS (
  WITH RECURSIVE up(word, place, nxt) AS (
    SELECT word, word, form FROM forms
    UNION ALL SELECT up.word, f.word, f.form FROM up JOIN forms f ON up.nxt = f.word)
  SELECT word, place AS root FROM up WHERE nxt IS NULL
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON f.word = w.word
"""


def op13_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_partenum_join": op1_partenum_join,
    "op2_html_blocks": op2_html_blocks,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_frequency": op5_line_frequency,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_files": op7_token_files,
    "op8_lyndon_groups": op8_lyndon_groups,
    "op9_diagonal_voting": op9_diagonal_voting,
    "op10_bpe_tree": op10_bpe_tree,
    "op11_bit_planes": op11_bit_planes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_simhash_balls": op13_simhash_balls,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": OP4_SQL,
    "op11_bit_planes": _op11_sql(),
    "op12_spelling_variants": OP12_SQL,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
