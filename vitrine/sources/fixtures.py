"""Fixtures derived by Spark from the given tables (FIXTURES.md section 3).

Each builder is a DataFrame plan over ``part`` / ``orders`` / ``lineitem`` /
``pages``, so its size grows with the input. ``FIXTURE_SQL`` holds the same
rules for DuckDB, used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources.tables import read_table

SHOP = "https://shop.example.com"
CDN = "https://cdn.example.com/files/"


def _price_text(amount: Column) -> Column:
    return F.concat(amount.cast("decimal(18,2)").cast("string"), F.lit(" EUR"))


def _product_url(name: Column, key: Column) -> Column:
    return F.concat(F.lit(SHOP + "/products/"), F.regexp_replace(name, " ", "-"), F.lit("-"), key.cast("string"))


def _image_url(name: Column, key: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(CDN), F.regexp_replace(name, " ", "_"), F.lit("_"), key.cast("string"),
                    F.lit(suffix + ".jpg"))


def catalog_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored catalog snapshot: every part except ``p_partkey % 10 = 3``."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.where(k % 10 != 3).select(
        F.col("p_brand").alias("source"),
        _product_url(F.col("p_name"), k).alias("product_url"),
        _image_url(F.col("p_name"), k).alias("image_url"),
        F.col("p_name").alias("title"),
        F.lower("p_type").alias("category"),
        F.col("p_size").cast("string").alias("size"),
        _price_text(F.col("p_retailprice")).alias("price"),
        (k % 5).cast("int").alias("last_seen_run"),
    )


def catalog_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This run's scrape: parts except ``% 10 = 7``, with shifted price/image,
    missing titles and duplicated rows (``ord`` 1 and 2) for keep-first/last."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base = p.where(k % 10 != 7).select(
        F.col("p_brand").alias("source"),
        _product_url(F.col("p_name"), k).alias("product_url"),
        F.when(k % 4 == 0, _image_url(F.col("p_name"), k, "_v2"))
         .otherwise(_image_url(F.col("p_name"), k)).alias("image_url"),
        F.when(k % 97 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("title"),
        F.lower("p_type").alias("category"),
        F.col("p_size").cast("string").alias("size"),
        _price_text(F.when(k % 5 == 0, F.col("p_retailprice") + 5)
                    .otherwise(F.col("p_retailprice"))).alias("price"),
        F.lit(1).alias("ord"),
        k.alias("p_partkey"),
    )
    dup = (base.where(F.col("p_partkey") % 50 == 0)
           .withColumn("size", (F.col("size").cast("int") + 1).cast("string"))
           .withColumn("ord", F.lit(2)))
    return base.unionByName(dup).drop("p_partkey")


def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price strings in the shapes a shop shows, one per part (``% 8`` picks it)."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    amt = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    comma = F.regexp_replace(amt, r"\.", ",")
    czk = (F.col("p_retailprice") * 25).cast("decimal(18,0)").cast("string")
    s = (F.when(k % 8 == 0, F.concat(amt, F.lit(" EUR")))
         .when(k % 8 == 1, F.concat(comma, F.lit(" eur")))
         .when(k % 8 == 2, F.concat(amt, F.lit(" USD, "), czk, F.lit(" CZK, "), comma, F.lit(" PLN")))
         .when(k % 8 == 3, F.concat(amt, F.lit("EUR")))
         .when(k % 8 == 4, F.concat(amt, F.lit(" EUR")))
         .when(k % 8 == 5, F.lit("price on request"))
         .when(k % 8 == 6, F.lit("  "))
         .otherwise(F.concat(F.lit("1."), comma, F.lit(" EUR"))))
    return p.select(k.alias("p_partkey"), s.alias("s"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_partkey, run)``: run = months since 1995-01 of the order date."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    run = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("int")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", run.alias("run"))


def page_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, next_url)``: page ``i`` points at ``i + 1`` within its ten pages; the
    tenth points nowhere, or back to the first (tens ``% 7 = 3``: a cycle that
    nothing leads into) or to the sixth (tens ``% 7 = 5``: a cycle behind a chain)."""
    pg = read_table(spark, sf_dir, "pages").select("page_id", "url")
    i = F.col("page_id")
    tens = F.floor(i / 10) % 7
    nxt = F.when((i + 1) % 10 != 0, i + 1).when(tens == 3, i - 9).when(tens == 5, i - 4)
    to = pg.select(F.col("page_id").alias("next_id"), F.col("url").alias("next_url"))
    return pg.withColumn("next_id", nxt).join(to, "next_id", "left").select("page_id", "url", "next_url")


# DuckDB twins of the builders above, same rules.
FIXTURE_SQL = {
    "catalog_old": """
SELECT p_brand AS source,
       'https://shop.example.com/products/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS product_url,
       'https://cdn.example.com/files/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image_url,
       p_name AS title, lower(p_type) AS category, CAST(p_size AS VARCHAR) AS size,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) || ' EUR' AS price,
       CAST(p_partkey % 5 AS INTEGER) AS last_seen_run
FROM part WHERE p_partkey % 10 <> 3""",
    "catalog_new_base": """
SELECT p_brand AS source,
       'https://shop.example.com/products/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS product_url,
       CASE WHEN p_partkey % 4 = 0
            THEN 'https://cdn.example.com/files/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '_v2.jpg'
            ELSE 'https://cdn.example.com/files/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.jpg' END AS image_url,
       CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_name END AS title,
       lower(p_type) AS category, CAST(p_size AS VARCHAR) AS size,
       CAST(CAST(CASE WHEN p_partkey % 5 = 0 THEN p_retailprice + 5 ELSE p_retailprice END AS DECIMAL(18,2)) AS VARCHAR) || ' EUR' AS price,
       1 AS ord, p_partkey
FROM part WHERE p_partkey % 10 <> 7""",
    "catalog_new": """
SELECT source, product_url, image_url, title, category, size, price, ord FROM catalog_new_base
UNION ALL
SELECT source, product_url, image_url, title, category, CAST(CAST(size AS INTEGER) + 1 AS VARCHAR) AS size, price, 2 AS ord
FROM catalog_new_base WHERE p_partkey % 50 = 0""",
    "price_texts": """
SELECT p_partkey,
  CASE p_partkey % 8
    WHEN 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) || ' EUR'
    WHEN 1 THEN replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || ' eur'
    WHEN 2 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) || ' USD, '
                || CAST(CAST(p_retailprice * 25 AS DECIMAL(18,0)) AS VARCHAR) || ' CZK, '
                || replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || ' PLN'
    WHEN 3 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) || 'EUR'
    WHEN 4 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) || chr(160) || 'EUR'
    WHEN 5 THEN 'price on request'
    WHEN 6 THEN '  '
    ELSE '1.' || replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || ' EUR'
  END AS s
FROM part""",
    "sightings": """
SELECT l_partkey, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS run
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "page_chain": """
SELECT a.page_id, a.url, b.url AS next_url
FROM pages a LEFT JOIN pages b ON b.page_id = CASE WHEN (a.page_id + 1) % 10 <> 0 THEN a.page_id + 1
  WHEN (a.page_id // 10) % 7 = 3 THEN a.page_id - 9 WHEN (a.page_id // 10) % 7 = 5 THEN a.page_id - 4 END""",
}


def with_fixtures(*names: str) -> str:
    """A DuckDB ``WITH`` prefix defining the named fixtures (dependencies first)."""
    order = ["catalog_old", "catalog_new_base", "catalog_new", "price_texts", "sightings", "page_chain"]
    need = set(names)
    if "catalog_new" in need:
        need.add("catalog_new_base")
    ctes = [f"{n} AS ({FIXTURE_SQL[n]})" for n in order if n in need]
    return "WITH " + ",\n".join(ctes) + "\n"
