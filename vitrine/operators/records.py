"""Record formatting for the catalog sink.

One ``select`` turns raw product rows into catalog schema B plus a
``reject_reason`` column; rejected rows are kept (never dropped silently) so
that the dead-letter sink and the run counters can see them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.price import normalize_price
from vitrine.functions.text import blank_to_null, tags_array
from vitrine.functions.urls import row_id

# Catalog schema B (the upsert whitelist) plus bookkeeping columns.
CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("product_url", T.StringType()),
    T.StructField("affiliate_url", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("additional_images", T.ArrayType(T.StringType())),
    T.StructField("brand", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("sale", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("second_hand", T.BooleanType()),
    T.StructField("country", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("other", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("image_embedding", T.ArrayType(T.FloatType())),
    T.StructField("info_embedding", T.ArrayType(T.FloatType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("last_seen_run", T.IntegerType()),
])
CATALOG_COLUMNS = [f.name for f in CATALOG_SCHEMA.fields]
# Columns the sink writes (F7 whitelist).
UPSERT_COLUMNS = [
    "id", "source", "product_url", "affiliate_url", "image_url", "brand", "title", "description",
    "category", "gender", "metadata", "size", "second_hand", "image_embedding", "info_embedding",
    "country", "tags", "other", "price", "sale", "additional_images",
]


def pad_columns(df: DataFrame, schema: T.StructType = CATALOG_SCHEMA) -> DataFrame:
    """F8: add every missing schema column as a typed null."""
    have = set(df.columns)
    for f in schema.fields:
        if f.name not in have:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def _present(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def reject_reason(df: DataFrame) -> Column:
    """First missing required field, else null."""
    def missing(c: str) -> Column:
        return F.coalesce(F.trim(_present(df, c).cast("string")), F.lit("")) == ""
    return (F.when(missing("title"), F.lit("no_title"))
            .when(missing("source"), F.lit("no_source"))
            .when(missing("product_url"), F.lit("no_product_url"))
            .when(missing("image_url"), F.lit("no_image_url")))


def format_products(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """F14 + F7: normalise a raw product frame to catalog schema B.

    ``price`` is X1-normalised and ``''`` when absent; ``sale`` is normalised or
    null; optional fields become null when blank; ``metadata`` defaults to the
    merchant/country JSON only when absent (Q3). Adds ``reject_reason``.
    """
    df = pad_columns(df, T.StructType(CATALOG_SCHEMA.fields + [
        T.StructField("merchant_name", T.StringType())]))
    add_imgs = df.schema["additional_images"].dataType
    additional = (F.col("additional_images") if isinstance(add_imgs, T.ArrayType)
                  else F.filter(F.transform(F.split("additional_images", r"\s*,\s*"), F.trim),
                                lambda s: s != ""))
    tags_t = df.schema["tags"].dataType
    tags = F.col("tags") if isinstance(tags_t, T.ArrayType) else tags_array(F.col("tags"))
    default_meta = F.to_json(F.struct(
        F.col("merchant_name").alias("merchant_name"), F.col("country").alias("country")))
    has_default = F.col("merchant_name").isNotNull() | F.col("country").isNotNull()
    out = df.select(
        row_id(F.col("source"), F.col("product_url")).alias("id"),
        "source", "product_url",
        blank_to_null(F.col("affiliate_url")).alias("affiliate_url"),
        "image_url",
        F.when(F.size(additional) > 0, additional).alias("additional_images"),
        "brand", "title",
        blank_to_null(F.col("description")).alias("description"),
        blank_to_null(F.col("category")).alias("category"),
        "gender",
        F.coalesce(normalize_price(F.col("price")), F.lit("")).alias("price"),
        normalize_price(F.col("sale")).alias("sale"),
        "size",
        F.coalesce(F.col("second_hand").cast("boolean"), F.lit(False)).alias("second_hand"),
        blank_to_null(F.col("country")).alias("country"),
        F.when(F.size(tags) > 0, tags).alias("tags"),
        blank_to_null(F.col("other")).alias("other"),
        F.coalesce(blank_to_null(F.col("metadata")), F.when(has_default, default_meta)).alias("metadata"),
        "image_embedding", "info_embedding", "created_at", "updated_at",
        F.col("last_seen_run").cast("int").alias("last_seen_run"),
        reject_reason(df).alias("reject_reason"),
        *keep,
    )
    return out


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNotNull())


def with_site_constants(df: DataFrame, sites: DataFrame) -> DataFrame:
    """source, merchant, brand, second_hand, country from the site spec,
    joined by site name; the spec is a small config table (broadcast)."""
    s = sites.select(
        F.col("site"), F.col("source").alias("_s_source"), F.col("merchant_name").alias("_s_merchant"),
        F.col("brand").alias("_s_brand"), F.col("second_hand").alias("_s_second_hand"),
        F.col("country").alias("_s_country"))
    from vitrine.sources.sites import bounded_broadcast

    j = df.join(bounded_broadcast(s), "site", "left")
    cols = {
        "source": F.coalesce(_present(j, "source"), F.col("_s_source")),
        "merchant_name": F.coalesce(_present(j, "merchant_name"), F.col("_s_merchant")),
        "brand": F.coalesce(_present(j, "brand"), F.col("_s_brand")),
        "second_hand": F.coalesce(_present(j, "second_hand").cast("boolean"), F.col("_s_second_hand"),
                                  F.lit(False)),
        "country": F.coalesce(_present(j, "country"), F.col("_s_country"), F.lit("eu")),
    }
    return j.withColumns(cols).drop("_s_source", "_s_merchant", "_s_brand", "_s_second_hand", "_s_country")
