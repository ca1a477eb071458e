"""Site specs (YAML or dict) as small DataFrames.

A spec holds constants (source, merchant, brand, second_hand, country), the
category pages to start from and the selectors. It becomes a ``sites`` frame
(one row per site, broadcast in joins: its size is the number of configured
sites) and a ``categories`` frame (J6: one row per site and category URL).
``field_map`` is never read by the pipelines, so it is ignored.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE_SCHEMA = ("site string, source string, mode string, base_url string, merchant_name string, brand string, "
               "second_hand boolean, country string, host string, selectors map<string,string>, "
               "categories array<struct<url:string,name:string>>")


def load_spec(path_or_dict) -> dict:
    if isinstance(path_or_dict, dict):
        return path_or_dict
    try:
        import yaml
    except ImportError as e:  # pragma: no cover - yaml ships with the image
        raise RuntimeError("reading a YAML site file needs PyYAML; pass a dict instead") from e
    with open(path_or_dict, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def sites_frame(spark: SparkSession, spec) -> DataFrame:
    spec = load_spec(spec)
    rows = []
    for name, s in spec.items():
        base = s.get("base_url", "")
        host = base.split("://", 1)[-1].split("/", 1)[0].lower()
        rows.append((name, s.get("source"), s.get("mode", "html"), base, s.get("merchant_name"), s.get("brand"),
                     bool(s.get("second_hand", False)), s.get("country", "eu"), host,
                     {k: str(v) for k, v in (s.get("selectors") or {}).items()},
                     [(c.get("url"), c.get("name", c.get("url"))) for c in s.get("categories", [])]))
    return spark.createDataFrame(rows, SITE_SCHEMA)


def categories_frame(sites: DataFrame) -> DataFrame:
    """Site x its category URLs."""
    return sites.select("site", F.explode("categories").alias("c")).select(
        "site", F.col("c.url").alias("category_url"), F.col("c.name").alias("category_name"))


# A spec with more sites than this is joined like any table (Spark decides).
MAX_BROADCAST_SITES = 10_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_SITES) -> DataFrame:
    """Broadcast a config-sized frame only after checking its size."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def pages_with_site(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Attach each page to its site spec by host (one row per site)."""
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return pages.withColumn("host", host).join(bounded_broadcast(sites.select("site", "host")), "host", "left")


DEFAULT_SPEC_PATH = os.path.join(os.path.dirname(__file__), "sites.yaml")
