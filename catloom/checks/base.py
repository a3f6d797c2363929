"""Registry of checked queries and the views they share.

A view is one SQL text over the given tables that both engines run, so a query and its reference
SQL start from the same rows. Views keep every row of their tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}
ROUNDED: dict[str, tuple[str, ...]] = {}


def define(name: str, inputs: str, sql: str, rounded: str = "") -> None:
    """``rounded``: columns of doubles that the text casts to integers. The reference rounds them, half to even; Spark's cast cuts."""
    VIEWS[name] = (sql, tuple(inputs.split()))
    ROUNDED[name] = tuple(rounded.split())


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf, name)
    sql, inputs = VIEWS[name]
    frames = {i: view(spark, sf, i) for i in inputs}
    rounded = lambda df: df.withColumns({c: F.rint(c) for c in ROUNDED[name] if c in df.columns})
    return spark.sql(sql, **{i: rounded(df) for i, df in frames.items()})


def _closure(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name in TABLES or name in seen:
            continue
        _closure(list(VIEWS[name][1]), seen)
        seen.append(name)
    return seen


def oracle(views: str, body: str) -> str:
    """The view texts as common table expressions in front of ``body``."""
    parts = []
    for name in _closure(views.split(), []):
        sql, inputs = VIEWS[name]
        parts.append(f"{name} AS ({sql.format(**{i: i for i in inputs})})")
    recursive = "RECURSIVE " if "/*recursive*/" in body else ""
    if not parts:
        return body
    joiner = ", ".join(parts)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {recursive}{joiner}, {body.lstrip()[5:]}"
    return f"WITH {recursive}{joiner} {body}"


def check(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``sql`` is its reference over the named views (none: rows only)."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(views, sql)
        return fn

    return register


# --- Views -----------------------------------------------------------------------------------

# Three overlapping sources of product records over the whole part table.
define("records", "part", """
SELECT CAST(p_partkey AS BIGINT) AS seq, 0 AS source_rank, 'registry' AS source, CAST(p_partkey AS STRING) AS source_id,
       p_name || ' ' || CAST(p_size AS STRING) AS name, p_brand AS brand,
       CASE WHEN p_size < 10 THEN 'Q' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) END AS external_id,
       CAST(NULL AS STRING) AS alt_id, CASE WHEN p_size > 15 THEN p_type END AS category,
       CASE WHEN p_size <> 7 THEN 1950 + p_size END AS year_from,
       CASE WHEN p_size > 25 THEN '' END AS fmt, CAST(NULL AS DOUBLE) AS price, CAST(p_partkey AS BIGINT) AS part_id
FROM {part}
UNION ALL
SELECT 1000000000000 + p_partkey, 1, 'market', CAST(NULL AS STRING),
       upper(p_name) || '  ' || CAST(p_size AS STRING), upper(p_brand), CAST(NULL AS STRING),
       'f' || CAST(p_partkey AS STRING), lower(p_type), CAST(NULL AS INT),
       CASE WHEN p_size > 10 THEN '35 mm' END, p_retailprice, CAST(p_partkey AS BIGINT)
FROM {part}
UNION ALL
SELECT 2000000000000 + p_partkey, 2, 'archive', 'a' || CAST(p_size AS STRING),
       p_name || ' ' || CAST(p_size AS STRING) || CASE WHEN p_size > 40 THEN 's' ELSE '' END, p_brand || ' Inc.',
       CASE WHEN p_size < 4 THEN 'Q' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) END,
       CAST(NULL AS STRING), 'SLR', 1951 + p_size, 'large format', p_retailprice + 1, CAST(p_partkey AS BIGINT)
FROM {part}
""")

define("aliases", "part", "SELECT DISTINCT lower(p_brand) AS alias, p_brand AS canonical FROM {part}")

# Records with their canonical brand and key.
define("keyed", "records", """
SELECT r.*, replace(r.brand, ' Inc.', '') AS short_brand,
       'Brand#' || substring(r.brand, 7, CASE WHEN r.source_rank = 2 THEN length(r.brand) - 11 ELSE 2 END) AS canonical,
       lower('Brand#' || substring(r.brand, 7, CASE WHEN r.source_rank = 2 THEN length(r.brand) - 11 ELSE 2 END))
       || '|' || lower(replace(r.name, '  ', ' ')) AS key
FROM {records} r
""")

# The merged catalog: one row per part, with country and region.
define("items", "part nation region", """
SELECT CAST(p_partkey AS BIGINT) AS item_id, p_name || ' ' || CAST(p_size AS STRING) AS name, p_brand AS brand,
       CASE WHEN p_size <> 7 THEN 1950 + p_size END AS year, CASE WHEN p_size > 20 THEN 1990 ELSE NULL END AS year_end,
       p_type AS category, CASE WHEN p_size < 17 THEN '135' WHEN p_size < 34 THEN '120' WHEN p_size < 40 THEN '4x5' END AS fmt,
       n_name AS country, r_name AS region, p_retailprice AS price, p_size AS size,
       CASE WHEN p_size > 40 THEN 'Q' || CAST(p_partkey AS STRING) END AS external_id,
       CASE WHEN p_size > 30 THEN 'The ' || p_name || ' was introduced in ' || CAST(1950 + p_size AS STRING) || '. It shoots ' || lower(p_type) || ' film.'
            WHEN p_size > 5 THEN lower(p_type) END AS description
FROM {part} LEFT JOIN {nation} ON n_nationkey = CAST(replace(p_brand, 'Brand#', '') AS INT)
     LEFT JOIN {region} ON r_regionkey = n_regionkey
""")

# One image per line item, in a total order within its item.
define("images", "lineitem", """
SELECT CAST(l_partkey AS BIGINT) AS item_id, (CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 1000000 + l_suppkey AS pos,
       'https://img' || CAST(l_suppkey AS STRING) || '.example.org/p/' || CAST(l_orderkey AS STRING) || '_a' || CAST(l_linenumber AS STRING) || '_m.jpg' AS url,
       CASE l_returnflag WHEN 'R' THEN 'flickr_scrape' WHEN 'A' THEN 'archive' ELSE 'shop' END AS source,
       CASE WHEN l_linestatus = 'F' THEN 'data/images/cameras/' || CAST(l_partkey AS STRING) || '/' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_suppkey AS STRING) || '.jpg' END AS local_path,
       CAST(l_extendedprice AS BIGINT) AS bytes, CAST(l_quantity AS INT) AS width, l_discount AS fraction,
       CAST(l_suppkey AS BIGINT) AS supplier_id
FROM {lineitem}
""", rounded="l_extendedprice l_quantity")

# Stored files: the ones of returned lines, and one unreferenced file per order.
define("inventory", "images orders", """
SELECT local_path AS path FROM {images} WHERE source = 'flickr_scrape' AND local_path IS NOT NULL
UNION ALL
SELECT 'data/images/cameras/_orphans/' || CAST(o_orderkey AS STRING) || '.jpg' AS path FROM {orders}
""")

# Marketplace listings.
define("listings", "lineitem part", """
SELECT CAST(l_partkey AS BIGINT) AS item_id, (CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 1000000 + l_suppkey AS pos,
       p_brand || ' ' || p_name || ' ' || CASE l_linestatus WHEN 'F' THEN CAST(p_size AS STRING) ELSE 'lot' END AS title,
       p_brand || ' ' || p_name || ' ' || CAST(p_size AS STRING) AS query, p_brand AS brand,
       l_extendedprice / l_quantity AS price,
       CASE l_returnflag WHEN 'R' THEN 'USD' WHEN 'A' THEN 'JPY' ELSE 'EUR' END AS currency,
       1990 + CAST(l_quantity AS INT) AS year, year(l_shipdate) AS ship_year
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
""")

# Stored texts as files: entity, group, provenance, digest, size.
define("blobs", "documents", """
SELECT doc_id, source AS grp, lang, md5(text) AS digest, n_chars, length(text) AS chars, text FROM {documents}
""")
