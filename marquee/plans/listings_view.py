"""Listings made of the driver's order tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The same rows for DuckDB, as the first common table expressions of a query.
LISTINGS_SQL = r"""WITH L0 AS (
  SELECT o_orderkey AS k, c_mktsegment AS seg, n_name, o_orderdate AS d, c_custkey, o_totalprice, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
L AS (
  SELECT CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'mt_' ELSE 'mtglobal_' END || CAST(k AS VARCHAR) AS id,
    k AS ord, CAST(k % 3 AS INTEGER) AS src,
    CASE WHEN k % 4 = 0 THEN '【' || seg || '】' ELSE '' END || seg || ' Live Tour ' || strftime(d, '%Y') || ' ' || n_name AS title,
    CASE WHEN k % 10 = 0 THEN '' ELSE 'http://img/' || CAST(k AS VARCHAR) END AS image,
    CASE k % 8 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y/%m/%d') WHEN 2 THEN 'TBD'
      WHEN 3 THEN strftime(d, '%Y.%m.%d') || ' 20:00' WHEN 4 THEN ' ' || strftime(d, '%Y.%m.%d')
      WHEN 5 THEN strftime(d, '%Y.%m.%d') || '-' || strftime(d, '%m') || '.28' ELSE strftime(d, '%Y.%m.%d') END AS date,
    CASE WHEN k % 11 = 0 THEN '' ELSE n_name END AS city,
    'Hall ' || CAST(c_custkey % 50 AS VARCHAR) AS venue,
    CASE WHEN k % 9 = 0 THEN '' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price,
    CASE WHEN k % 6 = 0 THEN '' ELSE o_orderstatus END AS status,
    o_orderpriority AS category,
    CASE WHEN k % 5 = 0 THEN '' WHEN k % 7 = 0 THEN 'Unknown' ELSE seg END AS artist,
    k % 13 = 0 AS is_tribute, CASE WHEN k % 3 = 0 THEN k % 2 = 0 END AS is_famous,
    1700000000000 + k * 1000 AS updated_at
  FROM L0)
"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    o = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, seg, day = F.col("o_orderkey"), F.col("c_mktsegment"), F.col("o_orderdate")
    fmt = lambda p: F.date_format(day, p)
    every = lambda n, hit, miss: F.when(k % n == 0, hit).otherwise(miss)
    kind = k % 8
    date = (
        F.when(kind == 0, fmt("yyyy-MM-dd"))
        .when(kind == 1, fmt("yyyy/MM/dd"))
        .when(kind == 2, "TBD")
        .when(kind == 3, F.concat(fmt("yyyy.MM.dd"), F.lit(" 20:00")))
        .when(kind == 4, F.concat(F.lit(" "), fmt("yyyy.MM.dd")))
        .when(kind == 5, F.concat(fmt("yyyy.MM.dd"), F.lit("-"), fmt("MM"), F.lit(".28")))
        .otherwise(fmt("yyyy.MM.dd"))
    )
    return o.select(
        F.concat(F.when(k % 3 == 0, "").when(k % 3 == 1, "mt_").otherwise("mtglobal_"), k.cast("string")).alias("id"),
        k.alias("ord"),
        (k % 3).cast("int").alias("src"),
        F.concat(every(4, F.concat(F.lit("【"), seg, F.lit("】")), F.lit("")), seg, F.lit(" Live Tour "), fmt("yyyy"), F.lit(" "), F.col("n_name")).alias("title"),
        every(10, F.lit(""), F.concat(F.lit("http://img/"), k.cast("string"))).alias("image"),
        date.alias("date"),
        every(11, F.lit(""), F.col("n_name")).alias("city"),
        F.concat(F.lit("Hall "), (F.col("c_custkey") % 50).cast("string")).alias("venue"),
        every(9, F.lit(""), F.floor("o_totalprice").cast("long").cast("string")).alias("price"),
        every(6, F.lit(""), F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("category"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, "Unknown").otherwise(seg).alias("artist"),
        (k % 13 == 0).alias("is_tribute"),
        F.when(k % 3 == 0, k % 2 == 0).alias("is_famous"),
        (F.lit(1_700_000_000_000) + k * 1000).alias("updated_at"),
    )
