"""The driver's tables seen as series, stars and catalogs, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Common table expressions that DuckDB puts before a query; Spark's twins are below.
SQL = {
    "lc": "SELECT user_id AS star, epoch_us(ts) / 86400e6 AS t, 1 - value / 1000e0 AS flux, event_type = 'error' AS quality FROM events",
    "stars": "SELECT c_custkey AS id, c_name AS name, c_acctbal / 1000e0 AS tmag, (c_custkey * 137.508::DOUBLE) % 360 AS ra, (c_custkey * 53.13::DOUBLE) % 160 - 80 AS dec FROM customer",
    "pool": "SELECT s_suppkey AS id, s_name AS name, s_acctbal / 1000e0 AS tmag, (s_suppkey * 137.508::DOUBLE) % 360 AS ra, (s_suppkey * 53.13::DOUBLE) % 160 - 80 AS dec, s_suppkey % 5 <> 0 AS has_data, s_suppkey % 7 = 0 AS excess FROM supplier",
    "injections": "SELECT l_orderkey * 10 + l_linenumber AS trial, l_extendedprice::DOUBLE AS depth_ppm, l_quantity::DOUBLE AS egress_hours, l_returnflag <> 'N' AS recovered FROM lineitem",
}
SPARK = {
    "lc": ("events", "user_id as star, unix_micros(cast(ts as timestamp)) / 86400e6D as t, 1 - value / 1000D as flux, event_type = 'error' as quality"),
    "stars": ("customer", "c_custkey as id, c_name as name, c_acctbal / 1000D as tmag, (c_custkey * 137.508D) % 360 as ra, (c_custkey * 53.13D) % 160 - 80 as dec"),
    "pool": ("supplier", "s_suppkey as id, s_name as name, s_acctbal / 1000D as tmag, (s_suppkey * 137.508D) % 360 as ra, (s_suppkey * 53.13D) % 160 - 80 as dec, s_suppkey % 5 <> 0 as has_data, s_suppkey % 7 = 0 as excess"),
    "injections": ("lineitem", "l_orderkey * 10 + l_linenumber as trial, cast(l_extendedprice as double) as depth_ppm, cast(l_quantity as double) as egress_hours, l_returnflag <> 'N' as recovered"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, cols = SPARK[name]
    frame = table(spark, sf_dir, source)
    return spark.sql(f"SELECT {cols} FROM {{frame}}", frame=frame)
