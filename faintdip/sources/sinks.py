"""Writing tables, series caches and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A table with a header; arrays become comma-joined text."""
    cols = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_series(df: DataFrame, path: str) -> None:
    """Appends series to a cache with a folder for each star; a star's samples lie together."""
    df.repartition("star").sortWithinPartitions("star", "t").write.mode("append").partitionBy("star").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """One append for each batch: the log of attempts is never rewritten."""
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_gallery(events: DataFrame, metadata: DataFrame, path: str) -> None:
    """A folder for each star: its events as CSV under events/, its metadata under metadata/."""
    events.repartition("star").write.mode("overwrite").partitionBy("star").option("header", True).csv(f"{path}/events")
    metadata.write.mode("overwrite").partitionBy("star").text(f"{path}/metadata")
