"""Cutting lineage in the folder that the cluster shares, and sums over a whole order of rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and written to spark.checkpoint.dir.

    Where that is not set, as in tests, a folder of this machine serves a local session; on a cluster that is an error.
    """
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def running(df: DataFrame, order: list[Column], parts: int | None = None, **sums: Column) -> DataFrame:
    """df with each sum from the first row through this one, in an order that leaves no ties open.

    Rows are dealt out by ranges of the order, summed within each, and ranges are put behind one
    another by their totals, so no task sees all rows. parts is the number of ranges, by default the session's.
    """
    placed = cut((df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)).withColumns({"__range": F.spark_partition_id(), **{f"__{n}": c for n, c in sums.items()}}))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    totals = placed.groupBy("__range").agg(*(F.sum(f"__{n}").alias(n) for n in sums)).select("__range", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in sums))
    here = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = (placed.repartition(parts, "__range") if parts else placed).join(F.broadcast(totals), "__range")
    return out.select(*df.columns, *((F.col(f"__before_{n}") + F.sum(f"__{n}").over(here)).alias(n) for n in sums))
