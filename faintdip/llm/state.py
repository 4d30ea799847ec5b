"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast.
SMALL = 32 << 20
#: Bits by which rows are chosen before they are shuffled, and those of one row of them; 4 MB in all, whatever the number of ids.
BITS, BITMAP = 1 << 25, 1 << 15


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir.

    Where that is not set, as in tests, a folder of this machine serves a local session; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and written to spark.checkpoint.dir."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written now as a Parquet table of the shared folder, of which later steps read the columns they use.

    The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the session's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def broadcast_if_small(df: DataFrame, size: Column, bound: int = SMALL) -> DataFrame:
    """df, to be broadcast if its rows, of size bytes each, are fewer than bound bytes in all. df should be cut: it is read for this."""
    return F.broadcast(df) if is_small(df, size, bound) else df


def is_small(df: DataFrame, size: Column, bound: int = SMALL) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) < bound


def having(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among those of ids, each once and with all columns.

    A bit for each hash of the ids, of which there are BITS, is broadcast, and rows without it go where they are read. Only the
    others are shuffled and joined, by the same plan at every size: the rows that are looked for, and of the rest the share of
    bits that are set.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(BITS))
    bits = ids.select(slot.alias("__slot")).groupBy(F.floor(F.col("__slot") / BITMAP).alias("__row")).agg(F.bitmap_construct_agg(F.col("__slot") % BITMAP).alias("__bits"))
    byte = F.expr(f"cast(conv(hex(substring(__bits, cast(pmod(xxhash64({key}), {BITMAP}) div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr(f"shiftleft(1, cast(pmod(xxhash64({key}), 8) as int))")
    some = rows.join(F.broadcast(bits), (F.floor(slot / BITMAP) == F.col("__row")) & (byte.bitwiseAND(bit) != 0), "left_semi")
    return some.join(ids.select(key).hint("merge"), key, "left_semi")
