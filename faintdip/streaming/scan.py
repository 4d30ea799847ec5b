"""The scan as a stream: new samples in, events of finished windows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import MAD_TO_SIGMA


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (star, ts, flux) from Parquet files of events, one file at a time."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.select(F.col("user_id").alias("star"), "ts", (1 - F.col("value") / 1000).alias("flux"))


def window_dips(samples: DataFrame, window: str = "5 days", late: str = "1 day", sigma: float = 4.0) -> DataFrame:
    """(star, start, end, n, depth, noise): windows whose least flux is sigma robust noises below their median.

    Samples later than `late` behind the newest are dropped; a window comes out once it can't change.
    """
    g = samples.withWatermark("ts", late).groupBy(F.window("ts", window), "star").agg(F.count("*").alias("n"), F.collect_list("flux").alias("f"))
    mid = lambda a: f"(element_at(array_sort({a}), int((size({a}) + 1) div 2)) + element_at(array_sort({a}), int(size({a}) div 2 + 1))) / 2"
    g = g.withColumn("base", F.expr(mid("f"))).withColumn("dev", F.expr("transform(f, x -> abs(x - base))"))
    g = g.withColumn("noise", MAD_TO_SIGMA * F.expr(mid("dev"))).withColumn("depth", F.col("base") - F.array_min("f"))
    return g.filter((F.col("noise") > 0) & (F.col("depth") >= sigma * F.col("noise"))).select("star", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "depth", "noise")


def scan_batches(samples: DataFrame, path: str, checkpoint: str, scan):
    """A running query that scans the stars of each batch with scan(DataFrame) and appends the events to path once.

    Batches are written under their number, so one that is run again replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return samples.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
