"""Nightly scan: takes the series files that have come since the last run, and scans the stars that they touch again.

A file stream reads what is new and keeps its place in a checkpoint; each batch is
  samples/batch=N/bucket=B   the new samples, dealt to buckets of stars,
  stars/batch=N              one row for each touched star, from all of its samples so far,
  dips/batch=N               its dips with features, flags and scores.
A star's rows of its latest batch are the ones that hold (current()). A batch that is run again after a failure writes the
same folders anew, so nothing is counted twice. Only the buckets of touched stars are read back. At the end of a run
review/priority=P has the stars with dips as they stand, for those who look at them.

    python -m jobs.nightly_scan --samples DIR --out DIR --state DIR [--config FILE]
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintdip.lineage import cut
from faintdip.functions.scores import final_score, quality_score
from faintdip.operators import consolidate, series, vetting

from .common import command_line, config, ready, written

log = logging.getLogger("nightly_scan")

SAMPLES = "star long, t double, flux double, batch long, bucket int"
STARS = "star long, n_samples long, baseline double, noise double, first_time double, last_time double, n_dips long, status string, batch long"
DIPS = (
    "star long, event_time double, depth_ppm double, local_snr double, n_points_window long, edge_event boolean, single_point_like boolean, skewness double, egress_ingress_ratio double, "
    "needs_manual_review boolean, automated_vetting_status string, quality_score double, final_candidate_score double, batch long"
)
REVIEW = ("star", "n_events", "n_pass", "max_score", "max_snr", "max_depth_ppm", "first_event_time", "last_event_time")
TABLES = {"samples": SAMPLES, "stars": STARS, "dips": DIPS}


def samples_of(rows: DataFrame, settings: dict) -> DataFrame:
    """(star, t, flux, bucket) of input rows; those without a star or a finite time and flux are left out."""
    named = rows.select(F.expr(settings["star"]).cast("long").alias("star"), F.expr(settings["time"]).alias("t"), F.expr(settings["flux"]).alias("flux"))
    return series.finite_samples(named).filter("star is not null").withColumn("bucket", F.pmod(F.xxhash64("star"), F.lit(settings["buckets"])).cast("int"))


def scan(lc: DataFrame, settings: dict) -> tuple[DataFrame, DataFrame]:
    """Stars and dips of series (star, t, flux). Stars with too few samples, or without noise, have no dips."""
    sigma, window = settings["sigma"], settings["window_days"]
    enough = series.noise(lc).withColumn("enough", (F.col("n") >= settings["least_samples"]) & (F.col("noise") > 0))
    low = series.local_minima(lc, sigma).select("star", F.col("t").alias("event")).join(enough.filter("enough").select("star"), "star", "left_semi")
    shape = series.half_depth_crossings(lc, low, window).select("star", "event", F.col("ratio").alias("egress_ingress_ratio"))
    found = series.window_features(lc, low, window).filter("n_points_window >= 3").join(shape, ["star", "event"], "left").withColumnRenamed("event", "event_time")
    flagged = vetting.vetting_flags(found)
    seen = [F.col(c) for c in ("local_snr", "egress_ingress_ratio")], [F.col(c) for c in ("edge_event", "single_point_like")]
    nothing = F.lit(None).cast("double")
    flagged = flagged.withColumn("quality_score", quality_score(*seen[0], nothing, *seen[1]))
    flagged = flagged.withColumn("final_candidate_score", final_score(nothing, F.col("quality_score"), F.col("local_snr"), *seen[1]))
    dips = cut(flagged.select(*(c.split()[0] for c in DIPS.split(", ")[:-1])))
    many = dips.groupBy("star").agg(F.count("*").alias("n_dips"))
    status = F.when(F.col("n") < settings["least_samples"], "too_few_samples").when(~F.col("enough"), "no_noise").when(F.col("n_dips") > 0, "dips").otherwise("quiet")
    stars = enough.join(many, "star", "left").withColumn("n_dips", F.coalesce("n_dips", F.lit(0)))
    return stars.select("star", F.col("n").alias("n_samples"), "baseline", "noise", F.col("first").alias("first_time"), F.col("last").alias("last_time"), "n_dips", status.alias("status")), dips


def take_batch(rows: DataFrame, number: int, out: str, settings: dict) -> None:
    """Keeps the samples of a batch and scans its stars anew; the same batch again gives the same folders."""
    spark = rows.sparkSession
    samples_of(rows, settings).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/samples/batch={number}")
    kept = spark.read.schema(SAMPLES).parquet(f"{out}/samples").filter(F.col("batch") <= number)
    new = kept.filter(F.col("batch") == number)
    touched = new.select("bucket", "star").distinct()
    buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most settings["buckets"]
    mine = kept.filter(F.col("bucket").isin(buckets)).join(touched, ["bucket", "star"], "left_semi")
    lc = cut(mine.groupBy("star", "t").agg(F.min("flux").alias("flux")))  # a sample that comes again counts once
    stars, dips = scan(lc, settings)
    stars.write.mode("overwrite").parquet(f"{out}/stars/batch={number}")
    dips.write.mode("overwrite").parquet(f"{out}/dips/batch={number}")
    count = lambda table: spark.read.schema(TABLES[table]).parquet(f"{out}/{table}").filter(F.col("batch") == number).count()
    log.info("batch %d: read %d samples in %d buckets, wrote %d stars and %d dips", number, new.count(), len(buckets), count("stars"), count("dips"))


def current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Stars and dips as they stand: each star's rows of its latest batch."""
    stars = spark.read.schema(STARS).parquet(f"{out}/stars")
    latest = stars.groupBy("star").agg(F.max("batch").alias("batch"))
    dips = spark.read.schema(DIPS).parquet(f"{out}/dips")
    return stars.join(latest, ["star", "batch"], "left_semi"), dips.join(latest, ["star", "batch"], "left_semi")


def run(spark: SparkSession, samples: str, out: str, state: str, settings: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Takes all files that samples (a folder or a pattern) has now and that no earlier run with this state took; gives current()."""
    settings = settings or config("nightly_scan")
    for name, schema in TABLES.items():
        plain = ", ".join(c for c in schema.split(", ") if c.split()[0] not in ("batch", "bucket"))
        ready(spark, f"{out}/{name}/batch=-1" + ("/bucket=0" if name == "samples" else ""), plain)
    schema = spark.read.parquet(samples).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_a_batch"]).parquet(samples)
    log.info("read new files of %s", samples)
    put = lambda rows, number: take_batch(rows, number, out, settings)
    stream = files.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    stream.awaitTermination()
    stars, dips = current(spark, out)
    summary = consolidate.star_summary(dips, settings["overtriggered"]).select(*REVIEW, F.col("recommended_review_priority").alias("priority"))
    written(summary.repartition("priority"), f"{out}/review", log, "priority")
    return stars, dips


if __name__ == "__main__":
    command_line("nightly_scan", __doc__.split("\n")[0], {"samples": "Parquet files of series", "out": "tables to write", "state": "checkpoint of the stream"}, run)
