"""The tables behind overview charts: flag counts, score points, histograms by priority, and examples of injections."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import finite
from .series import window_samples
from .vetting import FLAGS


def _set(df: DataFrame):
    """Each vetting flag that df has, as a boolean that is never null."""
    return {n: F.coalesce(F.col(n).cast("boolean"), F.lit(False)) for n in FLAGS if n in df.columns}


def with_flag_count(vetted: DataFrame) -> DataFrame:
    """vetted with n_flags, how many of its flags are set; absent flags and null ones are not."""
    flags = _set(vetted).values()
    return vetted.withColumn("n_flags", reduce(add, (f.cast("int") for f in flags)) if flags else F.lit(0))


def flag_totals(vetted: DataFrame) -> DataFrame:
    """(flag, n): events with each flag that the table has, and with any of them."""
    flags = _set(vetted)
    flags["any"] = reduce(or_, flags.values()) if flags else F.lit(False)
    row = vetted.agg(*(F.count_if(c).alias(n) for n, c in flags.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in flags))))


def score_points(events: DataFrame, score: str = "final_candidate_score") -> DataFrame:
    """(label, local_snr, score, status): a point for each event that has both numbers, labelled by name, else by star."""
    star = F.col("star").cast("string")
    label = F.coalesce("target_name", star) if "target_name" in events.columns else star
    status = F.col("automated_vetting_status") if "automated_vetting_status" in events.columns else F.lit(None).cast("string")
    points = events.select(label.alias("label"), finite(F.col("local_snr").cast("double")).alias("local_snr"), finite(F.col(score).cast("double")).alias("score"), status.alias("status"))
    return points.filter("local_snr is not null and score is not null")


def score_histogram_by_priority(stars: DataFrame, bins: int = 10) -> DataFrame:
    """(recommended_review_priority, bin, n) of a star summary's max_score: each priority has equal bins between its own least and greatest score.

    Where these are equal, the bins are around them, half a unit to each side; the last bin is closed on the right.
    """
    x = stars.select("recommended_review_priority", finite(F.col("max_score").cast("double")).alias("x")).filter("x is not null")
    ends = x.groupBy("recommended_review_priority").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    x = x.join(ends, "recommended_review_priority")
    low, high = F.when(F.col("low") < F.col("high"), F.col("low")).otherwise(F.col("low") - 0.5), F.when(F.col("low") < F.col("high"), F.col("high")).otherwise(F.col("high") + 0.5)
    at = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return x.groupBy("recommended_review_priority", at.alias("bin")).agg(F.count("*").alias("n"))


def examples(recovery: DataFrame, n: int = 3, *order: str) -> DataFrame:
    """The first n recovered and the first n missed injections by order; without `recovered` all are missed. A null counts as missed."""
    if n < 0:
        raise ValueError("n must not be negative")
    got = F.coalesce(F.col("recovered").cast("boolean"), F.lit(False)) if "recovered" in recovery.columns else F.lit(False)
    recovery, order = recovery.withColumn("recovered", got), list(order or ("star", "trial"))
    # two sorted limits: no task sees a whole class
    return recovery.filter("recovered").orderBy(*order).limit(n).unionByName(recovery.filter("not recovered").orderBy(*order).limit(n))


def example_windows(lc: DataFrame, recovery: DataFrame, n: int = 3, window: float = 1.5) -> DataFrame:
    """(star, trial, recovered, at, depth_ppm, t, flux): samples around the injections of examples(); those without a finite time have none."""
    some = examples(recovery, n).select("star", "trial", "recovered", finite(F.col("at").cast("double")).alias("at"), "depth_ppm").filter("at is not null")
    around = window_samples(lc, some.select("star", F.col("at").alias("event")).distinct(), window)
    return some.join(around.select("star", F.col("event").alias("at"), "t", "flux"), ["star", "at"]).select("star", "trial", "recovered", "at", "depth_ppm", "t", "flux")


def recovery_rate(recovery: DataFrame) -> DataFrame:
    """One row (n, recovered, fraction): all injections; the fraction is null without any."""
    return recovery.agg(F.count("*").alias("n"), F.count_if("recovered").alias("recovered"), F.avg(F.coalesce(F.col("recovered"), F.lit(False)).cast("int")).alias("fraction"))
