"""Which stars to scan, what became of each, and what a run amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.detect import FEATURES, NAMES, scan_series
from ..operators.series import finite_samples


def scan_plan(pairs: DataFrame, limit_pairs: int | None = None, targets: bool = True, controls: bool = True) -> DataFrame:
    """(seq, star, sample_role, pair_id, star_name): each pair's target, then its control; a star stays where it first is.

    pairs has pair_id, target_id, target_name and control_id; null and zero ids are skipped.
    """
    if limit_pairs is not None:
        pairs = pairs.orderBy("pair_id").limit(limit_pairs)
    both = [F.struct(F.lit(0).alias("k"), F.col("target_id").alias("star"), F.lit("target").alias("sample_role"), F.col("target_name").alias("star_name"))] * targets
    both += [F.struct(F.lit(1).alias("k"), F.col("control_id").alias("star"), F.lit("control").alias("sample_role"), F.concat(F.lit("TIC "), F.col("control_id").cast("string")).alias("star_name"))] * controls
    rows = pairs.select("pair_id", F.explode(F.array(*both)).alias("x")).select("pair_id", "x.*").filter("star is not null and star <> 0")
    first = rows.withColumn("__k", F.row_number().over(W.partitionBy("star").orderBy("pair_id", "k"))).filter("__k = 1")
    return first.select((F.col("pair_id") * 2 + F.col("k")).alias("seq"), "star", "sample_role", "pair_id", "star_name")


def latest_status(status: DataFrame) -> DataFrame:
    """The last row of each star in a log of attempts."""
    return status.withColumn("__k", F.row_number().over(W.partitionBy("star").orderBy(F.desc_nulls_last("scan_timestamp"), F.desc("success")))).filter("__k = 1").drop("__k")


def still_to_do(plan: DataFrame, status: DataFrame) -> DataFrame:
    """The plan without stars that were ever scanned with success."""
    return plan.join(status.filter("success and star is not null").select("star").distinct(), "star", "left_anti")


def scan_stars(plan: DataFrame, lc: DataFrame, sigma: float = 4.0, window: float = 1.0, fits: bool = True, least: int = 10, detector=scan_series, failures: DataFrame | None = None) -> DataFrame:
    """One row for each event, and one for each star with its outcome in status; events have a null status.

    Outcomes: download_failed:error for stars of failures (star, error), missing_columns for all where lc lacks t or
    flux, no_data, too_few_points:n, no_candidates, ok:n, detector_failed:class. What the detector raised is in error,
    as class: message.
    """
    import pandas as pd

    complete = {"t", "flux"} <= set(lc.columns)
    if not complete:
        lc = lc.select("star", *(F.lit(None).cast("double").alias(c) for c in ("t", "flux")))
    if failures is None:
        plan = plan.select("star", F.lit(None).cast("string").alias("error"))
    else:
        plan = plan.select("star").join(failures.groupBy("star").agg(F.min(F.coalesce("error", F.lit(""))).alias("error")), "star", "left")

    def one(key, mine, series):
        if not len(mine):
            return pd.DataFrame(columns=["star", "status", "error", *NAMES])
        t, f, events, error = series.t.to_numpy(), series.flux.to_numpy(), None, None
        if mine.error.notna().any():
            status = f"download_failed:{mine.error.dropna().iloc[0]}"
        elif not complete:
            status = "missing_columns"
        elif not len(t):
            status = "no_data"
        elif len(t) < least:
            status = f"too_few_points:{len(t)}"
        else:
            try:
                events = detector(t, f, sigma, window, fits)
                status = f"ok:{len(events)}" if len(events) else "no_candidates"
            except Exception as e:  # one bad series must not end a survey
                status, error = f"detector_failed:{type(e).__name__}", f"{type(e).__name__}: {e}"
        rows = [pd.DataFrame({"status": [status], "error": [error]})] + ([events] if events is not None and len(events) else [])
        return (pd.concat(rows) if len(rows) > 1 else rows[0]).assign(star=key[0]).reindex(columns=["star", "status", "error", *NAMES])

    samples = finite_samples(lc).select("star", "t", "flux")
    return plan.groupBy("star").cogroup(samples.groupBy("star")).applyInPandas(one, f"star long, status string, error string, {FEATURES}")


def status_rows(outcomes: DataFrame, plan: DataFrame, at) -> DataFrame:
    """The log rows of a scan: (star, sample_role, pair_id, star_name, attempted, success, failure_reason, n_candidates, scan_timestamp)."""
    s = outcomes.filter("status is not null").select("star", "status")
    ok = F.col("status").startswith("ok:") | (F.col("status") == "no_candidates")
    n = F.coalesce(F.split_part("status", F.lit(":"), F.lit(2)).try_cast("long"), F.lit(0))
    return plan.join(s, "star").select("star", "sample_role", "pair_id", "star_name", F.lit(True).alias("attempted"), ok.alias("success"), F.when(~ok, F.col("status")).alias("failure_reason"), F.when(ok, n).otherwise(0).alias("n_candidates"), at.alias("scan_timestamp"))


def run_summary(status: DataFrame) -> DataFrame:
    """One row: scanned and failed stars by role, and their candidates."""
    target, control, ok = F.col("sample_role") == "target", F.col("sample_role") == "control", F.col("success")
    some = lambda c, r: F.coalesce(F.sum(F.when(r, c)), F.lit(0))
    return status.agg(
        F.count_if(target & ok).alias("targets_scanned"), F.count_if(control & ok).alias("controls_scanned"), F.count_if(target & ~ok).alias("targets_failed"), F.count_if(control & ~ok).alias("controls_failed"),
        some(F.col("n_candidates"), target).alias("target_candidates"), some(F.col("n_candidates"), control).alias("control_candidates"),
    )


def scan_metadata(status: DataFrame) -> DataFrame:
    """(sample_role, n_scanned, stars): sorted ids of the stars scanned with success, for the JSON sink."""
    return status.filter("success").groupBy("sample_role").agg(F.count_distinct("star").alias("n_scanned"), F.array_sort(F.collect_set("star")).alias("stars"))
