"""Sheets and labels for people: vetting sheets, annotations, names, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .consolidate import MANUAL
from .vetting import FLAGS

#: The order of a vetting sheet's columns; the rest is left out.
SHEET = (
    "star", "target_name", "sample_role", "event_id", "event_time", "depth_ppm", "local_snr", "final_candidate_score", "quality_score", "ml_score", "egress_ingress_ratio", "delta_chi2",
    "duration_hours", "fwhm_hours", "skewness", "kurtosis", "n_points_window", *FLAGS, "flag_external_catalog_match", "automated_vetting_status", "needs_manual_review", "external_false_positive_flag", "external_vetting_notes",
)


def with_manual_columns(events: DataFrame) -> DataFrame:
    """events with the columns that people fill in, empty where they are absent."""
    return events.withColumns({c: F.lit("") for c in MANUAL if c not in events.columns})


def vetting_sheet(events: DataFrame) -> DataFrame:
    """The sheet's columns that events have, the best score first."""
    order = [F.col(c).desc_nulls_last() for c in ("final_candidate_score", "local_snr") if c in events.columns] + [F.col(c) for c in ("star", "event_time") if c in events.columns]
    return with_manual_columns(events).select(*(c for c in (*SHEET, *MANUAL) if c in events.columns or c in MANUAL)).orderBy(*order)


def annotation(events: DataFrame) -> DataFrame:
    """events with annotation: depth, S/N and the names of the flags that are set, one a line."""
    flags = F.concat_ws(", ", *(F.when(F.col(f), f.removeprefix("flag_")) for f in FLAGS if f in events.columns))
    text = F.concat_ws("\n", F.format_string("depth %.0f ppm", "depth_ppm"), F.when(F.col("local_snr").isNotNull(), F.format_string("S/N %.1f", "local_snr")), F.when(flags != "", F.concat(F.lit("flags: "), flags)))
    return events.withColumn("annotation", text)


def attach_names(events: DataFrame, targets: DataFrame) -> DataFrame:
    """events with star_name from targets (star, name), else TIC and the number."""
    names = targets.filter("name is not null").groupBy("star").agg(F.min("name").alias("__name"))
    return events.join(names, "star", "left").withColumn("star_name", F.coalesce("__name", F.concat(F.lit("TIC "), F.col("star").cast("string")))).drop("__name")


def attach_positions(events: DataFrame, *catalogs: DataFrame) -> DataFrame:
    """events with ra and dec from catalogs (star, ra, dec): of two that know a star the later counts.

    Events that have a position already are left as they are.
    """
    if {"ra", "dec"} <= set(events.columns) and events.filter("ra is not null").limit(1).count():
        return events
    rows = [c.select("star", "ra", "dec", F.lit(i).alias("__i")) for i, c in enumerate(catalogs)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    best = every.filter("ra is not null and dec is not null").withColumn("__k", F.row_number().over(W.partitionBy("star").orderBy(F.desc("__i"), "ra", "dec"))).filter("__k = 1")
    return events.drop("ra", "dec").join(best.select("star", "ra", "dec"), "star", "left")
