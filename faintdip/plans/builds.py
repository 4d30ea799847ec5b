"""Runs that put catalogs, controls and single stars together from what is at hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..columns import pick
from ..functions.coords import clean_id
from ..operators import catalogs, detect, matching, series
from ..sources import sinks


def looks_like_pairs(df: DataFrame) -> bool:
    """Whether a table is one of matched pairs, by its columns."""
    return {"target_id", "control_id", "match_quality_score"} <= set(df.columns)


def has_coordinates(df: DataFrame) -> bool:
    """Whether a table has columns of right ascension and declination, under any of their names."""
    return all(pick(df, catalogs.ALIASES[k]) for k in ("ra", "dec"))


def stars_to_scan(pairs: DataFrame | None = None, targets: DataFrame | None = None, controls: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """(star, sample_role): the targets and controls of the pairs, or, where these give no star, of both catalogs; each star once.

    Pairs have target_id and control_id, catalogs tic_id; ids that are no numbers are skipped. With only ("target" or
    "control") that catalog alone is read. A star that is both is a target.
    """
    if only not in (None, "target", "control"):
        raise ValueError("only must be target, control or None")

    def ids(df: DataFrame | None, column: str, role: str) -> list[DataFrame]:
        if df is None or column not in df.columns:
            return []
        return [df.select(clean_id(F.col(column).cast("string")).alias("star"), F.lit(role).alias("sample_role")).filter("star is not null")]

    of_pairs = [] if only else ids(pairs, "target_id", "target") + ids(pairs, "control_id", "control")
    rows = reduce(DataFrame.unionByName, of_pairs) if of_pairs else None
    if rows is None or rows.isEmpty():
        catalog = (ids(targets, "tic_id", "target") if only != "control" else []) + (ids(controls, "tic_id", "control") if only != "target" else [])
        if not catalog:
            raise ValueError("neither pairs nor catalogs have ids")
        rows = reduce(DataFrame.unionByName, catalog)
    return rows.groupBy("star").agg(F.max("sample_role").alias("sample_role"))  # "target" is the greater word


def control_build(targets: DataFrame, pool: DataFrame | None, folder: str | None = None, *, ratio: int = 1, dry_run: bool = False) -> dict[str, DataFrame]:
    """The normalised control pool, the controls chosen and their pairs; all three are written as CSV under folder.

    targets have id and photometry, pool is a raw table. Without a pool, or where nothing matches, the dictionary is empty and nothing is written;
    a dry run, and one without a folder, writes nothing.
    """
    if ratio < 1:
        raise ValueError("ratio must be at least 1")
    if pool is None:
        return {}
    clean = catalogs.normalize_pool(pool)
    usable = matching.usable(clean.withColumnRenamed("tic_id", "id"))
    pairs = matching.matched(matching.eligible(targets), usable, ratio)
    if pairs.isEmpty():
        return {}
    chosen = clean.join(pairs.select(F.col("control_id").alias("tic_id")).distinct(), "tic_id", "left_semi")
    out = {"control_pool": clean, "control_sample": chosen, "matched_pairs": pairs}
    if folder and not dry_run:
        for name, table in out.items():
            sinks.write_csv(table, f"{folder}/{name}")
    return out


def counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table, as a dry run reports them."""
    return {name: table.count() for name, table in tables.items()}


def strongest(events: DataFrame) -> DataFrame:
    """The deepest event of each star, the earlier of equal ones."""
    best = W.partitionBy("star").orderBy(F.desc_nulls_last("depth"), "event_time")
    return events.withColumn("__k", F.row_number().over(best)).filter("__k = 1").drop("__k")


def control_run(products: DataFrame, sigma: float = 4.0, min_distance: int = 5, window: float = 0.5) -> dict[str, DataFrame]:
    """The first detector over stitched and cleaned products (star, product, t, flux): samples, events, and each star's strongest with its window."""
    samples = series.clean_normalize(series.stitch(products))
    events = detect.asymmetry_scores(detect.first_scan(samples, sigma, min_distance, window), samples, window)
    best = strongest(events)
    zoom = series.window_samples(samples, best.select("star", F.col("event_time").alias("event")), window)
    return {"samples": samples, "events": events, "strongest": best, "zoom": zoom}
