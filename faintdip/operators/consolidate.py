"""From events to stars and review lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import LOW, star_priority
from .vetting import CONCERNS

VERSION = "stars_v1"
#: The order of events that stands for "first in input".
ORDER = ("event_time", "event_id")


def _present(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def _ranked(df: DataFrame, sort_by: str = "final_candidate_score") -> list[Column]:
    sort = [c.desc_nulls_last() for c in _present(df, *dict.fromkeys((sort_by, "local_snr")))]
    return sort + [c.asc_nulls_last() for c in _present(df, *ORDER)]


def star_summary(events: DataFrame, many: int = 5) -> DataFrame:
    """One row a star: counts, extremes, concerns and review priority. Null stars are left out."""
    has = set(events.columns)
    col = lambda n, kind: F.col(n) if n in has else F.lit(None).cast(kind)
    first = lambda n: F.min_by(col(n, "string"), F.struct(*(_present(events, *ORDER) or [F.lit(0)])))
    concern = F.coalesce(F.bool_or(F.coalesce(col("external_false_positive_flag", "string").isin(*CONCERNS), F.lit(False))), F.lit(False))
    g = events.filter("star is not null").groupBy("star").agg(
        F.coalesce(first("target_name"), F.concat(F.lit("TIC "), F.col("star").cast("string"))).alias("target_name"),
        F.coalesce(first("sample_role"), F.lit("unknown")).alias("sample_role"),
        F.count("*").alias("n_events"),
        F.count_if(col("automated_vetting_status", "string") == "pass").alias("n_pass"),
        F.count_if(col("flag_external_catalog_match", "boolean")).alias("n_external_flags"),
        F.max(col("final_candidate_score", "double")).alias("max_score"),
        F.max(col("local_snr", "double")).alias("max_snr"),
        F.median(col("local_snr", "double")).alias("median_snr"),
        F.max(col("depth_ppm", "double")).alias("max_depth_ppm"),
        F.min(col("event_time", "double")).alias("first_event_time"),
        F.max(col("event_time", "double")).alias("last_event_time"),
        concern.alias("has_known_variable_match"),
        F.coalesce(F.bool_or(col("eb_status", "string") == "matched"), F.lit(False)).alias("has_eb_match"),
    )
    c = F.col
    priority = star_priority(c("n_events"), c("n_pass"), c("has_known_variable_match"), c("has_eb_match"), c("max_score"), c("max_snr"), c("n_external_flags"), many=many)
    return g.withColumns({"recommended_review_priority": priority, "consolidation_version": F.lit(VERSION)})


def overtriggered(events: DataFrame, many: int = 5) -> DataFrame:
    """(star, sample_role, target_name, n_events) of stars with many events."""
    key = F.struct(*_present(events, *ORDER))
    g = events.filter("star is not null").groupBy("star").agg(F.min_by("sample_role", key).alias("sample_role"), F.min_by("target_name", key).alias("target_name"), F.count("*").alias("n_events"))
    return g.filter(F.col("n_events") >= many)


def top_event(events: DataFrame, sort_by: str = "final_candidate_score", strict_row: bool = False) -> DataFrame:
    """The best event of each star; each column is its first non-null value in that order, or with
    strict_row that of the best row."""
    events = events.filter("star is not null")
    if strict_row:
        return events.withColumn("__k", F.row_number().over(W.partitionBy("star").orderBy(*_ranked(events, sort_by)))).filter("__k = 1").drop("__k")
    w = W.partitionBy("star").orderBy(*_ranked(events, sort_by))
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cols = [F.first(c, ignorenulls=True).over(whole).alias(c) if c != "star" else F.col(c) for c in events.columns]
    return events.select(*cols, F.row_number().over(w).alias("__k")).filter("__k = 1").drop("__k")


def review_priority(events: DataFrame, most: int = 3, many: int = 5) -> DataFrame:
    """The best few events of each star with the star's priority."""
    top = events.withColumn("__k", F.row_number().over(W.partitionBy("star").orderBy(*_ranked(events)))).filter(F.col("__k") <= most).drop("__k")
    stars = star_summary(events, many).select("star", "recommended_review_priority")
    return top.join(stars, "star", "left").withColumns({"recommended_review_priority": F.coalesce("recommended_review_priority", F.lit(LOW)), "consolidation_version": F.lit(VERSION)})


def pass_candidates(events: DataFrame) -> DataFrame:
    return events.filter("automated_vetting_status = 'pass'")


def attach_new(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """left with right's further columns by key: the first right row by order, no column overwritten."""
    new = [c for c in right.columns if c not in left.columns]
    first = right.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("__k = 1")
    return left.join(first.select(key, *new), key, "left")


def inspection_list(events: DataFrame, stars: DataFrame, overtriggered_stars: DataFrame, most: int = 5, top_stars: int = 5) -> DataFrame:
    """Events that a person should look at, each once, with all its reasons and a sort category.

    Reasons: a medium-priority star's best events, passes, the best events of the most overtriggered
    stars, and every target star's best event.
    """
    e = events.withColumns({"__rank": F.row_number().over(W.partitionBy("star").orderBy(*_ranked(events))), "event_key": F.round("event_time", 6)})
    medium = stars.filter("recommended_review_priority = 'medium'").select("star", F.lit(True).alias("__medium"))
    worst = overtriggered_stars.orderBy(F.desc("n_events"), "star").limit(top_stars).select("star", F.lit(True).alias("__many"))
    e = e.join(medium, "star", "left").join(worst, "star", "left")
    reason = F.array_compact(F.array(
        F.when(F.col("__medium") & (F.col("__rank") <= most), "medium_priority"), F.when(F.col("automated_vetting_status") == "pass", "pass_vetting"),
        F.when(F.col("__many") & (F.col("__rank") <= most), "overtriggered_top5"), F.when((F.col("sample_role") == "target") & (F.col("__rank") == 1), "target_top_event"),
    ))
    e = e.withColumn("reasons", reason).filter(F.size("reasons") > 0)
    keys = ["star", "event_key"]
    kept = e.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.min("__rank").alias("__rank"))
    out = e.drop("reasons", "__medium", "__many").join(kept, [*keys, "__rank"])
    text = F.array_join("reasons", ",")
    category = reduce(lambda c, x: c.when(F.array_contains("reasons", x[0]), x[1]), [("medium_priority", 1), ("overtriggered_top5", 2)], F.when(F.array_contains("reasons", "pass_vetting"), 0)).otherwise(3)
    return out.withColumns({"inspection_reason": text, "sort_category": category}).drop("reasons", "__rank", "event_key")


#: Empty columns for people to fill in.
MANUAL = ("manual_disposition", "manual_reason", "reviewer", "review_date", "centroid_check", "neighbour_check", "follow_up")


def disposition_template(inspection: DataFrame, copied: tuple[str, ...]) -> DataFrame:
    return inspection.select(*(F.col(c) for c in copied if c in inspection.columns), *(F.lit("").alias(c) for c in MANUAL))


def gallery_metadata(inspection: DataFrame) -> DataFrame:
    """(star, metadata): a JSON object for each star: names, reasons, counts and the best score."""
    key = F.struct(*_present(inspection, *ORDER))
    g = inspection.groupBy("star").agg(
        F.min_by("target_name", key).alias("target_name"), F.min_by("sample_role", key).alias("sample_role"), F.count("*").alias("n_events"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("inspection_reason", ","))))).alias("reasons"),
        F.count_if(F.col("automated_vetting_status") == "pass").alias("n_pass"), F.max("final_candidate_score").alias("max_score"),
    )
    return g.select("star", F.to_json(F.struct("star", "target_name", "sample_role", "n_events", "reasons", "n_pass", "max_score")).alias("metadata"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by..., bin, n): equal bins, the last one closed on the right; values outside are left out."""
    x = F.col(column)
    b = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
    return df.filter(x.between(low, high)).groupBy(*by, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
