"""Matched study: do labelled documents hold more of a pattern than like ones? Pairs each with a control and compares rates.

Targets are documents whose label is 1, controls those whose label is 0, matched one after the other on language,
length and number of words. Writes
  pairs/<language>   target, control, score, and how often each holds the pattern,
  rates/<language>   events and documents of both, rates with exact intervals, their ratio, Fisher's test, bootstrap.
A run replaces the languages that it works on, all or those of the setting only, and leaves the others; its result hangs
on the input alone, so running it again changes nothing.

    python -m jobs.matched_study --documents DIR --labels DIR --out DIR [--config FILE]
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintdip.lineage import cut
from faintdip.operators import matching, rates

from .common import command_line, config, written

log = logging.getLogger("matched_study")

WORD = r"[^\x20\x09-\x0D]+"


def measured(documents: DataFrame, pattern: str, within: str) -> DataFrame:
    """(id, group, n_chars, n_words, n_events) of each id; texts go no further than the scan. Of rows with one id the least count."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col(within), F.lit("unknown")).alias("group"), F.char_length(text).cast("long").alias("n_chars"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.regexp_count(text, F.lit(pattern)).cast("long").alias("n_events"),
    )
    return rows.filter("id is not null").groupBy("id").agg(F.min(F.struct("group", "n_chars", "n_words", "n_events")).alias("x")).select("id", "x.*")


def pairs_of(documents: DataFrame, settings: dict) -> DataFrame:
    """(group, target_id, control_id, match_rank, score, target_events, control_events) of measured documents with a role."""
    star = documents.select("id", "group", "role", (F.col("n_chars") / settings["chars_apart"]).alias("tmag"), F.col("n_words").cast("double").alias("parallax"))
    targets, pool = (star.filter(F.col("role") == r).drop("role") for r in (1, 0))
    # lengths are compared like magnitudes, numbers of words by their share, like parallaxes
    pairs = matching.matched(targets, pool, settings["ratio"], tmag=1.0, parallax=settings["words_share"], within=("group",))
    held = lambda side: documents.select(F.col("id").alias(f"{side}_id"), F.col("n_events").alias(f"{side}_events"), *(["group"] if side == "target" else []))
    return pairs.join(held("target"), "target_id").join(held("control"), "control_id").select("group", "target_id", "control_id", "match_rank", "score", "target_events", "control_events")


def rates_of(pairs: DataFrame, settings: dict) -> DataFrame:
    """One row for each group: events and documents by role, and what rates.rate_statistics says of them."""
    sums = pairs.groupBy("group").agg(
        F.sum("target_events").alias("target_candidates"), F.sum("control_events").alias("control_candidates"), F.lit(0).cast("long").alias("unknown_candidates"),
        F.count_distinct("target_id").cast("double").alias("target_exposure"), F.count("*").cast("double").alias("control_exposure"),
    )
    return rates.rate_statistics(sums, settings["replicates"], settings["confidence"])


def _emptied(rows: DataFrame, found: DataFrame, only: list[str], path: str) -> None:
    """Empties the partitions of chosen languages that have no pair any more; those with pairs are replaced as they are written."""
    for group in set(only) - {r["group"] for r in found.filter(F.col("group").isin(only)).select("group").distinct().collect()}:
        some = rows.sparkSession.createDataFrame([], rows.drop("group").schema)
        some.write.mode("overwrite").parquet(f"{path}/group={group}")


def run(spark: SparkSession, documents: str, labels: str, out: str, settings: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads the two tables, writes pairs and rates under out, and gives both as they then stand there."""
    settings = settings or config("matched_study")
    docs, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    log.info("read %s and %s", documents, labels)
    roles = marks.filter(F.col(settings["role"]).isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.max(settings["role"]).alias("role"))
    mine = measured(docs, settings["pattern"], settings["within"])
    if settings["only"]:
        mine = mine.filter(F.col("group").isin(settings["only"]))
    mine = cut(mine.join(roles, "id"))
    for row in mine.groupBy("role").count().collect():  # two rows
        log.info("%d %s", row["count"], "targets" if row["role"] else "controls")
    found = cut(pairs_of(mine, settings).select("target_id", "control_id", "match_rank", "score", "target_events", "control_events", "group"))
    tables = []
    for name, rows in (("pairs", found.repartition("group")), ("rates", rates_of(found, settings))):
        rows = rows.select(*(c for c in rows.columns if c != "group"), "group")
        if settings["only"]:
            _emptied(rows, found, settings["only"], f"{out}/{name}")
        tables.append(written(rows, f"{out}/{name}", log, "group", dynamic=bool(settings["only"])))
    return tables[0], tables[1]


if __name__ == "__main__":
    command_line("matched_study", __doc__.split("\n")[0], {"documents": "Parquet table of documents", "labels": "Parquet table of labels", "out": "tables to write"}, run)
