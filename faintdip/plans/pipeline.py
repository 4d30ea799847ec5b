"""The whole run: scan, rank, vet, check, consolidate, review, rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import final_score, quality_score
from ..lineage import cut
from ..operators import consolidate, ranking, rates, vetting
from . import scans


@dataclass
class Run:
    """What a run gives; all but events and status are lazy."""

    events: DataFrame
    status: DataFrame
    stars: DataFrame
    overtriggered: DataFrame
    review: DataFrame
    inspection: DataFrame
    statistics: DataFrame
    summary: DataFrame


def run(lc: DataFrame, pairs: DataFrame, *, status: DataFrame | None = None, model=None, catalogs: dict[str, DataFrame] | None = None, positions: DataFrame | None = None, sigma: float = 4.0, window: float = 1.0, many: int = 5, fits: bool = True) -> Run:
    """Scans the stars of pairs that status lacks, and turns events into review lists and rates.

    catalogs may have eb, vsx and simbad snapshots, with positions of stars; without them, and without
    a model, those phases are skipped: scores then count 0.5 and no star has an external match.
    """
    plan = scans.scan_plan(pairs)
    todo = scans.still_to_do(plan, status) if status is not None else plan
    outcomes = cut(scans.scan_stars(todo, lc, sigma, window, fits))
    log = scans.status_rows(outcomes, todo, F.current_timestamp())
    log = cut(log if status is None else status.unionByName(log, allowMissingColumns=True))
    order = W.partitionBy("star").orderBy("event_time")
    events = outcomes.filter("status is null").drop("status").join(plan.select("star", "sample_role", "pair_id", F.col("star_name").alias("target_name")), "star")
    events = events.withColumn("event_id", F.concat_ws("-", "star", F.row_number().over(order).cast("string")))
    if model is not None:
        scores = ranking.score(model, ranking.impute(ranking.candidate_features(events))).select("event_id", "ml_score")
        events = events.join(scores, "event_id", "left")
    else:
        events = events.withColumn("ml_score", F.lit(None).cast("double"))
    c = F.col
    events = events.withColumn("quality_score", quality_score(c("local_snr"), c("egress_ingress_ratio"), c("delta_chi2"), c("edge_event"), c("single_point_like")))
    events = events.withColumn("final_candidate_score", final_score(c("ml_score"), c("quality_score"), c("local_snr"), c("edge_event"), c("single_point_like")))
    events = vetting.vetting_flags(events)
    if catalogs and positions is not None:
        events = vetting.check_external(events, positions, catalogs["eb"], catalogs["vsx"], catalogs["simbad"])
    events = cut(events)
    stars, busy = consolidate.star_summary(events, many), consolidate.overtriggered(events, many)
    scanned = scans.latest_status(log).filter("success").select("star", "sample_role")
    yields = rates.yield_by_role(events, pairs, scanned).withColumn("subset", F.lit("all"))
    passed = rates.yield_by_role(consolidate.pass_candidates(events), pairs, scanned).withColumn("subset", F.lit("pass"))
    return Run(events, log, stars, busy, consolidate.review_priority(events, 3, many), consolidate.inspection_list(events, stars, busy), rates.rate_statistics(yields.unionByName(passed)), scans.run_summary(scans.latest_status(log)))
