"""The jobs as queries: each is run twice into a folder of its own, and its whole output read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintdip.lineage import shared
from faintdip.plans.views import SQL
from faintdip.queries import with_parts

from . import matched_study, nightly_scan


def job1_nightly_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every star as it stands after two runs, with its dips; stars without dips have one row."""
    folder = f"{shared(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        stars, dips = nightly_scan.run(spark, f"{sf_dir}/events*.parquet", f"{folder}/out", f"{folder}/state")
    review = spark.read.parquet(f"{folder}/out/review").select("star", "priority")
    rows = stars.select("star", "n_samples", "noise", "n_dips", "status").join(review, "star", "left").join(dips.drop("batch", "skewness", "egress_ingress_ratio", "quality_score"), "star", "left")
    rounds = {"noise": 9, "event_time": 6, "depth_ppm": 3, "local_snr": 6, "final_candidate_score": 9}
    return rows.withColumns({c: F.round(c, n) for c, n in rounds.items()})


def job2_matched_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair after two runs, with the rates of its language."""
    folder = f"{shared(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        pairs, rates = matched_study.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", folder)
    point = rates.select("group", "target_candidates", "control_candidates", *(F.round(c, 9).alias(c) for c in ("target_rate", "control_rate", "ratio")))
    return pairs.withColumn("score", F.round("score", 9)).join(point, "group")


QUERIES = {f.__name__: f for f in (job1_nightly_scan, job2_matched_study)}



def _scan_sql(sql: str) -> str:
    """The library's SQL of events, over samples that count once, of stars with ten at least, without fits and without a ranker."""
    out = with_parts(sql)
    for old, new in {
        SQL["lc"]: f"SELECT star, t, min(flux) AS flux FROM ({SQL['lc']}) WHERE star IS NOT NULL GROUP BY star, t",
        "CASE WHEN feats.star % 5 <> 0 THEN (feats.star * 7 + row_number() OVER (PARTITION BY feats.star ORDER BY feats.event)) % 41 * 3.0::DOUBLE - 10 END AS delta_chi2 FROM feats": "NULL::DOUBLE AS delta_chi2 FROM (SELECT feats.* FROM feats JOIN noise USING (star) WHERE n >= 10) feats",
        "0.5 * (event_id % 10 / 10.0::DOUBLE)": "0.5 * 0.5::DOUBLE",
    }.items():
        if old not in out:
            raise ValueError("the library's SQL has changed")
        out = out.replace(old, new)
    return out


ORACLES = {
    "job1_nightly_scan": _scan_sql("""SELECT noise.star, noise.n AS n_samples, round(noise.noise, 9) AS noise, coalesce(n_events, 0) AS n_dips, recommended_review_priority AS priority,
CASE WHEN noise.n < 10 THEN 'too_few_samples' WHEN NOT coalesce(noise.noise > 0, false) THEN 'no_noise' WHEN n_events > 0 THEN 'dips' ELSE 'quiet' END AS status,
round(event_time, 6) AS event_time, round(depth_ppm, 3) AS depth_ppm, round(local_snr, 6) AS local_snr, n_points_window, edge_event, single_point_like, needs_manual_review, automated_vetting_status, final_candidate_score
FROM noise LEFT JOIN scored ON scored.star = noise.star LEFT JOIN summary ON summary.star = noise.star"""),
    "job2_matched_study": r"""
WITH RECURSIVE m AS (SELECT doc_id AS id, coalesce(lang, 'unknown') AS g, length(coalesce(text, ''))::BIGINT AS n_chars, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, len(regexp_extract_all(coalesce(text, ''), '[A-Z]{3,}'))::BIGINT AS n_events
    FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT m.*, n_chars / 1000::DOUBLE AS x, CASE WHEN n_words > 0 THEN n_words::DOUBLE END AS w, role FROM m JOIN (SELECT doc_id AS id, max(toxic) AS role FROM labels WHERE toxic IN (0, 1) GROUP BY doc_id) USING (id)),
e AS (SELECT t.id AS target_id, c.id AS control_id, abs(c.x - t.x) / 1 + coalesce(abs(c.w - t.w) / t.w / 0.5::DOUBLE, 0) AS score FROM d t JOIN d c ON t.g = c.g AND t.role = 1 AND c.role = 0 AND abs(c.x - t.x) <= 1 AND (t.w IS NULL OR abs(c.w - t.w) / t.w <= 0.5)),
l AS (SELECT target_id, list({'s': score, 'c': control_id} ORDER BY score, control_id) AS l, row_number() OVER (ORDER BY target_id) AS k FROM e GROUP BY target_id),
go AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS target_id, NULL::BIGINT AS control_id, NULL::DOUBLE AS score UNION ALL
    SELECT k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.c) END, target_id, best.c, best.s FROM (SELECT l.k, used, l.target_id, list_filter(l.l, lambda y: NOT list_contains(used, y.c))[1] AS best FROM go JOIN l ON l.k = go.k + 1)),
p AS (SELECT t.g, go.target_id, go.control_id, go.score, t.n_events AS target_events, c.n_events AS control_events FROM go JOIN d t ON t.id = go.target_id JOIN d c ON c.id = go.control_id),
r AS (SELECT g, sum(target_events)::BIGINT AS target_candidates, sum(control_events)::BIGINT AS control_candidates, count(*)::DOUBLE AS n FROM p GROUP BY g)
SELECT g AS "group", target_id, control_id, 1 AS match_rank, round(score, 9) AS score, target_events, control_events, target_candidates, control_candidates, round(target_candidates / n, 9) AS target_rate, round(control_candidates / n, 9) AS control_rate,
    CASE WHEN control_candidates > 0 THEN round((target_candidates / n) / (control_candidates / n), 9) END AS ratio FROM p JOIN r USING (g)""",
}
