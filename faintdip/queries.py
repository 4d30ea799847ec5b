"""Registered queries of the library's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.coords import clean_id, separation_arcsec, sexagesimal
from .functions.scores import final_score, quality_score
from .operators import catalogs, consolidate, detect, inject, matching, overview, ranking, rates, series, sky, vetting
from .plans import builds, scans
from .plans.views import SQL, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Windows of the sparse stand-in series, in days, events a star must have to be overtriggered, and radii in arcseconds.
WINDOW, MANY, RADIUS, NEAR = 5.0, 3, 10_800.0, 3_600.0

# ---- SQL that several oracles share -------------------------------------------------------------

PARTS = dict(SQL) | {
    "med": "SELECT star, t, flux, median(flux) OVER (PARTITION BY star) AS med FROM lc",
    "noise": "SELECT star, count(*) AS n, any_value(med) AS baseline, CASE WHEN 1.4826 * median(abs(flux - med)) > 0 OR count(*) <= 1 THEN 1.4826 * median(abs(flux - med)) ELSE stddev_pop(flux) END AS noise FROM med GROUP BY star",
    "numbered": "SELECT star, t, flux, row_number() OVER (PARTITION BY star ORDER BY t) AS i, CASE WHEN lag(flux) OVER (PARTITION BY star ORDER BY t) = flux THEN 0 ELSE 1 END AS new FROM lc",
    "running": "SELECT *, sum(new) OVER (PARTITION BY star ORDER BY i) AS run FROM numbered",
    "runs": "SELECT star, run, any_value(flux) AS flux, (min(i) + max(i)) // 2 AS mid FROM running GROUP BY star, run",
    "low": "SELECT *, lag(flux) OVER (PARTITION BY star ORDER BY run) AS before, lead(flux) OVER (PARTITION BY star ORDER BY run) AS after FROM runs",
    "minima": "SELECT low.star, numbered.t, low.flux, baseline, noise FROM low JOIN noise ON noise.star = low.star JOIN numbered ON numbered.star = low.star AND numbered.i = low.mid WHERE before > low.flux AND after > low.flux AND noise > 0 AND baseline - low.flux >= 4 * noise",
    "win": "SELECT minima.star, minima.t AS event, lc.t, lc.flux FROM minima JOIN lc ON lc.star = minima.star AND lc.t BETWEEN minima.t - 2.5 AND minima.t + 2.5",
    "based": "SELECT *, median(flux) OVER (PARTITION BY star, event) AS base, min(flux) OVER (PARTITION BY star, event) AS least, avg(flux) OVER (PARTITION BY star, event) AS mean, min({'f': flux, 't': t}) OVER (PARTITION BY star, event) AS low, count(*) OVER (PARTITION BY star, event) AS cnt FROM win",
    "shape": "SELECT star, event, count(*) AS n, any_value(base) AS base, any_value(least) AS least, 1.4826 * median(abs(flux - base)) AS mad, stddev_pop(flux) AS sd, count(*) FILTER (flux < base - greatest(base - least, 0) / 2) AS below, avg((flux - mean)**2) AS m2, avg((flux - mean)**3) AS m3, avg((flux - mean)**4) AS m4 FROM based GROUP BY star, event",
    "span": "SELECT star, min(t) AS first, max(t) AS last FROM lc GROUP BY star",
    "feats": """SELECT star, event, n AS n_points_window, greatest(base - least, 0) * 1e6 AS depth_ppm, s AS local_noise, greatest(base - least, 0) / s AS local_snr,
        coalesce(NOT (s IS NOT NULL AND base > least) OR below <= 1, true) AS single_point_like, event < first + 0.5 OR event > last - 0.5 AS edge_event,
        CASE WHEN m2 > 0 THEN m3 / m2**1.5 END AS skewness, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS kurtosis
        FROM (SELECT shape.*, first, last, CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd WHEN noise > 0 THEN noise END AS s FROM shape JOIN span USING (star) JOIN noise USING (star)) WHERE n >= 3""",
    "crossings": """SELECT star, event, (any_value(low.t) - max(t) FILTER (t <= low.t AND flux >= base - (base - low.f) / 2)) * 24 AS ingress_hours,
        (min(t) FILTER (t >= low.t AND flux >= base - (base - low.f) / 2) - any_value(low.t)) * 24 AS egress_hours FROM based WHERE cnt >= 5 AND base > low.f GROUP BY star, event""",
    "fwhm": """SELECT star, event, CASE WHEN b > a THEN (b - a) * 24 END AS fwhm_hours FROM (SELECT star, event,
        max({'t': t, 'x': t + (half - flux) / (f1 - flux) * (t1 - t)}) FILTER (flux >= half AND t < low.t).x AS a, min({'t': t, 'x': t0 + (half - f0) / (flux - f0) * (t - t0)}) FILTER (flux >= half AND t > low.t).x AS b
        FROM (SELECT *, base - (base - low.f) / 2 AS half, lead(t) OVER w AS t1, lead(flux) OVER w AS f1, lag(t) OVER w AS t0, lag(flux) OVER w AS f0 FROM based WINDOW w AS (PARTITION BY star, event ORDER BY t)) WHERE cnt >= 4 AND base > low.f GROUP BY star, event)""",
    "cadence": "SELECT star, count(*) AS n, median(step) AS dt FROM (SELECT star, t - lag(t) OVER (PARTITION BY star ORDER BY t) AS step FROM lc) GROUP BY star",
    "peaks": """SELECT minima.star, numbered.i, numbered.t, baseline - minima.flux AS height, CASE WHEN dt > 0 THEN greatest(3, floor(floor(5.0::DOUBLE / (2 * dt)) / 2)) ELSE 3 END AS apart, cadence.n,
        row_number() OVER (PARTITION BY minima.star ORDER BY baseline - minima.flux DESC, numbered.i DESC) AS k FROM minima JOIN numbered ON numbered.star = minima.star AND numbered.t = minima.t JOIN cadence ON cadence.star = minima.star""",
    "thinning": """SELECT DISTINCT star, 0::BIGINT AS k, []::BIGINT[] AS scanned, []::BIGINT[] AS first FROM peaks UNION ALL
        SELECT peaks.star, peaks.k, CASE WHEN len(list_filter(scanned, lambda x: abs(x - i) < apart)) = 0 THEN list_append(scanned, i) ELSE scanned END, CASE WHEN len(list_filter(first, lambda x: abs(x - i) < 5)) = 0 THEN list_append(first, i) ELSE first END
        FROM thinning JOIN peaks ON peaks.star = thinning.star AND peaks.k = thinning.k + 1""",
    "thinned": "SELECT star, arg_max(scanned, k) AS scanned, arg_max(first, k) AS first FROM thinning GROUP BY star",
    "events0": """SELECT feats.star, feats.event AS event_time, feats.star * 1000 + row_number() OVER (PARTITION BY feats.star ORDER BY feats.event) AS event_id, CASE WHEN feats.star % 2 = 0 THEN 'target' ELSE 'control' END AS sample_role,
        'star-' || feats.star AS target_name, depth_ppm, local_snr, n_points_window, edge_event, single_point_like, skewness, kurtosis, ingress_hours, egress_hours, CASE WHEN ingress_hours > 0 THEN egress_hours / ingress_hours END AS egress_ingress_ratio,
        CASE WHEN feats.star % 5 <> 0 THEN (feats.star * 7 + row_number() OVER (PARTITION BY feats.star ORDER BY feats.event)) % 41 * 3.0::DOUBLE - 10 END AS delta_chi2 FROM feats LEFT JOIN crossings USING (star, event)""",
    "flagged": """SELECT *, coalesce(local_snr < 5, false) AS flag_low_snr, edge_event AS flag_edge_event, single_point_like AS flag_single_point_like, coalesce(skewness > 0 AND egress_ingress_ratio < 1, false) AS flag_likely_flare_shape,
        coalesce(delta_chi2 < 5, false) AS flag_low_delta_chi2, egress_ingress_ratio IS NULL OR egress_ingress_ratio BETWEEN 0.9 AND 1.1 AS flag_poor_asymmetry_fit FROM events0""",
    "vetted": """SELECT *, flag_low_snr OR flag_edge_event OR flag_single_point_like OR flag_likely_flare_shape OR flag_low_delta_chi2 OR flag_poor_asymmetry_fit AS needs_manual_review,
        CASE WHEN flag_low_snr OR flag_edge_event OR flag_single_point_like OR flag_likely_flare_shape OR flag_low_delta_chi2 OR flag_poor_asymmetry_fit THEN 'flagged' ELSE 'pass' END AS automated_vetting_status FROM flagged""",
    "scored": """SELECT *, round(least(greatest(0.5 * (event_id % 10 / 10.0::DOUBLE) + 0.4 * quality_score + 0.1 * least(coalesce(local_snr, 0) / 10, 1) - 0.15 * edge_event::INT - 0.15 * single_point_like::INT, 0), 1), 9) AS final_candidate_score FROM (
        SELECT *, least(greatest(0.45 * least(coalesce(local_snr, 0) / 10, 1) + 0.30 * least(greatest((coalesce(egress_ingress_ratio, 1) - 1) / 5, 0), 1) + 0.25 * least(greatest(coalesce(delta_chi2, 0) / 100, 0), 1) - 0.25 * edge_event::INT - 0.25 * single_point_like::INT, 0), 1) AS quality_score FROM vetted)""",
    "external": """SELECT star, event_time, event_id, CASE star % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'failed' ELSE 'not_found' END AS eb_status, star AS eb_match_id, 1.25::DOUBLE AS eb_sep_arcsec,
        CASE star % 3 WHEN 0 THEN 'matched' ELSE 'not_found' END AS vsx_status, 'V' || star AS vsx_match_name, CASE star % 4 WHEN 0 THEN ' ea/SD' WHEN 1 THEN 'M:' ELSE '' END AS vsx_type, 2.5::DOUBLE AS vsx_sep_arcsec,
        CASE star % 7 WHEN 0 THEN 'matched' ELSE 'not_attempted' END AS simbad_status, 'S' || star AS simbad_main_id, CASE star % 2 WHEN 0 THEN 'EB*' ELSE 'Star' END AS simbad_otype, CAST(NULL AS DOUBLE) AS simbad_sep_arcsec, automated_vetting_status, needs_manual_review FROM vetted""",
    "classified": """SELECT *, CASE WHEN eb_status = 'matched' OR (vsx_status = 'matched' AND regexp_matches(upper(trim(split_part(split_part(vsx_type, ':', 1), '/', 1))), '^(CEP|CV|DCEP|DSCT|E|GDOR|HADS|NL|RR|SU|UG)')) THEN 'possible_eclipsing_binary_match'
        WHEN vsx_status = 'matched' THEN 'known_variable_match' WHEN simbad_status = 'matched' AND simbad_otype = 'EB*' THEN 'simbad_nonstellar_or_problematic_type'
        WHEN eb_status = 'failed' THEN 'external_check_failed' ELSE 'no_external_match' END AS external_false_positive_flag FROM external""",
    "stars0": """SELECT star, min_by(target_name, event_time) AS target_name, min_by(sample_role, event_time) AS sample_role, count(*) AS n_events, count(*) FILTER (automated_vetting_status = 'pass') AS n_pass, max(final_candidate_score) AS max_score, max(local_snr) AS max_snr,
        median(local_snr) AS median_snr, max(depth_ppm) AS max_depth_ppm, min(event_time) AS first_event_time, max(event_time) AS last_event_time FROM scored GROUP BY star""",
    "summary": "SELECT *, CASE WHEN n_events >= 3 THEN 'overtriggered_review' WHEN n_pass > 0 THEN 'high' WHEN coalesce(max_score, -1) >= 0.65 OR coalesce(max_snr, -1) >= 6 THEN 'medium' ELSE 'low' END AS recommended_review_priority FROM stars0",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY star ORDER BY final_candidate_score DESC NULLS LAST, local_snr DESC NULLS LAST, event_time) AS k FROM scored",
    "pairs": "SELECT id // 2 AS pair_id, id AS target_id, 'star-' || id AS target_name, id + 1 AS control_id FROM (SELECT DISTINCT star - star % 2 AS id FROM lc)",
    "near": "SELECT stars.id AS left_id, pool.id AS right_id, degrees(2 * asin(sqrt(least(1, greatest(0, sin(radians(pool.dec - stars.dec) / 2)**2 + cos(radians(stars.dec)) * cos(radians(pool.dec)) * sin(radians(pool.ra - stars.ra) / 2)**2))))) * 3600 AS separation_arcsec FROM stars, pool",
    "wide": "SELECT left_id AS star, arg_min(right_id, (separation_arcsec, right_id)) AS id, min(separation_arcsec) AS sep FROM near WHERE separation_arcsec <= 32400 GROUP BY left_id",
    "close": "SELECT left_id AS star, arg_min(right_id, (separation_arcsec, right_id)) AS id, min(separation_arcsec) AS sep FROM near WHERE separation_arcsec <= 10800 GROUP BY left_id",
    "latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY star ORDER BY scan_timestamp DESC, success DESC) AS k FROM status) WHERE k = 1",
    "status": "SELECT user_id AS star, CASE WHEN user_id % 2 = 0 THEN 'target' ELSE 'control' END AS sample_role, event_type <> 'error' AS success, CASE WHEN event_type <> 'error' THEN event_id % 4 ELSE 0 END AS n_candidates, epoch_us(ts) AS scan_timestamp FROM events",
}


#: Parts that refer to themselves.
RECURSIVE = ("thinning",)


def with_parts(sql: str) -> str:
    """sql with the parts that it needs before it."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                if name in RECURSIVE:
                    visit("FROM peaks")
                else:
                    visit(PARTS[name])
                need.append(name) if name not in need else None

    visit(sql)
    return (("WITH RECURSIVE " if set(need) & set(RECURSIVE) else "WITH ") + ",\n".join(f"{n} AS ({PARTS[n]})" for n in need) + "\n" if need else "") + sql


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_parts(oracle)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---- series and dips ------------------------------------------------------------------------------


def lc_of(spark, d):
    return view(spark, d, "lc")


def minima_of(spark, d):
    return series.local_minima(lc_of(spark, d)).withColumnRenamed("t", "event")


def events_of(spark, d):
    """Events with features, roles and names, as the oracles' events0."""
    from pyspark.sql import Window as W

    lc, ev = lc_of(spark, d), minima_of(spark, d).select("star", "event")
    f = series.window_features(lc, ev, WINDOW).filter("n_points_window >= 3").drop("local_noise")
    c = series.half_depth_crossings(lc, ev, WINDOW).withColumnRenamed("ratio", "egress_ingress_ratio")
    e = f.join(c, ["star", "event"], "left").withColumnRenamed("event", "event_time")
    number = F.row_number().over(W.partitionBy("star").orderBy("event_time"))
    return e.withColumns({
        "event_id": F.col("star") * 1000 + number, "sample_role": F.when(F.col("star") % 2 == 0, "target").otherwise("control"),
        "target_name": F.concat(F.lit("star-"), F.col("star").cast("string")), "delta_chi2": F.when(F.col("star") % 5 != 0, (F.col("star") * 7 + number) % 41 * 3.0 - 10),
    })


def vetted_of(spark, d):
    return vetting.vetting_flags(events_of(spark, d))


def scored_of(spark, d):
    c = F.col
    v = vetted_of(spark, d).withColumn("quality_score", quality_score(c("local_snr"), c("egress_ingress_ratio"), c("delta_chi2"), c("edge_event"), c("single_point_like")))
    return v.withColumn("final_candidate_score", F.round(final_score(c("event_id") % 10 / 10, c("quality_score"), c("local_snr"), c("edge_event"), c("single_point_like")), 9))


@query("SELECT star, round(event_time, 6) AS event_time, round(depth_ppm, 3) AS depth_ppm, round(local_snr, 6) AS local_snr, n_points_window, edge_event, single_point_like, automated_vetting_status, recommended_review_priority FROM scored JOIN (SELECT star, recommended_review_priority FROM summary) USING (star)")
def flagship_dip_scan(spark, d):
    e = scored_of(spark, d)
    stars = consolidate.star_summary(e, MANY).select("star", "recommended_review_priority")
    cols = ["star", F.round("event_time", 6).alias("event_time"), F.round("depth_ppm", 3).alias("depth_ppm"), F.round("local_snr", 6).alias("local_snr")]
    return e.join(stars, "star").select(*cols, "n_points_window", "edge_event", "single_point_like", "automated_vetting_status", "recommended_review_priority")


@query("""SELECT star, round(t, 6) AS t, round(flux / median(flux) OVER (PARTITION BY star), 9) AS flux FROM
(SELECT *, median(flux) OVER (PARTITION BY star) AS m, stddev_pop(flux) OVER (PARTITION BY star) AS s FROM lc) WHERE abs(flux - m) <= 10 * s""")
def lc_clean_normalize(spark, d):
    out = series.clean_normalize(lc_of(spark, d))
    return out.select("star", F.round("t", 6).alias("t"), F.round("flux", 9).alias("flux"))


@query("SELECT star, n, round(baseline, 9) AS baseline, round(noise, 9) AS noise FROM noise")
def lc_noise_mad(spark, d):
    return rounded(series.noise(lc_of(spark, d)).select("star", "n", "baseline", "noise"), 9)


@query("SELECT star, count(*) AS n, round(median(step), 6) AS cadence FROM (SELECT star, t - lag(t) OVER (PARTITION BY star ORDER BY t) AS step FROM lc) GROUP BY star")
def lc_cadence(spark, d):
    return rounded(series.cadence(lc_of(spark, d)))


@query("SELECT star, round(t, 6) AS t, round(flux, 9) AS flux, round(baseline - flux, 9) AS depth FROM minima")
def dip_local_minima(spark, d):
    return series.local_minima(lc_of(spark, d)).select("star", F.round("t", 6).alias("t"), F.round("flux", 9).alias("flux"), F.round(F.col("baseline") - F.col("flux"), 9).alias("depth"))


@query("SELECT star, round(event, 6) AS event, n_points_window, round(depth_ppm, 3) AS depth_ppm, round(local_noise, 9) AS local_noise, round(local_snr, 6) AS local_snr, single_point_like, edge_event FROM feats")
def dip_slice_depth(spark, d):
    f = series.window_features(lc_of(spark, d), minima_of(spark, d), WINDOW).filter("n_points_window >= 3")
    return f.select("star", F.round("event", 6).alias("event"), "n_points_window", F.round("depth_ppm", 3).alias("depth_ppm"), F.round("local_noise", 9).alias("local_noise"), F.round("local_snr", 6).alias("local_snr"), "single_point_like", "edge_event")


@query("SELECT star, round(event, 6) AS event, round(ingress_hours, 5) AS ingress_hours, round(egress_hours, 5) AS egress_hours, CASE WHEN ingress_hours > 0 THEN round(egress_hours / ingress_hours, 5) END AS ratio FROM crossings")
def dip_half_depth_crossings(spark, d):
    c = series.half_depth_crossings(lc_of(spark, d), minima_of(spark, d), WINDOW)
    return c.select("star", F.round("event", 6).alias("event"), *(F.round(x, 5).alias(x) for x in ("ingress_hours", "egress_hours", "ratio")))


@query("SELECT star, round(event, 6) AS event, round(fwhm_hours, 5) AS fwhm_hours FROM fwhm")
def dip_fwhm(spark, d):
    return series.width_at_half_depth(lc_of(spark, d), minima_of(spark, d), WINDOW).select("star", F.round("event", 6).alias("event"), F.round("fwhm_hours", 5).alias("fwhm_hours"))


@query("SELECT star, round(event, 6) AS event, round(skewness, 5) AS skewness, round(kurtosis, 5) AS kurtosis FROM feats")
def dip_window_moments(spark, d):
    f = series.window_features(lc_of(spark, d), minima_of(spark, d), WINDOW).filter("n_points_window >= 3")
    return f.select("star", F.round("event", 6).alias("event"), F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"))


def numbers(df, digits: int = 5):
    """df with doubles rounded, and null where there is no number."""
    return df.select(*(F.when(~F.isnan(c), F.round(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


THINNED = """SELECT peaks.star, round(peaks.t, 5) AS event_time, round(depth_ppm, 5) AS depth_ppm, round(local_snr, 5) AS local_snr, round(coalesce(ingress_hours + egress_hours, fwhm_hours), 5) AS duration_hours, round(fwhm_hours, 5) AS fwhm_hours,
round(ingress_hours, 5) AS ingress_hours, round(egress_hours, 5) AS egress_hours, CASE WHEN ingress_hours > 0 THEN round(egress_hours / ingress_hours, 5) END AS egress_ingress_ratio, round(skewness, 5) AS skewness, round(kurtosis, 5) AS kurtosis,
w.cnt AS n_points_window, peaks.t < span.first + 0.5 OR peaks.t > span.last - 0.5 AS edge_event, coalesce(single_point_like, true) AS single_point_like
FROM peaks JOIN thinned ON thinned.star = peaks.star AND list_contains(scanned, i) JOIN span ON span.star = peaks.star JOIN (SELECT star, event, any_value(cnt) AS cnt FROM based GROUP BY star, event) w ON w.star = peaks.star AND w.event = peaks.t
LEFT JOIN feats ON feats.star = peaks.star AND feats.event = peaks.t LEFT JOIN crossings ON crossings.star = peaks.star AND crossings.event = peaks.t LEFT JOIN fwhm ON fwhm.star = peaks.star AND fwhm.event = peaks.t WHERE peaks.n >= 10"""


@query(THINNED)
def dip_scan_thinned(spark, d):
    return numbers(detect.scan(lc_of(spark, d), window=WINDOW, fits=False).drop("delta_chi2"))


@query(THINNED)
def dip_scan_chunked(spark, d):
    """The same by chunks of 16 samples, as if each series were too long for a task."""
    return numbers(detect.scan_chunked(lc_of(spark, d), window=WINDOW, fits=False, chunk=16, few=20).drop("delta_chi2"))


@query("""SELECT star, round(t, 5) AS event_time, round(depth * 1e6, 4) AS depth_ppm, round(s, 9) AS local_noise, round(depth / s, 5) AS local_snr, n AS n_points_window, round(t - 2.5, 5) AS window_start, round(t + 2.5, 5) AS window_end, below <= 1 AS single_point_like,
round(ingress_hours / 24, 6) AS ingress_days, round(egress_hours / 24, 6) AS egress_days, CASE WHEN ingress_hours > 0 THEN round(egress_hours / ingress_hours, 5) END AS asymmetry_score
FROM (SELECT p.star, p.t, depth, count(*) AS n, count(*) FILTER (flux < base - depth / 2) AS below, any_value(CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE noise END) AS s
    FROM (SELECT peaks.star, peaks.t, CASE WHEN shape.base - minima.flux > 0 THEN shape.base - minima.flux ELSE height END AS depth, mad, sd, shape.n, noise FROM peaks JOIN thinned ON thinned.star = peaks.star AND list_contains(thinned.first, i)
        JOIN minima ON minima.star = peaks.star AND minima.t = peaks.t JOIN shape ON shape.star = peaks.star AND shape.event = peaks.t WHERE peaks.n >= 5 AND shape.n >= 3) p
    JOIN based ON based.star = p.star AND based.event = p.t GROUP BY p.star, p.t, depth) q LEFT JOIN crossings ON crossings.star = q.star AND crossings.event = q.t""".replace("SELECT star, round(t, 5)", "SELECT q.star, round(q.t, 5)"))
def dip_first_detector(spark, d):
    out = detect.first_scan(lc_of(spark, d), min_distance=5, window=WINDOW).drop("depth")
    digits = {"depth_ppm": 4, "local_noise": 9, "ingress_days": 6, "egress_days": 6}
    return out.select(*(F.when(~F.isnan(c), F.round(c, digits.get(c, 5))).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("SELECT star, round(event, 5) AS event_time, round(ingress_hours / 24, 6) AS ingress_days, round(egress_hours / 24, 6) AS egress_days, CASE WHEN ingress_hours > 0 THEN round(egress_hours / ingress_hours, 5) END AS asymmetry_score FROM (SELECT star, t AS event FROM minima) LEFT JOIN crossings USING (star, event)")
def dip_asymmetry_scores(spark, d):
    events = minima_of(spark, d).select("star", F.col("event").alias("event_time"), F.lit(999.0).alias("asymmetry_score"))
    out = detect.asymmetry_scores(events, lc_of(spark, d), WINDOW)
    return out.select("star", F.round("event_time", 5).alias("event_time"), F.round("ingress_days", 6).alias("ingress_days"), F.round("egress_days", 6).alias("egress_days"), F.round("asymmetry_score", 5).alias("asymmetry_score"))


@query()
def dip_fit_delta_chi2(spark, d):
    return detect.scan(lc_of(spark, d), window=WINDOW).select("star", "event_time", "delta_chi2")


@query("""SELECT e.star, round(e.event, 6) AS event, round(coalesce(CASE WHEN a.t = e.event OR b.t IS NULL THEN a.flux WHEN a.t IS NULL THEN b.flux ELSE a.flux + (b.flux - a.flux) * (e.event - a.t) / (b.t - a.t) END, a.flux), 7) AS flux
FROM (SELECT star, t + 0.01 AS event FROM minima) e ASOF LEFT JOIN (SELECT star, t, flux FROM med) a ON a.star = e.star AND a.t <= e.event ASOF LEFT JOIN (SELECT star, t, flux FROM med) b ON b.star = e.star AND b.t >= e.event""")
def dip_marker_flux(spark, d):
    ev = minima_of(spark, d).select("star", (F.col("event") + 0.01).alias("event"))
    return series.flux_at(lc_of(spark, d), ev).select("star", F.round("event", 6).alias("event"), F.round("flux", 7).alias("flux"))


@query("""SELECT star, round(t, 6) AS t, round(flux - least(greatest(CASE WHEN x >= -0.5 AND x < 0 THEN 0.002 * (1 + x / 0.5) WHEN x >= 0 AND x <= 1 THEN 0.002 * (1 - x) ELSE 0 END, 0), 0.002), 9) AS flux
FROM (SELECT star, lc.t, flux, lc.t - m AS x FROM lc JOIN (SELECT star, (first + last) / 2 AS m FROM span) USING (star))""")
def inject_flux(spark, d):
    lc = lc_of(spark, d)
    dips = lc.groupBy("star").agg(((F.min("t") + F.max("t")) / 2).alias("at")).select("star", "at", F.lit(2000.0).alias("depth_ppm"), F.lit(12.0).alias("ingress_hours"), F.lit(24.0).alias("egress_hours"))
    return inject.inject(lc, dips).select("star", F.round("t", 6).alias("t"), F.round("flux", 9).alias("flux"))


@query()
def inject_recovery(spark, d):
    return inject.recovery(lc_of(spark, d), n=10, window=WINDOW, tolerance_hours=24.0)


@query("""SELECT star, n AS trial, round(mid, 6) AS "at", round(near_t, 6) AS recovered_time, near_t IS NOT NULL AS recovered FROM (
SELECT s.star, 1 AS n, s.mid, arg_min(m.t, (abs(m.t - s.mid), m.t)) AS near_t FROM (SELECT star, (first + last) / 2 AS mid FROM span) s LEFT JOIN (SELECT star, t FROM minima) m ON m.star = s.star AND abs(m.t - s.mid) * 24 <= 72 GROUP BY ALL)""")
def inject_recover_match(spark, d):
    lc = lc_of(spark, d)
    truth = lc.groupBy("star").agg(((F.min("t") + F.max("t")) / 2).alias("at")).withColumn("trial", F.lit(1))
    found = series.local_minima(lc).select("star", F.lit(1).alias("trial"), F.col("t").alias("event_time"), F.lit(None).cast("double").alias("depth_ppm"), F.lit(None).cast("double").alias("local_snr"))
    return inject.match_detections(truth, found, 72.0).select("star", "trial", F.round("at", 6).alias("at"), F.round("recovered_time", 6).alias("recovered_time"), "recovered")


@query("""SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (recovered) AS recovered, round(avg(recovered::INT), 6) AS fraction FROM (SELECT *, floor((ln(depth_ppm) - ln(low)) / (ln(high) - ln(low)) * 10) AS bin
FROM injections, (SELECT greatest(min(depth_ppm), 10) AS low, max(depth_ppm) * 1.05 AS high FROM injections)) WHERE bin BETWEEN 0 AND 9 GROUP BY bin""")
def recovery_by_depth(spark, d):
    return rounded(inject.recovery_by_depth(view(spark, d, "injections")))


@query("""SELECT CAST(db AS BIGINT) AS depth_bin, CAST(eb AS BIGINT) AS egress_bin, count(*) AS n, round(avg(recovered::INT), 6) AS fraction FROM (SELECT *, floor((ln(depth_ppm) - ln(low)) / (ln(high) - ln(low)) * 8) AS db, floor((egress_hours - e0) / (e1 - e0) * 6) AS eb
FROM injections, (SELECT greatest(min(depth_ppm), 10) AS low, max(depth_ppm) * 1.05 AS high, min(egress_hours) * 0.95 AS e0, max(egress_hours) * 1.05 AS e1 FROM injections)) WHERE db BETWEEN 0 AND 7 AND eb BETWEEN 0 AND 5 GROUP BY db, eb""")
def recovery_heatmap(spark, d):
    return rounded(inject.recovery_heatmap(view(spark, d, "injections")))


# ---- sky, catalogs and controls -------------------------------------------------------------------


@query("SELECT left_id, right_id, round(separation_arcsec, 4) AS separation_arcsec FROM near WHERE separation_arcsec <= 10800")
def sky_within(spark, d):
    return rounded(sky.within(view(spark, d, "stars"), view(spark, d, "pool"), RADIUS), 4)


@query("SELECT left_id, arg_min(right_id, (separation_arcsec, right_id)) AS right_id, round(min(separation_arcsec), 4) AS separation_arcsec FROM near WHERE separation_arcsec <= 10800 GROUP BY left_id")
def sky_nearest(spark, d):
    return rounded(sky.nearest(view(spark, d, "stars"), view(spark, d, "pool"), RADIUS), 4)


@query("""SELECT id, coalesce(right_id, -1) AS tic_match_id, round(s, 4) AS tic_sep_arcsec, CASE WHEN id % 9 = 0 THEN 'not_attempted' WHEN right_id IS NULL THEN 'not_found' ELSE 'matched' END AS tic_status FROM stars
LEFT JOIN (SELECT left_id, arg_min(right_id, (separation_arcsec, right_id)) AS right_id, min(separation_arcsec) AS s FROM near WHERE separation_arcsec <= 10800 GROUP BY left_id) ON left_id = id AND id % 9 <> 0""")
def sky_nearest_left_status(spark, d):
    stars = view(spark, d, "stars").select("id", F.when(F.col("id") % 9 != 0, F.col("ra")).alias("ra"), "dec")  # every ninth has no position
    out = sky.crossmatch(stars, view(spark, d, "pool"), RADIUS, "tic")
    return rounded(out.select("id", F.coalesce("tic_match_id", F.lit(-1)).alias("tic_match_id"), "tic_sep_arcsec", "tic_status"), 4)


@query("SELECT a.id AS left_id, count(*) AS n FROM pool a JOIN pool b ON a.id <> b.id AND degrees(2 * asin(sqrt(least(1, greatest(0, sin(radians(b.dec - a.dec) / 2)**2 + cos(radians(a.dec)) * cos(radians(b.dec)) * sin(radians(b.ra - a.ra) / 2)**2))))) * 3600 <= 21600 GROUP BY a.id")
def sky_self_neighbours(spark, d):
    pool = view(spark, d, "pool")
    return sky.within(pool, pool, 21_600.0).filter("left_id <> right_id").groupBy("left_id").agg(F.count("*").alias("n"))


SEPARATION = "degrees(2 * asin(sqrt(least(1, greatest(0, sin(radians({b}.dec - {a}.dec) / 2)**2 + cos(radians({a}.dec)) * cos(radians({b}.dec)) * sin(radians({b}.ra - {a}.ra) / 2)**2))))) * 3600"


@query(f"""WITH RECURSIVE p AS (SELECT id, ra, "dec", row_number() OVER (ORDER BY id) AS k FROM ({SQL["pool"]})),
go AS (SELECT 0::BIGINT AS k, []::STRUCT(id BIGINT, ra DOUBLE, "dec" DOUBLE)[] AS kept UNION ALL SELECT p.k, CASE WHEN len(list_filter(kept, lambda x: {SEPARATION.format(a="x", b="p")} <= 21600)) = 0 THEN list_append(kept, {{'id': p.id, 'ra': p.ra, 'dec': p.dec}}) ELSE kept END FROM go JOIN p ON p.k = go.k + 1)
SELECT x.id, x.ra, x.dec FROM (SELECT unnest(arg_max(kept, k)) AS x FROM go)""")
def sky_dedupe(spark, d):
    return sky.deduplicate(view(spark, d, "pool").select("id", "ra", "dec"), 21_600.0)


@query(f"""SELECT s.id AS left_id, p.id AS right_id, round({SEPARATION.format(a="s", b="p")}, 3) AS separation_arcsec FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) g
JOIN ({SQL["stars"]}) s ON s.id = o_custkey JOIN ({SQL["pool"]}) p ON p.id = l_suppkey""")
def sky_separation(spark, d):
    """Pairs that a table gives: customers and the suppliers of their orders."""
    given = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    a, b = view(spark, d, "stars").alias("a"), view(spark, d, "pool").alias("b")
    pairs = given.join(a, F.col("a.id") == F.col("o_custkey")).join(b, F.col("b.id") == F.col("l_suppkey"))
    return pairs.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.round(separation_arcsec(F.col("a.ra"), F.col("a.dec"), F.col("b.ra"), F.col("b.dec")), 3).alias("separation_arcsec"))


@query("SELECT left_id AS target_id, pool.id, round(s, 4) AS separation_arcsec, name, has_data FROM (SELECT left_id, arg_min(right_id, (separation_arcsec, right_id)) AS right_id, min(separation_arcsec) AS s FROM near WHERE separation_arcsec <= 10800 GROUP BY left_id) JOIN pool ON pool.id = right_id")
def control_approximate(spark, d):
    out = sky.approximate_controls(view(spark, d, "stars"), view(spark, d, "pool"), RADIUS)
    return out.select("target_id", "id", F.round("separation_arcsec", 4).alias("separation_arcsec"), "name", "has_data")


@query("""SELECT c_custkey AS id, round((h + m / 60.0::DOUBLE + s / 3600) * 15, 7) AS ra_deg, round(CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * (dd + m / 60.0::DOUBLE + s / 3600), 7) AS dec_deg, c_custkey AS tic_id
FROM (SELECT c_custkey, c_custkey % 24 AS h, c_custkey % 60 AS m, (c_custkey % 600) / 10.0::DOUBLE AS s, c_custkey % 90 AS dd FROM customer)""")
def sexagesimal_parse(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    text = lambda first: F.concat_ws(" ", first, F.concat((k % 60).cast("string"), F.lit("m")), F.concat(((k % 600) / 10).cast("string"), F.lit("s")))
    ra = text(F.concat((k % 24).cast("string"), F.lit("h")))
    dec = text(F.concat(F.when(k % 2 == 0, "-").otherwise("+"), (k % 90).cast("string"), F.lit("d")))
    tic = F.when(k % 3 == 0, F.concat(F.lit("TIC "), k.cast("string"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string"))
    return c.select(k.alias("id"), F.round(sexagesimal(ra, True), 7).alias("ra_deg"), F.round(sexagesimal(dec, False), 7).alias("dec_deg"), clean_id(tic).alias("tic_id"))


@query("""SELECT 'star ' || c_custkey AS target_name, round((c_custkey % 24 + (c_custkey % 60) / 60.0::DOUBLE) * 15, 7) AS ra_deg, round(CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * (c_custkey % 90 + (c_custkey % 60) / 60.0::DOUBLE), 7) AS dec_deg,
c_custkey AS tic_id, round(c_acctbal / 1000, 6) AS tmag, 'chen_2014' AS source_catalog, 2 AS catalog_priority, true AS is_secondary FROM customer""")
def catalog_normalize(spark, d):
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(
        F.concat(F.lit("star "), k.cast("string")).alias("Name"), (k % 24).cast("string").alias("RAh"), (k % 60).cast("string").alias("RAm"), F.lit("0").alias("RAs"), F.when(k % 2 == 0, "-").otherwise("+").alias("DE-"),
        (k % 90).cast("string").alias("DEd"), (k % 60).cast("string").alias("DEm"), F.lit("0.0").alias("DEs"), F.concat(F.lit("TIC"), k.cast("string")).alias("TIC"), (F.col("c_acctbal") / 1000).alias("Tmag"),
    )
    out = catalogs.normalize(raw, "chen_2014")
    return out.select("target_name", F.round("ra_deg", 7).alias("ra_deg"), F.round("dec_deg", 7).alias("dec_deg"), "tic_id", F.round("tmag", 6).alias("tmag"), "source_catalog", "catalog_priority", "is_secondary")


CATALOG = """SELECT CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS target_name, c_mktsegment AS source_catalog, round((c_custkey * 137.508::DOUBLE) % 360, 6) AS ra_deg, CASE WHEN c_custkey % 13 <> 0 THEN round((c_custkey * 53.13::DOUBLE) % 160 - 80, 6) END AS dec_deg,
CASE WHEN m THEN c_custkey::VARCHAR END AS tic_id, CASE WHEN m THEN round(c_acctbal / 1000, 6) END AS tmag, CASE WHEN m AND c_custkey % 17 <> 0 THEN round(c_acctbal / 5000, 6) END AS bp_rp, CASE WHEN m THEN 5800.0::DOUBLE END AS teff, CAST(NULL AS DOUBLE) AS parallax,
CASE WHEN m THEN 'matched' WHEN c_custkey % 4 = 2 THEN 'failed' ELSE 'not_attempted' END AS tic_query_status, CASE WHEN c_custkey % 3 = 0 THEN 'matched' ELSE 'not_attempted' END AS gaia_query_status FROM (SELECT *, c_custkey % 4 < 2 AS m FROM customer)"""


def catalog_of(spark, d):
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(
        F.when(k % 11 != 0, F.col("c_name")).otherwise("N/A").alias("target_name"), F.col("c_mktsegment").alias("source_catalog"), F.round((k * 137.508) % 360, 6).cast("string").alias("ra_deg"),
        F.when(k % 13 != 0, F.round((k * 53.13) % 160 - 80, 6).cast("string")).otherwise("--").alias("dec_deg"), k.alias("tic_id"), F.round(F.col("c_acctbal") / 1000, 6).alias("tmag"),
        F.when(k % 17 != 0, F.round(F.col("c_acctbal") / 5000, 6)).otherwise(float("nan")).alias("bp_rp"), F.lit("5800").alias("teff"), F.lit("").alias("parallax"),
        F.when(k % 4 < 2, "MATCHED").when(k % 4 == 2, "failed").otherwise("strange").alias("tic_query_status"), F.when(k % 3 == 0, "matched").alias("gaia_query_status"),
    )
    return catalogs.clean_targets(raw)


@query("""SELECT c_name AS target_name, 'chen_2014' AS source_catalog, CASE WHEN c_custkey % 3 = 0 THEN 'G2V' END AS sp_type, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 90 + 50.5::DOUBLE END AS disk_temperature, c_custkey % 7::DOUBLE AS disk_radius,
CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 5000.0::DOUBLE + c_custkey % 100 END AS teff_catalog, NULL::DOUBLE AS distance_pc, CASE c_custkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'not_attempted' ELSE 'odd' END AS tic_query_status, 'not_attempted' AS gaia_query_status,
CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN c_custkey::VARCHAR END AS tic_id, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal / 1000, 6) END AS tmag, NULL::DOUBLE AS parallax FROM customer""")
def catalog_research(spark, d):
    """Fields from the first column that has a number anywhere: Td1 and T* have none, Rd1 comes before Rd2."""
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(
        F.col("c_name").alias("Name"), F.lit("chen_2014").alias("source_catalog"), F.when(k % 3 == 0, "G2V").alias("SpT"), F.lit("--").alias("Td1"), F.when(k % 5 != 0, k % 90 + 50.5).alias("Tgr"), F.lit(1.0).alias("Tgr1"), (k % 7).cast("string").alias("Rd1"), F.lit("9").alias("Rd2"),
        F.lit(None).cast("string").alias("T*"), F.when(k % 4 == 0, "unknown").otherwise((5000 + k % 100).cast("string")).alias("Teff"), F.when(k % 3 == 0, " matched ").when(k % 3 == 1, "<NA>").otherwise("odd").alias("tic_query_status"),
        F.when(k % 6 == 0, "n/a").otherwise(k.cast("string")).alias("tic_id"), F.round(F.col("c_acctbal") / 1000, 6).alias("tmag"), F.lit("5.0").alias("parallax"),
    )
    names = ["target_name", "source_catalog", "sp_type", "disk_temperature", "disk_radius", "teff_catalog", "distance_pc", "tic_query_status", "gaia_query_status", "tic_id", "tmag", "parallax"]
    return catalogs.research_table(raw).select(*names)


@query(CATALOG)
def catalog_clean(spark, d):
    return catalog_of(spark, d).withColumn("tic_id", F.col("tic_id").cast("string"))


@query(f"""WITH c AS ({CATALOG}) SELECT metric, label, CAST(value AS BIGINT) AS value FROM (
SELECT 'n_targets' AS metric, '' AS label, count(*) AS value FROM c UNION ALL SELECT 'n_with_coordinates', '', count(*) FILTER (ra_deg IS NOT NULL AND dec_deg IS NOT NULL) FROM c UNION ALL SELECT 'n_tic_matched', '', count(*) FILTER (tic_query_status = 'matched') FROM c
UNION ALL SELECT 'n_gaia_matched', '', count(*) FILTER (gaia_query_status = 'matched') FROM c UNION ALL SELECT 'n_with_tic', '', count(tic_id) FROM c UNION ALL SELECT 'n_distinct_tic', '', count(DISTINCT tic_id) FROM c
UNION ALL SELECT 'missing', 'tic_id', count(*) - count(tic_id) FROM c UNION ALL SELECT 'missing', 'tmag', count(*) - count(tmag) FROM c UNION ALL SELECT 'missing', 'bp_rp', count(*) - count(bp_rp) FROM c UNION ALL SELECT 'missing', 'parallax', count(*) FROM c
UNION ALL SELECT 'source', source_catalog, count(*) FROM c GROUP BY source_catalog)""")
def verify_catalog(spark, d):
    return catalogs.verification_report(catalog_of(spark, d))


def photometry(df, key, mag):
    k = F.col(key)
    return df.select(k.alias("id"), (F.col(mag) / 1000).alias("tmag"), F.when(k % 5 != 0, (k % 20) / 20).alias("bp_rp"), (4000 + (k % 30) * 100).cast("double").alias("teff"), F.when(k % 7 != 0, (1 + k % 10).cast("double")).alias("parallax"))


PHOTOMETRY = "SELECT {k} AS id, {m} / 1000 AS tmag, CASE WHEN {k} % 5 <> 0 THEN ({k} % 20) / 20 END AS bp_rp, (4000 + ({k} % 30) * 100)::DOUBLE AS teff, CASE WHEN {k} % 7 <> 0 THEN (1 + {k} % 10)::DOUBLE END AS parallax FROM {t}"
TARGETS, CONTROLS = PHOTOMETRY.format(k="c_custkey", m="c_acctbal", t="customer"), PHOTOMETRY.format(k="s_suppkey", m="s_acctbal", t="supplier")
BAND = f"""WITH t AS ({TARGETS}), c AS ({CONTROLS}) SELECT t.id AS target_id, c.id AS control_id, round(abs(c.tmag - t.tmag) / 1 + coalesce(abs(c.bp_rp - t.bp_rp) / 0.35, 0) + CASE WHEN t.bp_rp IS NULL THEN abs(c.teff - t.teff) / 400 ELSE 0 END + coalesce(abs(c.parallax - t.parallax) / t.parallax / 0.5, 0), 6) AS score
FROM t JOIN c ON abs(c.tmag - t.tmag) <= 1 AND (t.bp_rp IS NULL OR abs(c.bp_rp - t.bp_rp) <= 0.35) AND (t.bp_rp IS NOT NULL OR abs(c.teff - t.teff) <= 400) AND (t.parallax IS NULL OR abs(c.parallax - t.parallax) / t.parallax <= 0.5)"""


@query(BAND)
def control_candidates(spark, d):
    return rounded(matching.candidates(photometry(table(spark, d, "customer"), "c_custkey", "c_acctbal"), photometry(table(spark, d, "supplier"), "s_suppkey", "s_acctbal")))


GREEDY = f"""WITH RECURSIVE t AS ({TARGETS}), c AS ({CONTROLS}), far AS (SELECT t.id AS target_id, c.id AS control_id, abs(c.tmag - t.tmag) / 0.5 + CASE WHEN t.bp_rp IS NOT NULL THEN coalesce(abs(c.bp_rp - t.bp_rp) / 0.15, 1) ELSE abs(c.teff - t.teff) / 300 END
    + CASE WHEN t.parallax > 0 THEN coalesce(abs(c.parallax - t.parallax) / t.parallax / 0.5, 1) ELSE 0 END AS score, coalesce(abs(c.bp_rp - t.bp_rp) < 0.15, false) AS like_colour, abs(c.teff - t.teff) < 300 AS warm, t.bp_rp IS NOT NULL AS coloured,
    t.parallax IS NULL OR coalesce(abs(c.parallax - t.parallax) / t.parallax < 0.5, false) AS fits FROM t JOIN c ON abs(c.tmag - t.tmag) < 0.5),
each AS (SELECT target_id, control_id, score, false AS fallback, fits FROM far WHERE CASE WHEN coloured THEN like_colour ELSE warm END UNION ALL SELECT target_id, control_id, score, true, fits FROM far WHERE coloured AND warm),
l AS (SELECT target_id, list({{'s': score, 'c': control_id, 'b': fallback, 'f': fits}} ORDER BY score, control_id) AS l, row_number() OVER (ORDER BY target_id) AS k FROM each GROUP BY target_id),
go AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS target_id, NULL::BIGINT AS control_id, NULL::DOUBLE AS score UNION ALL
    SELECT k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.c) END, target_id, best.c, best.s FROM (SELECT k, used, target_id, list_filter(free, lambda x: x.f AND x.b = plain)[1] AS best FROM (
        SELECT *, len(list_filter(free, lambda x: NOT x.b)) = 0 AS plain FROM (SELECT l.k, used, l.target_id, list_filter(l.l, lambda x: NOT list_contains(used, x.c)) AS free FROM go JOIN l ON l.k = go.k + 1))))
SELECT target_id, control_id, 1 AS match_rank, round(score, 6) AS match_quality_score FROM go WHERE control_id IS NOT NULL"""


@query(GREEDY)
def control_greedy_pairs(spark, d):
    return rounded(matching.matched_pairs(photometry(table(spark, d, "customer"), "c_custkey", "c_acctbal"), photometry(table(spark, d, "supplier"), "s_suppkey", "s_acctbal")))


@query(f"SELECT (SELECT count(*) FROM customer) AS n_targets, (SELECT count(*) FROM customer) - count(*) AS n_unmatched FROM ({GREEDY})")
def control_unmatched(spark, d):
    targets = photometry(table(spark, d, "customer"), "c_custkey", "c_acctbal")
    return matching.unmatched(targets, matching.matched_pairs(targets, photometry(table(spark, d, "supplier"), "s_suppkey", "s_acctbal")))


@query("""SELECT pool.id, CASE WHEN pool.excess THEN 'known_ir_excess_tic' WHEN near.right_id IS NOT NULL THEN 'known_ir_excess_coordinate' ELSE '' END AS excluded_reason FROM pool
LEFT JOIN (SELECT DISTINCT right_id FROM near WHERE separation_arcsec <= 3600) near ON near.right_id = pool.id""")
def exclusion_reason(spark, d):
    pool = view(spark, d, "pool")
    return sky.excluded(pool.select("id", "ra", "dec", "excess"), pool.filter("excess").select("id"), view(spark, d, "stars"), NEAR).select("id", "excluded_reason")


@query("""SELECT metric, round(avg(dd), 6) AS mean_abs_diff, round(stddev_pop(dd), 6) AS std_abs_diff, count(dd) AS n FROM (SELECT 'tmag' AS metric, abs(c_acctbal - s_acctbal) AS dd FROM customer JOIN supplier ON c_custkey = s_suppkey
UNION ALL SELECT 'bp_rp', abs(c_nationkey - s_nationkey) FROM customer JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT 'parallax', NULL FROM customer JOIN supplier ON c_custkey = s_suppkey) GROUP BY metric""")
def verify_pairs(spark, d):
    p = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    n = F.lit(None).cast("double")
    p = p.select(F.col("c_acctbal").alias("tmag_target"), F.col("s_acctbal").alias("tmag_control"), F.col("c_nationkey").alias("bp_rp_target"), F.col("s_nationkey").alias("bp_rp_control"), n.alias("parallax_target"), n.alias("parallax_control"))
    return rounded(matching.pair_balance(p))


@query("SELECT p_partkey AS tic_id, n_tess_products, first_sector, n_tess_products > 0 AS has_tess_lightcurve FROM (SELECT p_partkey, count(l_partkey) AS n_tess_products, min(l_linenumber) AS first_sector FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)")
def product_availability(spark, d):
    products = table(spark, d, "lineitem").select(F.col("l_partkey").alias("tic_id"), F.col("l_linenumber").alias("sector"))
    return catalogs.availability(table(spark, d, "part").select(F.col("p_partkey").alias("tic_id")), products)


@query("""SELECT l_orderkey AS tic_id, author, l_linenumber AS product FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS author,
CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS r, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) WHERE r = best) WHERE k <= 2""")
def product_preference(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tic_id"), F.col("l_returnflag").alias("author"), F.col("l_linenumber").alias("product"))
    return catalogs.preferred_products(p, ["R", "A"], 2)


# ---- vetting, scores and stars ------------------------------------------------------------------------

FLAG_COLUMNS = [*vetting.FLAGS, "needs_manual_review", "automated_vetting_status"]


@query(f"SELECT event_id, {', '.join(FLAG_COLUMNS)} FROM vetted")
def vetting_flags(spark, d):
    return vetted_of(spark, d).select("event_id", *FLAG_COLUMNS)


@query("""SELECT metric, value FROM (SELECT unnest(['n_total', 'flag_low_snr', 'flag_edge_event', 'flag_single_point_like', 'flag_likely_flare_shape', 'flag_low_delta_chi2', 'flag_poor_asymmetry_fit', 'n_pass', 'n_flagged', 'fraction_pass']) AS metric,
unnest([count(*)::DOUBLE, count(*) FILTER (flag_low_snr), count(*) FILTER (flag_edge_event), count(*) FILTER (flag_single_point_like), count(*) FILTER (flag_likely_flare_shape), count(*) FILTER (flag_low_delta_chi2), count(*) FILTER (flag_poor_asymmetry_fit),
count(*) FILTER (automated_vetting_status = 'pass'), count(*) FILTER (automated_vetting_status <> 'pass'), round(count(*) FILTER (automated_vetting_status = 'pass') / count(*), 6)]) AS value FROM vetted)""")
def vetting_summary(spark, d):
    return rounded(vetting.vetting_summary(vetted_of(spark, d)))


def external_of(spark, d):
    s, nothing = F.col("star"), F.lit(None).cast("double")
    return vetted_of(spark, d).select(
        "star", "event_time", "event_id", F.when(s % 5 == 0, "matched").when(s % 5 == 1, "failed").otherwise("not_found").alias("eb_status"), s.alias("eb_match_id"), F.lit(1.25).alias("eb_sep_arcsec"),
        F.when(s % 3 == 0, "matched").otherwise("not_found").alias("vsx_status"), F.concat(F.lit("V"), s.cast("string")).alias("vsx_match_name"), F.when(s % 4 == 0, " ea/SD").when(s % 4 == 1, "M:").otherwise("").alias("vsx_type"), F.lit(2.5).alias("vsx_sep_arcsec"),
        F.when(s % 7 == 0, "matched").otherwise("not_attempted").alias("simbad_status"), F.concat(F.lit("S"), s.cast("string")).alias("simbad_main_id"), F.when(s % 2 == 0, "EB*").otherwise("Star").alias("simbad_otype"), nothing.alias("simbad_sep_arcsec"), "automated_vetting_status", "needs_manual_review",
    )


@query("""SELECT event_id, external_false_positive_flag, concat_ws('; ', CASE WHEN eb_status = 'matched' THEN 'TESS-EB catalog: TIC ' || star || ' (1.3")' END, CASE WHEN vsx_status = 'matched' THEN 'VSX: ' || vsx_match_name || ' type=' || vsx_type || ' (2.5")' END,
CASE WHEN simbad_status = 'matched' THEN 'SIMBAD: ' || simbad_main_id || ' otype=' || simbad_otype || CASE WHEN simbad_otype = 'EB*' THEN ' (eclipsing binary)' ELSE '' END || ' (?)' END,
CASE WHEN external_false_positive_flag = 'external_check_failed' THEN 'WARNING: one or more catalog queries failed, so no match is unreliable' END) AS external_vetting_notes FROM classified""")
def external_classify(spark, d):
    return vetting.classify_external(external_of(spark, d)).select("event_id", "external_false_positive_flag", "external_vetting_notes")


CONCERN = "external_false_positive_flag IN ('possible_eclipsing_binary_match', 'known_variable_match', 'simbad_nonstellar_or_problematic_type')"


@query(f"SELECT event_id, {CONCERN} AS flag_external_catalog_match, CASE WHEN {CONCERN} AND automated_vetting_status = 'pass' THEN 'flagged' ELSE automated_vetting_status END AS automated_vetting_status, needs_manual_review OR {CONCERN} AS needs_manual_review FROM classified")
def external_demote(spark, d):
    out = vetting.demote(vetting.classify_external(external_of(spark, d)))
    return out.select("event_id", "flag_external_catalog_match", "automated_vetting_status", "needs_manual_review")


@query("""SELECT catalog, label, count(*) AS n FROM (SELECT 'eb' AS catalog, eb_status AS label FROM classified UNION ALL SELECT 'vsx', vsx_status FROM classified UNION ALL SELECT 'simbad', simbad_status FROM classified UNION ALL SELECT 'flag', external_false_positive_flag FROM classified) GROUP BY ALL""")
def external_summary(spark, d):
    return vetting.external_summary(vetting.classify_external(external_of(spark, d)))


@query("""SELECT e.event_id, CASE WHEN b.id IS NOT NULL THEN 'matched' ELSE 'not_found' END AS eb_status, b.id AS eb_match_id, round(b.sep, 3) AS eb_sep_arcsec, CASE WHEN v.id IS NOT NULL THEN 'matched' ELSE 'not_found' END AS vsx_status,
p.name AS vsx_match_name, CASE v.id % 2 WHEN 0 THEN 'EA' WHEN 1 THEN 'M' END AS vsx_type, v.id AS simbad_match_id, CASE WHEN b.id IS NOT NULL OR v.id % 2 = 0 THEN 'possible_eclipsing_binary_match' WHEN v.id IS NOT NULL THEN 'known_variable_match' ELSE 'no_external_match' END AS external_false_positive_flag
FROM events0 e JOIN stars ON stars.id = e.star LEFT JOIN wide b ON b.star = e.star LEFT JOIN close v ON v.star = e.star LEFT JOIN pool p ON p.id = v.id""")
def external_check(spark, d):
    e = events_of(spark, d).select("star", "event_time", "event_id")
    stars = view(spark, d, "stars").select(F.col("id").alias("star"), "ra", "dec")
    e = e.join(stars.select("star"), "star", "left_semi")
    pool = view(spark, d, "pool").select("id", "ra", "dec", "name", F.when(F.col("id") % 2 == 0, "EA").otherwise("M").alias("type"))
    out = vetting.check_external(e, stars, pool, pool, pool, RADIUS)
    return out.select("event_id", "eb_status", "eb_match_id", F.round("eb_sep_arcsec", 3).alias("eb_sep_arcsec"), "vsx_status", "vsx_match_name", "vsx_type", "simbad_match_id", "external_false_positive_flag")


@query("SELECT event_id, round(quality_score, 6) AS quality_score, round(final_candidate_score, 6) AS final_candidate_score FROM scored")
def quality_and_final_score(spark, d):
    return rounded(scored_of(spark, d).select("event_id", "quality_score", "final_candidate_score"))


SUMMARY = "star, target_name, sample_role, n_events, n_pass, round(max_score, 6) AS max_score, round(max_snr, 6) AS max_snr, round(median_snr, 6) AS median_snr, round(max_depth_ppm, 3) AS max_depth_ppm, round(first_event_time, 6) AS first_event_time, round(last_event_time, 6) AS last_event_time, recommended_review_priority"


@query(f"SELECT {SUMMARY} FROM summary")
def star_summary(spark, d):
    frame = consolidate.star_summary(scored_of(spark, d), MANY)
    return spark.sql(f"SELECT {SUMMARY} FROM {{frame}}", frame=frame)


@query("SELECT star, sample_role, target_name, n_events FROM summary WHERE n_events >= 3")
def overtriggered_stars(spark, d):
    return consolidate.overtriggered(scored_of(spark, d), MANY)


@query("SELECT star, event_id, round(final_candidate_score, 6) AS final_candidate_score, round(local_snr, 6) AS local_snr, automated_vetting_status FROM ranked WHERE k = 1")
def top_event_per_star(spark, d):
    return rounded(consolidate.top_event(scored_of(spark, d), strict_row=True).select("star", "event_id", "final_candidate_score", "local_snr", "automated_vetting_status"))


@query("SELECT star, first(event_id ORDER BY k) AS event_id, round(first(egress_ingress_ratio ORDER BY k) FILTER (egress_ingress_ratio IS NOT NULL), 5) AS egress_ingress_ratio FROM ranked GROUP BY star")
def top_event_composite(spark, d):
    return rounded(consolidate.top_event(scored_of(spark, d)).select("star", "event_id", "egress_ingress_ratio"), 5)


@query("SELECT star, event_id, recommended_review_priority FROM ranked JOIN (SELECT star, recommended_review_priority FROM summary) USING (star) WHERE k <= 3")
def review_priority(spark, d):
    return consolidate.review_priority(scored_of(spark, d), 3, MANY).select("star", "event_id", "recommended_review_priority")


@query("SELECT event_id, star FROM vetted WHERE automated_vetting_status = 'pass'")
def pass_candidates(spark, d):
    return consolidate.pass_candidates(vetted_of(spark, d)).select("event_id", "star")


def inspection_of(spark, d):
    e = scored_of(spark, d)
    return consolidate.inspection_list(e, consolidate.star_summary(e, MANY), consolidate.overtriggered(e, MANY))


INSPECTION = """SELECT event_id, star, string_agg(reason, ',' ORDER BY reason) AS inspection_reason, min(CASE reason WHEN 'pass_vetting' THEN 0 WHEN 'medium_priority' THEN 1 WHEN 'overtriggered_top5' THEN 2 ELSE 3 END)::INT AS sort_category FROM (
SELECT event_id, star, 'medium_priority' AS reason FROM ranked JOIN (SELECT star FROM summary WHERE recommended_review_priority = 'medium') USING (star) WHERE k <= 5
UNION ALL SELECT event_id, star, 'pass_vetting' FROM ranked WHERE automated_vetting_status = 'pass' UNION ALL SELECT event_id, star, 'target_top_event' FROM ranked WHERE sample_role = 'target' AND k = 1
UNION ALL SELECT event_id, star, 'overtriggered_top5' FROM ranked JOIN (SELECT star FROM summary WHERE n_events >= 3 ORDER BY n_events DESC, star LIMIT 5) USING (star) WHERE k <= 5) GROUP BY event_id, star"""


@query(INSPECTION)
def inspection_list(spark, d):
    return inspection_of(spark, d).select("event_id", "star", "inspection_reason", "sort_category")


@query(f"SELECT scored.star, target_name, sample_role, round(event_time, 6) AS event_time, round(depth_ppm, 3) AS depth_ppm, round(local_snr, 6) AS local_snr, inspection_reason, {', '.join(f"'' AS {c}" for c in consolidate.MANUAL)} FROM scored JOIN ({INSPECTION}) USING (event_id)")
def disposition_template(spark, d):
    out = consolidate.disposition_template(inspection_of(spark, d), ("star", "target_name", "sample_role", "event_time", "depth_ppm", "local_snr", "inspection_reason"))
    return out.withColumns({c: F.round(c, n) for c, n in (("event_time", 6), ("depth_ppm", 3), ("local_snr", 6))})


@query(f"""SELECT star, n_events, n_pass, target_name, sample_role, (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest(string_split(all_reasons, ',')) AS x)) AS reasons, round(max_score, 6) AS max_score FROM (
SELECT scored.star, count(*) AS n_events, count(*) FILTER (automated_vetting_status = 'pass') AS n_pass, any_value(target_name) AS target_name, any_value(sample_role) AS sample_role, string_agg(inspection_reason, ',') AS all_reasons, max(final_candidate_score) AS max_score
FROM scored JOIN (SELECT event_id, inspection_reason FROM ({INSPECTION})) USING (event_id) GROUP BY scored.star)""")
def gallery_metadata(spark, d):
    """The JSON objects, read again so that their values can be compared."""
    kind = "star long, target_name string, sample_role string, n_events long, reasons array<string>, n_pass long, max_score double"
    m = consolidate.gallery_metadata(inspection_of(spark, d)).select("star", F.from_json("metadata", kind).alias("m"))
    return m.select("star", "m.n_events", "m.n_pass", "m.target_name", "m.sample_role", F.array_join("m.reasons", ",").alias("reasons"), F.round("m.max_score", 6).alias("max_score"))


@query("SELECT sample_role, least(floor(final_candidate_score * 14), 13)::INT AS bin, count(*) AS n FROM scored GROUP BY ALL")
def score_histogram(spark, d):
    return consolidate.histogram(scored_of(spark, d), "final_candidate_score", 0.0, 1.0, 14, "sample_role")


@query("SELECT recommended_review_priority, sample_role, count(*) AS n FROM summary GROUP BY ALL")
def priority_by_role(spark, d):
    return consolidate.star_summary(scored_of(spark, d), MANY).groupBy("recommended_review_priority", "sample_role").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, e.event_type, n.n_name AS target_name, coalesce(n.n_regionkey, -1) AS region FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 30")
def attach_status(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 30).cast("int").alias("key"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("target_name"), F.col("n_regionkey").alias("region"), F.lit("x").alias("event_type"))
    return consolidate.attach_new(e, n, "key", "target_name").drop("key").withColumn("region", F.coalesce("region", F.lit(-1)))


# ---- scans and rates ------------------------------------------------------------------------------------


def pairs_of(spark, d):
    ids = lc_of(spark, d).select((F.col("star") - F.col("star") % 2).alias("id")).distinct()
    return ids.select(F.expr("id div 2").alias("pair_id"), F.col("id").alias("target_id"), F.concat(F.lit("star-"), F.col("id").cast("string")).alias("target_name"), (F.col("id") + 1).alias("control_id"))


def status_of(spark, d):
    e, ok = table(spark, d, "events"), F.col("event_type") != "error"
    return e.select(F.col("user_id").alias("star"), F.when(F.col("user_id") % 2 == 0, "target").otherwise("control").alias("sample_role"), ok.alias("success"), F.when(ok, F.col("event_id") % 4).otherwise(0).alias("n_candidates"), F.expr("unix_micros(cast(ts as timestamp))").alias("scan_timestamp"))


@query("""SELECT pair_id * 2 AS seq, target_id AS star, 'target' AS sample_role, pair_id, target_name AS star_name FROM pairs WHERE target_id <> 0 UNION ALL SELECT pair_id * 2 + 1, control_id, 'control', pair_id, 'TIC ' || control_id FROM pairs""")
def scan_plan(spark, d):
    return scans.scan_plan(pairs_of(spark, d))


@query("""SELECT star, sample_role FROM (SELECT target_id AS star, 'target' AS sample_role FROM pairs WHERE target_id <> 0 UNION ALL SELECT control_id, 'control' FROM pairs) WHERE star NOT IN (SELECT star FROM latest WHERE success)""")
def scan_resume(spark, d):
    """What is left where a scan's last attempt at a star failed."""
    return scans.still_to_do(scans.scan_plan(pairs_of(spark, d)), scans.latest_status(status_of(spark, d))).select("star", "sample_role")


@query("SELECT star, success, n_candidates, scan_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY star ORDER BY scan_timestamp DESC, success DESC) AS k FROM status) WHERE k = 1")
def scan_status_latest(spark, d):
    return scans.latest_status(status_of(spark, d)).select("star", "success", "n_candidates", "scan_timestamp")


@query("""SELECT count(*) FILTER (sample_role = 'target' AND success) AS targets_scanned, count(*) FILTER (sample_role = 'control' AND success) AS controls_scanned, count(*) FILTER (sample_role = 'target' AND NOT success) AS targets_failed,
count(*) FILTER (sample_role = 'control' AND NOT success) AS controls_failed, sum(n_candidates) FILTER (sample_role = 'target')::BIGINT AS target_candidates, sum(n_candidates) FILTER (sample_role = 'control')::BIGINT AS control_candidates FROM status""")
def run_summary(spark, d):
    return scans.run_summary(status_of(spark, d))


@query("SELECT sample_role, count(DISTINCT star) AS n_scanned, list_sort(list(DISTINCT star))::VARCHAR AS stars FROM status WHERE success GROUP BY sample_role")
def scan_metadata(spark, d):
    m = scans.scan_metadata(status_of(spark, d))
    return m.select("sample_role", "n_scanned", F.concat(F.lit("["), F.array_join("stars", ", "), F.lit("]")).alias("stars"))


@query()
def scan_outcomes(spark, d):
    return scans.scan_stars(scans.scan_plan(pairs_of(spark, d)), lc_of(spark, d), window=WINDOW)


@query("""SELECT star, sample_role, pair_id, star_name, true AS attempted, n >= 10 AND n IS NOT NULL AS success, CASE WHEN n IS NULL THEN 'no_data' WHEN n < 10 THEN 'too_few_points:' || n END AS failure_reason, CASE WHEN n >= 10 THEN coalesce(k, 0) ELSE 0 END AS n_candidates
FROM (SELECT target_id AS star, 'target' AS sample_role, pair_id, target_name AS star_name FROM pairs WHERE target_id <> 0 UNION ALL SELECT control_id, 'control', pair_id, 'TIC ' || control_id FROM pairs) plan
LEFT JOIN cadence USING (star) LEFT JOIN (SELECT star, len(scanned) AS k FROM thinned) USING (star)""")
def scan_statuses(spark, d):
    """The log rows of a whole scan: what became of each star of the plan."""
    plan = scans.scan_plan(pairs_of(spark, d))
    return scans.status_rows(scans.scan_stars(plan, lc_of(spark, d), window=WINDOW, fits=False), plan, F.current_timestamp()).drop("scan_timestamp")


YIELD = "SELECT count(*) FILTER (sample_role = 'target') AS target_candidates, count(*) FILTER (sample_role = 'control') AS control_candidates, CAST(0 AS BIGINT) AS unknown_candidates, (SELECT count(DISTINCT target_id) FROM pairs)::DOUBLE AS target_exposure, (SELECT count(DISTINCT control_id) FROM pairs)::DOUBLE AS control_exposure FROM scored"


@query(YIELD)
def yield_by_role(spark, d):
    return rates.yield_by_role(scored_of(spark, d), pairs_of(spark, d)).drop("exposure_source")


@query(f"SELECT *, round(target_candidates / target_exposure, 6) AS target_rate, round(control_candidates / control_exposure, 6) AS control_rate, round((target_candidates / target_exposure) / (control_candidates / control_exposure), 6) AS rate_ratio FROM ({YIELD})")
def rate_ratio_point(spark, d):
    return rounded(rates.rate_point(rates.yield_by_role(scored_of(spark, d), pairs_of(spark, d)).drop("exposure_source")))


@query()
def rate_statistics(spark, d):
    return rates.rate_statistics(rates.yield_by_role(scored_of(spark, d), pairs_of(spark, d)))


# ---- features and ranking ---------------------------------------------------------------------------------


def labelled_of(spark, d):
    """Order lines as injection rows: some values missing, a label, and a fixed score."""
    c = F.col
    rows = table(spark, d, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.when(c("l_linenumber") % 3 != 0, c("l_extendedprice")).alias("depth_ppm"), F.when(c("l_linenumber") % 2 == 0, c("l_quantity")).alias("local_snr"),
        c("l_discount").alias("skewness"), (c("l_linenumber") == 1).alias("edge_event"), (c("l_returnflag") != "N").cast("int").alias("label"), F.round(c("l_tax") * 10, 3).alias("ml_score"),
    )
    return rows


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, round(coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice END, (SELECT median(l_extendedprice) FROM lineitem WHERE l_linenumber % 3 <> 0)), 6) AS depth_ppm,
round(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END, (SELECT median(l_quantity) FROM lineitem WHERE l_linenumber % 2 = 0)), 6) AS local_snr, (l_linenumber = 1)::INT::DOUBLE AS edge_event, 0::DOUBLE AS kurtosis FROM lineitem""")
def feature_impute(spark, d):
    out = ranking.impute(ranking.candidate_features(labelled_of(spark, d)))
    return rounded(out.select("id", "depth_ppm", "local_snr", "edge_event", "kurtosis"))


@query("SELECT count(*) AS n, count(DISTINCT l_returnflag <> 'N') AS classes, count(*) FILTER (l_linenumber % 3 <> 0) AS n_depth_ppm, count(*) FILTER (l_linenumber % 2 = 0) AS n_local_snr, CAST(0 AS BIGINT) AS n_kurtosis FROM lineitem")
def feature_validate(spark, d):
    return ranking.validate(ranking.candidate_features(labelled_of(spark, d))).select("n", "classes", "n_depth_ppm", "n_local_snr", "n_kurtosis")


METRICS = """WITH x AS (SELECT (l_returnflag <> 'N') AS y, round(l_tax * 10, 3) AS s FROM lineitem), g AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM x GROUP BY s),
r AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM g), a AS (SELECT sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS roc, sum(p * tp / (tp + fp)) / sum(p) AS ap FROM r),
c AS (SELECT count(*) FILTER (y AND s >= 0.5) AS tp, count(*) FILTER (NOT y AND s >= 0.5) AS fp, count(*) FILTER (y AND s < 0.5) AS fn, count(*) FILTER (NOT y AND s < 0.5) AS tn FROM x) """


@query(METRICS + "SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(roc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM c, a")
def rank_metrics(spark, d):
    return rounded(ranking.metrics(labelled_of(spark, d)))


@query(METRICS + "SELECT s AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp FROM r")
def rank_curve(spark, d):
    return ranking.curve(labelled_of(spark, d))


@query()
def rank_train_score(spark, d):
    rows = ranking.split(ranking.impute(ranking.candidate_features(labelled_of(spark, d).drop("ml_score"))), ["id"])
    model = ranking.train(rows.filter("not is_test"))
    return ranking.score(model, rows.filter("is_test")).select("id", "label", F.round("ml_score", 6).alias("ml_score"))


@query()
def full_run_statistics(spark, d):
    from .plans.pipeline import run

    return run(lc_of(spark, d), pairs_of(spark, d), window=WINDOW, many=MANY).statistics


@query("""SELECT star, w * 432000000000 AS "start", (w + 1) * 432000000000 AS "end", n, round(base - least, 9) AS depth, round(noise, 9) AS noise FROM (SELECT star, w, count(*) AS n, any_value(base) AS base, min(flux) AS least, 1.4826 * median(abs(flux - base)) AS noise
FROM (SELECT *, median(flux) OVER (PARTITION BY star, w) AS base FROM (SELECT user_id AS star, epoch_us(ts) // 432000000000 AS w, 1 - value / 1000e0 AS flux FROM events)) GROUP BY star, w)
WHERE noise > 0 AND base - least >= 4 * noise AND (w + 1) * 432000000000 <= (SELECT max(epoch_us(ts)) FROM events) - 86400000000""")
def stream_window_dips(spark, d):
    """The stream of events run to its end, written as a table and read again: windows that the watermark has closed."""
    import uuid

    from .lineage import shared
    from .streaming.scan import read_samples, window_dips

    folder = f"{shared(spark)}/dips-{uuid.uuid4().hex}"
    out = window_dips(read_samples(spark, f"{d}/events*.parquet")).writeStream.format("parquet").outputMode("append")
    q = out.option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("star long, start timestamp, end timestamp, n long, depth double, noise double").parquet(f"{folder}/rows")
    return rows.select("star", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", F.round("depth", 9).alias("depth"), F.round("noise", 9).alias("noise"))


# ---- samples and sheets -----------------------------------------------------------------------------------


@query("""SELECT events0.event_id, coalesce(pool.ra, stars.ra) AS ra, coalesce(pool.dec, stars.dec) AS "dec" FROM events0 LEFT JOIN stars ON stars.id = star LEFT JOIN pool ON pool.id = star""")
def attach_coords(spark, d):
    from .operators import review

    one, two = (view(spark, d, n).select(F.col("id").alias("star"), "ra", "dec") for n in ("stars", "pool"))
    return review.attach_positions(events_of(spark, d).select("event_id", "star"), one, two).select("event_id", "ra", "dec")


@query("SELECT event_id, coalesce(c_name, 'TIC ' || star) AS star_name FROM events0 LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = star")
def attach_names(spark, d):
    from .operators import review

    names = table(spark, d, "customer").select(F.col("c_custkey").alias("star"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"))
    return review.attach_names(events_of(spark, d).select("event_id", "star"), names).select("event_id", "star_name")


@query("""SELECT event_id, printf('depth %.0f ppm', depth_ppm) || chr(10) || printf('S/N %.1f', local_snr) || coalesce(chr(10) || 'flags: ' || nullif(concat_ws(', ', CASE WHEN flag_low_snr THEN 'low_snr' END, CASE WHEN flag_edge_event THEN 'edge_event' END,
CASE WHEN flag_single_point_like THEN 'single_point_like' END, CASE WHEN flag_likely_flare_shape THEN 'likely_flare_shape' END, CASE WHEN flag_low_delta_chi2 THEN 'low_delta_chi2' END, CASE WHEN flag_poor_asymmetry_fit THEN 'poor_asymmetry_fit' END), ''), '') AS annotation FROM vetted""")
def event_annotation(spark, d):
    from .operators import review

    return review.annotation(vetted_of(spark, d)).select("event_id", "annotation")


@query("SELECT star, event_id, automated_vetting_status, '' AS manual_disposition FROM scored")
def vetting_sheet(spark, d):
    from .operators import review

    return review.vetting_sheet(scored_of(spark, d)).select("star", "event_id", "automated_vetting_status", "manual_disposition")


@query(f"""WITH t AS ({TARGETS}), c AS ({CONTROLS}), k AS (SELECT c.id, t.id AS target_id, row_number() OVER (PARTITION BY t.id ORDER BY abs(c.tmag - t.tmag), c.id) AS k FROM t JOIN c ON abs(c.tmag - t.tmag) <= 0.5 AND c.teff BETWEEN greatest(t.teff - 300, 2500) AND t.teff + 300)
SELECT id, min(target_id) AS target_id FROM k WHERE k <= 3 GROUP BY id""")
def range_scan(spark, d):
    from .plans import samples

    t, c = photometry(table(spark, d, "customer"), "c_custkey", "c_acctbal"), photometry(table(spark, d, "supplier"), "s_suppkey", "s_acctbal")
    return samples.range_scan(t, c, each=3).select("id", "target_id")


@query("""SELECT c_name AS target_name, CASE WHEN c_custkey % 2 = 0 THEN 'cotten_song_2016' ELSE 'chen_2014' END AS source_catalog, round((c_custkey * 137.508::DOUBLE) % 360, 6) AS ra_deg, round((c_custkey * 53.13::DOUBLE) % 160 - 80, 6) AS dec_deg, 'target' AS sample_role
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def target_sample(spark, d):
    from .plans import samples

    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    one = c.filter(k % 2 == 0).select(F.col("c_name").alias("name"), ((k * 137.508) % 360).alias("ra"), ((k * 53.13) % 160 - 80).alias("dec"), k.alias("tic"))
    two = c.filter(k % 3 == 0).select(F.col("c_name").alias("Star"), ((k * 137.508) % 360).cast("string").alias("RAJ2000"), ((k * 53.13) % 160 - 80).cast("string").alias("DEJ2000"))
    out = samples.target_sample({"cotten_song_2016": one, "chen_2014": two})
    return out.select("target_name", "source_catalog", F.round("ra_deg", 6).alias("ra_deg"), F.round("dec_deg", 6).alias("dec_deg"), "sample_role")


@query("SELECT star FROM (SELECT DISTINCT star FROM lc) ORDER BY md5(star || ':42'), star LIMIT 10")
def random_stars(spark, d):
    from .plans import samples

    return samples.some_stars(lc_of(spark, d).select("star").distinct(), 10)


@query("SELECT sample_role, least(floor((tmag + 1) / 11 * 20), 19)::INT AS bin, count(*) AS n FROM (SELECT 'target' AS sample_role, tmag FROM stars UNION ALL SELECT 'control', tmag FROM pool) WHERE tmag BETWEEN -1 AND 10 GROUP BY ALL")
def balance_histogram(spark, d):
    both = view(spark, d, "stars").select(F.lit("target").alias("sample_role"), "tmag").unionByName(view(spark, d, "pool").select(F.lit("control").alias("sample_role"), "tmag"))
    return consolidate.histogram(both, "tmag", -1.0, 10.0, 20, "sample_role")


@query("SELECT sample_role, automated_vetting_status, count(*) AS n FROM scored GROUP BY ALL")
def candidates_by_role(spark, d):
    return scored_of(spark, d).groupBy("sample_role", "automated_vetting_status").agg(F.count("*").alias("n"))


@query("SELECT star, n_events, round(max_score, 6) AS max_score FROM summary ORDER BY max_score DESC, star LIMIT 5")
def top_scores_by_star(spark, d):
    s = consolidate.star_summary(scored_of(spark, d), MANY)
    return rounded(s.orderBy(F.desc("max_score"), "star").limit(5).select("star", "n_events", "max_score"))


# ---- overviews and builds -------------------------------------------------------------------------


@query("SELECT star, round(event_time, 6) AS event_time, flag_low_snr::INT + flag_edge_event::INT + flag_single_point_like::INT + flag_likely_flare_shape::INT + flag_low_delta_chi2::INT + flag_poor_asymmetry_fit::INT AS n_flags FROM vetted")
def event_flag_counts(spark, d):
    return overview.with_flag_count(vetted_of(spark, d)).select("star", F.round("event_time", 6).alias("event_time"), "n_flags")


@query("""SELECT flag, n FROM (SELECT count(*) FILTER (flag_low_snr) AS flag_low_snr, count(*) FILTER (flag_edge_event) AS flag_edge_event, count(*) FILTER (flag_single_point_like) AS flag_single_point_like, count(*) FILTER (flag_likely_flare_shape) AS flag_likely_flare_shape,
count(*) FILTER (flag_low_delta_chi2) AS flag_low_delta_chi2, count(*) FILTER (flag_poor_asymmetry_fit) AS flag_poor_asymmetry_fit, count(*) FILTER (needs_manual_review) AS "any" FROM vetted) UNPIVOT (n FOR flag IN (flag_low_snr, flag_edge_event, flag_single_point_like, flag_likely_flare_shape, flag_low_delta_chi2, flag_poor_asymmetry_fit, "any"))""")
def flag_totals(spark, d):
    return overview.flag_totals(vetted_of(spark, d))


@query("SELECT target_name AS label, round(local_snr, 6) AS local_snr, round(final_candidate_score, 6) AS score, automated_vetting_status AS status FROM scored WHERE local_snr IS NOT NULL AND final_candidate_score IS NOT NULL")
def score_snr_points(spark, d):
    return rounded(overview.score_points(scored_of(spark, d)))


@query("""SELECT recommended_review_priority, CAST(least(floor((x - low) / (high - low) * 10), 9) AS INT) AS bin, count(*) AS n FROM (SELECT recommended_review_priority, x, CASE WHEN a < b THEN a ELSE a - 0.5 END AS low, CASE WHEN a < b THEN b ELSE b + 0.5 END AS high
FROM (SELECT recommended_review_priority, max_score AS x, min(max_score) OVER (PARTITION BY recommended_review_priority) AS a, max(max_score) OVER (PARTITION BY recommended_review_priority) AS b FROM summary WHERE max_score IS NOT NULL)) GROUP BY ALL""")
def score_histogram_by_priority(spark, d):
    return overview.score_histogram_by_priority(consolidate.star_summary(scored_of(spark, d), MANY))


@query("SELECT count(*) AS n, count(*) FILTER (recovered) AS recovered, round(avg(recovered::INT), 9) AS fraction FROM injections")
def recovery_rate(spark, d):
    return rounded(overview.recovery_rate(view(spark, d, "injections")), 9)


@query("""SELECT star, trial, recovered, round(e.at, 6) AS at, depth_ppm, round(lc.t, 6) AS t, round(flux, 9) AS flux FROM (SELECT *, row_number() OVER (PARTITION BY recovered ORDER BY star, trial) AS k FROM
(SELECT star, 1 AS trial, (first + last) / 2 AS at, 500e0 + star AS depth_ppm, star % 3 = 0 AS recovered FROM span)) e JOIN lc USING (star) WHERE k <= 3 AND lc.t BETWEEN e.at - 2.5 AND e.at + 2.5""")
def recovery_examples(spark, d):
    lc = lc_of(spark, d)
    made = lc.groupBy("star").agg(((F.min("t") + F.max("t")) / 2).alias("at")).select("star", F.lit(1).alias("trial"), "at", (500 + F.col("star")).cast("double").alias("depth_ppm"), (F.col("star") % 3 == 0).alias("recovered"))
    out = overview.example_windows(lc, made, 3, WINDOW)
    return out.select("star", "trial", "recovered", F.round("at", 6).alias("at"), "depth_ppm", F.round("t", 6).alias("t"), F.round("flux", 9).alias("flux"))


@query("SELECT star, product, round(t, 6) AS t, round(flux / median(flux) OVER (PARTITION BY star, product), 9) AS flux FROM (SELECT user_id AS star, event_type AS product, epoch_us(ts) / 86400e6 AS t, 1 - value / 1000e0 AS flux FROM events)")
def lc_stitch(spark, d):
    made = table(spark, d, "events").selectExpr("user_id AS star", "event_type AS product", "unix_micros(cast(ts as timestamp)) / 86400e6D AS t", "1 - value / 1000D AS flux")
    return series.stitch(made).select("star", "product", F.round("t", 6).alias("t"), F.round("flux", 9).alias("flux"))


@query("""SELECT star, round(t, 6) AS event_time, round(depth * 1e6, 4) AS depth_ppm FROM (SELECT peaks.star, peaks.t, CASE WHEN shape.base - minima.flux > 0 THEN shape.base - minima.flux ELSE height END AS depth FROM peaks JOIN thinned ON thinned.star = peaks.star AND list_contains(thinned.first, i)
JOIN minima ON minima.star = peaks.star AND minima.t = peaks.t JOIN shape ON shape.star = peaks.star AND shape.event = peaks.t WHERE peaks.n >= 5 AND shape.n >= 3) QUALIFY row_number() OVER (PARTITION BY star ORDER BY depth DESC, t) = 1""")
def strongest_dip(spark, d):
    best = builds.strongest(detect.first_scan(lc_of(spark, d), min_distance=5, window=WINDOW))
    return best.select("star", F.round("event_time", 6).alias("event_time"), F.round("depth_ppm", 4).alias("depth_ppm"))


@query()
def single_star_control(spark, d):
    """The whole control run, of every star: stitched, cleaned, scanned by the first detector, its strongest events."""
    made = table(spark, d, "events").selectExpr("user_id AS star", "event_type AS product", "unix_micros(cast(ts as timestamp)) / 86400e6D AS t", "1 - value / 1000D AS flux")
    return builds.control_run(made, window=WINDOW)["strongest"].select("star", "event_time", "depth_ppm", "n_points_window")


@query("SELECT star, max(sample_role) AS sample_role FROM (SELECT o_custkey AS star, 'target' AS sample_role FROM orders UNION ALL SELECT l_suppkey, 'control' FROM lineitem) GROUP BY star")
def stars_to_scan(spark, d):
    pairs = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "full").select(F.col("o_custkey").alias("target_id"), F.col("l_suppkey").alias("control_id"))
    return builds.stars_to_scan(pairs)


@query("""SELECT c_custkey AS tic_id, c_acctbal::DOUBLE AS tmag, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(c_acctbal::DOUBLE + c_nationkey - c_acctbal::DOUBLE / 2, 6) END AS bp_rp, round((c_custkey * 137.508::DOUBLE) % 360, 6) AS ra_deg FROM customer WHERE c_custkey % 7 <> 0""")
def remote_catalog_rows(spark, d):
    made = table(spark, d, "customer").selectExpr(
        "concat('TIC ', c_custkey) AS ID", "cast(c_acctbal AS string) AS Tmag", "'nan' AS bp_rp", "(c_custkey * 137.508D) % 360 AS ra", "if(c_custkey % 7 = 0, 'n/a', '1.5') AS dec",
        "c_acctbal + c_nationkey AS gaiabp", "if(c_custkey % 3 = 0, null, c_acctbal / 2) AS gaiarp")
    out = catalogs.query_rows(made)
    return out.select("tic_id", "tmag", F.round("bp_rp", 6).alias("bp_rp"), F.round("ra_deg", 6).alias("ra_deg"))
