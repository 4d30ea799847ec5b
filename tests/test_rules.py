import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faintdip.functions.scores import final_score, quality_score
from faintdip.operators import consolidate, ranking, rates, vetting
from faintdip.plans import scans


def vetted(spark):
    rows = [(1, 3.0, 0.8, 0.5, 2.0, False, False), (2, 6.0, 2.5, -0.3, 20.0, False, False), (3, 8.0, 3.0, -0.8, 50.0, False, False), (4, 1.5, 0.5, 0.7, 1.0, True, False), (5, 5.5, 1.0, 0.0, 5.5, False, True), (6, None, None, None, float("nan"), None, False)]
    return vetting.vetting_flags(spark.createDataFrame(rows, "event_id long, local_snr double, egress_ingress_ratio double, skewness double, delta_chi2 double, edge_event boolean, single_point_like boolean"))


def test_vetting_flags(spark):
    got = {r["event_id"]: r for r in vetted(spark).collect()}
    which = lambda n: {k for k, r in got.items() if r[n]}
    assert which("flag_low_snr") == {1, 4}
    assert which("flag_likely_flare_shape") == {1, 4}
    assert which("flag_low_delta_chi2") == {1, 4}
    assert which("flag_poor_asymmetry_fit") == {5, 6}
    assert which("flag_edge_event") == {4, 6}
    assert {k for k, r in got.items() if r["automated_vetting_status"] == "pass"} == {2, 3}
    no_snr = vetting.vetting_flags(spark.createDataFrame([(1,)], "event_id long")).first()
    assert no_snr["flag_low_snr"] and not no_snr["flag_low_delta_chi2"]


def test_vetting_summary_of_nothing(spark):
    got = {r["metric"]: r["value"] for r in vetting.vetting_summary(vetted(spark).limit(0)).collect()}
    assert got["n_total"] == 0 and got["fraction_pass"] is None


def test_external_precedence(spark):
    cols = "eb_status string, eb_match_id string, eb_sep_arcsec double, vsx_status string, vsx_match_name string, vsx_type string, vsx_sep_arcsec double, simbad_status string, simbad_main_id string, simbad_otype string, simbad_sep_arcsec double, automated_vetting_status string, needs_manual_review boolean"
    no = ("not_found", None, None)
    rows = [
        ("matched", "5", 1.0, "matched", "v", "M", 1.0, "matched", "s", "EB*", 1.0), (*no, "matched", "v", "EA/SD", 1.0, "matched", "s", "EB*", 1.0), (*no, "matched", "v", "", 1.0, *no, None),
        (*no, *no, None, "matched", "s", "V*", None), (*no, "failed", None, None, None, *no, None), (*no, *no, None, "matched", "s", "Star", 1.0),
    ]
    out = vetting.demote(vetting.classify_external(spark.createDataFrame([(*r, "pass", False) for r in rows], cols))).collect()
    assert [r["external_false_positive_flag"] for r in out] == [vetting.POSSIBLE_EB, vetting.POSSIBLE_EB, vetting.KNOWN_VARIABLE, vetting.PROBLEMATIC, vetting.CHECK_FAILED, vetting.NO_MATCH]
    assert [r["automated_vetting_status"] for r in out] == ["flagged"] * 4 + ["pass"] * 2
    assert out[3]["external_vetting_notes"] == "SIMBAD: s otype=V* (variable star (generic)) (?)"


def test_scores(spark):
    q = quality_score(F.lit(29.54), F.lit(None).cast("double"), F.lit(float("nan")), F.lit(False), F.lit(False))
    s = final_score(F.lit(0.92270243), F.lit(0.71714285), F.lit(29.54), F.lit(False), F.lit(False))
    assert tuple(spark.range(1).select(q, s).first()) == (pytest.approx(0.45), pytest.approx(0.84820836))


def events(spark):
    rows = [
        (1, 1, 10.0, "a", "target", "pass", 0.9, 9.0, None), (1, 2, 11.0, "a", "target", "flagged", None, 20.0, None), (2, 3, 5.0, "b", "control", "flagged", 0.7, 3.0, None), (2, 4, 6.0, "b", "control", "flagged", 0.7, 4.0, None),
        *((3, 10 + i, float(i), "c", "control", "flagged", 0.1 * i, 1.0, None) for i in range(5)), (4, 20, 1.0, "d", "target", "pass", 0.2, 1.0, "known_variable_match"), (None, 30, 1.0, "e", "target", "pass", 0.2, 1.0, None), (5, 40, 1.0, None, None, "flagged", 0.1, 1.0, None),
    ]
    return spark.createDataFrame(rows, "star long, event_id long, event_time double, target_name string, sample_role string, automated_vetting_status string, final_candidate_score double, local_snr double, external_false_positive_flag string")


def test_star_summary_and_priorities(spark):
    got = {r["star"]: r for r in consolidate.star_summary(events(spark)).collect()}
    assert {k: r["recommended_review_priority"] for k, r in got.items()} == {1: "high", 2: "medium", 3: "overtriggered_review", 4: "medium", 5: "low"}
    assert got[1]["median_snr"] == 14.5 and got[5]["target_name"] == "TIC 5" and got[5]["sample_role"] == "unknown"
    assert [r["star"] for r in consolidate.overtriggered(events(spark)).collect()] == [3]


def test_top_events(spark):
    got = {r["star"]: r for r in consolidate.top_event(events(spark)).collect()}
    assert got[1]["event_id"] == 1 and got[2]["event_id"] == 4
    assert {r["star"]: r["event_id"] for r in consolidate.top_event(events(spark), strict_row=True).collect()}[2] == 4
    assert consolidate.review_priority(events(spark), 3).filter("star = 3").count() == 3


def test_inspection_list_merges_reasons(spark):
    e = events(spark).filter("star is not null")
    got = {r["event_id"]: (r["inspection_reason"], r["sort_category"]) for r in consolidate.inspection_list(e, consolidate.star_summary(e), consolidate.overtriggered(e)).collect()}
    assert got[1] == ("pass_vetting,target_top_event", 0)
    assert got[3] == ("medium_priority", 1) and got[10] == ("overtriggered_top5", 2)
    assert got[20] == ("medium_priority,pass_vetting,target_top_event", 0)


def test_garwood_contains_the_count():
    for n in range(10):
        low, high = rates.poisson_interval(n)
        assert low <= n <= high
    low, high = rates.poisson_interval(57, 28)
    assert (low, high) == (pytest.approx(1.541830120, abs=1e-8), pytest.approx(2.637503979, abs=1e-8))


def test_rate_ratio_and_fisher():
    r = rates.rate_ratio(57, 28, 99, 28)
    assert (r["ratio"], r["ratio_low"], r["ratio_high"]) == (pytest.approx(0.57575757, abs=1e-7), pytest.approx(0.35818153, abs=1e-7), pytest.approx(0.91782236, abs=1e-7))
    assert rates.rate_ratio(3, 10, 0, 10)["ratio"] is None
    assert rates.fisher(0, 28, 3, 25)[1] == pytest.approx(0.2363636, abs=1e-6)


def test_rate_statistics(spark):
    y = spark.createDataFrame([(57, 99, 0, 28.0, 28.0), (0, 0, 0, 1.0, 1.0)], "target_candidates long, control_candidates long, unknown_candidates long, target_exposure double, control_exposure double")
    a, b = sorted(rates.rate_statistics(y).collect(), key=lambda r: -r["target_candidates"])
    assert a["n_finite"] == 1000 and 0.3 < a["bootstrap_low"] < a["bootstrap_median"] < a["bootstrap_high"] < 0.95 and a["warning"] is None
    assert b["ratio"] is None and b["bootstrap_median"] is None and b["warning"].startswith("unstable")


def test_yield_by_role_from_pairs(spark):
    e = spark.createDataFrame([(1,), (1,), (2,), (9,)], "star long")
    p = spark.createDataFrame([(1, 2), (3, None)], "target_id long, control_id long")
    r = rates.yield_by_role(e, p).first()
    assert (r["target_candidates"], r["control_candidates"], r["unknown_candidates"], r["target_exposure"], r["control_exposure"]) == (2, 1, 1, 2.0, 1.0)


def test_scan_plan_resume_and_status(spark):
    pairs = spark.createDataFrame([(1, 5, "x", 6), (2, 5, "x", 0), (3, None, None, 7)], "pair_id long, target_id long, target_name string, control_id long")
    plan = scans.scan_plan(pairs)
    assert [(r["star"], r["sample_role"]) for r in plan.orderBy("seq").collect()] == [(5, "target"), (6, "control"), (7, "control")]
    t = [float(i) for i in range(40)]
    lc = spark.createDataFrame([(5, x, 1.0 + (i % 3) * 1e-4 - (0.5 if i == 20 else 0)) for i, x in enumerate(t)] + [(6, x, 1.0) for x in t[:3]], "star long, t double, flux double")
    out = scans.scan_stars(plan, lc, fits=False)
    status = {r["star"]: r for r in scans.status_rows(out, plan, F.lit(1)).collect()}
    assert status[5]["success"] and status[5]["n_candidates"] == 1
    assert status[6]["failure_reason"] == "too_few_points:3" and status[7]["failure_reason"] == "no_data"

    def broken(*_):
        raise KeyError("x")

    assert scans.scan_stars(plan, lc, detector=broken).filter("star = 5").first()["status"] == "detector_failed:KeyError"
    log = spark.createDataFrame([(5, False, 1), (5, True, 2), (6, False, 3)], "star long, success boolean, scan_timestamp long")
    assert {r["star"]: r["success"] for r in scans.latest_status(log).collect()} == {5: True, 6: False}
    assert sorted(r["star"] for r in scans.still_to_do(plan, log).collect()) == [6, 7]


def test_imputation_and_features(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 0), (None, 1)], "depth_ppm double, label int")
    out = ranking.impute(ranking.candidate_features(df)).toPandas()
    assert sorted(out.depth_ppm) == [1.0, 2.0, 3.0] and (out["kurtosis"] == 0).all()
    assert not set(ranking.FEATURES) & set(ranking.TRUTH)
    rec = spark.createDataFrame([(True, 5.0, 1.0), (False, None, None)], "recovered boolean, recovered_depth_ppm double, recovered_snr double")
    assert ranking.training_features(rec).select("label", "depth_ppm").collect()[0] == (1, 5.0)


def test_ranker_and_metrics(spark):
    rows = [(i, float(i % 2 * 500 + i), float(i % 2 * 5 + i % 7), i % 2) for i in range(60)]
    df = ranking.impute(ranking.candidate_features(spark.createDataFrame(rows, "id long, depth_ppm double, local_snr double, label int")))
    parts = ranking.split(df, ["id"]).cache()
    assert parts.filter("is_test").count() == 14
    model = ranking.train(parts.filter("not is_test"))
    scored = ranking.score(model, parts.filter("is_test"))
    m = ranking.metrics(scored).first()
    assert m["roc_auc"] > 0.9 and 0 <= m["average_precision"] <= 1
    assert ranking.importances(model)[0][1] > 0
    with pytest.raises(ValueError):
        ranking.train(parts.filter("label = 1"))


def test_metrics_with_ties(spark):
    pdf = pd.DataFrame({"label": [1, 0, 1, 0, 1], "ml_score": [0.9, 0.9, 0.5, 0.4, 0.2]})
    m = ranking.metrics(spark.createDataFrame(pdf)).first()
    pairs = [(a, b) for a, y in zip(pdf.ml_score, pdf.label) if y for b, z in zip(pdf.ml_score, pdf.label) if not z]
    assert m["roc_auc"] == pytest.approx(sum(1 if a > b else 0.5 if a == b else 0 for a, b in pairs) / len(pairs))
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (2, 1, 1, 1)
    one = ranking.metrics(spark.createDataFrame(pdf[pdf.label == 1])).first()
    assert one["roc_auc"] is None and math.isclose(one["recall"], 2 / 3)


def test_histogram_closes_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.1,), (None,)], "x double")
    assert {r["bin"]: r["n"] for r in consolidate.histogram(df, "x", 0, 1, 2).collect()} == {0: 1, 1: 2}


def test_fisher_by_tails():
    """The sum over all tables no likelier, and a table too large to go through."""
    import math
    import random

    from faintdip.operators.rates import fisher

    def all_tables(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        log = lambda k: math.log(math.comb(row, k)) + math.log(math.comb(n - row, col - k)) - math.log(math.comb(n, col))
        return sum(math.exp(log(k)) for k in range(max(0, col - (n - row)), min(row, col) + 1) if log(k) <= log(a) + 1e-7)

    rng = random.Random(2)
    for _ in range(300):
        t = [rng.randrange(rng.choice([3, 15, 60])) for _ in range(4)]
        if sum(t):
            assert abs(fisher(*t)[1] - min(1.0, all_tables(*t))) < 1e-9, t
    assert 0.5 < fisher(10**7, 9 * 10**7, 10**7 + 3000, 9 * 10**7)[1] < 0.55


def test_subsets_have_draws_of_their_own(spark):
    from faintdip.operators.rates import rate_statistics

    row = (30, 20, 0, 100.0, 100.0)
    df = spark.createDataFrame([(*row, "all"), (*row, "pass")], "target_candidates long, control_candidates long, unknown_candidates long, target_exposure double, control_exposure double, subset string")
    a, b = (rate_statistics(df.filter(f"subset = '{s}'")).first() for s in ("all", "pass"))
    assert a["bootstrap_low"] != b["bootstrap_low"] and a["ratio"] == b["ratio"]
    assert rate_statistics(df).filter("subset = 'all'").first() == a
