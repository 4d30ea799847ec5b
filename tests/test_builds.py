import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from faintdip.operators import catalogs, detect, overview, ranking, series
from faintdip.plans import builds, samples
from faintdip.sources import tables


def test_stars_to_scan(spark):
    pairs = spark.createDataFrame([("1", "TIC 2"), ("2", "3"), (None, "x")], "target_id string, control_id string")
    got = {r["star"]: r["sample_role"] for r in builds.stars_to_scan(pairs).collect()}
    assert got == {1: "target", 2: "target", 3: "control"}
    empty, t, c = pairs.limit(0), spark.createDataFrame([(7,)], "tic_id long"), spark.createDataFrame([(7,), (8,)], "tic_id long")
    assert {tuple(r) for r in builds.stars_to_scan(empty, t, c).collect()} == {(7, "target"), (8, "control")}
    assert {tuple(r) for r in builds.stars_to_scan(pairs, t, c, only="control").collect()} == {(7, "control"), (8, "control")}
    with pytest.raises(ValueError):
        builds.stars_to_scan()
    with pytest.raises(ValueError):
        builds.stars_to_scan(pairs, only="both")


def test_control_build(spark, tmp_path):
    targets = spark.createDataFrame([(1, 8.0, 1.0, 5000.0, 10.0), (2, 12.0, 1.0, 5000.0, 10.0)], "id long, tmag double, bp_rp double, teff double, parallax double")
    raw = spark.createDataFrame([("TIC 11", "8.1", "1.1", "5100", "11", "1", "2", "yes"), ("12", "8.2", "1.0", "4900", "10", "1", "2", "true"), ("13", "20", "1", "5000", "10", "1", "2", "true")], "TIC string, Tmag string, bp_rp string, teff string, plx string, ra string, dec string, has_data string")
    got = builds.control_build(targets, raw, str(tmp_path / "dry"), ratio=2, dry_run=True)
    assert builds.counts(got) == {"control_pool": 3, "control_sample": 2, "matched_pairs": 2} and not (tmp_path / "dry").exists()
    got = builds.control_build(targets, raw, str(tmp_path / "out"))
    assert [r["target_id"] for r in got["matched_pairs"].collect()] == [1]
    assert tables.read_csv(spark, str(tmp_path / "out/control_pool")).count() == 3 and tables.read_csv(spark, str(tmp_path / "out/matched_pairs")).count() == 1
    assert builds.control_build(targets, None) == {} and builds.control_build(targets.limit(0), raw) == {}
    with pytest.raises(ValueError):
        builds.control_build(targets, raw, ratio=0)


def test_schemas(spark):
    df = spark.createDataFrame([], "target_id long, control_id long, match_quality_score double, RA double, DE double")
    assert builds.looks_like_pairs(df) and builds.has_coordinates(df)
    assert not builds.looks_like_pairs(df.drop("control_id")) and not builds.has_coordinates(df.drop("DE"))


def test_pipe_targets(spark, tmp_path):
    cells = [f"c{i}" for i in range(17)]
    cells[0], cells[2], cells[4], cells[6], cells[7], cells[11] = "HD 1", "01 30 00 -10 30 00", "6000", "x", "", "12.5"
    heading = ["Name", *cells[1:]]
    (tmp_path / "t.txt").write_text("\n".join(["# note", "-" * 30, "|".join(heading), "|".join(cells), "|".join(["", *cells[1:]]), "|".join(["HD 2", "", "1 2 3 4 5", *cells[3:]]), "HD 3|short"]) + "\n")
    got = {r["target_name"]: r for r in tables.read_pipe_targets(spark, str(tmp_path / "t.txt"), "cat").collect()}
    assert set(got) == {"HD 1", "HD 2"}
    one = got["HD 1"]
    assert (one["ra_deg"], one["dec_deg"], one["teff_catalog"], one["disk_temperature"], one["disk_radius"], one["distance_pc"], one["reference"]) == (22.5, -10.5, 6000.0, None, None, 12.5, "c16")
    assert got["HD 2"]["ra_deg"] is None and got["HD 2"]["dec_deg"] is None
    # a web page in place of the CSV gives way to the text table, as does a missing or empty one
    (tmp_path / "page.csv").write_text("<!DOCTYPE html>\n<HTML><body>a,b</body></html>\n")
    (tmp_path / "empty.csv").write_text("name,ra,dec\n")
    (tmp_path / "real.csv").write_text("name,ra,dec\nB,1,2\nA,3,4\n")
    names = lambda csv, **k: [r["target_name"] for r in tables.local_targets(spark, str(tmp_path / csv), str(tmp_path / "t.txt"), "cat", **k).collect()]
    assert names("page.csv") == names("none.csv") == names("empty.csv") == ["HD 1", "HD 2"]
    assert names("real.csv") == ["A", "B"] and names("real.csv", most=1) == ["A"]
    with pytest.raises(FileNotFoundError):
        tables.local_targets(spark, str(tmp_path / "page.csv"), str(tmp_path / "none.txt"), "cat")
    with pytest.raises(ValueError):
        names("real.csv", most=0)


def test_siblings(spark, tmp_path):
    events = str(tmp_path / "vetted_candidate_events_x.csv")
    assert tables.read_sibling_csv(spark, events) is None and tables.read_run_metadata(spark, events) is None
    (tmp_path / "target_sample_enriched.csv").write_text("a\n1\n")
    (tmp_path / "detector_candidate_events_x.meta.json").write_text(json.dumps({"n_target_success": 3}))
    (tmp_path / "own.json").write_text(json.dumps({"n_target_success": 4}))
    assert tables.read_sibling_csv(spark, events).count() == 1
    assert tables.read_run_metadata(spark, events).first()["n_target_success"] == 3
    assert tables.read_run_metadata(spark, events, str(tmp_path / "own.json")).first()["n_target_success"] == 4
    assert tables.read_run_metadata(spark, events, str(tmp_path / "gone.json")).first()["n_target_success"] == 3


def test_query_rows(spark):
    kind = "ID string, Tmag string, ra string, dec string, bp_rp string, gaiabp double, gaiarp double"
    rows = [("1", "8", "1", "2", None, 10.0, 9.0), ("TIC 1", "8", "1", "2", None, 10.0, 9.0), ("2", "9", None, "2", None, 1.0, 1.0), (None, "9", "1", "2", None, 1.0, 1.0)]
    got = catalogs.query_rows(spark.createDataFrame(rows, kind)).collect()
    assert [(r["tic_id"], r["bp_rp"]) for r in got] == [(1, 1.0)]
    # one given colour is enough for the column to stand
    got = catalogs.query_rows(spark.createDataFrame([*rows[:1], ("3", "8", "1", "2", "0.7", 10.0, 9.0)], kind)).collect()
    assert {r["tic_id"]: r["bp_rp"] for r in got} == {1: None, 3: 0.7}


def test_features_at_hand(spark):
    df = spark.createDataFrame([(1, 2, 5.0, 1.0, True, 9.0, "target")], "star long, trial long, recovered_depth_ppm double, noise_mad double, recovered boolean, injected_depth_ppm double, sample_role string")
    out = ranking.training_features(df)
    assert {"injected_depth_ppm", "sample_role", "star", "trial", "label"} <= set(out.columns)
    assert ranking.feature_columns(out) == list(ranking.FEATURES) and ranking.feature_columns(df) == ["noise_mad"]
    assert not set(ranking.feature_columns(out)) & set(ranking.TRUTH)


def test_range_scan_total(spark):
    t = spark.createDataFrame([(1, 8.0, 5000.0), (2, 10.0, 5000.0)], "id long, tmag double, teff double")
    s = spark.createDataFrame([(i, 8.0 + i % 3, 5000.0) for i in range(20)], "id long, tmag double, teff double")
    all_of = samples.range_scan(t, s).count()
    got = samples.range_scan(t, s, total=5).collect()
    assert len(got) == 5 < all_of and {r["target_id"] for r in got} == {1}
    with pytest.raises(ValueError):
        samples.range_scan(t, s, tmag=0)


def test_overviews_of_odd_tables(spark):
    events = spark.createDataFrame([(1, None, float("nan"), 0.5), (2, True, 3.0, 0.5)], "star long, flag_low_snr boolean, local_snr double, final_candidate_score double")
    assert [r["n_flags"] for r in overview.with_flag_count(events).orderBy("star").collect()] == [0, 1]
    assert {r["flag"]: r["n"] for r in overview.flag_totals(events).collect()} == {"flag_low_snr": 1, "any": 1}
    assert [tuple(r) for r in overview.score_points(events).collect()] == [("2", 3.0, 0.5, None)]
    assert overview.with_flag_count(events.drop("flag_low_snr")).filter("n_flags = 0").count() == 2
    rec = spark.createDataFrame([(i, 1, i % 2 == 0 if i else None) for i in range(9)], "star long, trial long, recovered boolean")
    got = [(r["star"], r["recovered"]) for r in overview.examples(rec, 2).collect()]
    assert sorted(got) == [(0, False), (1, False), (2, True), (4, True)]
    assert overview.examples(rec.drop("recovered"), 2).filter("not recovered").count() == 2 and overview.examples(rec, 0).count() == 0
    same = spark.createDataFrame([("low", 0.5)] * 3, "recommended_review_priority string, max_score double")
    assert [tuple(r) for r in overview.score_histogram_by_priority(same).collect()] == [("low", 5, 3)]
    assert overview.recovery_rate(rec.limit(0)).first()["fraction"] is None


def test_control_run(spark):
    rng = np.random.default_rng(3)
    t = np.arange(400) * 0.02
    dip = np.where(np.abs(t - 5.0) < 0.1, 0.02 * (1 - np.abs(t - 5.0) / 0.1), 0)
    flux = 1 + 1e-4 * rng.standard_normal(400) - dip
    # the two products are on different scales
    rows = [(1, "a" if i < 200 else "b", float(t[i]), float(flux[i] * (1 if i < 200 else 50))) for i in range(400)] + [(1, "a", None, 1.0), (1, "c", 3.0, 0.0)]
    products = spark.createDataFrame(rows, "star long, product string, t double, flux double")
    assert abs(series.stitch(products).agg(F.avg("flux")).first()[0] - 1) < 0.01
    got = builds.control_run(products)
    best = got["strongest"].collect()
    assert len(best) == 1 and abs(best[0]["event_time"] - 5.0) < 0.021 and best[0]["depth_ppm"] > 15_000
    clean = got["samples"].orderBy("t").toPandas()
    want = detect.first_series(clean.t.to_numpy(), clean.flux.to_numpy())
    assert got["events"].count() == len(want) and abs(want.depth.iloc[0] * 1e6 - best[0]["depth_ppm"]) < 1e-6
    near = got["zoom"].agg(F.min("t"), F.max("t")).first()
    assert near[0] >= best[0]["event_time"] - 0.25 and near[1] <= best[0]["event_time"] + 0.25
