import numpy as np
import pandas as pd
import pytest

from faintdip.operators import detect, inject, series


def flat(n=800, noise=2e-4, seed=1):
    rng = np.random.default_rng(seed)
    return np.linspace(1500, 1527, n), 1 + rng.normal(0, noise, n)


def dipped(depth=0.003, rise=2 / 24, fall=8 / 24, at=1513.5, **k):
    t, f = flat(**k)
    x = t - at
    return t, f - depth * np.clip(np.where(x < 0, 1 + x / rise, 1 - x / fall), 0, 1)


def slow_peaks(x, height, distance):
    """Peaks one by one, as the definition says."""
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if j < len(x) - 1 and x[i - 1] < x[i] > x[j + 1] and x[i] >= height:
            found.append((i + j) // 2)
        i = j + 1
    kept = set(found)
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if p in kept:
            kept -= {q for q in kept if q != p and abs(q - p) < distance}
    return sorted(kept)


@pytest.mark.parametrize("seed", range(20))
def test_peaks_match_the_slow_way(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, 80).astype(float)
    for distance in (1, 3, 7):
        assert detect.peaks(x, 2.0, distance).tolist() == slow_peaks(x, 2.0, distance)


def test_flat_series_has_no_events():
    t = np.linspace(0, 27, 500)
    assert len(detect.scan_series(t, np.ones(500))) == 0
    assert len(detect.scan_series(t[:5], np.ones(5))) == 0


def test_a_dip_is_found_and_is_asymmetric():
    e = detect.scan_series(*dipped())
    assert abs(e.event_time[0] - 1513.5) < 0.2
    assert not e.single_point_like[0] and not e.edge_event[0]
    assert e.delta_chi2[0] > 0
    assert e.egress_ingress_ratio[0] > 1


def test_one_low_sample_is_a_single_point():
    t, f = flat()
    f[400] = 0.90
    e = detect.scan_series(t, f, fits=False)
    assert e.single_point_like[0] and e.event_time[0] == t[400]


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        detect.scan_series(*flat(), sigma=0)


def test_scan_of_many_stars_ignores_missing_samples(spark):
    t, f = dipped()
    a = pd.DataFrame({"star": 1, "t": t, "flux": f})
    b = pd.DataFrame({"star": 2, "t": [1.0, np.nan, 3.0], "flux": [1.0, 1.0, np.nan]})
    got = detect.scan(spark.createDataFrame(pd.concat([a, b])), fits=False).toPandas()
    assert set(got.star) == {1}


def test_sql_features_match_the_kernel(spark):
    t, f = dipped()
    lc = spark.createDataFrame(pd.DataFrame({"star": 1, "t": t, "flux": f})).cache()
    event = float(t[np.argmin(f)])
    ev = spark.createDataFrame([(1, event)], "star long, event double")
    want = dict(zip(detect.NAMES, detect.features(t, f, event, 1.0, False)))
    got = series.window_features(lc, ev, 1.0).first()
    for name in ("depth_ppm", "local_snr", "skewness", "kurtosis", "n_points_window", "edge_event", "single_point_like"):
        assert got[name] == pytest.approx(want[name])
    c = series.half_depth_crossings(lc, ev, 1.0).first()
    assert c["ingress_hours"] == pytest.approx(want["ingress_hours"]) and c["ratio"] == pytest.approx(want["egress_ingress_ratio"])
    assert series.width_at_half_depth(lc, ev, 1.0).first()["fwhm_hours"] == pytest.approx(want["fwhm_hours"])


def test_noise_falls_back_to_the_deviation(spark):
    lc = spark.createDataFrame([(1, float(i), 1.0 if i < 9 else 2.0) for i in range(10)], "star long, t double, flux double")
    assert series.noise(lc).first()["noise"] == pytest.approx(0.3)


def test_injection_and_recovery(spark):
    t, f = flat(noise=3e-4)
    lc = spark.createDataFrame(pd.DataFrame({"star": 1, "t": t, "flux": f}))
    got = inject.recovery(lc, n=20).toPandas()
    assert len(got) == 20 and got.recovered.mean() >= 0.25
    assert got.depth_ppm.between(50, 5000).all() and got.egress_hours.between(1, 24).all()
    again = inject.recovery(lc.repartition(3), n=20).toPandas()
    assert sorted(got.depth_ppm) == sorted(again.depth_ppm)
    assert (got[got.recovered].timing_error_hours <= 3).all()


def test_synthetic_series(spark):
    pdf = inject.synthetic_series(spark).toPandas()
    assert len(pdf) == 500 and pdf.flux.min() < 0.995


def test_interpolated_markers(spark):
    lc = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0)], "star long, t double, flux double")
    ev = spark.createDataFrame([(1, 0.25), (1, 1.0), (1, 9.0), (1, -1.0)], "star long, event double")
    got = {r["event"]: r["flux"] for r in series.flux_at(lc, ev).collect()}
    assert got == {0.25: 1.5, 1.0: 3.0, 9.0: 3.0, -1.0: 1.0}
