"""Injections judged where samples changed give what whole scans give."""

import time
from types import SimpleNamespace

import numpy as np
import pytest

from faintdip.operators import inject
from faintdip.operators.detect import scan_series


def series_of(kind, rng):
    n = int(rng.integers(12, 400))
    t = rng.permutation(np.cumsum(rng.uniform(0.01, 0.2, n)))
    f = 1 + rng.normal(0, 1e-3, n)
    if kind == "steps":
        f = np.round(f, 3)
    if kind == "flat":
        f = np.where(rng.random(n) < 0.7, 1.0, np.round(f, 3))
    if kind == "equal":
        f = np.ones(n)
    if kind == "same times":
        t = np.round(t, 0)
    return t, f


@pytest.mark.parametrize("kind", ["noise", "steps", "flat", "equal", "same times"])
def test_trials_are_whole_scans(kind):
    rng = np.random.default_rng(len(kind))
    seen = 0
    for _ in range(40):
        t, f = series_of(kind, rng)
        star = inject.Trials(t, f, 3.0, 1.0)
        for _ in range(6):
            d = SimpleNamespace(at=rng.uniform(t.min() - 0.5, t.max() + 0.5), ingress_hours=rng.uniform(0.5, 8), egress_hours=rng.uniform(1, 24), depth_ppm=rng.choice([0.0, 3000.0, 20000.0]))
            x = t - d.at
            lost = d.depth_ppm / 1e6 * np.clip(np.where(x < 0, 1 + x / (d.ingress_hours / 24), 1 - x / (d.egress_hours / 24)), 0, 1)
            want = scan_series(t, f - lost, 3.0, 1.0, False)
            want = want[np.abs(want.event_time - d.at) <= 0.5].sort_values("event_time")
            got = np.array(sorted(star.found(d, 0.5))).reshape(-1, 3)
            assert np.allclose(got, want[["event_time", "depth_ppm", "local_snr"]].to_numpy(float), equal_nan=True, rtol=1e-12), kind
            seen += len(got)
        assert (star.f == f[np.argsort(t, kind="stable")]).all()
    assert seen > 20 or kind == "equal"


def test_ten_trials_cost_less_than_three_scans():
    rng = np.random.default_rng(3)
    n = 50_000
    t, f = np.linspace(0, 100, n), 1 + rng.normal(0, 3e-4, n)
    dips = [SimpleNamespace(at=rng.uniform(10, 90), ingress_hours=2.0, egress_hours=6.0, depth_ppm=3000.0) for _ in range(10)]
    best = lambda run: min(_took(run) for _ in range(3))
    scan = best(lambda: scan_series(t, f, fits=False))

    def trials():
        star = inject.Trials(t, f, 4.0, 1.0)
        assert all(star.found(d, 0.125) for d in dips)

    assert best(trials) < 3 * scan


def _took(run):
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def test_another_detector_sees_whole_series(spark):
    from pyspark.sql import functions as F

    lc = inject.synthetic_series(spark, 300).withColumn("star", F.lit(1).cast("long"))
    own = lambda t, f, sigma, window, fits: scan_series(t, f, sigma, window, fits)
    rows = lambda df: sorted(str([f"{x:.10g}" if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert rows(inject.recovery(lc, 8)) == rows(inject.recovery(lc, 8, detector=own))
