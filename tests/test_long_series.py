"""Exact medians by counting, and detection in series that are cut into chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faintdip.operators import detect, medians, ranking, series


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(1)
    kinds = [
        rng.normal(size=3000), 2.0 ** rng.uniform(-300, 300, 2001), rng.integers(0, 3, 3000).astype(float), rng.normal(size=3), np.array([np.nan]), np.where(rng.random(3500) < 0.6, 7.0, rng.normal(size=3500)),
        np.r_[np.zeros(1000), np.ones(1000)], np.r_[np.zeros(900), rng.random(120), np.ones(900)], np.array([5.0, np.inf, np.nan]), np.full(500, -1.5),
    ]
    pdf = pd.concat([pd.DataFrame({"star": i, "a": k, "b": np.sort(k)[::-1] * 2}) for i, k in enumerate(kinds)])
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("few, broadcast", [(1 << 16, 200_000), (40, 200_000), (40, 1)])
def test_medians_of_groups(groups, monkeypatch, few, broadcast):
    pdf, df = groups
    monkeypatch.setattr(medians, "BROADCAST", broadcast)
    want = pdf.replace([np.inf, -np.inf], np.nan).groupby("star").median()
    got = medians.medians(df, ["star"], ["a", "b"], few).toPandas().set_index("star").sort_index()
    assert list(got.columns) == ["a", "b"] and got.equals(want)


def test_medians_of_a_whole_table(spark, groups):
    pdf, df = groups
    clean = pdf.replace([np.inf, -np.inf], np.nan)
    for few in (30, 1 << 16):
        r = medians.medians(df.withColumn("none", F.lit(None).cast("double")), [], ["a", "b", "none"], few).collect()
        assert len(r) == 1 and (r[0]["a"], r[0]["b"], r[0]["none"]) == (clean.a.median(), clean.b.median(), None)
    empty = medians.medians(df.limit(0), [], ["a", "b"]).collect()
    assert len(empty) <= 1 and all(v is None for r in empty for v in r)
    assert medians.medians(df.limit(0), ["star"], ["a"]).count() == 0
    fills = ranking.medians(df.select(F.col("a").alias("depth_ppm")).limit(0).withColumns({f: F.lit(None).cast("double") for f in ranking.FEATURES}))
    assert fills.count() == 1 and set(fills.first()) == {0.0}


def stars():
    rng = np.random.default_rng(4)
    out = []
    for star in range(6):
        n = int(rng.integers(300, 900))
        t = np.sort(rng.uniform(0, 27, n))
        f = 1 + rng.normal(0, 2e-4, n)
        for at in rng.uniform(1, 26, 5):
            x = t - at
            f -= rng.uniform(1e-3, 4e-3) * np.clip(np.where(x < 0, 1 + x / 0.1, 1 - x / 0.3), 0, 1)
        if star == 2:
            f = np.round(f, 3)  # plateaus, over borders of chunks too
        if star == 3:
            f[n // 2 : n // 2 + 60] = f.min() - 0.01
        out.append(pd.DataFrame({"star": star, "t": t, "flux": f}))
    out.append(pd.DataFrame({"star": 7, "t": np.arange(9.0), "flux": np.arange(9.0)}))
    out.append(pd.DataFrame({"star": 8, "t": np.arange(40.0), "flux": 1.0}))
    return pd.concat(out)


@pytest.mark.parametrize("chunk, few", [(37, 50), (1 << 18, 1 << 16)])
def test_chunks_give_the_events_of_whole_series(spark, chunk, few):
    pdf = stars()
    want = pd.concat([detect.scan_series(g.t.to_numpy(), g.flux.to_numpy(), fits=False).assign(star=s) for s, g in pdf.groupby("star")])
    got = detect.scan_chunked(spark.createDataFrame(pdf), fits=False, chunk=chunk, few=few).toPandas()
    order = ["star", "event_time"]
    want, got = (x.sort_values(order, ignore_index=True)[["star", *detect.NAMES]] for x in (want, got))
    assert len(got) == len(want) > 20
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


def test_one_long_series_in_many_tasks(spark):
    """Half a million samples: every dip that was put in is found, by tasks of a few thousand samples."""
    n, dips = 500_000, 40
    at = [(i + 0.5) * 1000 / dips for i in range(dips)]
    t = spark.range(n).select(F.lit(1).cast("long").alias("star"), (F.col("id") * (1000 / n)).alias("t"))
    near = F.lit(0.0)
    for x in at:
        near = near + F.greatest(F.lit(0.0), 1 - F.abs(F.col("t") - x) / 0.1)
    lc = t.withColumn("flux", 1 - 0.05 * near + (F.pmod(F.xxhash64("t"), F.lit(1000)) - 500) * 1e-6)
    events = detect.scan_chunked(lc, fits=False, chunk=20_000, few=5_000).toPandas()
    assert len(events) == dips and np.allclose(sorted(events.event_time), at, atol=0.01)


def test_no_samples(spark):
    none = spark.createDataFrame([], "star long, t double, flux double")
    assert detect.scan_chunked(none).count() == 0 and series.noise(none).count() == 0
