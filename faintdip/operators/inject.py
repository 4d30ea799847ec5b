"""Synthetic dips: injection into series, and how many of them the scanner gets back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import beside
from .detect import MAD_TO_SIGMA, features, scan_series, thinned
from .series import finite_samples

#: Ranges of injected shapes: depth in ppm, ingress and egress in hours, ratio of egress to ingress.
DEPTH, INGRESS, EGRESS, RATIO = (50.0, 5000.0), (0.5, 8.0), (1.0, 24.0), (1.2, 8.0)
TOLERANCE_HOURS = 3.0


def decrement(t: Column, at: Column, depth: Column, ingress: Column, egress: Column) -> Column:
    """How much an asymmetric dip takes from the flux: linear in and out, between 0 and depth. Times in days, depth a fraction."""
    x = t - at
    falling = F.when((x >= -ingress) & (x < 0), depth * (1 + F.try_divide(x, ingress)))
    rising = falling.when((x >= 0) & (x <= egress), depth * (1 - F.coalesce(F.try_divide(x, egress), F.lit(0.0))))
    return F.least(F.greatest(rising.otherwise(0.0), F.lit(0.0)), depth)


def inject(lc: DataFrame, dips: DataFrame) -> DataFrame:
    """lc with dips (star, at, depth_ppm, ingress_hours, egress_hours) taken out of the flux."""
    d = F.col
    lost = decrement(d("t"), d("at"), d("depth_ppm") / 1e6, d("ingress_hours") / 24, d("egress_hours") / 24)
    return lc.join(dips, "star").withColumn("flux", d("flux") - lost)


def uniform(seed: int, name: str, *keys: str) -> Column:
    """A number in [0, 1) that depends on the keys alone, not on how rows are dealt out."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(name)), F.lit(1 << 52)) / float(1 << 52)


def trials(stars: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n injections for each star of (star, first, last): away from the ends by a tenth of the span, half an hour at least."""
    t = stars.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("trial"))
    u = lambda name: uniform(seed, name, "star", "trial")
    between = lambda name, r: r[0] + (r[1] - r[0]) * u(name)
    buffer = F.greatest((F.col("last") - F.col("first")) * 0.1, F.lit(0.5 / 24))
    t = t.withColumns({"depth_ppm": between("depth", DEPTH), "ingress_hours": between("ingress", INGRESS)})
    egress = F.col("ingress_hours") * F.exp(F.log(F.lit(RATIO[0])) + (F.log(F.lit(RATIO[1])) - F.log(F.lit(RATIO[0]))) * u("ratio"))
    return t.withColumns({"egress_hours": F.least(F.greatest(egress, F.lit(EGRESS[0])), F.lit(EGRESS[1])), "at": F.col("first") + buffer + (F.col("last") - F.col("first") - 2 * buffer) * u("at")})


def match_detections(truth: DataFrame, found: DataFrame, tolerance_hours: float = TOLERANCE_HOURS) -> DataFrame:
    """truth (star, trial, at, ...) with the nearest detection (star, trial, event_time, ...) within the tolerance."""
    apart = F.abs(F.col("event_time") - F.col("at")) * 24
    near = truth.select("star", "trial", "at").join(found, ["star", "trial"]).withColumn("timing_error_hours", apart).filter(F.col("timing_error_hours") <= tolerance_hours)
    best = near.groupBy("star", "trial").agg(F.min_by(F.struct("event_time", "timing_error_hours", "depth_ppm", "local_snr"), F.struct("timing_error_hours", "event_time")).alias("b"))
    best = best.select("star", "trial", F.col("b.event_time").alias("recovered_time"), "b.timing_error_hours", F.col("b.depth_ppm").alias("recovered_depth_ppm"), F.col("b.local_snr").alias("recovered_snr"))
    return truth.join(best, ["star", "trial"], "left").withColumn("recovered", F.col("recovered_time").isNotNull())


def _strict_minima(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, the runs that are lower than both neighbours, and the middle sample of these."""
    start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    stop = np.append(start[1:], len(f)) - 1
    v = f[start]
    low = np.flatnonzero((v[1:-1] < v[:-2]) & (v[1:-1] < v[2:])) + 1
    return start, low, (start[low] + stop[low]) // 2


def _middle(s: np.ndarray) -> float:
    n = len(s)
    return float(s[n // 2]) if n % 2 else float((s[n // 2 - 1] + s[n // 2]) / 2)


def _deviation(s: np.ndarray, mid: float) -> float:
    """Median of |s - mid| for sorted s: the values nearest to mid lie side by side, and bisection finds where."""

    def rank(k: int) -> float:
        low, high = 0, len(s) - k
        while low < high:
            i = (low + high) // 2
            if mid - s[i] > s[i + k] - mid:
                low = i + 1
            else:
                high = i
        return max(mid - s[low], s[low + k - 1] - mid)

    n = len(s)
    return float(rank(n // 2 + 1)) if n % 2 else float((rank(n // 2) + rank(n // 2 + 1)) / 2)


class Trials:
    """A star's series, made ready for many injections: sorted once, with all its minima.

    A dip changes a few samples. The new median and deviation come from the sorted fluxes with these exchanged, and minima
    are looked for anew only where samples changed; elsewhere they stay, and only the threshold moves.
    """

    def __init__(self, t: np.ndarray, f: np.ndarray, sigma: float, window: float):
        order = np.argsort(t, kind="stable")
        self.t, self.f, self.sigma, self.window = t[order], f[order], sigma, window
        self.sorted = np.sort(self.f)
        self.start, self.low, self.at = _strict_minima(self.f)
        deep = np.argsort(self.f[self.at], kind="stable")
        self.by_depth, self.depths = deep, self.f[self.at][deep]
        dt = float(np.median(np.diff(self.t)))
        self.apart = max(3, int(window / (2 * dt) // 2)) if dt > 0 else 3

    def found(self, dip, tolerance: float) -> list[tuple]:
        """(event_time, depth_ppm, local_snr) of the events with the dip within the tolerance in days of its time."""
        rise, fall, deep = dip.ingress_hours / 24, dip.egress_hours / 24, dip.depth_ppm / 1e6
        a, b = np.searchsorted(self.t, dip.at - rise, "left"), np.searchsorted(self.t, dip.at + fall, "right")
        x, old = self.t[a:b] - dip.at, self.f[a:b].copy()
        self.f[a:b] = old - deep * np.clip(np.where(x < 0, 1 + x / rise, 1 - x / fall), 0, 1)
        try:
            return self._events(a, b, old, dip.at, tolerance)
        finally:
            self.f[a:b] = old

    def _events(self, a: int, b: int, old: np.ndarray, at: float, tolerance: float) -> list[tuple]:
        f, s, n = self.f, self.sorted, len(self.f)
        if a < b:
            old = np.sort(old)
            # equal values take places side by side
            gone = np.searchsorted(s, old) + np.arange(len(old)) - np.searchsorted(old, old)
            s = np.delete(s, gone)
            new = np.sort(f[a:b])
            s = np.insert(s, np.searchsorted(s, new), new)
        mid = _middle(s)
        noise = MAD_TO_SIGMA * _deviation(s, mid)
        if noise <= 0:
            noise = float(np.std(f))
        if not noise > 0:
            return []
        least = self.sigma * noise
        near = self.by_depth[: np.searchsorted(self.depths, mid - least * (1 - 1e-9) + 1e-12, "right")]
        if a < b:
            # runs from the last unchanged sample before to the first after may have changed, and are judged beside one more on either side
            first = np.searchsorted(self.start, a - 1, "right") - 1 if a > 0 else 0
            last = np.searchsorted(self.start, b, "right") - 1 if b < n else len(self.start) - 1
            lo = self.start[max(first - 1, 0)]
            hi = self.start[last + 2] if last + 2 < len(self.start) else n
            here = lo + _strict_minima(f[lo:hi])[2]
            near = near[(self.low[near] < first) | (self.low[near] > last)]
            places = np.sort(np.concatenate([self.at[near], here]))
        else:
            places = np.sort(self.at[near])
        x = mid - f[places]
        places, x = places[x >= least], x[x >= least]
        places = places[thinned(places, x, self.apart)]
        places = places[np.abs(self.t[places] - at) <= tolerance]
        rows = (features(self.t, f, float(self.t[i]), self.window, False, noise) for i in places)
        return [(r[0], r[1], r[2]) for r in rows]


def recovery(lc: DataFrame, n: int = 10, sigma: float = 4.0, window: float = 1.0, tolerance_hours: float = TOLERANCE_HOURS, seed: int = 42, detector=scan_series) -> DataFrame:
    """One row for each star and trial: the injected dip, and what the detector found of it.

    A star's samples are sent once; its trials run where they are. The scanner itself is not run again for each: Trials gives
    what it would find near the dip. Another detector sees the whole series each time.
    """
    if sigma <= 0 or window <= 0:
        raise ValueError("sigma and window must be positive")
    samples = finite_samples(lc).select("star", "t", "flux")
    span = samples.groupBy("star").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).filter("n >= 10")
    truth = trials(span, n, seed)
    names = ["star", "trial", "event_time", "depth_ppm", "local_snr"]

    def again(key, series, dips):
        t, f = series.t.to_numpy(), series.flux.to_numpy()
        out = []
        for d in dips.itertuples():
            x, rise, fall, deep = t - d.at, d.ingress_hours / 24, d.egress_hours / 24, d.depth_ppm / 1e6
            lost = deep * np.clip(np.where(x < 0, 1 + x / rise, 1 - x / fall), 0, 1)
            e = detector(t, f - lost, sigma, window, False)
            if len(e):
                out.append(e[names[2:]].assign(star=key[0], trial=d.trial))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    def run(key, series, dips):
        if len(series) < 10 or not len(dips):
            return pd.DataFrame(columns=names)
        star = Trials(series.t.to_numpy(), series.flux.to_numpy(), sigma, window)
        # a little more than the tolerance, which is judged by the join
        rows = [(key[0], d.trial, *e) for d in dips.itertuples() for e in star.found(d, tolerance_hours / 24 * (1 + 1e-9))]
        return pd.DataFrame(rows, columns=names)

    kernel = run if detector is scan_series else again
    found = samples.groupBy("star").cogroup(truth.groupBy("star")).applyInPandas(kernel, "star long, trial int, event_time double, depth_ppm double, local_snr double")
    return match_detections(truth.drop("first", "last", "n"), found, tolerance_hours)


def synthetic_series(spark, n: int = 500, at: float = 5.0, depth: float = 0.01, ingress: float = 0.03, egress: float = 0.2, noise: float = 5e-4, seed: int = 42, days: float = 10.0) -> DataFrame:
    """One star of n samples with one dip in white noise."""
    t = spark.range(n).select(F.lit(1).cast("long").alias("star"), (F.col("id") * (days / max(n - 1, 1))).alias("t"))
    lost = decrement(F.col("t"), F.lit(at), F.lit(depth), F.lit(ingress), F.lit(egress))
    return t.withColumn("flux", 1 - lost + noise * F.sqrt(-2 * F.log(1 - uniform(seed, "a", "t"))) * F.cos(2 * np.pi * uniform(seed, "b", "t")))


def recovery_by_depth(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, recovered, fraction) over log-spaced depths from the least, at least 10, to 1.05 times the greatest."""
    rows = rows.filter("depth_ppm is not null")
    span = rows.agg(F.greatest(F.min("depth_ppm"), F.lit(10.0)).alias("low"), (F.max("depth_ppm") * 1.05).alias("high"))
    x = beside(rows, span)
    b = F.floor((F.log("depth_ppm") - F.log("low")) / (F.log("high") - F.log("low")) * bins)
    return x.withColumn("bin", b).filter(f"bin between 0 and {bins - 1}").groupBy("bin").agg(F.count("*").alias("n"), F.count_if("recovered").alias("recovered"), F.avg(F.col("recovered").cast("int")).alias("fraction"))


def recovery_heatmap(rows: DataFrame, depth_bins: int = 8, egress_bins: int = 6) -> DataFrame:
    """(depth_bin, egress_bin, n, fraction): depth log-spaced, egress linear from .95 of the least to 1.05 of the greatest."""
    rows = rows.filter("depth_ppm is not null and egress_hours is not null")
    span = rows.agg(F.greatest(F.min("depth_ppm"), F.lit(10.0)).alias("low"), (F.max("depth_ppm") * 1.05).alias("high"), (F.min("egress_hours") * 0.95).alias("e0"), (F.max("egress_hours") * 1.05).alias("e1"))
    x = beside(rows, span)
    d = F.floor((F.log("depth_ppm") - F.log("low")) / (F.log("high") - F.log("low")) * depth_bins)
    e = F.floor((F.col("egress_hours") - F.col("e0")) / (F.col("e1") - F.col("e0")) * egress_bins)
    x = x.withColumns({"depth_bin": d, "egress_bin": e}).filter(f"depth_bin between 0 and {depth_bins - 1} and egress_bin between 0 and {egress_bins - 1}")
    return x.groupBy("depth_bin", "egress_bin").agg(F.count("*").alias("n"), F.avg(F.col("recovered").cast("int")).alias("fraction"))
