"""The dip scanner: peak thinning, event features and model fits, one series at a time.

Thinning keeps the highest peak and drops its neighbours in turn, which is sequential within
a star; stars are independent, so a grouped kernel takes one star's samples and gives all its events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut
from .medians import BROADCAST, FEW, beside_group, medians
from .series import EDGE_DAYS, MAD_TO_SIGMA, finite_samples, half_depth_crossings, window_samples

VERSION = "scan_v1"
FEATURES = (
    "event_time double, depth_ppm double, local_snr double, duration_hours double, fwhm_hours double, ingress_hours double, egress_hours double, "
    "egress_ingress_ratio double, skewness double, kurtosis double, delta_chi2 double, n_points_window long, edge_event boolean, single_point_like boolean"
)
NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def robust_noise(f: np.ndarray) -> float:
    if not len(f):
        return np.nan
    s = MAD_TO_SIGMA * float(np.median(np.abs(f - np.median(f))))
    return float(np.std(f)) if s <= 0 and len(f) > 1 else s


def peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Indices of strict local maxima of at least height, thinned to be distance samples apart.

    The middle of a plateau stands for it; of peaks that are too close the higher stays, of equal
    ones the later.
    """
    if len(x) < 3:
        return np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    stop = np.append(start[1:], len(x)) - 1
    v = x[start]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    at = (start[top] + stop[top]) // 2
    at = at[x[at] >= height]
    return at[thinned(at, x[at], distance)]


def thinned(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which of sorted places stay if the highest take out those within distance in turn; of equal heights the later goes first."""
    keep = np.ones(len(at), bool)
    for i in np.argsort(height, kind="stable")[::-1]:
        if keep[i]:
            a, b = np.searchsorted(at, at[i] - distance, "right"), np.searchsorted(at, at[i] + distance, "left")
            keep[a:b] = False
            keep[i] = True
    return keep


#: Points of a grid after the first, and how far, as a share of the sum of squares, a cost by sums may be off.
STEPS, SLACK = np.arange(7.0), 1e-12


def _best(model, t, f, grids, rounds: int = 6):
    """Least squares over the shape's parameters by shrinking grids; the depth is linear and solved for.

    The depth is kept between 0 and 1, and every parameter within its first grid's ends. Costs come from sums first, and those
    that may be the least of a grid from the residuals.
    """
    points = [np.asarray(g, float) for g in grids]
    ends = [(float(p[0]), float(p[-1])) for p in points]
    depth, short = 1 - f, f - 1
    total = float(depth @ depth)
    best = (np.inf, None, 0.0)
    for _ in range(rounds):
        # at its ends a grid holds a value more than once, which need not be tried again
        some = [list(dict.fromkeys(p.tolist())) for p in points]
        size, along, shapes = model(t, depth, *(np.array(p) for p in some))
        d = np.minimum(np.maximum(along / np.where(size > 0, size, 1), 0), 1)
        rough = (total - d * (2 * along - d * size)).ravel()
        near = np.flatnonzero(rough <= rough.min() + SLACK * total)
        at = np.unravel_index(near, size.shape)
        phi = shapes(*at)
        size = np.square(phi).sum(1)
        # where the squares of a shape add up to 0, so does the numerator
        d = np.minimum(np.maximum((phi * depth).sum(1) / np.where(size > 0, size, 1), 0), 1)
        cost = np.square(d[:, None] * phi + short).sum(1)
        k = int(cost.argmin())
        if cost[k] < best[0]:
            best = (float(cost[k]), [p[i[k]] for p, i in zip(some, at)], float(d[k]))
        for i, (p, c, (a, b)) in enumerate(zip(points, best[1], ends)):
            s = float(p[1] - p[0]) if len(p) > 1 else 0.0
            p = STEPS * (((c + s) - (c - s)) / 6) + (c - s)
            p[6] = c + s
            points[i] = np.minimum(np.maximum(p, a, out=p), b, out=p)
    return best


def gaussian(t, depth, at, width):
    """For each place and width: the sums of the shape's squares and of its products with depth, and a function that gives shapes."""
    phi = np.exp(-0.5 * ((t - at[:, None, None]) / width[:, None]) ** 2)
    return np.square(phi) @ np.ones(len(t)), phi @ depth, lambda i, j: phi[i, j]


def triangle(t, depth, at, rise, fall):
    """As gaussian(), for each place, rise and fall; the two sides meet in sums only, so each is computed by itself."""
    x = (t - at[:, None])[:, None]
    up = np.where(x <= 0, np.maximum(1 + x / rise[:, None], 0), 0)
    down = np.where(x <= 0, 0, np.maximum(1 - x / fall[:, None], 0))
    one = np.ones(len(t))
    size = (np.square(up) @ one)[:, :, None] + (np.square(down) @ one)[:, None]
    return size, (up @ depth)[:, :, None] + (down @ depth)[:, None], lambda i, j, k: up[i, j] + down[i, k]


def fit_difference(t: np.ndarray, f: np.ndarray, event: float, window: float) -> float:
    """Chi-squared of the symmetric fit less that of the asymmetric one; NaN where there is nothing to fit."""
    if len(t) < 5 or np.median(f) - f.min() <= 0:
        return np.nan
    half, dt = window / 2, float(np.median(np.diff(t)))
    if not 0 < dt < half:
        return np.nan
    s = robust_noise(f)
    s = s if np.isfinite(s) and s > 0 else 1e-6
    at = np.linspace(event - half, event + half, 11)
    symmetric = _best(gaussian, t, f, [at, np.geomspace(dt, half, 7)])[0]
    near = np.linspace(event - half / 2, event + half / 2, 9)
    asymmetric = _best(triangle, t, f, [near, np.geomspace(dt, half, 6), np.geomspace(dt, 2 * half, 6)])[0]
    return (symmetric - asymmetric) / s**2


def crossings(t: np.ndarray, f: np.ndarray):
    """Ingress and egress hours, their ratio and the interpolated width at half depth."""
    nothing = (np.nan,) * 4
    if len(t) < 4:
        return nothing
    k = int(np.argmin(f))
    base = float(np.median(f))
    depth = base - f[k]
    if depth <= 0:
        return nothing
    half = base - depth / 2
    before, after = np.flatnonzero(f[: k + 1] >= half), k + np.flatnonzero(f[k:] >= half)
    ingress = (t[k] - t[before[-1]]) * 24 if len(before) else np.nan
    egress = (t[after[0]] - t[k]) * 24 if len(after) else np.nan
    width = np.nan
    if len(before) and len(after):
        a, b = before[-1], after[0]
        left = t[a] + (half - f[a]) / (f[a + 1] - f[a]) * (t[a + 1] - t[a])
        right = t[b - 1] + (half - f[b - 1]) / (f[b] - f[b - 1]) * (t[b] - t[b - 1])
        width = (right - left) * 24 if right > left else np.nan
    if len(t) < 5:
        return np.nan, np.nan, np.nan, width
    return ingress, egress, egress / ingress if ingress > 0 else np.nan, width


def features(t: np.ndarray, f: np.ndarray, event: float, window: float, fits: bool = True, overall: float | None = None) -> tuple:
    """All features of one event, in the order of NAMES."""
    a, b = np.searchsorted(t, event - window / 2, "left"), np.searchsorted(t, event + window / 2, "right")
    lt, lf = t[a:b], f[a:b]
    edge = bool(event < t[0] + EDGE_DAYS or event > t[-1] - EDGE_DAYS)
    if len(lt) < 3:
        return (event, *[np.nan] * 10, len(lt), edge, True)
    base = float(np.median(lf))
    depth = max(base - float(lf.min()), 0.0)
    s = robust_noise(lf)
    if not (np.isfinite(s) and s > 0):
        s = robust_noise(f) if overall is None else overall
    known = np.isfinite(s) and s > 0
    single = not (known and depth > 0) or np.count_nonzero(lf < base - depth / 2) <= 1
    ingress, egress, ratio, width = crossings(lt, lf)
    duration = ingress + egress if np.isfinite(ingress + egress) else width
    x = lf - lf.mean()
    m2 = float(np.mean(x**2))
    skew, kurtosis = (float(np.mean(x**3)) / m2**1.5, float(np.mean(x**4)) / m2**2 - 3) if m2 > 0 else (np.nan, np.nan)
    delta = fit_difference(lt, lf, event, window) if fits else np.nan
    return (event, depth * 1e6, depth / s if known else np.nan, duration, width, ingress, egress, ratio, skew, kurtosis, delta, len(lt), edge, bool(single))


def scan_series(t: np.ndarray, f: np.ndarray, sigma: float = 4.0, window: float = 1.0, fits: bool = True) -> pd.DataFrame:
    """Events of one series sorted by time within it, deepest first."""
    if sigma <= 0 or window <= 0:
        raise ValueError("sigma and window must be positive")
    order = np.argsort(t, kind="stable")
    t, f = t[order], f[order]
    s = robust_noise(f)
    if len(t) < 10 or not s > 0:
        return pd.DataFrame(columns=NAMES)
    dt = float(np.median(np.diff(t)))
    apart = max(3, int(window / (2 * dt) // 2)) if dt > 0 else 3
    at = peaks(np.median(f) - f, sigma * s, apart)
    rows = [features(t, f, float(t[i]), window, fits, s) for i in at]
    return pd.DataFrame(rows, columns=NAMES).sort_values(["depth_ppm", "event_time"], ascending=[False, True], ignore_index=True)


def scan(lc: DataFrame, sigma: float = 4.0, window: float = 1.0, fits: bool = True, detector=scan_series) -> DataFrame:
    """Events of every star of (star, t, flux). detector may be any function like scan_series()."""
    if sigma <= 0 or window <= 0:
        raise ValueError("sigma and window must be positive")

    def one(key, pdf):
        out = detector(pdf.t.to_numpy(), pdf.flux.to_numpy(), sigma, window, fits)
        out.insert(0, "star", key[0])
        return out

    return finite_samples(lc).select("star", "t", "flux").groupBy("star").applyInPandas(one, f"star long, {FEATURES}")


#: Samples of a star that one task looks at in scan_chunked().
CHUNK = 1 << 18


def _chunked(samples: DataFrame, span: DataFrame, n_stars: int, chunk: int) -> DataFrame:
    """(star, t, flux, i, before, after, step): samples numbered from 0, with their neighbours' flux and the time since the one before.

    A star's time is cut into spans of about chunk samples; what lies on the other side of a border comes from a table
    of one row a chunk.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))
    wide = beside_group(samples, span.select("star", "first", "last", parts.alias("parts")), ["star"], n_stars)
    place = F.when(F.col("last") > F.col("first"), F.least(F.floor((F.col("t") - F.col("first")) / (F.col("last") - F.col("first")) * F.col("parts")), F.col("parts") - 1)).otherwise(0)
    here = W.partitionBy("star", "chunk").orderBy("t", "flux")
    rows = wide.select("star", "t", "flux", place.cast("long").alias("chunk"))
    rows = cut(rows.withColumns({"k": F.row_number().over(here), "b": F.lag("flux").over(here), "a": F.lead("flux").over(here), "bt": F.lag("t").over(here)}))
    ends = F.struct("t", "flux")
    borders = rows.groupBy("star", "chunk").agg(F.count("*").alias("c"), F.min(ends).alias("head"), F.max(ends).alias("tail"))
    star = W.partitionBy("star").orderBy("chunk")
    borders = cut(borders.select("star", "chunk", (F.sum("c").over(star) - F.col("c")).alias("earlier"), F.lag("tail").over(star).alias("tail"), F.lead("head").over(star).alias("head")))
    # a chunk is no hot key, so the table of chunks is broadcast only where it is small
    few = borders.count() <= BROADCAST
    rows = rows.join(F.broadcast(borders) if few else borders, ["star", "chunk"])
    before, after = F.coalesce("b", F.col("tail.flux")), F.coalesce("a", F.col("head.flux"))
    return rows.select("star", "t", "flux", (F.col("earlier") + F.col("k") - 1).alias("i"), before.alias("before"), after.alias("after"), (F.col("t") - F.coalesce("bt", F.col("tail.t"))).alias("step"))


def scan_chunked(lc: DataFrame, sigma: float = 4.0, window: float = 1.0, fits: bool = True, chunk: int = CHUNK, few: int = FEW) -> DataFrame:
    """Events of every star as scan() gives them, for series that are too long for one task.

    Medians come by counting, minima from chunks of a star's time, thinning from chains of minima that lie closer than the least
    distance (chains do not touch one another, wherever chunks end), and features from each event's window alone. Samples of one
    star at one time are ordered by flux. Null stars, times and fluxes are left out; stars of fewer than ten samples
    have no events, nor have those without noise.
    """
    if sigma <= 0 or window <= 0:
        raise ValueError("sigma and window must be positive")
    samples = finite_samples(lc).select("star", "t", "flux").filter("star is not null")
    span = cut(samples.groupBy("star").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.stddev_pop("flux").alias("sd")).filter("n >= 10"))
    n_stars = span.count()
    rows = cut(_chunked(samples, span, n_stars, chunk))
    middle = cut(medians(rows, ["star"], ["flux", "step"], few).select("star", F.col("flux").alias("med"), F.col("step").alias("dt")))
    away = beside_group(rows, middle.select("star", "med"), ["star"], n_stars).select("star", F.abs(F.col("flux") - F.col("med")).alias("mad"))
    s = F.when(F.col("mad") > 0, MAD_TO_SIGMA * F.col("mad")).otherwise(F.col("sd"))
    apart = F.when(F.col("dt") > 0, F.greatest(F.lit(3), F.floor(F.floor(F.lit(float(window)) / (2 * F.col("dt"))) / 2))).otherwise(3).cast("long")
    stats = span.join(middle, "star").join(medians(away, ["star"], ["mad"], few), "star").select("star", "first", "last", "med", s.alias("s"), apart.alias("apart")).filter("s > 0")
    stats = cut(stats)
    low = beside_group(rows, stats, ["star"], n_stars).withColumn("x", F.col("med") - F.col("flux")).filter(F.col("x") >= sigma * F.col("s"))
    low = low.select("star", "i", "t", "x", (F.col("med") - F.col("before")).alias("b"), (F.col("med") - F.col("after")).alias("a"), "apart")
    # what is left are few samples of each star: plateaus are runs of equal ones, and chains are runs of close minima
    star = W.partitionBy("star").orderBy("i")
    new = F.coalesce((F.col("x") != F.lag("x").over(star)) | (F.col("i") != F.lag("i").over(star) + 1), F.lit(True))
    run = W.partitionBy("star", "run")
    low = low.withColumn("new", new.cast("long")).withColumn("run", F.sum("new").over(star))
    low = low.withColumns({"from": F.min("i").over(run), "to": F.max("i").over(run), "b": F.min_by("b", "i").over(run), "a": F.max_by("a", "i").over(run)})
    tops = low.filter((F.col("b") < F.col("x")) & (F.col("a") < F.col("x")) & (F.col("i") == F.floor((F.col("from") + F.col("to")) / 2))).select("star", "i", "t", "x", "apart")
    tops = tops.withColumn("new", F.coalesce(F.col("i") - F.lag("i").over(star) >= F.col("apart"), F.lit(True)).cast("long")).withColumn("chain", F.sum("new").over(star))

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf[thinned(pdf.i.to_numpy(), pdf.x.to_numpy(), int(pdf.apart.iloc[0]))][["star", "t"]]

    alone = W.partitionBy("star", "chain")
    tops = tops.withColumn("size", F.count("*").over(alone))
    kept = tops.filter("size = 1").select("star", "t").unionByName(tops.filter("size > 1").select("star", "i", "t", "x", "apart", "chain").groupBy("star", "chain").applyInPandas(thin, "star long, t double"))
    events = cut(kept.withColumnRenamed("t", "event").distinct().join(stats.select("star", "first", "last", "s"), "star"))

    def one(key, about, near):
        near = near.sort_values(["t", "flux"])
        row = about.iloc[0]
        got = list(features(near.t.to_numpy(), near.flux.to_numpy(), float(key[1]), window, fits, float(row.s)))
        got[NAMES.index("edge_event")] = bool(key[1] < row["first"] + EDGE_DAYS or key[1] > row["last"] - EDGE_DAYS)
        return pd.DataFrame([[key[0], *got]], columns=["star", *NAMES])

    near = window_samples(samples, events, window).select(F.col("star").alias("of"), F.col("event").alias("at"), "t", "flux")
    return events.groupBy("star", "event").cogroup(near.groupBy("of", "at")).applyInPandas(one, f"star long, {FEATURES}")


#: What the first, simple detector says of an event.
FIRST_FEATURES = (
    "event_time double, depth double, depth_ppm double, local_noise double, local_snr double, n_points_window long, window_start double, window_end double, "
    "single_point_like boolean, ingress_days double, egress_days double, asymmetry_score double"
)
FIRST_NAMES = [x.split()[0] for x in FIRST_FEATURES.split(", ")]


def first_series(t: np.ndarray, f: np.ndarray, sigma: float = 4.0, min_distance: int = 5, window: float = 0.5) -> pd.DataFrame:
    """Events of one series by the first detector, deepest first: peaks at least min_distance samples apart.

    The depth is that of the peak's own sample below its window's median, or below the series' where that is not positive.
    """
    if sigma <= 0 or min_distance < 1 or window <= 0:
        raise ValueError("sigma and window must be positive, min_distance at least 1")
    order = np.argsort(t, kind="stable")
    t, f = t[order], f[order]
    s = robust_noise(f)
    rows = []
    height = np.median(f) - f if len(f) else f
    for i in peaks(height, sigma * s, min_distance) if len(t) >= 5 and s > 0 else ():
        a, b = np.searchsorted(t, t[i] - window / 2, "left"), np.searchsorted(t, t[i] + window / 2, "right")
        lt, lf = t[a:b], f[a:b]
        if len(lt) < 3:
            continue
        base = float(np.median(lf))
        depth = base - float(f[i])
        depth = depth if depth > 0 else float(height[i])
        local = robust_noise(lf)
        local = local if np.isfinite(local) and local > 0 else s
        ingress, egress, ratio, _ = crossings(lt, lf)
        rows.append((float(t[i]), depth, depth * 1e6, local, depth / local, len(lt), t[i] - window / 2, t[i] + window / 2, bool(np.count_nonzero(lf < base - depth / 2) <= 1), ingress / 24, egress / 24, ratio))
    return pd.DataFrame(rows, columns=FIRST_NAMES).sort_values(["depth", "event_time"], ascending=[False, True], ignore_index=True)


def first_scan(lc: DataFrame, sigma: float = 4.0, min_distance: int = 5, window: float = 0.5) -> DataFrame:
    """Events of every star of (star, t, flux) by the first detector. Null and infinite samples are left out; a star without events has no row."""
    if sigma <= 0 or min_distance < 1 or window <= 0:
        raise ValueError("sigma and window must be positive, min_distance at least 1")

    def one(key, pdf):
        out = first_series(pdf.t.to_numpy(), pdf.flux.to_numpy(), sigma, min_distance, window)
        out.insert(0, "star", key[0])
        return out

    return finite_samples(lc).select("star", "t", "flux").groupBy("star").applyInPandas(one, f"star long, {FIRST_FEATURES}")


def asymmetry_scores(events: DataFrame, lc: DataFrame, window: float = 0.5) -> DataFrame:
    """events (star, event_time, ...) with ingress_days, egress_days and asymmetry_score measured anew on lc; other columns stay."""
    names = FIRST_NAMES[-3:]
    at = events.select("star", F.col("event_time").alias("event")).filter("event is not null")
    got = half_depth_crossings(lc, at, window).select("star", F.col("event").alias("event_time"), (F.col("ingress_hours") / 24).alias(names[0]), (F.col("egress_hours") / 24).alias(names[1]), F.col("ratio").alias(names[2]))
    return events.drop(*names).join(got, ["star", "event_time"], "left")
