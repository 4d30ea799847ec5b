"""Rates of events in two samples: exact intervals, Fisher's test, bootstrap."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import beside


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    log = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(log)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(log)


def chi2_quantile(p: float, df: int) -> float:
    """Where the chi-squared distribution reaches p, by bisection."""
    low, high = 0.0, max(10.0, 4.0 * df)
    while 1 - upper_gamma(df / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - upper_gamma(df / 2, mid / 2) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def poisson_interval(count: int, exposure: float = 1.0, confidence: float = 0.95) -> tuple[float, float]:
    """Garwood's exact interval of a rate."""
    tail = (1 - confidence) / 2
    low = chi2_quantile(tail, 2 * count) / 2 if count else 0.0
    return low / exposure, chi2_quantile(1 - tail, 2 * (count + 1)) / 2 / exposure


def rate_ratio(target: int, target_exposure: float, control: int, control_exposure: float) -> dict:
    te, ce = max(target_exposure, 1e-9), max(control_exposure, 1e-9)
    (tl, th), (cl, ch) = poisson_interval(target, te), poisson_interval(control, ce)
    out = {"target_rate": target / te, "target_low": tl, "target_high": th, "control_rate": control / ce, "control_low": cl, "control_high": ch}
    if not control:
        return out | {"ratio": None, "ratio_low": None, "ratio_high": None}
    return out | {"ratio": (target / te) / (control / ce), "ratio_low": tl / (ch if ch > 0 else 1e-9), "ratio_high": th / max(cl, 1e-9)}


def _tail(log, seen: float, start: int, end: int, step: int) -> float:
    """Sum of exp(log(k)) from start to end where log, which falls on the way, is at most seen; terms too small to count are left out."""
    near, far = 0, (end - start) * step + 1
    while near < far:
        mid = (near + far) // 2
        if log(start + mid * step) <= seen:
            far = mid
        else:
            near = mid + 1
    total, k = 0.0, start + near * step
    while (end - k) * step >= 0:
        term = math.exp(log(k))
        total += term
        if term <= total * 1e-18:
            break
        k += step
    return total


def fisher(a: int, b: int, c: int, d: int) -> tuple[float | None, float]:
    """Odds ratio (null if undefined) and two-sided p of a table: all tables no likelier than it."""
    n, row, col = a + b + c + d, a + b, a + c
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    log = lambda k: choose(row, k) + choose(n - row, col - k) - choose(n, col)
    seen, low, high = log(a) + 1e-7, max(0, col - (n - row)), min(row, col)
    mode = min(max((row + 1) * (col + 1) // (n + 2), low), high)
    p = _tail(log, seen, mode, low, -1) + _tail(log, seen, mode + 1, high, 1) if log(mode) > seen else 1.0
    odds = None if b * c == 0 and a * d == 0 else (math.inf if b * c == 0 else a * d / (b * c))
    return odds, min(1.0, p)


def interpretation(p: float) -> str:
    if p < 0.05:
        return "p < 0.05 (nominal, not confirmed at this sample size)"
    return "p < 0.10 (marginal, not significant)" if p < 0.10 else "p >= 0.10 (no significant difference)"


def yield_by_role(events: DataFrame, pairs: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """One row: events by role and exposures. Roles come from sample_role, else from the pairs' stars;
    exposures from scanned (star, sample_role), else from the pairs; at least 1."""
    targets, controls = (pairs.select(F.col(f"{s}_id").alias("star")).filter("star is not null").distinct() for s in ("target", "control"))
    if "sample_role" not in events.columns:
        events = events.join(targets.withColumn("__t", F.lit(True)), "star", "left").join(controls.withColumn("__c", F.lit(True)), "star", "left")
        events = events.withColumn("sample_role", F.when(F.col("__t"), "target").when(F.col("__c"), "control"))
    role = F.coalesce("sample_role", F.lit("unknown"))
    counts = events.agg(F.count_if(role == "target").alias("target_candidates"), F.count_if(role == "control").alias("control_candidates"), F.count_if(~role.isin("target", "control")).alias("unknown_candidates"))
    stars = scanned.select("star", "sample_role") if scanned is not None else targets.withColumn("sample_role", F.lit("target")).unionByName(controls.withColumn("sample_role", F.lit("control")))
    one = lambda r: F.greatest(F.count_distinct(F.when(F.col("sample_role") == r, F.col("star"))), F.lit(1)).cast("double").alias(f"{r}_exposure")
    exposure = stars.agg(one("target"), one("control"))
    return beside(counts, exposure).withColumn("exposure_source", F.lit("scan_meta_actual" if scanned is not None else "matched_pairs_total"))


def rate_point(yields: DataFrame) -> DataFrame:
    """yields with both rates and their ratio, null without control events."""
    t, c = F.col("target_candidates") / F.col("target_exposure"), F.col("control_candidates") / F.col("control_exposure")
    return yields.withColumns({"target_rate": t, "control_rate": c, "rate_ratio": F.try_divide(t, c)})


STATS = (
    "target_rate double, target_low double, target_high double, control_rate double, control_low double, control_high double, ratio double, ratio_low double, ratio_high double, "
    "odds_ratio double, p_value double, interpretation string, bootstrap_median double, bootstrap_low double, bootstrap_high double, n_finite long, warning string"
)


def rate_statistics(yields: DataFrame, replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Each row of yields with intervals, Fisher's test and a bootstrap of the ratio.

    Resampling n events with replacement is a multinomial draw of the role counts, so a replicate
    costs three numbers, however many events there are. Where yields have a subset, each has draws of its own.
    """
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for y in pdf.itertuples():
                t, c, u = int(y.target_candidates), int(y.control_candidates), int(y.unknown_candidates)
                te, ce = max(y.target_exposure, 1e-9), max(y.control_exposure, 1e-9)
                r = rate_ratio(t, te, c, ce)
                odds, p = fisher(t, max(0, max(1, round(te)) - t), c, max(0, max(1, round(ce)) - c))
                n = t + c + u
                some = np.empty(0)
                if n:
                    own = zlib.crc32(str(y.subset).encode()) if hasattr(y, "subset") else 0
                    draws = np.random.default_rng([seed, own] if own else seed).multinomial(n, np.array([t, c, u]) / n, replicates)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        some = (draws[:, 0] / te) / (draws[:, 1] / ce)
                    some = some[np.isfinite(some)]
                tail = 50 * (1 - confidence)
                boot = [float(np.median(some)), float(np.percentile(some, tail)), float(np.percentile(some, 100 - tail))] if len(some) >= 2 else [None] * 3
                warning = f"unstable: only {n} events ({t} target, {c} control)" if n < 10 else None
                rows.append([*r.values(), odds, p, interpretation(p), *boot, len(some), warning])
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    from pyspark.sql import types as T

    schema = T.StructType([*yields.schema, *T._parse_datatype_string(STATS)])
    return yields.mapInPandas(run, schema)
