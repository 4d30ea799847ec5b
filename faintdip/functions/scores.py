"""Transparent scores and priorities as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import clip, finite

LOW, MEDIUM, HIGH, OVERTRIGGERED = "low", "medium", "high", "overtriggered_review"


def quality_score(snr: Column, ratio: Column, delta_chi2: Column, edge: Column, single: Column) -> Column:
    """Between 0 and 1; a missing S/N counts 0, a missing ratio 1, other missing values 0."""
    snr, ratio, dchi2 = F.coalesce(finite(snr), F.lit(0.0)), F.coalesce(finite(ratio), F.lit(1.0)), F.coalesce(finite(delta_chi2), F.lit(0.0))
    penalty = 0.25 * F.coalesce(edge, F.lit(False)).cast("int") + 0.25 * F.coalesce(single, F.lit(False)).cast("int")
    return clip(0.45 * clip(snr / 10, 0, 1) + 0.30 * clip((ratio - 1) / 5, 0, 1) + 0.25 * clip(dchi2 / 100, 0, 1) - penalty, 0, 1)


def final_score(ml: Column, quality: Column, snr: Column, edge: Column, single: Column) -> Column:
    ml, quality, snr = F.coalesce(finite(ml), F.lit(0.5)), F.coalesce(finite(quality), F.lit(0.0)), F.coalesce(finite(snr), F.lit(0.0))
    penalty = 0.15 * F.coalesce(edge, F.lit(False)).cast("int") + 0.15 * F.coalesce(single, F.lit(False)).cast("int")
    return clip(0.5 * ml + 0.4 * quality + 0.1 * clip(snr / 10, 0, 1) - penalty, 0, 1)


def star_priority(n_events: Column, n_pass: Column, concern: Column, binary: Column, score: Column, snr: Column, n_external: Column, *, many: int = 5, score_from: float = 0.65, snr_from: float = 6.0) -> Column:
    """Review priority of a star: the first rule that holds decides."""
    strong = (F.coalesce(score, F.lit(-1.0)) >= score_from) | (F.coalesce(snr, F.lit(-1.0)) >= snr_from)
    rules = [
        (n_events >= many, OVERTRIGGERED),
        ((n_pass > 0) & ~concern & ~binary, HIGH),
        (n_pass > 0, MEDIUM),
        (strong & (n_external == 0) & ~concern, MEDIUM),
    ]
    return reduce(lambda c, rule: c.when(*rule), rules[1:], F.when(*rules[0])).otherwise(LOW)
