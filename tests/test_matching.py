"""Greedy controls against one target after the other."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faintdip.operators import matching

KIND = "id long, tmag double, bp_rp double, teff double, parallax double"


def in_turn(edges, ratio):
    """The greedy order itself, over (target, control, score, fallback, fits)."""
    used, out = set(), []
    for t in sorted({e[0] for e in edges}):
        free = sorted((s, c, b, f) for x, c, s, b, f in edges if x == t and c not in used)
        if not free:
            continue
        mode = min(b for _, _, b, _ in free)
        for rank, (s, c, _, _) in enumerate([x for x in free if x[2] == mode and x[3]][:ratio], 1):
            used.add(c)
            out.append((t, c, rank))
    return sorted(out)


def rows(df):
    return sorted((r["target_id"], r["control_id"], r["match_rank"]) for r in df.collect())


@pytest.mark.parametrize("seed, group_rows", [(0, 1), (1, 40), (2, 1 << 20)])
def test_groups_of_any_size_give_the_greedy_order(spark, seed, group_rows):
    rng = random.Random(seed)
    pairs = {(rng.randrange(40), rng.randrange(50)) for _ in range(300)}
    edges = [(t, c, rng.randrange(4) / 2, rng.random() < 0.3, rng.random() < 0.7) for t, c in sorted(pairs)]
    df = spark.createDataFrame(edges, "target_id long, control_id long, score double, fallback boolean, fits boolean")
    assert rows(matching.assign(df, 2, group_rows=group_rows)) == in_turn(edges, 2)


def test_pairs_with_missing_values_and_columns(spark):
    rng = random.Random(7)
    maybe = lambda x, p=0.25: None if rng.random() < p else x
    star = lambda i: (i, maybe(rng.uniform(5, 8)), maybe(rng.uniform(0, 1)), maybe(rng.uniform(4000, 6000)), maybe(rng.uniform(-1, 20)))
    targets, pool = [star(i) for i in range(60)], [star(1000 + i) for i in range(80)]
    for drop in (None, "parallax", "bp_rp"):
        edges = []
        for t in targets:
            for c in pool:
                _, tm, tc, tt, tp = t
                _, cm, cc, ct, cp = c
                tp = tp if tp is not None and tp > 0 else None
                if drop == "parallax":
                    tp = None
                if drop == "bp_rp":
                    tc = cc = None
                near = lambda a, b, tol: b is not None and abs(a - b) < tol
                if tm is not None and not near(tm, cm, 0.5):
                    continue
                score = abs(cm - tm) / 0.5 if tm is not None else 0.0
                if tc is not None:
                    score += abs(cc - tc) / 0.15 if cc is not None else 1.0
                elif tt is not None:
                    score += abs(ct - tt) / 300 if ct is not None else 1.0
                fits = True
                if tp is not None:
                    score += abs(cp - tp) / tp / 0.5 if cp is not None else 1.0
                    fits = near(tp, cp, 0.5 * tp)
                if tc is not None:
                    if near(tc, cc, 0.15):
                        edges.append((t[0], c[0], score, False, fits))
                    if tt is None or near(tt, ct, 300):
                        edges.append((t[0], c[0], score, True, fits))
                elif tt is None or near(tt, ct, 300):
                    edges.append((t[0], c[0], score, False, fits))
        t, c = spark.createDataFrame(targets, KIND), spark.createDataFrame(pool, KIND)
        c = c.drop(drop) if drop else c
        assert rows(matching.matched_pairs(t, c, group_rows=300)) == in_turn(edges, 1), drop


def test_a_missing_criterion_is_skipped(spark):
    t = spark.createDataFrame([(1, 8.0), (2, 8.1)], "id long, tmag double")
    c = spark.createDataFrame([(7,), (8,)], "id long")
    got = [(r["target_id"], r["control_id"], r["score"]) for r in matching.candidates(t, c).collect()]
    assert sorted(got) == [(1, 7, 0.0), (1, 8, 0.0), (2, 7, 0.0), (2, 8, 0.0)]
    assert rows(matching.matched(t, c)) == [(1, 7, 1), (2, 8, 1)]


def test_pool_aliases(spark):
    from faintdip.operators import catalogs

    raw = spark.createDataFrame([("TIC 5", "x", "Yes", "0", "3"), ("6", "y", "1", "true", "2"), ("7", "z", "no", "0", "0")], "TIC string, Name string, has_tess string, disk_flag string, n_tess string")
    pool = catalogs.normalize_pool(raw)
    got = {r["tic_id"]: (r["target_name"], r["has_tess_lightcurve"], r["ir_excess_flag"], r["n_tess_products"]) for r in pool.collect()}
    assert got == {5: ("x", True, False, 3.0), 6: ("y", True, True, 2.0), 7: ("z", False, False, 0.0)}
    assert [r["tic_id"] for r in matching.usable(pool).collect()] == [5]


def test_controls_within_the_same_group(spark):
    t = spark.createDataFrame([(1, 8.0, "a"), (2, 8.0, "b"), (3, 8.0, None)], "id long, tmag double, field string")
    c = spark.createDataFrame([(7, 8.0, "b"), (8, 8.4, "a"), (9, 8.0, None)], "id long, tmag double, field string")
    assert rows(matching.matched(t, c, within=("field",))) == [(1, 8, 1), (2, 7, 1), (3, 9, 1)]


def test_many_equal_targets_settle_in_few_rounds(spark, monkeypatch):
    """20,000 targets that like the same controls in the same order, as one class, and as lists of their own."""
    cuts = []
    monkeypatch.setattr(matching, "cut", lambda df, real=matching.cut: cuts.append(1) or real(df))
    n = 20_000
    targets = spark.range(n).select(F.col("id"), F.lit(8.0).alias("tmag"))
    pool = spark.range(n + 5).select((F.col("id") + n).alias("id"), (8 + F.col("id") / (4 * n)).alias("tmag"))
    got = matching.matched_pairs(targets, pool)
    assert got.filter("control_id = target_id + 20000").count() == n == got.count() and len(cuts) < 40
    cuts.clear()
    near = spark.range(n).select(F.col("id").alias("target_id"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("control_id"), F.lit(0.5).alias("score"))
    got = matching.assign(near, group_rows=200_000)
    assert rows(got) == [(i, i, 1) for i in range(30)] and len(cuts) < 40


def test_crowded_band_with_a_dense_pool(spark):
    """Distinct values, so that lists differ: near ones are opened first, and all is as in turn."""
    rng = random.Random(11)
    targets = [(i, 8 + rng.random() / 50, None, None, None) for i in range(300)]
    pool = [(1000 + i, 8 + rng.random() / 4, None, None, None) for i in range(400)]
    edges = [(t[0], c[0], abs(c[1] - t[1]) / 0.5, False, True) for t in targets for c in pool]
    got = matching.matched_pairs(spark.createDataFrame(targets, KIND), spark.createDataFrame(pool, KIND), group_rows=20_000)
    assert rows(got) == in_turn(edges, 1)


def test_no_targets_and_no_pool(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame([(1, 8.0, None, None, None), (None, 8.0, None, None, None)], KIND)
    for t, c in ((none, some), (some, none), (none, none)):
        assert matching.matched_pairs(t, c).count() == matching.candidates(t, c).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_batches_of_targets_give_the_greedy_order(spark, monkeypatch, seed):
    """Batches of a few targets, each with the controls that are left, and lists opened in many levels."""
    monkeypatch.setattr(matching, "PAIRS", 400), monkeypatch.setattr(matching, "PAIRS_A_ROW", 1)
    monkeypatch.setattr(matching, "EDGES", 200), monkeypatch.setattr(matching, "EDGES_A_ROW", 1)
    monkeypatch.setattr(matching, "DENSE", 4)
    rng = random.Random(seed)
    targets = [(i, round(8 + rng.random(), 2), None, None, None) for i in range(90)]
    pool = [(1000 + i, round(8 + rng.random(), 2), None, None, None) for i in range(40)]
    edges = [(t[0], c[0], abs(c[1] - t[1]) / 0.5, False, True) for t in targets for c in pool if abs(c[1] - t[1]) < 0.5]
    got = matching.matched_pairs(spark.createDataFrame(targets, KIND), spark.createDataFrame(pool, KIND))
    assert rows(got) == in_turn(edges, 1)


def test_candidates_are_joined_once(spark):
    """No join, and so no shuffle, of the pairs themselves."""
    t, c = (spark.createDataFrame([(i, 8.0, 0.5, 5000.0, 2.0)], KIND) for i in (1, 2))
    out = matching.candidates(t, c)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1 and rows(out.withColumn("match_rank", F.lit(1))) == [(1, 2, 1)]


def test_controls_are_matched_without_a_table_of_pairs(spark, monkeypatch):
    """Where all is within reach of all, what is shuffled is the two sides."""
    monkeypatch.setattr(matching, "_banded", lambda *a, **b: pytest.fail("pairs are joined"))
    targets = [(i, 8.0 + i % 7 / 100, None, None, None) for i in range(60)]
    pool = [(1000 + i, 8.0 + i % 11 / 100, None, None, None) for i in range(50)]
    t, c = (spark.createDataFrame(x, KIND) for x in (targets, pool))
    for got, tol in ((matching.matched_pairs(t, c), 0.5), (matching.matched(t, c), 1.0)):
        assert rows(got) == in_turn([(x[0], y[0], abs(y[1] - x[1]) / tol, False, True) for x in targets for y in pool], 1)


@pytest.mark.parametrize("group_rows", [3, 1000])
def test_regions_and_batches_give_the_greedy_order(spark, monkeypatch, group_rows):
    """Regions of a few controls next to one another, targets without a magnitude among them, two controls each, ids that repeat."""
    monkeypatch.setattr(matching, "DENSE", 2)
    rng = random.Random(group_rows)
    maybe = lambda x: None if rng.random() < 0.2 else x
    star = lambda i: (i, maybe(round(rng.uniform(0, 8), 1)), maybe(rng.randrange(4) / 4), None, maybe(float(rng.randrange(1, 5))), "ab"[i % 2])
    targets, pool = [star(i // 2) for i in range(80)], [star(1000 + i // 2) for i in range(90)]
    used, want = set(), []
    for t in sorted(targets, key=lambda t: [(x is not None, x) for x in t]):
        near = lambda k, tol: t[k] is None or c[k] is not None and abs(c[k] - t[k]) <= tol  # noqa: B023, E731
        best = {}
        for c in pool:
            if c[0] not in used and c[5] == t[5] and near(1, 1.0) and near(2, 0.35) and near(4, 0.5 * (t[4] or 1)):
                score = sum(abs(c[k] - t[k]) / tol for k, tol in ((1, 1.0), (2, 0.35), (4, 0.5 * (t[4] or 1))) if t[k] is not None)
                best[c[0]] = min(score, best.get(c[0], score))
        for rank, (_, c) in enumerate(sorted((s, c) for c, s in best.items())[:2], 1):
            used.add(c)
            want.append((t[0], c, rank))
    t, c = (spark.createDataFrame(x, KIND + ", field string") for x in (targets, pool))
    assert rows(matching.matched(t, c, 2, within=("field",), group_rows=group_rows)) == sorted(want)


def test_candidates_are_dealt_to_all_partitions(spark):
    """However small the two sides are, their pairs are not left to a few tasks."""
    t, c = (spark.createDataFrame([(k * 1000 + i, i % 40 / 4, None, None, None) for i in range(400)], KIND) for k in (1, 2))
    out = matching.candidates(t, c)
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
    assert out.count() == sum(abs(i % 40 - j % 40) <= 4 for i in range(400) for j in range(400))
