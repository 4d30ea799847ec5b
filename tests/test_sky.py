import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faintdip.functions.coords import clean_id, from_parts, separation_arcsec, sexagesimal
from faintdip.operators import catalogs, matching, sky


def points(spark, rows):
    return spark.createDataFrame([(i, *map(lambda x: None if x is None else float(x), r)) for i, r in enumerate(rows)], "id long, ra double, dec double")


def brute(a, b, radius):
    out = set()
    for i, (r1, d1) in enumerate(a):
        for j, (r2, d2) in enumerate(b):
            r1_, d1_, r2_, d2_ = map(np.radians, (r1, d1, r2, d2))
            h = np.sin((d2_ - d1_) / 2) ** 2 + np.cos(d1_) * np.cos(d2_) * np.sin((r2_ - r1_) / 2) ** 2
            if np.degrees(2 * np.arcsin(np.sqrt(min(1, h)))) * 3600 <= radius:
                out.add((i, j))
    return out


@pytest.mark.parametrize("radius", [30.0, 3600.0, 40_000.0])
def test_zone_join_is_the_cross_join(spark, radius):
    rng = np.random.default_rng(int(radius))
    d = radius / 3600
    spots = [(0.0, 0.0), (359.9999, 10.0), (120.0, 89.9), (10.0, -89.95), (200.0, 60.0), (45.0, 90.0), (45.0, -90.0)]
    a = [((r + rng.normal(0, d / max(np.cos(np.radians(e)), 0.01))) % 360, float(np.clip(e + rng.normal(0, d), -90, 90))) for r, e in spots for _ in range(8)]
    b = [((r + rng.normal(0, d / max(np.cos(np.radians(e)), 0.01))) % 360, float(np.clip(e + rng.normal(0, d), -90, 90))) for r, e in spots for _ in range(8)]
    got = sky.within(points(spark, a), points(spark, b), radius).collect()
    assert len(got) == len({(r[0], r[1]) for r in got})
    assert {(r[0], r[1]) for r in got} == brute(a, b, radius)


def test_nearest_and_statuses(spark):
    a = points(spark, [(10, 5), (20, -5), (None, 1), (30, 0)])
    b = points(spark, [(10.0001, 5.0001), (10.0001, 5.0001), (359, 80)])
    got = {r["id"]: (r["x_status"], r["x_match_id"]) for r in sky.crossmatch(a, b, 1.0, "x", limit=2).collect()}
    assert got == {0: ("matched", 0), 1: ("not_found", None), 2: ("not_attempted", None), 3: ("not_attempted", None)}
    with pytest.raises(ValueError):
        sky.nearest(a, b, 0)


def test_dedupe_is_greedy(spark):
    s = 1 / 3600
    df = points(spark, [(10, 0), (10, 1.5 * s), (10, 3 * s), (50, 50), (None, None)])
    assert sorted(r["id"] for r in sky.deduplicate(df, 2.0).collect()) == [0, 2, 3, 4]
    assert sorted(r["id"] for r in sky.deduplicate(df, 2.0, "last").collect()) == [0, 2, 3, 4]
    df = points(spark, [(10, 0), (10, 1.5 * s)])
    assert [r["id"] for r in sky.deduplicate(df, 2.0, "last").collect()] == [1]


def test_exclusion_reasons(spark):
    pool = points(spark, [(10, 0), (20, 0), (30, 0)])
    got = sky.excluded(pool, spark.createDataFrame([(0,)], "id long"), points(spark, [(20, 0.0001)]), 5.0)
    assert {r["id"]: r["excluded_reason"] for r in got.collect()} == {0: "known_ir_excess_tic", 1: "known_ir_excess_coordinate", 2: ""}


def test_coordinates(spark):
    df = spark.createDataFrame([("03 36 52.38", "-00 30 00", "TIC 12.0"), ("03h36m52.38s", "+10d30m00s", "7"), ("x", None, "none")], "r string, d string, i string")
    got = df.select(sexagesimal(F.col("r"), True).alias("ra"), sexagesimal(F.col("d"), False).alias("dec"), clean_id(F.col("i")).alias("id")).collect()
    assert got[0]["ra"] == pytest.approx(54.21825) and got[0]["dec"] == pytest.approx(-0.5) and got[0]["id"] == 12
    assert got[1]["dec"] == pytest.approx(10.5) and got[1]["id"] == 7
    assert tuple(got[2]) == (None, None, None)
    row = spark.range(1).select(from_parts(F.lit(10), F.lit(30), F.lit(0), False, F.lit("-")).alias("d"), separation_arcsec(F.lit(10.0), F.lit(5.0), F.lit(10.0), F.lit(5.001)).alias("s")).first()
    assert row["d"] == -10.5 and row["s"] == pytest.approx(3.6)


def test_catalog_rows(spark):
    raw = spark.createDataFrame([("A", 1, 30, 0, "-", 10, 30, 0, "TIC 5")], "Name string, RAh int, RAm int, RAs int, `DE-` string, DEd int, DEm int, DEs int, TIC string")
    r = catalogs.normalize(raw, "chen_2014").first()
    assert (r["target_name"], r["ra_deg"], r["dec_deg"], r["tic_id"], r["catalog_priority"]) == ("A", 22.5, -10.5, 5, 2)


def test_greedy_assignment_is_the_sequential_one(spark):
    rng = np.random.default_rng(3)
    edges = pd.DataFrame({"target_id": rng.integers(0, 30, 200), "control_id": rng.integers(0, 40, 200)}).drop_duplicates()
    edges["score"] = rng.integers(0, 5, len(edges)) / 2
    used, want = set(), []
    for t, g in edges.sort_values(["target_id", "score", "control_id"]).groupby("target_id"):
        free = g[~g.control_id.isin(used)].head(2)
        used |= set(free.control_id)
        want += [(t, c, k) for k, c in enumerate(free.control_id, 1)]
    got = matching.assign(spark.createDataFrame(edges), 2).collect()
    assert sorted((r["target_id"], r["control_id"], r["match_rank"]) for r in got) == sorted(want)


def test_usable_controls(spark):
    pool = spark.createDataFrame([(1, "yes", "0"), (2, "no", "0"), (3, "1", "true"), (4, "1", None)], "id int, has_tess_lightcurve string, ir_excess_flag string")
    assert [r["id"] for r in matching.usable(pool).collect()] == [1]


def test_candidates_of_targets_without_magnitude_and_colour(spark):
    import random

    kind = "id long, tmag double, bp_rp double, teff double, parallax double"
    rng = random.Random(5)
    maybe = lambda x, p=0.2: None if rng.random() < p else x
    pool = [(i, maybe(rng.uniform(5, 9)), maybe(rng.uniform(0, 2)), maybe(rng.uniform(3000, 9000)), maybe(rng.uniform(-1, 20))) for i in range(200)]
    targets = [(1000 + i, None, None, maybe(rng.uniform(3000, 9000), 0.4), maybe(rng.uniform(-5, 20), 0.3)) for i in range(40)] + [(2000, None, None, None, None), (2001, None, None, None, 8.0), (2002, None, None, None, -1.0)]
    want = set()
    for t in targets:
        for c in pool:
            warm = t[3] is None or (c[3] is not None and abs(c[3] - t[3]) <= 400)
            far = t[4] is None or t[4] <= 0 or (c[4] is not None and abs(c[4] - t[4]) / t[4] <= 0.5)
            if warm and far:
                want.add((t[0], c[0]))
    got = [(r["target_id"], r["control_id"]) for r in matching.candidates(spark.createDataFrame(targets, kind), spark.createDataFrame(pool, kind)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and sum(t == 2000 for t, _ in got) == 200


@pytest.mark.parametrize("keep", ["first", "last"])
@pytest.mark.parametrize("group_rows", [40, 1 << 19])
def test_dedupe_by_groups_of_any_size(spark, keep, group_rows):
    """A long chain in order of id, a crowd, and points far from all."""
    rng = np.random.default_rng(9)
    chain = [(i, 10 + i * 2.9 / 3600, 0.0) for i in range(60)]
    crowd = [(1000 + i, 50 + rng.uniform(0, 12) / 3600, rng.uniform(0, 12) / 3600) for i in range(60)]
    rows = chain + crowd + [(5000, None, 1.0), (5001, 200.0, 80.0)]
    want, kept = set(), []
    for i, ra, dec in sorted(rows, reverse=keep == "last"):
        near = ra is not None and any(abs(dec - d) < 1 and np.hypot((ra - r) * np.cos(np.radians(dec)), dec - d) * 3600 <= 3.0 for _, r, d in kept)
        if not near:
            want.add(i)
            if ra is not None:
                kept.append((i, ra, dec))
    got = sky.deduplicate(spark.createDataFrame(rows, "id long, ra double, dec double"), 3.0, keep, group_rows)
    assert {r["id"] for r in got.collect()} == want


def test_a_chain_of_many_points(spark):
    n = 20_000
    pairs = spark.range(1, n).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert [r["a"] for r in sky._losers(pairs, 8_000).orderBy("a").collect()] == list(range(1, n, 2))


@pytest.mark.parametrize("crowd", [5, 2000])
def test_a_crowded_field(spark, monkeypatch, crowd):
    """A third of all points in one cell: the same pairs, and no task with more than a twentieth of them."""
    monkeypatch.setattr(sky, "CROWD", crowd)
    rng = np.random.default_rng(6)
    n = 300
    ra, dec = rng.uniform(0, 360, n), rng.uniform(-80, 80, n)
    ra[:100], dec[:100] = 120 + rng.uniform(0, 0.5, 100), 20 + rng.uniform(0, 0.5, 100)
    pdf = pd.DataFrame({"id": range(n), "ra": ra, "dec": dec})
    pdf = pd.concat([pdf, pdf.head(2)])  # rows that repeat
    df = spark.createDataFrame(pdf)
    got = sorted((r["left_id"], r["right_id"]) for r in sky.within(df, df, 3600.0).collect())
    a, d = np.radians(pdf.ra.to_numpy()), np.radians(pdf.dec.to_numpy())
    cos = np.sin(d)[:, None] * np.sin(d) + np.cos(d)[:, None] * np.cos(d) * np.cos(a[:, None] - a)
    i, j = np.nonzero(np.degrees(np.arccos(np.clip(cos, -1, 1))) <= 1)
    ids = pdf.id.to_numpy()
    assert got == sorted(zip(ids[i].tolist(), ids[j].tolist()))
    if crowd == 5:
        one = df.select(F.col("id").alias("left_id"), F.col("ra").alias("ra1"), F.col("dec").alias("dec1"), F.lit(1).alias("zone"), F.lit(1).alias("cell"))
        two = df.select(F.col("id").alias("right_id"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), F.lit(1).alias("zone"), F.lit(1).alias("cell"))
        p, q = sky._in_blocks(one, two)
        work = [r["count"] for r in p.join(q, ["zone", "cell", "p", "q"]).groupBy("p", "q").count().collect()]
        assert sum(work) == len(pdf) ** 2 and max(work) < sum(work) / 20


def test_nearest_looks_near_first(spark):
    """A wide radius and a dense pool: in several radii, the same as over all pairs within the last."""
    stars = spark.range(200).selectExpr("id", "(id * 137.508D) % 360 as ra", "(id * 53.13D) % 160 - 80 as dec")
    pool = spark.range(4000).selectExpr("id", "(id * 97.31D) % 360 as ra", "(id * 31.77D) % 160 - 80 as dec")
    radius = 40_000.0
    assert len(sky._radii(pool, radius)) > 1
    want = {}
    for r in sky.within(stars, pool, radius).collect():
        want[r["left_id"]] = min(want.get(r["left_id"], (1e9, 0)), (r["separation_arcsec"], r["right_id"]))
    assert {r["left_id"]: (r["separation_arcsec"], r["right_id"]) for r in sky.nearest(stars, pool, radius).collect()} == want
