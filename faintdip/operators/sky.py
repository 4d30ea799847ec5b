"""Joins on the sky: nearest neighbour within a radius, and deduplication.

Points are dealt to zones of declination and cells of right ascension; the searching side is
copied to the cells that its radius touches, with right ascension wrapped around and widened
towards the poles. So a join is an equi-join on small cells, with an exact check after it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import number
from ..functions.coords import separation_arcsec
from ..lineage import cut, running
from .medians import BROADCAST

#: Rows of a cell from which it counts as crowded, and of each side that a task meets at once there.
CROWD = 2000
#: Arcseconds up to which a radius is searched at once.
WIDE = 60.0


def with_coordinates(df: DataFrame, ra: str = "ra_deg", dec: str = "dec_deg") -> DataFrame:
    """ra_deg and dec_deg as finite numbers or null, and has_skycoord."""
    df = df.withColumns({"ra_deg": number(F.col(ra)), "dec_deg": number(F.col(dec))})
    return df.withColumn("has_skycoord", F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull())


def _height(radius_arcsec: float) -> float:
    return max(radius_arcsec / 3600 * 1.000001, 1e-4)


def _cells(zone: Column, height: float) -> Column:
    """How many cells of about height the zone's circle has; the caps have one."""
    widest = F.least(F.abs(zone), F.abs(zone + 1)) * height  # the edge nearer to the equator
    narrow = F.greatest(F.abs(zone), F.abs(zone + 1)) * height
    cells = F.floor(360 * F.cos(F.radians(F.least(narrow, F.lit(90.0)))) / height)
    return F.when((narrow >= 89.0) | (cells < 3), F.lit(1)).otherwise(F.when(widest > 90, 1).otherwise(cells)).cast("long")


def _placed(df: DataFrame, height: float) -> DataFrame:
    zone = F.floor(F.col("dec") / height)
    ra = F.pmod(F.col("ra"), F.lit(360.0))
    return df.withColumn("zone", zone).withColumn("cell", F.least(F.floor(ra / 360 * _cells(F.col("zone"), height)), _cells(F.col("zone"), height) - 1))


def _searching(df: DataFrame, height: float) -> DataFrame:
    """A copy for every cell within reach."""
    df = df.withColumn("zone", F.explode(F.array(*(F.floor(F.col("dec") / height) + i for i in (-1, 0, 1)))))
    n = _cells(F.col("zone"), height)
    ra = F.least(F.floor(F.pmod(F.col("ra"), F.lit(360.0)) / 360 * n), n - 1)
    # cells are as wide as the radius or wider at the zone's narrow edge
    return df.withColumn("cell", F.explode(F.array_distinct(F.array(*(F.pmod(ra + i, n) for i in (-1, 0, 1))))))


def _in_blocks(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on (zone, cell) with blocks p and q: in crowded cells p numbers a's rows and q b's, by CROWD at most or so.

    A row is copied to all blocks of the other side, so the pairs of a crowded field are met by many tasks.
    """
    one = lambda df, left: df.groupBy("zone", "cell").agg(F.count("*").alias("n")).select("zone", "cell", *((F.col("n") if x == left else F.lit(0).cast("long")).alias(x) for x in ("l", "r")))
    both = one(a, "l").unionByName(one(b, "r")).groupBy("zone", "cell").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    crowded = cut(both.filter((F.greatest("l", "r") > CROWD) & (F.least("l", "r") > 0)))
    n = crowded.count()
    if not n:
        flat = {"p": F.lit(0), "q": F.lit(0)}
        return a.withColumns(flat), b.withColumns(flat)
    blocks = crowded.select("zone", "cell", F.ceil(F.col("l") / CROWD).cast("int").alias("ps"), F.ceil(F.col("r") / CROWD).cast("int").alias("qs"))
    blocks = F.broadcast(blocks) if n <= BROADCAST else blocks
    mine = lambda key, many: F.pmod(F.xxhash64(*key), F.coalesce(many, F.lit(1))).cast("int")
    all_of = lambda many: F.explode(F.sequence(F.lit(0), F.coalesce(many, F.lit(1)) - 1))
    a = a.join(blocks, ["zone", "cell"], "left").withColumn("p", mine(["left_id", "ra1", "dec1"], "ps")).withColumn("q", all_of("qs")).drop("ps", "qs")
    b = b.join(blocks, ["zone", "cell"], "left").withColumn("q", mine(["right_id", "ra2", "dec2"], "qs")).withColumn("p", all_of("ps")).drop("ps", "qs")
    return a, b


def _on_sphere(df: DataFrame, side: str) -> DataFrame:
    """df with the point of the unit sphere at its position."""
    ra, dec = F.radians(F.col(f"ra{side}")), F.radians(F.col(f"dec{side}"))
    return df.withColumns({f"x{side}": F.cos(dec) * F.cos(ra), f"y{side}": F.cos(dec) * F.sin(ra), f"z{side}": F.sin(dec)})


def within(left: DataFrame, right: DataFrame, radius_arcsec: float) -> DataFrame:
    """(left_id, right_id, separation_arcsec) of all pairs within the radius; both sides have id, ra, dec in degrees."""
    if radius_arcsec <= 0:
        raise ValueError("the radius must be positive")
    h = _height(radius_arcsec)
    ok = "ra is not null and dec is not null"
    a = _searching(left.select("id", "ra", "dec").filter(ok), h).select(F.col("id").alias("left_id"), F.col("ra").alias("ra1"), F.col("dec").alias("dec1"), "zone", "cell")
    b = _placed(right.select("id", "ra", "dec").filter(ok), h).select(F.col("id").alias("right_id"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), "zone", "cell")
    sep = separation_arcsec(F.col("ra1"), F.col("dec1"), F.col("ra2"), F.col("dec2"))
    a, b = _in_blocks(a, b)
    # chords are cheap and spare most of the cells' pairs the angle, which decides
    a, b = _on_sphere(a, "1"), _on_sphere(b, "2")
    chord = (2 * math.sin(math.radians(min(radius_arcsec / 3600, 180.0)) / 2) * (1 + 1e-6) + 1e-14) ** 2
    near = sum((F.col(f"{x}1") - F.col(f"{x}2")) * (F.col(f"{x}1") - F.col(f"{x}2")) for x in "xyz") <= chord
    return a.join(b, ["zone", "cell", "p", "q"]).filter(near).withColumn("separation_arcsec", sep).filter(F.col("separation_arcsec") <= radius_arcsec).select("left_id", "right_id", "separation_arcsec")


def nearest(left: DataFrame, right: DataFrame, radius_arcsec: float = 3.0) -> DataFrame:
    """The nearest right point of each left point within the radius; of equals the smallest id.

    Wide radii are searched near first, and again only for points that have nothing there, so the pairs
    that are met hang on the points and not on how many lie within the radius.
    """
    best = F.min(F.struct("separation_arcsec", "right_id")).alias("b")
    closest = lambda some, r: within(some, right, r).groupBy("left_id").agg(best).select("left_id", "b.right_id", "b.separation_arcsec")
    radii = _radii(right, radius_arcsec)
    found, some = [], left.select("id", "ra", "dec") if len(radii) > 1 else left
    for r in radii[:-1]:
        found.append(cut(closest(some, r)))
        some = cut(some.join(found[-1].select(F.col("left_id").alias("id")), "id", "left_anti"))
    return reduce(DataFrame.unionByName, found, closest(some, radii[-1]))


def _radii(right: DataFrame, radius_arcsec: float) -> list[float]:
    """Radii that double up to the last; the first holds some four points if they are spread evenly over the sky."""
    radii = [radius_arcsec]
    if radius_arcsec > WIDE:
        some = 3600 * 360 / math.pi * 2 / math.sqrt(max(1, right.count()))
        while radii[0] > max(some, WIDE):
            radii.insert(0, radii[0] / 2)
    return radii


def crossmatch(left: DataFrame, right: DataFrame, radius_arcsec: float, prefix: str, limit: int | None = None, order: str = "id") -> DataFrame:
    """left with {prefix}_match_id, {prefix}_sep_arcsec and {prefix}_status.

    Status is matched, not_found, or not_attempted for rows without coordinates and, with limit,
    for those after the first limit rows by order.
    """
    tried = F.col("ra").isNotNull() & F.col("dec").isNotNull()
    if limit is not None:
        chosen = left.filter(tried).orderBy(order).limit(limit).select("id").withColumn("__tried", F.lit(True))
        left = left.join(chosen, "id", "left")
        tried = F.coalesce(F.col("__tried"), F.lit(False))
    got = nearest(left.filter(tried), right, radius_arcsec).withColumnsRenamed({"left_id": "id", "right_id": f"{prefix}_match_id", "separation_arcsec": f"{prefix}_sep_arcsec"})
    status = F.when(~tried, "not_attempted").when(F.col(f"{prefix}_match_id").isNotNull(), "matched").otherwise("not_found")
    return left.join(got, "id", "left").withColumn(f"{prefix}_status", status).drop("__tried")


def approximate_controls(targets: DataFrame, pool: DataFrame, radius_arcsec: float = 30.0, limit: int | None = None) -> DataFrame:
    """(target_id, separation_arcsec, all columns of pool): the nearest of the pool to each target within the radius.

    Only stars of a real pool with coordinates are returned, none is made up. With limit only the
    first pairs by target id stay. Both sides have id, ra, dec.
    """
    near = nearest(targets, pool, radius_arcsec).select(F.col("left_id").alias("target_id"), F.col("right_id").alias("id"), "separation_arcsec")
    if limit is not None:
        near = near.orderBy("target_id").limit(limit)
    return near.join(pool, "id").select("target_id", "separation_arcsec", *pool.columns)


#: Pairs of close points that one task decides at a time.
GROUP = 1 << 19
KEPT, GONE, OPEN = 1, 0, -1


def deduplicate(df: DataFrame, radius_arcsec: float = 3.0, keep: str = "first", group_rows: int = GROUP) -> DataFrame:
    """df (id, ra, dec, ...) without points within the radius of a kept one, taken in order of id.

    Keeping is greedy: a point goes only if a kept point is near, so of a chain A-B-C both A and C
    can stay. Rows without coordinates stay. keep is "first" or "last".
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    sign = 1 if keep == "first" else -1
    close = within(df, df, radius_arcsec).filter(F.col("left_id") * sign > F.col("right_id") * sign)
    gone = _losers(close.select((F.col("left_id") * sign).alias("a"), (F.col("right_id") * sign).alias("b")), group_rows)
    return df.join(gone.select((F.col("a") * sign).alias("id")), "id", "left_anti")


def decide(pairs: pd.DataFrame) -> pd.DataFrame:
    """(a, state) of the points a of pairs (a, b, state of b), b before a, that can be decided: gone if any b is kept, kept if all are gone.

    Points are taken in order, so one may hang on others of the same pairs; such that hang on an open one elsewhere stay open.
    """
    order = np.argsort(pairs.a.to_numpy(), kind="stable")
    a, b, state = (pairs[c].to_numpy()[order] for c in ("a", "b", "state"))
    names, start = np.unique(a, return_index=True)
    stop = np.append(start[1:], len(a))
    # arrays only: a list of a group's numbers would take several times their bytes
    at = np.minimum(np.searchsorted(names, b), max(len(names) - 1, 0)).astype(np.int32)
    inside = (state == OPEN) & (names[at] == b) if len(a) else np.zeros(0, bool)
    lost = np.add.reduceat(state == KEPT, start, dtype=np.int64) > 0 if len(a) else np.zeros(0, bool)
    waits = np.add.reduceat((state == OPEN) & ~inside, start, dtype=np.int64) > 0 if len(a) else np.zeros(0, bool)
    mine = np.where(lost, GONE, np.where(waits, OPEN, KEPT)).astype(np.int8)
    hangs = np.add.reduceat(inside, start, dtype=np.int64) > 0 if len(a) else np.zeros(0, bool)
    for i in np.flatnonzero(hangs & ~lost):
        near = mine[at[start[i] : stop[i]][inside[start[i] : stop[i]]]]
        # one kept neighbour is enough; else one open neighbour leaves it open
        if (near == KEPT).any():
            mine[i] = GONE
        elif (near == OPEN).any():
            mine[i] = OPEN
    done = mine != OPEN
    return pd.DataFrame({"a": names[done].astype("int64"), "state": mine[done].astype("int64")})


def _losers(pairs: DataFrame, group_rows: int) -> DataFrame:
    """(a) of the points that lose to a kept one, for pairs (a, b) of close points, b before a.

    Points are dealt in their order to groups of about group_rows pairs. In each round every group decides what hangs
    on decided points and on its own, so the first group with open points is done by each round: there are at most as many
    rounds as groups, and few where chains are short. A chain of any length is no group.
    """
    pairs = cut(pairs.distinct())
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    groups = running(sizes, [F.col("a")], upto="n").select("a", F.floor((F.col("upto") - F.col("n")) / group_rows).alias("group"))
    # a point that has no earlier neighbour is kept from the start
    later = sizes.select(F.col("a").alias("b"), F.lit(OPEN).alias("state"))
    open_ = cut(pairs.join(groups, "a").join(later, "b", "left").select("a", "b", "group", F.coalesce("state", F.lit(KEPT)).cast("long").alias("state")))
    lost = open_.select("a").limit(0)
    while not open_.isEmpty():
        now = cut(open_.groupBy("group").applyInPandas(lambda pdf: decide(pdf), "a long, state long"))
        lost = lost.unionByName(now.filter(F.col("state") == GONE).select("a"))
        news = now.select(F.col("a").alias("b"), F.col("state").alias("news"))
        left = open_.join(now.select("a"), "a", "left_anti").join(news, "b", "left")
        open_ = cut(left.select("a", "b", "group", F.coalesce("news", "state").alias("state")))
    return lost


def excluded(pool: DataFrame, bad_ids: DataFrame, bad_points: DataFrame, radius_arcsec: float = 5.0) -> DataFrame:
    """pool (id, ra, dec, ...) with excluded_reason: a known id, else a known coordinate, else ''."""
    known = bad_ids.select("id").distinct().withColumn("__id", F.lit(True))
    near = nearest(pool, bad_points, radius_arcsec).select(F.col("left_id").alias("id"), F.lit(True).alias("__near"))
    reason = F.when(F.col("__id"), "known_ir_excess_tic").when(F.col("__near"), "known_ir_excess_coordinate").otherwise("")
    return pool.join(known, "id", "left").join(near, "id", "left").withColumn("excluded_reason", reason).drop("__id", "__near")
