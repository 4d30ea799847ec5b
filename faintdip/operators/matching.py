"""Matched controls: band joins for candidates, then greedy assignment without reuse.

The greedy choice depends on the order of the targets. Regions of magnitude settle it each for themselves over arrays of free
controls, near ones first, and a control that several regions take is left to the first target, until no two take the same.
Large sets of targets are settled in batches, in order, each of the controls that earlier batches left. assign() does
the same for given edges, by groups of targets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import truthy
from ..lineage import cut, running

CRITERIA = ("tmag", "bp_rp", "teff", "parallax")
#: Cells of the pool for classes that have no criterion.
CELLS = 64
#: Keys that each band of candidates is dealt to.
SPREAD = 16
#: Controls to either side in magnitude that a target looks at first; eight times as many next.
DENSE = 64
#: Pairs of targets and free controls that a first batch of targets may have, at least and for each row of the input, and
#: likewise pairs looked at that later batches aim at.
PAIRS, PAIRS_A_ROW = 1 << 40, 1 << 20
EDGES, EDGES_A_ROW = 1 << 30, 1 << 12
#: Targets of a batch, and controls of a region, at most: what one task holds. Few regions take few rounds.
REGION = 1 << 20
#: Targets that are numbers of Python at a time.
CHUNK = 1 << 13
#: Edges and targets that one task settles at a time.
GROUP = 1 << 19
NO_BOUND = (1 << 63) - 1


def usable(pool: DataFrame) -> DataFrame:
    """Controls that have data and are no disk; a criterion without its column is skipped."""
    if "has_tess_lightcurve" in pool.columns:
        pool = pool.filter(truthy(F.col("has_tess_lightcurve")))
    if "ir_excess_flag" in pool.columns:
        pool = pool.filter(~truthy(F.col("ir_excess_flag"), True))
    return pool


def _criterion(target: Column, delta: Column, tolerance: float, strict: bool):
    """(passes, score): skipped where the target lacks the value, failed where the control does."""
    ok = delta < tolerance if strict else delta <= tolerance
    return target.isNull() | F.coalesce(ok, F.lit(False)), F.coalesce(delta / tolerance, F.lit(0.0))


def _rows(targets: DataFrame, pool: DataFrame, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides as (id, values): those of targets as t_, of controls as c_, and in_ for the columns of within.

    A criterion whose column one side lacks is null on both, so it is skipped, as is a parallax that is not positive.
    """
    both = [n for n in CRITERIA if n in targets.columns and n in pool.columns]
    value = lambda n: (F.col(n) if n in both else F.lit(None)).cast("double")
    t, c = (df.filter("id is not null").select("id", *(value(n).alias(f"{side}_{n}") for n in CRITERIA), *(F.coalesce(F.col(w).cast("string"), F.lit("")).alias(f"in_{w}") for w in within)) for df, side in ((targets, "t"), (pool, "c")))
    return t.withColumn("t_parallax", F.when(F.col("t_parallax") > 0, F.col("t_parallax"))), c.withColumnRenamed("id", "control_id")


def _banded(t: DataFrame, c: DataFrame, *keys: tuple[str, float], within: tuple[str, ...] = (), octaves: tuple[float, float] | None = None) -> DataFrame:
    """Pairs of classes and controls in the same or neighbouring bands of every key, and the same values of within.

    A parallax's tolerance is a share of it, so its bands are octaves, between the two factors. Without any
    key a class meets the pool in cells of about even size.
    """
    names = [f"in_{w}" for w in within]
    for name, size in keys:
        size *= 1 + 1e-9
        t = t.withColumn(f"band_{name}", F.explode(F.array(*(F.floor(F.col(f"t_{name}") / size) + i for i in (-1, 0, 1)))))
        c = c.withColumn(f"band_{name}", F.floor(F.col(f"c_{name}") / size))
        names.append(f"band_{name}")
    if octaves:
        low, high = (F.floor(F.log2(F.col("t_parallax") * x)) for x in octaves)
        t, c = t.withColumn("octave", F.explode(F.sequence(low, high))), c.filter("c_parallax > 0").withColumn("octave", F.floor(F.log2("c_parallax")))
        names.append("octave")
    if not keys and not octaves:
        t = t.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
        c = c.withColumn("cell", F.pmod(F.xxhash64("control_id"), F.lit(CELLS)).cast("int"))
        names.append("cell")
    # the sides are small where their pairs are many: partitions of a given number are not coalesced by size
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return t.repartition(parts, *names).join(c.repartition(parts, *names), names).drop(*names)


def _has(n: str) -> Column:
    return F.col(f"t_{n}").isNotNull()


def _delta(n: str) -> Column:
    return F.abs(F.col(f"c_{n}") - F.col(f"t_{n}"))


def _by_mode(classes: DataFrame, c: DataFrame, modes, share: float, parallax: float, within: tuple[str, ...]) -> list[tuple[DataFrame, list]]:
    """Banded pairs of each mode (which classes, which keys), with the keys; those without keys by octaves of parallax where they have one."""
    octaves = ((1 - parallax) * (1 - 1e-9), (1 + parallax) * (1 + 1e-9)) if parallax < 1 else None
    parts = []
    # one count of the modes spares the joins of those that no class has
    used = classes.agg(*(F.max(F.coalesce(which, F.lit(False))) for which, _ in modes)).first()
    for which, keys in [m for m, some in zip(modes, used) if some] or modes[:1]:
        mine = classes.filter(which)
        if keys:
            parts.append((_banded(mine, c, *((n, size * share) for n, size in keys), within=within), keys))
            continue
        if octaves:  # without keys
            parts.append((_banded(mine.filter(_has("parallax")), c, within=within, octaves=octaves), keys))
            mine = mine.filter(~_has("parallax"))
        parts.append((_banded(mine, c, within=within), keys))
    return parts


def _loose(classes: DataFrame, c: DataFrame, tmag: float, color: float, teff: float, parallax: float, strict: bool, within: tuple[str, ...], share: float = 1.0) -> DataFrame:
    """(class, control_id, score) of what passes every criterion and, where share is below 1, scores at most that."""
    modes = []
    for bright, first in ((_has("tmag"), [("tmag", tmag)]), (~_has("tmag"), [])):
        modes += [(bright & _has("bp_rp"), [*first, ("bp_rp", color)]), (bright & ~_has("bp_rp") & _has("teff"), [*first, ("teff", teff)]), (bright & ~_has("bp_rp") & ~_has("teff"), first)]
    pairs = reduce(DataFrame.unionByName, (p for p, _ in _by_mode(classes, c, modes, share, parallax, within)))
    by_color, plx = _has("bp_rp"), F.col("t_parallax")
    rules = [
        _criterion(F.col("t_tmag"), _delta("tmag"), tmag, strict),
        _criterion(F.col("t_bp_rp"), _delta("bp_rp"), color, strict),
        _criterion(F.when(~by_color, F.col("t_teff")), F.when(~by_color, _delta("teff")), teff, strict),
        _criterion(plx, _delta("parallax") / plx, parallax, strict),
    ]
    for ok, _ in rules:
        pairs = pairs.filter(ok)
    out = pairs.select("class", "control_id", sum((s for _, s in rules[1:]), rules[0][1]).alias("score"))
    return out.filter(F.col("score") <= share) if share < 1 else out


def candidates(targets: DataFrame, pool: DataFrame, *, tmag: float = 1.0, color: float = 0.35, teff: float = 400.0, parallax: float = 0.5, strict: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """(target_id, control_id, score) of all pairs that pass every criterion.

    Both sides have id and any of tmag, bp_rp, teff and parallax; a criterion whose column one side lacks is
    skipped. Colour decides where the target has one, else temperature. score sums the differences over their
    tolerances. A target that lacks all of them has every control as a candidate, with score 0. Columns of within must
    be equal, null being a value. Null ids are left out.
    """
    # each target by itself: only the two sides are shuffled, not the pairs. Bands are few, so each is dealt to SPREAD keys
    t, c = _rows(targets, pool, within)
    t = t.withColumnRenamed("id", "class").withColumn("in_spread", F.pmod(F.xxhash64("class"), F.lit(SPREAD)).cast("int"))
    c = c.withColumn("in_spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return _loose(t, c, tmag, color, teff, parallax, strict, (*within, "spread")).withColumnRenamed("class", "target_id")


class _List:
    """A class's controls in its order, of which targets in ascending order take the first free ones."""

    def __init__(self):
        self.fit, self.unfit = [], []
        self.at = self.unfit_at = 0

    def take(self, target, taken: set, most: int) -> list:
        # what is taken or out of bounds for a target is so for all later ones
        while self.at < len(self.fit) and (self.fit[self.at][0] in taken or self.fit[self.at][2] < target):
            self.at += 1
        found, i = [], self.at
        while len(found) < most and i < len(self.fit):
            control, score, bound = self.fit[i]
            if control not in taken and bound >= target:
                found.append((control, score))
            i += 1
        return found

    def only_unfit_left(self, target, taken: set) -> bool:
        while self.unfit_at < len(self.unfit) and (self.unfit[self.unfit_at][0] in taken or self.unfit[self.unfit_at][2] < target):
            self.unfit_at += 1
        return self.unfit_at < len(self.unfit)


def _settle(members: pd.DataFrame, edges: pd.DataFrame, most: int) -> pd.DataFrame:
    """What the targets of one group take, one after the other, as if there were no other group."""
    edges = edges.sort_values(["score", "control_id"], kind="stable")
    lists: dict[tuple, _List] = defaultdict(_List)
    for name, fallback, fits, *edge in zip(*(edges[c].tolist() for c in ("class", "fallback", "fits", "control_id", "score", "bound"))):
        mine = lists[name, fallback]
        (mine.fit if fits else mine.unfit).append(edge)
    taken, out = set(), []
    for target, name in members.sort_values("target_id")[["target_id", "class"]].itertuples(index=False):
        first, second = lists.get((name, False)), lists.get((name, True))
        found = first.take(target, taken, most) if first else []
        if not found and second and not (first and first.only_unfit_left(target, taken)):
            found = second.take(target, taken, most)
        for rank, (control, score) in enumerate(found, 1):
            taken.add(control)
            out.append((target, control, rank, score))
    return pd.DataFrame(out, columns=["target_id", "control_id", "match_rank", "score"])


def _grouped(edges: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """members with group: runs of targets in order of id, with their lists of about size rows together."""
    each = members.groupBy("class").agg(F.count("*").alias("n")).join(edges.groupBy("class").agg(F.count("*").alias("m")), "class", "left")
    rows = members.join(each, "class").select("class", "target_id", (1 + F.ceil(F.coalesce("m", F.lit(0)) / F.col("n"))).alias("rows"))
    return running(rows, [F.col("target_id"), F.col("class")], upto="rows").select("class", "target_id", F.floor((F.col("upto") - F.col("rows")) / size).alias("group"))


def assign(edges: DataFrame, ratio: int = 1, members: DataFrame | None = None, more: list[Callable[[DataFrame], DataFrame]] = (), group_rows: int = GROUP) -> DataFrame:
    """(target_id, control_id, match_rank, score): targets in order of id take their best unused controls, ratio each.

    edges has target_id, control_id and score, and may have fallback and fits: fallback edges count only while
    a target has no other free one, and edges that don't fit are never taken, but are free. Ties go to the smaller
    control id. Ids are whole numbers. With members (class, target_id), edges has class for target_id, and more lists
    functions that give further edges of some classes (a table with class), asked one after the other for
    classes that have run out.

    Targets are dealt in their order to groups of about group_rows edges and targets, and each group settles its own
    one after the other. What a target takes so is gone by its turn in the whole order too, whoever took it, so later
    targets lose that edge; groups settle again until no two take the same control. That is the greedy order's choice. A
    group hangs on earlier ones only, so there are at most as many rounds as groups, and few where little is contested.
    A list that alone outgrows group_rows is still settled by one task.
    """
    if ratio < 1:
        raise ValueError("ratio must be at least 1")
    if members is None:
        edges = edges.withColumnRenamed("target_id", "class")
        members = edges.select("class", F.col("class").alias("target_id")).distinct()
    return _assign(edges, ratio, members, more, group_rows, len(more))[0]


def _assign(edges: DataFrame, ratio: int, members: DataFrame, more, group_rows: int, plain: int) -> tuple[DataFrame, int]:
    """What assign() gives, and how many edges it went by; the first plain levels of more hold no fallback."""

    def full(e: DataFrame) -> DataFrame:
        own = lambda n, other: (F.col(n) if n in e.columns else F.lit(other)).alias(n)
        return e.select("class", "control_id", "score", own("fallback", False), own("fits", True))

    e = cut(full(edges))
    members = cut(_grouped(e, members, group_rows))
    groups = cut(members.groupBy("class", "group").agg(F.min("target_id").alias("first")))
    placed = lambda rows: rows.join(groups, "class").withColumn("bound", F.lit(NO_BOUND))
    state = cut(placed(e))
    seen = state.count()
    at = members.select("class", F.lit(0).alias("level")).distinct()
    asked = 0
    kind = f"target_id {dict(members.dtypes)['target_id']}, control_id {dict(e.dtypes)['control_id']}, match_rank int, score double"
    settle = lambda m, x: _settle(m, x, ratio)
    while True:
        claims = cut(members.groupBy("group").cogroup(state.groupBy("group")).applyInPandas(settle, kind))
        until = claims.groupBy("control_id").agg(F.min("target_id").alias("until"))
        bounded = lambda rows: rows.join(until, "control_id", "left").withColumn("bound", F.least("bound", F.coalesce("until", F.lit(NO_BOUND)))).drop("until").filter(F.col("bound") >= F.col("first"))  # noqa: B023, E731
        lost = claims.join(until, "control_id").filter("target_id > until")
        # a control that does not fit is free until it is gone, which may send its class to the fallback
        gone = state.filter("not fits").join(until, "control_id").filter("until < bound")
        if not lost.isEmpty() or not gone.isEmpty():
            state = cut(bounded(state))
            continue
        asked += 1
        due = _due(members, claims, ratio, at, len(more), plain if asked > len(more) else 0)
        levels = sorted(r["level"] for r in due.select("level").distinct().collect())  # a row a level
        if not levels:
            return claims, seen
        state = cut(bounded(reduce(DataFrame.unionByName, (placed(full(more[n](due.filter(F.col("level") == n).select("class")))) for n in levels), state)))
        seen = max(seen, state.count())
        at = cut(at.join(due.select("class", F.lit(1).alias("up")), "class", "left").select("class", (F.col("level") + F.coalesce("up", F.lit(0))).alias("level")))


def _due(members: DataFrame, claims: DataFrame, ratio: int, at: DataFrame, levels: int, everyone: int) -> DataFrame:
    """(class, level) of the lists to open next, for classes with a target that took less than its due; with them, where controls are scarce, those of all other classes up to level everyone."""
    full = claims.filter(F.col("match_rank") == ratio).select("target_id")
    stuck = cut(members.join(full, "target_id", "left_anti").select("class").distinct().join(at, "class").filter(F.col("level") < levels))
    if not everyone or stuck.isEmpty():
        return stuck
    return cut(stuck.unionByName(at.filter(F.col("level") < everyone)).distinct())


def _regions(t: DataFrame, c: DataFrame, width: float, names: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Targets, and controls for each region that may want them, with region: runs of bands of magnitude with about so many controls.

    Targets of different values of names are in different regions. Those without a magnitude have a region with all controls.
    """
    width *= 1 + 1e-9
    t = t.withColumn("bright", _has("tmag")).withColumn("band", F.floor(F.col("t_tmag") / width))
    here = c.filter("c_tmag is not null").groupBy(*names, F.floor(F.col("c_tmag") / width).alias("band")).agg(F.count("*").alias("n"))
    bands = t.select(*names, "bright", "band").distinct().join(here, [*names, "band"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bands = running(bands, [F.col(x) for x in (*names, "bright", "band")], upto="n")
    # as text, so that no two values are taken for one
    bands = cut(bands.withColumn("part", F.floor((F.col("upto") - F.col("n")) / rows)).select(*names, "bright", "band", F.to_json(F.struct(*names, "bright", "part")).alias("region")))
    t = t.join(bands.filter("bright").select(*names, "band", F.col("region").alias("r")), [*names, "band"], "left")
    t = t.join(bands.filter("not bright").select(*names, F.col("region").alias("whole")), names, "left") if names else t.crossJoin(bands.filter("not bright").agg(F.first("region").alias("whole")))
    t = t.withColumn("region", F.when(F.col("bright"), F.col("r")).otherwise(F.col("whole"))).drop("r", "whole", "bright", "band")
    near = bands.filter("bright").withColumn("band", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1))))).select(*names, "band", "region").distinct()
    some = c.filter("c_tmag is not null").withColumn("band", F.floor(F.col("c_tmag") / width)).join(near, [*names, "band"])
    dark = bands.filter("not bright").select(*names, "region")
    every = c.join(dark, names) if names else c.crossJoin(dark)
    keep = ["control_id", *(f"c_{n}" for n in CRITERIA), "region"]
    return t, some.select(*keep).unionByName(every.select(*keep)).distinct()


class _Free:
    """Free controls of one region, by magnitude, of which targets in ascending order take the best."""

    def __init__(self, controls: pa.Table, bands: tuple[float, float, float, float], strict: bool):
        self.bands, self.strict, self.looked, self.gone = bands, strict, 0, 0
        value = lambda n: controls[n].to_numpy().astype(np.float64)  # noqa: E731  (null is NaN, which passes nothing)
        self.ids, self.until = controls["control_id"].to_numpy(), controls["until"].to_numpy()
        self.values = [value(f"c_{n}") for n in CRITERIA]
        self.free = np.ones(len(self.ids), bool)
        self._keep(np.lexsort((self.ids, self.values[0])))
        self.repeated = len(np.unique(self.ids)) < len(self.ids)

    def _keep(self, which: np.ndarray) -> None:
        self.ids, self.until, self.free = self.ids[which], self.until[which], self.free[which]
        self.values = [v[which] for v in self.values]
        self.gone = 0

    def passing(self, at: slice, seq: int, t: tuple, fallback: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(places, scores) of the free controls of at that pass, and under strict bands the places of those that only parallax rules out."""
        tmag, color, teff, parallax = self.bands
        within = np.less if self.strict else np.less_equal
        mag, col, temp, plx = (v[at] for v in self.values)
        self.looked += len(mag)
        ok = self.free[at] & (self.until[at] >= seq)
        score = 0.0
        if t[0] is not None:
            d = np.abs(mag - t[0])
            ok &= within(d, tmag)
            score = d / tmag
        if t[1] is not None:
            d = np.abs(col - t[1])
            if fallback:
                if t[2] is not None:
                    ok &= np.abs(temp - t[2]) < teff
                d = d / color
                score = score + np.where(np.isnan(d), 1.0, d)
            else:
                ok &= within(d, color)
                score = score + d / color
        elif t[2] is not None:
            d = np.abs(temp - t[2])
            ok &= within(d, teff)
            score = score + d / teff
        unfit = None
        if t[3] is not None:
            away = np.abs(plx - t[3]) / t[3]
            fits = within(away, parallax)
            unfit = np.flatnonzero(ok & ~fits) + at.start if self.strict else None
            ok &= fits
            score = score + away / parallax
        found = np.flatnonzero(ok)
        return found + at.start, score[found] if isinstance(score, np.ndarray) else np.zeros(len(found)), unfit

    def best(self, seq: int, t: tuple, most: int, fallback: bool = False) -> tuple[list[tuple[int, float]], int | None]:
        """The best controls, (place, score), and the place of a free one that only parallax rules out, if all were looked at."""
        n, h = len(self.ids), DENSE
        i = int(np.searchsorted(self.values[0], t[0])) if t[0] is not None else 0
        while True:
            low, high = (max(0, i - h), min(n, i + h)) if t[0] is not None else (0, n)
            at, score, unfit = self.passing(slice(low, high), seq, t, fallback)
            if most == 1 and len(at):
                k = at[score == score.min()]
                k = k[np.argmin(self.ids[k])]
                found = [(int(k), float(score.min()))]
            else:
                found = []
                for k in np.lexsort((self.ids[at], score)).tolist():
                    if not self.repeated or self.ids[at[k]] not in [self.ids[x] for x, _ in found]:
                        found.append((int(at[k]), float(score[k])))
                    if len(found) == most:
                        break
            # what was not looked at differs in magnitude by so much at least
            edge = min(t[0] - self.values[0][low - 1] if low else np.inf, self.values[0][high] - t[0] if high < n else np.inf) if t[0] is not None else np.inf
            if edge > self.bands[0] or len(found) == most and found[-1][1] < edge / self.bands[0]:
                return found, int(unfit[0]) if unfit is not None and len(unfit) else None
            h *= 8

    def take(self, places: list[int], seq: int) -> None:
        for k in places:
            mine = np.flatnonzero(self.ids == self.ids[k]) if self.repeated else k
            self.free[mine] = False
        self.gone += len(places)
        if self.gone > 32 + 2 * len(self.ids) ** 0.5:
            self._keep(np.flatnonzero(self.free & (self.until >= seq)))


def _taken(targets: pa.Table, controls: pa.Table, most: int, bands: tuple[float, float, float, float], strict: bool) -> pa.Table:
    """What the targets of one region take, one after the other, as if there were no other region: match_rank from 1.

    A target that takes nothing only because a control is free that does not fit has a row of match_rank 0 with that control. One
    row of match_rank -1 has as its score how many pairs were looked at.
    """
    targets = targets.sort_by("seq")
    free, out, none = _Free(controls, bands, strict), [], set()
    names = ["seq", "target_id", *(f"t_{n}" for n in CRITERIA)]
    # a few at a time as numbers of Python
    rows = (row for i in range(0, len(targets), CHUNK) for row in zip(*(targets[n].slice(i, CHUNK).to_pylist() for n in names)))
    for seq, target, *t in rows:
        if not free.free.any():
            break
        t = tuple(t)
        # where nothing is free for some values, nothing is for later targets
        if t in none:
            continue
        found, unfit = free.best(seq, t, most)
        if not found and strict and t[1] is not None:
            if unfit is None:
                found, _ = free.best(seq, t, most, fallback=True)
            else:
                out.append((seq, target, int(free.ids[unfit]), 0, 0.0))
                continue
        if not found:
            none.add(t)
            continue
        out += [(seq, target, int(free.ids[k]), rank, score) for rank, (k, score) in enumerate(found, 1)]
        free.take([k for k, _ in found], seq)
    out.append((None, None, None, -1, float(free.looked)))
    region = (targets if len(targets) else controls)["region"][0].as_py()
    kinds = (pa.int64(), targets["target_id"].type, controls["control_id"].type, pa.int32(), pa.float64())
    return pa.table([*(pa.array(x, k) for x, k in zip(zip(*out), kinds)), pa.array([region] * len(out))], ["seq", "target_id", "control_id", "match_rank", "score", "region"])


def _settled(now: DataFrame, free: DataFrame, most: int, bands: tuple[float, float, float, float], strict: bool) -> DataFrame:
    """Rows of _taken() of all regions, once no control is taken twice.

    What a target takes in its region is gone by its turn in the whole order too, whoever has it, so where several regions
    take a control all but the first target lose it, and from the first such target on a region settles again.
    """
    kind = f"seq long, target_id {dict(now.dtypes)['target_id']}, control_id {dict(free.dtypes)['control_id']}, match_rank int, score double, region string"
    settle = lambda x, y: _taken(x, y, most, bands, strict)
    claims = cut(now.groupBy("region").cogroup(free.withColumn("until", F.lit(NO_BOUND)).groupBy("region")).applyInArrow(settle, kind))
    while True:
        until = claims.filter("match_rank > 0").groupBy("control_id").agg(F.min("seq").alias("until"))
        lost = cut(claims.filter("match_rank >= 0").join(until, "control_id").filter("seq > until").groupBy("region").agg(F.min("seq").alias("first")))  # a row a region
        if lost.isEmpty():
            return claims
        lost = F.broadcast(lost)
        again = now.join(lost, "region").filter("seq >= first").drop("first")
        left = free.join(lost.select("region"), "region", "left_semi").join(until, "control_id", "left").withColumn("until", F.coalesce("until", F.lit(NO_BOUND)))
        new = again.groupBy("region").cogroup(left.groupBy("region")).applyInArrow(settle, kind)
        claims = cut(claims.join(lost, "region", "left").filter("match_rank < 0 or first is null or seq < first").drop("first").unionByName(new))


def _in_turn(targets: DataFrame, pool: DataFrame, ratio: int, bands: tuple[float, float, float, float], strict: bool, within: tuple[str, ...], group_rows: int) -> DataFrame:
    """(target_id, control_id, match_rank, score): targets in order of id take their best unused controls, ratio each.

    They are settled in batches, each of which has the controls that those before it left, and within a batch by regions of
    magnitude. Under strict bands temperature stands in for colour where no control of a target's colour is free.
    """
    if ratio < 1:
        raise ValueError("ratio must be at least 1")
    t, c = _rows(targets, pool, within)
    names = [f"in_{w}" for w in within]
    t = running(t, [F.col(x) for x in ("id", *(f"t_{n}" for n in CRITERIA), *names)], seq=F.lit(1)).withColumnRenamed("id", "target_id")
    t, free = _regions(cut(t), c, bands[0], names, group_rows)
    t, free = cut(t), cut(free)
    n, n_free = t.count(), free.select("control_id").distinct().count()
    most, aim = (max(least, each * (n + n_free)) for least, each in ((PAIRS, PAIRS_A_ROW), (EDGES, EDGES_A_ROW)))
    size, start, found = min(group_rows, max(1, most // max(1, n_free))), 0, []
    while True:
        claims = _settled(t.filter((F.col("seq") > start) & (F.col("seq") <= start + size)), free, ratio, bands, strict)
        taken = claims.filter("match_rank > 0")
        found.append(taken.select("target_id", "control_id", "match_rank", "score"))
        start += size
        if start >= n:
            return reduce(DataFrame.unionByName, found)
        free = cut(free.join(taken.select("control_id"), "control_id", "left_anti"))
        if free.isEmpty():
            return reduce(DataFrame.unionByName, found)
        looked = claims.filter("match_rank < 0").agg(F.sum("score")).first()[0] or 0
        size = min(group_rows, max(1, int(size * min(4.0, max(0.25, aim / max(1.0, looked))))))


def matched(targets: DataFrame, pool: DataFrame, ratio: int = 1, *, tmag: float = 1.0, color: float = 0.35, teff: float = 400.0, parallax: float = 0.5, within: tuple[str, ...] = (), group_rows: int = REGION) -> DataFrame:
    """assign(candidates(...), ratio), without ever spelling out the candidates."""
    return _in_turn(targets, pool, ratio, (tmag, color, teff, parallax), False, within, group_rows)


def eligible(targets: DataFrame) -> DataFrame:
    """Targets with data, where they say so."""
    return targets.filter(truthy(F.col("has_tess_lightcurve"))) if "has_tess_lightcurve" in targets.columns else targets


def matched_pairs(targets: DataFrame, pool: DataFrame, *, tmag: float = 0.5, color: float = 0.15, teff: float = 300.0, parallax: float = 0.5, group_rows: int = REGION) -> DataFrame:
    """(target_id, control_id, match_rank, match_quality_score): pairs one to one under strict bands, in order of the targets' ids.

    Colour, or temperature where a target has no colour or its free controls of that colour are used up. A
    criterion whose column one side lacks is skipped.
    """
    return _in_turn(eligible(targets), usable(pool), 1, (tmag, color, teff, parallax), True, (), group_rows).withColumnRenamed("score", "match_quality_score")


def unmatched(targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: how many targets with data there are, and how many have no control."""
    found = eligible(targets).select("id").join(pairs.select(F.col("target_id").alias("id"), F.lit(1).alias("one")).distinct(), "id", "left")
    return found.agg(F.count("*").alias("n_targets"), F.count_if(F.col("one").isNull()).alias("n_unmatched"))


def pair_balance(pairs: DataFrame, names: tuple[str, ...] = ("tmag", "bp_rp", "parallax")) -> DataFrame:
    """(metric, mean_abs_diff, std_abs_diff, n): population deviation of the absolute differences."""
    diff = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.abs(F.col(f"{n}_target") - F.col(f"{n}_control")).alias("d")) for n in names))).alias("x")
    return pairs.select(diff).groupBy("x.metric").agg(F.avg("x.d").alias("mean_abs_diff"), F.stddev_pop("x.d").alias("std_abs_diff"), F.count("x.d").alias("n"))
