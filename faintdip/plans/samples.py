"""Choosing stars: target samples, control pools, and small runs for development."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..columns import truthy
from ..lineage import cut, running
from ..operators import catalogs, sky


def limited(tables: dict[str, DataFrame], wanted: int | None, order: str) -> dict[str, DataFrame]:
    """Each table's first rows by order: five times the wanted stars, 50 at least; all without a limit."""
    return tables if wanted is None else {n: t.orderBy(order).limit(max(50, 5 * wanted)) for n, t in tables.items()}


def target_sample(tables: dict[str, DataFrame], wanted: int | None = None, radius_arcsec: float = 5.0) -> DataFrame:
    """Targets of all catalogs: the first by catalog priority and name at each place on the sky."""
    rows = catalogs.union([catalogs.normalize(t, n) for n, t in limited(tables, wanted, tables[next(iter(tables))].columns[0]).items()])
    rows = rows.select("target_name", "ra_deg", "dec_deg", "tic_id", "tmag", "bp_rp", "teff", "parallax", "source_catalog", "catalog_priority", "is_secondary")
    # numbers that follow the order, by ranges, without one task that sees all rows
    order = ["catalog_priority", "source_catalog", "target_name", "ra_deg", "dec_deg", "tic_id"]
    rows = running(rows, [F.asc_nulls_last(c) for c in order], id=F.lit(1))
    kept = sky.deduplicate(rows.withColumnsRenamed({"ra_deg": "ra", "dec_deg": "dec"}), radius_arcsec).withColumnsRenamed({"ra": "ra_deg", "dec": "dec_deg"})
    kept = kept.withColumn("sample_role", F.lit("target"))
    return kept if wanted is None else kept.orderBy("catalog_priority", "target_name").limit(wanted)


def range_scan(targets: DataFrame, stars: DataFrame, *, tmag: float = 0.5, teff: float = 300.0, floor: float = 2500.0, each: int = 50, total: int | None = None) -> DataFrame:
    """For each target the stars of like magnitude and temperature, at most `each` of them, the closest first; a star once.

    Both sides have id, tmag and teff; the temperature band ends at floor. With total only the first so many stars
    by target and id stay.
    """
    if tmag <= 0 or teff <= 0 or each < 1 or (total is not None and total < 1):
        raise ValueError("tmag, teff, each and total must be positive")
    t = targets.select(F.col("id").alias("target_id"), F.col("tmag").alias("t"), F.col("teff").alias("e"))
    low = F.greatest(F.col("e") - teff, F.lit(floor))
    apart = F.abs(F.col("tmag") - F.col("t"))

    def closest(some: DataFrame, reach: float) -> DataFrame:
        size = reach * (1 + 1e-9)
        some = some.withColumn("band", F.explode(F.array(*(F.floor(F.col("t") / size) + i for i in (-1, 0, 1)))))
        pairs = stars.withColumn("band", F.floor(F.col("tmag") / size)).join(some, "band").filter((apart <= reach) & (F.col("e").isNull() | F.col("teff").between(low, F.col("e") + teff)))
        best = W.partitionBy("target_id").orderBy(apart, "id")
        return pairs.withColumn("__k", F.row_number().over(best)).filter(F.col("__k") <= each).select("target_id", "id", "tmag", "teff", "__k")

    # dense fields are searched near first, and again only for targets that have too few there
    shares, n = [1.0], stars.count()
    while n > 32 * each:
        shares.insert(0, shares[0] / 4)
        n /= 4
    parts = []
    for share in shares[:-1]:
        got = cut(closest(t, share * tmag))
        done = got.filter(F.col("__k") == each).select("target_id")
        parts.append(got.join(done, "target_id", "left_semi"))
        t = cut(t.join(done, "target_id", "left_anti"))
    pairs = reduce(DataFrame.unionByName, parts, closest(t, tmag))
    found = pairs.groupBy("id").agg(F.min("target_id").alias("target_id"), F.first("tmag").alias("tmag"), F.first("teff").alias("teff"))
    return found if total is None else found.orderBy("target_id", "id").limit(total)


def control_pool(stars: DataFrame, targets: DataFrame, bad_ids: DataFrame, bad_points: DataFrame, products: DataFrame, checks: int | None = None) -> DataFrame:
    """Candidates near the targets in magnitude and temperature with data and without infrared excess.

    stars has id, ra, dec, tmag and teff; products has tic_id and sector. With checks only the first so
    many by id are looked up.
    """
    found = range_scan(targets, stars).select("id")
    pool = sky.excluded(stars.join(found, "id", "left_semi"), bad_ids, bad_points).filter("excluded_reason = ''")
    if checks is not None:
        pool = pool.orderBy("id").limit(checks)
    return catalogs.availability(pool.withColumnRenamed("id", "tic_id"), products).filter("has_tess_lightcurve")


def ready_to_scan(targets: DataFrame) -> DataFrame:
    """Targets with coordinates and data."""
    have = sky.with_coordinates(targets)
    return have.filter(F.col("has_skycoord") & truthy(F.col("has_tess_lightcurve")))


def some_stars(stars: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n stars (star, ...) at random, the same ones however the rows are dealt out: those with the least MD5 of "star:seed"."""
    return stars.orderBy(F.md5(F.concat_ws(":", F.col("star").cast("string"), F.lit(str(seed)))), "star").limit(n)


def search_products(products: DataFrame, star: int | None = None, author: str | None = None, cadence: float | None = None) -> DataFrame:
    """Rows of a product table that fit all given criteria."""
    for name, value in (("tic_id", star), ("author", author), ("cadence", cadence)):
        if value is not None:
            products = products.filter(F.col(name) == value)
    return products


def product_number(products: DataFrame, index: int) -> DataFrame:
    """Product number index, from 0, of each star; an error if some star has fewer."""
    if index < 0:
        raise ValueError("the index must not be negative")
    k = F.row_number().over(W.partitionBy("tic_id").orderBy("product"))
    n = F.count("*").over(W.partitionBy("tic_id"))
    checked = F.when(n <= index, F.raise_error(F.concat(F.lit("too few products of star "), F.col("tic_id").cast("string")))).otherwise(k)
    return products.withColumn("__k", checked).filter(F.col("__k") == index + 1).drop("__k")
