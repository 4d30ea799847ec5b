"""Star catalogs: normalising names, coordinates and identifiers, and reports on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import first_of, meaningful, number, pick, truthy
from ..functions.coords import clean_id, from_parts, sexagesimal

# Names that catalogs give the same things.
ALIASES = {
    "name": ["target_name", "name", "star", "main_id", "designation"],
    "ra": ["ra_deg", "ra", "raj2000", "_ra", "ra_icrs"],
    "dec": ["dec_deg", "dec", "de", "dej2000", "_de", "de_icrs"],
    "id": ["tic_id", "tic", "ticid", "id"],
    "tmag": ["tmag", "tessmag"],
    "bp_rp": ["bp_rp", "bp-rp"],
    "teff": ["teff", "teff_catalog"],
    "parallax": ["parallax", "plx"],
}
POOL_ALIASES = {
    "n_tess_products": ["n_tess_products", "n_tess", "tess_products"],
    "has_tess_lightcurve": ["has_tess_lightcurve", "has_tess", "tess_available"],
    "ir_excess_flag": ["ir_excess_flag", "has_ir_excess", "disk_flag"],
}
# Fields of the research table, and the columns that they may come from.
RESEARCH_TEXT = {
    "target_name": ["target_name", "Name", "Star"],
    "source_catalog": ["source_catalog"],
    "sp_type": ["sp_type", "SpT", "SpType"],
    "reference": ["reference", "Ref", "BibCode"],
    "sample_role": ["sample_role"],
    "has_tess_lightcurve": ["has_tess_lightcurve"],
    "first_author": ["first_author"],
    "first_mission": ["first_mission"],
}
RESEARCH_NUMBERS = {
    "ra_deg": ["ra_deg"],
    "dec_deg": ["dec_deg"],
    "teff_catalog": ["teff_catalog", "T*", "Teff"],
    "distance_pc": ["distance_pc", "Dist", "D"],
    "disk_temperature": ["disk_temperature", "Td1", "Tdt2", "Tgr", "Tgr1", "Tgr2"],
    "disk_radius": ["disk_radius", "Rd1", "Rd2", "D1", "D2"],
    "n_tess_products": ["n_tess_products"],
    "first_year": ["first_year"],
    "first_sector": ["first_sector"],
}
RESEARCH_MATCHED = {"tic_query_status": ["tic_id", "tmag"], "gaia_query_status": ["gaia_dr3_source_id", "bp_rp", "parallax"]}
RA_PARTS, DEC_PARTS, DEC_SIGN = ("rah", "ram", "ras"), ("ded", "dem", "des"), "de-"
PRIORITIES = {"cotten_song_2016": 1, "chen_2014": 2, "mcdonald_2017": 3}


def coordinate(df: DataFrame, kind: str) -> Column:
    """Degrees from a decimal column, else a sexagesimal one, else parts; null where none can be read."""
    ra = kind == "ra"
    tried = []
    if name := pick(df, ALIASES[kind]):
        tried += [number(F.col(f"`{name}`")), sexagesimal(F.col(f"`{name}`").cast("string"), ra)]
    parts = [pick(df, [p]) for p in (RA_PARTS if ra else DEC_PARTS)]
    if all(parts):
        sign = pick(df, [DEC_SIGN])
        tried.append(from_parts(*(F.col(f"`{p}`") for p in parts), ra, F.col(f"`{sign}`") if sign and not ra else None))
    return F.coalesce(*tried) if tried else F.lit(None).cast("double")


def normalize(df: DataFrame, source: str) -> DataFrame:
    """Common columns first, then the source's own: name, coordinates, id, photometry, source, priority, statuses."""
    own = {
        "target_name": first_of(df, ALIASES["name"]).cast("string"), "ra_deg": coordinate(df, "ra"), "dec_deg": coordinate(df, "dec"),
        "tic_id": clean_id(first_of(df, ALIASES["id"]).cast("string")), "tmag": number(first_of(df, ALIASES["tmag"])), "bp_rp": number(first_of(df, ALIASES["bp_rp"])),
        "teff": number(first_of(df, ALIASES["teff"])), "parallax": number(first_of(df, ALIASES["parallax"])), "source_catalog": F.lit(source),
        "catalog_priority": F.lit(PRIORITIES.get(source, 9)), "is_secondary": F.lit(PRIORITIES.get(source, 9) > 1), "tic_query_status": F.lit("not_attempted"), "gaia_query_status": F.lit("not_attempted"),
    }
    rest = [c for c in df.columns if c.lower() not in own]
    return df.select(*(c.alias(n) for n, c in own.items()), *(F.col(f"`{c}`") for c in rest))


def query_rows(df: DataFrame) -> DataFrame:
    """Stars of a remote catalog's answer: id, photometry, coordinates; those without an id or place go, an id stays once.

    A colour column without any value gives way to the difference of the two magnitudes, row by row where it is there.
    """
    from pyspark.sql import Window as W

    blue, red = (pick(df, names) for names in (["gaiabp", "phot_bp_mean_mag"], ["gaiarp", "phot_rp_mean_mag"]))
    color = number(first_of(df, ALIASES["bp_rp"] + ["bp_rp"]))
    out = df.select(
        clean_id(first_of(df, ALIASES["id"]).cast("string")).alias("tic_id"), *(number(first_of(df, ALIASES[n])).alias(n) for n in ("tmag", "teff", "parallax")), color.alias("bp_rp"),
        number(first_of(df, ALIASES["ra"])).alias("ra_deg"), number(first_of(df, ALIASES["dec"])).alias("dec_deg"), first_of(df, ["gaia"]).cast("string").alias("gaia_dr3_source_id"),
        (number(F.col(f"`{blue}`")) - number(F.col(f"`{red}`")) if blue and red else F.lit(None).cast("double")).alias("difference"),
    )
    known = out.agg(F.count("bp_rp").alias("n"))
    out = out.withColumn("bp_rp", F.when(known.select("n").scalar() == 0, F.col("difference")).otherwise(F.col("bp_rp"))).drop("difference")
    first = W.partitionBy("tic_id").orderBy(*(F.col(c).asc_nulls_last() for c in out.columns[1:]))
    return out.dropna(subset=["tic_id", "ra_deg", "dec_deg"]).withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")


def union(catalogs: list[DataFrame]) -> DataFrame:
    """All rows of all catalogs by column name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), catalogs)


def clean_targets(df: DataFrame) -> DataFrame:
    """The research table: measured values only where the look-up matched, placeholders null, one status vocabulary."""
    status = lambda n: F.when(F.lower(F.col(n)).isin("matched", "not_found", "failed"), F.lower(F.col(n))).otherwise("not_attempted")
    tic = status("tic_query_status")
    if_matched = lambda n: F.when(tic == "matched", number(F.col(n)))
    return df.select(
        meaningful(F.col("target_name")).alias("target_name"), "source_catalog", number(F.col("ra_deg")).alias("ra_deg"), number(F.col("dec_deg")).alias("dec_deg"),
        F.when(tic == "matched", F.col("tic_id")).alias("tic_id"), *(if_matched(n).alias(n) for n in ("tmag", "bp_rp", "teff", "parallax")), tic.alias("tic_query_status"), status("gaia_query_status").alias("gaia_query_status"),
    )


def research_table(df: DataFrame) -> DataFrame:
    """The compact table for research, with no value made up: one row for each of df's, absent columns null.

    Text fields come from the first of their columns that exists, numbers from the first in which any row has a number.
    What a look-up gave counts only where its status is matched, placeholders count as nothing, and an empty status is
    not_attempted.
    """
    number_of = {(f, real): number(F.col(f"`{real}`")) for f, names in RESEARCH_NUMBERS.items() for n in names if (real := pick(df, [n]))}
    several = [k for k in number_of if sum(f == k[0] for f, _ in number_of) > 1]
    known = df.agg(*(F.count(number_of[k]).alias(str(i)) for i, k in enumerate(several))) if several else None

    def numeric(field: str) -> Column:
        mine = [k for k in number_of if k[0] == field]
        if len(mine) < 2:
            return number_of[mine[0]] if mine else F.lit(None).cast("double")
        some = [(known.select(str(several.index(k))).scalar() > 0, number_of[k]) for k in mine]
        return reduce(lambda c, x: c.when(*x), some[1:], F.when(*some[0]))

    def status(name: str) -> Column:
        text = F.trim(first_of(df, [name]).cast("string"))
        return F.when(text.isNull() | F.lower(text).isin("", "nan", "none", "<na>", "not_attempted_placeholder"), "not_attempted").otherwise(text)

    own = {f: first_of(df, names).cast("string") for f, names in RESEARCH_TEXT.items()} | {f: numeric(f) for f in RESEARCH_NUMBERS}
    own["tess_query_status"] = status("tess_query_status")
    for by, fields in RESEARCH_MATCHED.items():
        own[by] = status(by)
        for f in fields:
            value = meaningful(first_of(df, [f]).cast("string"))
            own[f] = F.when(own[by] == "matched", value if f.endswith("id") else number(value))
    return df.select(*(c.alias(n) for n, c in own.items()))


def normalize_pool(df: DataFrame) -> DataFrame:
    """A control pool: ids, names, photometry, coordinates, and whether there is data; null ids go, the first of each id stays."""
    out = df.select(
        clean_id(first_of(df, ALIASES["id"]).cast("string")).alias("tic_id"), first_of(df, ALIASES["name"] + ["tic_id", "tic"]).cast("string").alias("target_name"), *(number(first_of(df, ALIASES[n])).alias(n) for n in ("tmag", "teff", "bp_rp", "parallax")),
        number(first_of(df, ALIASES["ra"])).alias("ra_deg"), number(first_of(df, ALIASES["dec"])).alias("dec_deg"), number(first_of(df, POOL_ALIASES["n_tess_products"])).alias("n_tess_products"),
        truthy(first_of(df, POOL_ALIASES["has_tess_lightcurve"] + ["has_data"])).alias("has_tess_lightcurve"), truthy(first_of(df, POOL_ALIASES["ir_excess_flag"] + ["excess"])).alias("ir_excess_flag"),
    )
    rest = [c for c in out.columns if c != "tic_id"]
    first = out.filter("tic_id is not null").groupBy("tic_id").agg(F.min(F.struct(*rest)).alias("x"))
    return first.select("tic_id", "x.*")


def availability(df: DataFrame, products: DataFrame) -> DataFrame:
    """df (tic_id, ...) with n_tess_products, first_sector and has_tess_lightcurve from products (tic_id, sector)."""
    g = products.groupBy("tic_id").agg(F.count("*").alias("n_tess_products"), F.min("sector").alias("first_sector"))
    out = df.drop("n_tess_products", "first_sector", "has_tess_lightcurve").join(g, "tic_id", "left")
    return out.withColumn("n_tess_products", F.coalesce("n_tess_products", F.lit(0))).withColumn("has_tess_lightcurve", F.col("n_tess_products") > 0)


def preferred_products(products: DataFrame, authors: list[str], most: int = 1) -> DataFrame:
    """The first products of each star by its best available author; authors not named come last."""
    from pyspark.sql import Window as W

    rank = reduce(lambda c, x: c.when(F.col("author") == x[1], x[0]), enumerate(authors[1:], 1), F.when(F.col("author") == authors[0], 0)).otherwise(len(authors))
    p = products.withColumn("__rank", rank)
    p = p.withColumn("__best", F.min("__rank").over(W.partitionBy("tic_id"))).filter("__rank = __best")
    return p.withColumn("__k", F.row_number().over(W.partitionBy("tic_id").orderBy("product"))).filter(F.col("__k") <= most).drop("__rank", "__best", "__k")


def verification_report(df: DataFrame, fields: tuple[str, ...] = ("tic_id", "tmag", "bp_rp", "parallax")) -> DataFrame:
    """(metric, label, value): totals, rows with coordinates, matches, rows of each source, missing values of fields."""
    c = F.col
    row = df.agg(F.count("*").alias("n_targets"), F.count_if(c("ra_deg").isNotNull() & c("dec_deg").isNotNull()).alias("n_with_coordinates"), F.count_if(c("tic_query_status") == "matched").alias("n_tic_matched"),
                 F.count_if(c("gaia_query_status") == "matched").alias("n_gaia_matched"), F.count_if(c("tic_id").isNotNull()).alias("n_with_tic"), F.count_distinct("tic_id").alias("n_distinct_tic"), *(F.count_if(c(f).isNull()).alias(f"missing_{f}") for f in fields))
    names = ["n_targets", "n_with_coordinates", "n_tic_matched", "n_gaia_matched", "n_with_tic", "n_distinct_tic"]
    cells = [F.struct(F.lit(n).alias("metric"), F.lit("").alias("label"), c(n).alias("value")) for n in names] + [F.struct(F.lit("missing").alias("metric"), F.lit(f).alias("label"), c(f"missing_{f}").alias("value")) for f in fields]
    by_source = df.groupBy(F.coalesce("source_catalog", F.lit("")).alias("label")).agg(F.count("*").alias("value")).select(F.lit("source").alias("metric"), "label", "value")
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*").unionByName(by_source)
