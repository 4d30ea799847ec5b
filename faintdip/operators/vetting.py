"""Vetting flags and checks against external catalogs, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import finite

FLAGS = ("flag_low_snr", "flag_edge_event", "flag_single_point_like", "flag_likely_flare_shape", "flag_low_delta_chi2", "flag_poor_asymmetry_fit")
NO_MATCH, POSSIBLE_EB, KNOWN_VARIABLE, PROBLEMATIC, CHECK_FAILED = (
    "no_external_match", "possible_eclipsing_binary_match", "known_variable_match", "simbad_nonstellar_or_problematic_type", "external_check_failed",
)
CONCERNS = (POSSIBLE_EB, KNOWN_VARIABLE, PROBLEMATIC)

# Prefixes of variable types that suggest a binary or the like, and object types of concern.
BINARY_PREFIXES = ("CEP", "CV", "DCEP", "DSCT", "E", "EA", "EB", "EC", "EW", "GDOR", "HADS", "NL", "RR", "RRAB", "RRC", "SU", "UG")
CONCERN_TYPES = {
    "Algol": "Algol-type EB",
    "BYDra": "BY Dra type variable",
    "CV*": "cataclysmic variable",
    "Cepheid": "Cepheid variable",
    "EB": "eclipsing binary",
    "EB*": "eclipsing binary",
    "EclBin": "eclipsing binary",
    "LPV*": "long-period variable",
    "Mira": "Mira variable",
    "Nova": "nova",
    "RRLyr": "RR Lyrae variable",
    "RRLyr*": "RR Lyrae variable",
    "RS*": "RS CVn variable",
    "V*": "variable star (generic)",
    "WD*": "white dwarf",
    "YSO": "young stellar object",
    "bCep": "beta Cep variable",
    "pulsV*": "pulsating variable",
}


def _value(df: DataFrame, name: str) -> Column:
    return finite(F.col(name).cast("double")) if name in df.columns else F.lit(None).cast("double")


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def vetting_flags(events: DataFrame, snr_from: float = 5.0, delta_chi2_from: float = 5.0) -> DataFrame:
    """events with the six flags, needs_manual_review and automated_vetting_status.

    A null S/N or chi-squared difference is not low; without an S/N column all are. A null edge or
    single-point value counts as set, an absent column as not.
    """
    snr, ratio, skew, dchi2 = (_value(events, n) for n in ("local_snr", "egress_ingress_ratio", "skewness", "delta_chi2"))
    boolean = lambda n: F.coalesce(F.col(n).cast("boolean"), F.lit(True)) if n in events.columns else F.lit(False)
    flags = dict(zip(FLAGS, (
        _holds(snr < snr_from) if "local_snr" in events.columns else F.lit(True),
        boolean("edge_event"),
        boolean("single_point_like"),
        _holds((skew > 0) & (ratio < 1)),
        _holds(dchi2 < delta_chi2_from),
        ratio.isNull() | _holds(ratio.between(0.9, 1.1)),
    )))
    out = events.withColumns(flags).withColumn("needs_manual_review", reduce(or_, map(F.col, FLAGS)))
    return out.withColumn("automated_vetting_status", F.when(F.col("needs_manual_review"), "flagged").otherwise("pass"))


def vetting_summary(vetted: DataFrame) -> DataFrame:
    """(metric, value): totals, each flag's count, passes and their fraction (null without events)."""
    names = ["n_total", *FLAGS, "n_pass", "n_flagged"]
    passes = F.col("automated_vetting_status") == "pass"
    row = vetted.agg(F.count("*").alias("n_total"), *(F.count_if(F.col(f)).alias(f) for f in FLAGS), F.count_if(passes).alias("n_pass"), F.count_if(~passes).alias("n_flagged"))
    row = row.withColumn("fraction_pass", F.try_divide(F.col("n_pass"), F.col("n_total")))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in [*names, "fraction_pass"]))).alias("x")).select("x.*")


def classify_external(df: DataFrame) -> DataFrame:
    """df with external_false_positive_flag and external_vetting_notes.

    Reads {eb,vsx,simbad}_status, eb_match_id, vsx_match_name, vsx_type, simbad_main_id, simbad_otype
    and {..}_sep_arcsec. A binary catalog's match comes first, then a variable's type, then an
    object type of concern; if nothing matched but a look-up failed, no match is not reliable.
    """
    c = F.col
    got = lambda n: _holds(c(f"{n}_status") == "matched")
    failed = reduce(or_, (_holds(c(f"{n}_status") == "failed") for n in ("eb", "vsx", "simbad")))
    kind = F.upper(F.trim(F.split_part(F.split_part(F.coalesce(c("vsx_type"), F.lit("")), F.lit(":"), F.lit(1)), F.lit("/"), F.lit(1))))
    binary = reduce(or_, (kind.startswith(p) for p in BINARY_PREFIXES))
    problem = got("simbad") & c("simbad_otype").isin(*CONCERN_TYPES)
    flag = F.when(got("eb") | (got("vsx") & binary), POSSIBLE_EB).when(got("vsx"), KNOWN_VARIABLE).when(problem, PROBLEMATIC).when(failed, CHECK_FAILED).otherwise(NO_MATCH)
    sep = lambda n: F.when(c(f"{n}_sep_arcsec").isNotNull(), F.format_string('%.1f"', c(f"{n}_sep_arcsec"))).otherwise("?")
    human = F.create_map(*(F.lit(x) for kv in CONCERN_TYPES.items() for x in kv))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    notes = F.concat_ws(
        "; ",
        F.when(got("eb"), F.concat(F.lit("TESS-EB catalog: TIC "), text(c("eb_match_id")), F.lit(" ("), sep("eb"), F.lit(")"))),
        F.when(got("vsx"), F.concat(F.lit("VSX: "), text(c("vsx_match_name")), F.lit(" type="), text(c("vsx_type")), F.lit(" ("), sep("vsx"), F.lit(")"))),
        F.when(got("simbad"), F.concat(F.lit("SIMBAD: "), text(c("simbad_main_id")), F.lit(" otype="), text(c("simbad_otype")), F.when(problem, F.concat(F.lit(" ("), human[c("simbad_otype")], F.lit(")"))).otherwise(""), F.lit(" ("), sep("simbad"), F.lit(")"))),
        F.when(flag == CHECK_FAILED, F.lit("WARNING: one or more catalog queries failed, so no match is unreliable")),
    )
    return df.withColumns({"external_false_positive_flag": flag, "external_vetting_notes": notes})


def demote(df: DataFrame) -> DataFrame:
    """External concerns turn a pass into flagged; nothing is promoted."""
    concern = _holds(F.col("external_false_positive_flag").isin(*CONCERNS))
    status = F.when(concern & (F.col("automated_vetting_status") == "pass"), "flagged").otherwise(F.col("automated_vetting_status"))
    return df.withColumns({"flag_external_catalog_match": concern, "automated_vetting_status": status, "needs_manual_review": F.col("needs_manual_review") | concern})


def external_summary(df: DataFrame) -> DataFrame:
    """(catalog, label, n): each catalog's statuses, and the flags under catalog "flag"."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("catalog"), F.coalesce(F.col(f"{n}_status"), F.lit("not_attempted")).alias("label")) for n in ("eb", "vsx", "simbad")), F.struct(F.lit("flag").alias("catalog"), F.col("external_false_positive_flag").alias("label")))).alias("x")
    return df.select(rows).groupBy("x.catalog", "x.label").agg(F.count("*").alias("n"))


def check_external(events: DataFrame, positions: DataFrame, eb: DataFrame, vsx: DataFrame, simbad: DataFrame, radius_arcsec: float = 10.0) -> DataFrame:
    """events with the nearest entry of three catalog snapshots, looked up once for each star.

    positions has star, ra, dec; the snapshots have id, ra, dec and their names and types. The
    binary catalog is searched within three times the radius.
    """
    from .sky import crossmatch

    stars = positions.select(F.col("star").alias("id"), "ra", "dec").join(events.select(F.col("star").alias("id")).distinct(), "id", "left_semi")
    out = crossmatch(stars, eb, 3 * radius_arcsec, "eb")
    out = crossmatch(out, vsx, radius_arcsec, "vsx").join(vsx.select(F.col("id").alias("vsx_match_id"), F.col("name").alias("vsx_match_name"), F.col("type").alias("vsx_type")), "vsx_match_id", "left")
    out = crossmatch(out, simbad, radius_arcsec, "simbad").join(simbad.select(F.col("id").alias("simbad_match_id"), F.col("name").alias("simbad_main_id"), F.col("type").alias("simbad_otype")), "simbad_match_id", "left")
    checked = classify_external(events.join(out.withColumnRenamed("id", "star"), "star", "left"))
    return demote(checked) if "automated_vetting_status" in events.columns else checked
