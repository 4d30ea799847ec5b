"""Brightness series as long tables (star, t, flux): cleaning, noise, minima and event windows.

Everything here is column expressions over one partitioning by star. Window features join
samples to events on star and a time bucket, so a dense series spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..columns import finite

MAD_TO_SIGMA = 1.4826
EDGE_DAYS = 0.5


def finite_samples(lc: DataFrame) -> DataFrame:
    """Samples whose time and flux are both finite."""
    return lc.withColumns({"t": finite(F.col("t").cast("double")), "flux": finite(F.col("flux").cast("double"))}).filter("t is not null and flux is not null")


def clean_normalize(lc: DataFrame, sigma: float = 10.0) -> DataFrame:
    """Finite samples within sigma standard deviations of their star's median, divided by the median of what is left."""
    star = W.partitionBy("star")
    lc = finite_samples(lc).withColumns({"med": F.median("flux").over(star), "sd": F.stddev_pop("flux").over(star)})
    lc = lc.filter(F.abs(F.col("flux") - F.col("med")) <= sigma * F.col("sd"))
    return lc.withColumn("flux", F.try_divide(F.col("flux"), F.median("flux").over(star))).drop("med", "sd")


def stitch(products: DataFrame) -> DataFrame:
    """One series of each star from its products (star, product, t, flux): each product divided by its own median; samples without a number go."""
    lc = finite_samples(products)
    return lc.withColumn("flux", F.try_divide("flux", F.median("flux").over(W.partitionBy("star", "product")))).filter("flux is not null")


def _robust(n, mad, sd):
    """The scaled median deviation, or the population deviation where that is not positive."""
    return F.when((mad > 0) | (n <= 1), MAD_TO_SIGMA * mad).otherwise(sd)


def noise(lc: DataFrame) -> DataFrame:
    """(star, n, baseline, noise, first, last): robust noise and the ends of each series."""
    lc = finite_samples(lc).withColumn("med", F.median("flux").over(W.partitionBy("star")))
    g = lc.groupBy("star").agg(
        F.count("*").alias("n"), F.first("med").alias("baseline"), F.median(F.abs(F.col("flux") - F.col("med"))).alias("mad"), F.stddev_pop("flux").alias("sd"), F.min("t").alias("first"), F.max("t").alias("last")
    )
    return g.select("star", "n", "baseline", _robust(F.col("n"), F.col("mad"), F.col("sd")).alias("noise"), "first", "last")


def cadence(lc: DataFrame) -> DataFrame:
    """(star, n, cadence): median difference of consecutive times."""
    step = F.col("t") - F.lag("t").over(W.partitionBy("star").orderBy("t"))
    return finite_samples(lc).withColumn("step", step).groupBy("star").agg(F.count("*").alias("n"), F.median("step").alias("cadence"))


def local_minima(lc: DataFrame, sigma: float = 4.0) -> DataFrame:
    """(star, t, flux, baseline, noise): strict local minima at least sigma noises below the star's median.

    A run of equal values counts as one sample at its middle; ends of a series are none.
    """
    # windows over the star and over parts of it share one shuffle
    star, order = W.partitionBy("star"), W.partitionBy("star").orderBy("t")
    run = W.partitionBy("star", "run")
    before, after = F.lag("flux").over(order), F.lead("flux").over(order)
    lc = finite_samples(lc).select("star", "t", "flux")
    lc = lc.withColumns({"i": F.row_number().over(order), "before": before, "after": after, "n": F.count("*").over(star), "baseline": F.median("flux").over(star), "sd": F.stddev_pop("flux").over(star)})
    lc = lc.withColumn("run", F.sum(F.coalesce(F.col("before") != F.col("flux"), F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    lc = lc.withColumn("noise", _robust(F.col("n"), F.median(F.abs(F.col("flux") - F.col("baseline"))).over(star), F.col("sd")))
    lc = lc.withColumns({"a": F.min("i").over(run), "b": F.max("i").over(run), "before": F.min_by("before", "i").over(run), "after": F.max_by("after", "i").over(run)})
    low = (F.col("before") > F.col("flux")) & (F.col("after") > F.col("flux")) & (F.col("i") == F.floor((F.col("a") + F.col("b")) / 2))
    return lc.filter(low & (F.col("noise") > 0) & (F.col("baseline") - F.col("flux") >= sigma * F.col("noise"))).select("star", "t", "flux", "baseline", "noise")


def window_samples(lc: DataFrame, events: DataFrame, window: float) -> DataFrame:
    """(star, event, t, flux) of the samples within half a window of each event, both ends included.

    events has star and event (its time). Either side is keyed by star and time bucket.
    """
    half = window / 2
    lc = finite_samples(lc).select("star", "t", "flux", F.floor(F.col("t") / window).alias("bucket"))
    near = F.explode(F.sequence(F.floor((F.col("event") - half) / window), F.floor((F.col("event") + half) / window))).alias("bucket")
    keyed = events.select("star", "event").distinct().select("star", "event", near)
    return lc.join(keyed, ["star", "bucket"]).filter((F.col("t") >= F.col("event") - half) & (F.col("t") <= F.col("event") + half)).select("star", "event", "t", "flux")


def window_features(lc: DataFrame, events: DataFrame, window: float = 1.0) -> DataFrame:
    """Depth, noise, S/N, single-point and edge flags and biased moments of each event's window.

    Windows of fewer than three samples have null features and count as single points.
    """
    each = W.partitionBy("star", "event")
    w = window_samples(lc, events, window)
    w = w.withColumns({"base": F.median("flux").over(each), "least": F.min("flux").over(each), "mean": F.avg("flux").over(each)})
    d = F.col("flux") - F.col("mean")
    g = w.groupBy("star", "event").agg(
        F.count("*").alias("n"), F.first("base").alias("base"), F.first("least").alias("least"),
        (MAD_TO_SIGMA * F.median(F.abs(F.col("flux") - F.col("base")))).alias("mad"), F.stddev_pop("flux").alias("sd"),
        F.count_if(F.col("flux") < F.col("base") - F.greatest(F.col("base") - F.col("least"), F.lit(0.0)) / 2).alias("below"),
        F.avg(d * d).alias("m2"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"),
    )
    g = g.join(noise(lc).select("star", F.col("noise").alias("global"), "first", "last"), "star")
    enough = F.col("n") >= 3
    local = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd")).when(F.col("global") > 0, F.col("global"))
    depth = F.greatest(F.col("base") - F.col("least"), F.lit(0.0))
    return g.select(
        "star", "event", F.col("n").alias("n_points_window"),
        F.when(enough, depth * 1e6).alias("depth_ppm"), F.when(enough, local).alias("local_noise"), F.when(enough, depth / local).alias("local_snr"),
        F.coalesce(~(enough & local.isNotNull() & (depth > 0)) | (F.col("below") <= 1), F.lit(True)).alias("single_point_like"),
        ((F.col("event") < F.col("first") + EDGE_DAYS) | (F.col("event") > F.col("last") - EDGE_DAYS)).alias("edge_event"),
        F.when(enough & (F.col("m2") > 0), F.col("m3") / F.pow("m2", F.lit(1.5))).alias("skewness"),
        F.when(enough & (F.col("m2") > 0), F.col("m4") / (F.col("m2") * F.col("m2")) - 3).alias("kurtosis"),
    )


def half_depth_crossings(lc: DataFrame, events: DataFrame, window: float = 1.0) -> DataFrame:
    """(star, event, ingress_hours, egress_hours, ratio): from the last sample at or above half depth before the
    minimum, and to the first after it; null for fewer than five samples or no depth."""
    each = W.partitionBy("star", "event")
    w = window_samples(lc, events, window).withColumn("base", F.median("flux").over(each)).withColumn("low", F.min(F.struct("flux", "t")).over(each))
    half = F.col("base") - (F.col("base") - F.col("low.flux")) / 2
    g = w.groupBy("star", "event").agg(
        F.count("*").alias("n"), F.first(F.col("base") - F.col("low.flux")).alias("depth"), F.first("low.t").alias("at"),
        F.max(F.when((F.col("t") <= F.col("low.t")) & (F.col("flux") >= half), F.col("t"))).alias("before"),
        F.min(F.when((F.col("t") >= F.col("low.t")) & (F.col("flux") >= half), F.col("t"))).alias("after"),
    ).filter("n >= 5 and depth > 0")
    ingress, egress = (F.col("at") - F.col("before")) * 24, (F.col("after") - F.col("at")) * 24
    return g.select("star", "event", ingress.alias("ingress_hours"), egress.alias("egress_hours"), F.when(ingress > 0, egress / ingress).alias("ratio"))


def width_at_half_depth(lc: DataFrame, events: DataFrame, window: float = 1.0) -> DataFrame:
    """(star, event, fwhm_hours): both half-depth crossings interpolated between neighbouring samples."""
    each = W.partitionBy("star", "event")
    order = each.orderBy("t")
    w = window_samples(lc, events, window).withColumns({"base": F.median("flux").over(each), "low": F.min(F.struct("flux", "t")).over(each), "n": F.count("*").over(each)})
    w = w.withColumns({"half": F.col("base") - (F.col("base") - F.col("low.flux")) / 2, "t1": F.lead("t").over(order), "f1": F.lead("flux").over(order), "t0": F.lag("t").over(order), "f0": F.lag("flux").over(order)})
    cross = lambda ta, fa, tb, fb: ta + F.coalesce(F.try_divide(F.col("half") - fa, fb - fa), F.lit(0.0)) * (tb - ta)
    above = F.col("flux") >= F.col("half")
    left = F.when(above & (F.col("t") < F.col("low.t")), F.struct("t", cross(F.col("t"), F.col("flux"), F.col("t1"), F.col("f1")).alias("x")))
    right = F.when(above & (F.col("t") > F.col("low.t")), F.struct("t", cross(F.col("t0"), F.col("f0"), F.col("t"), F.col("flux")).alias("x")))
    g = w.filter("n >= 4 and base > low.flux").groupBy("star", "event").agg(F.max(left).alias("a"), F.min(right).alias("b"))
    width = (F.col("b.x") - F.col("a.x")) * 24
    return g.select("star", "event", F.when(width > 0, width).alias("fwhm_hours"))


def flux_at(lc: DataFrame, events: DataFrame) -> DataFrame:
    """(star, event, flux): flux interpolated at each event, held at the ends of the series."""
    both = finite_samples(lc).select("star", "t", "flux", F.lit(None).cast("double").alias("event")).unionByName(events.select("star", F.col("event").alias("t"), F.lit(None).cast("double").alias("flux"), "event"))
    order = W.partitionBy("star").orderBy("t", F.col("flux").isNull())
    sample = F.when(F.col("flux").isNotNull(), F.struct("t", "flux"))
    both = both.withColumns({"a": F.last(sample, True).over(order.rowsBetween(W.unboundedPreceding, 0)), "b": F.first(sample, True).over(order.rowsBetween(0, W.unboundedFollowing))})
    value = F.when(F.col("a").isNull(), F.col("b.flux")).when(F.col("b").isNull() | (F.col("a.t") == F.col("b.t")) | (F.col("a.t") == F.col("t")), F.col("a.flux"))
    value = value.otherwise(F.col("a.flux") + (F.col("b.flux") - F.col("a.flux")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    return both.filter("event is not null").select("star", "event", value.alias("flux"))
