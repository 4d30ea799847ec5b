import pytest
from pyspark.sql import functions as F

from faintdip.operators import review
from faintdip.plans import pipeline, samples


def test_target_sample_keeps_the_first_catalog(spark):
    a = spark.createDataFrame([("A", 10.0, 5.0), ("B", 20.0, 5.0)], "name string, ra double, dec double")
    b = spark.createDataFrame([("A again", 10.0001, 5.0), ("C", 30.0, 5.0)], "name string, ra double, dec double")
    got = samples.target_sample({"cotten_song_2016": a, "chen_2014": b}).collect()
    assert sorted(r["target_name"] for r in got) == ["A", "B", "C"] and {r["sample_role"] for r in got} == {"target"}


def test_control_pool(spark):
    stars = spark.createDataFrame([(i, 10.0 * i, 0.0, 8.0 + 0.1 * i, 5000.0) for i in range(1, 6)], "id long, ra double, dec double, tmag double, teff double")
    targets = spark.createDataFrame([(100, 8.2, 5100.0)], "id long, tmag double, teff double")
    products = spark.createDataFrame([(1, 3), (1, 2), (3, 5), (4, 1)], "tic_id long, sector int")
    got = samples.control_pool(stars, targets, spark.createDataFrame([(4,)], "id long"), spark.createDataFrame([(9, 30.0, 0.0)], "id long, ra double, dec double"), products)
    assert [(r["tic_id"], r["first_sector"]) for r in got.collect()] == [(1, 2)]


def test_products(spark):
    p = spark.createDataFrame([(1, "b", "SPOC"), (1, "a", "QLP"), (2, "c", "SPOC")], "tic_id long, product string, author string")
    assert samples.search_products(p, author="SPOC").count() == 2
    assert sorted(r["product"] for r in samples.product_number(p, 0).collect()) == ["a", "c"]
    with pytest.raises(Exception, match="too few products"):
        samples.product_number(p, 1).collect()


def test_stars_at_random_do_not_depend_on_partitions(spark):
    df = spark.range(100).withColumnRenamed("id", "star")
    assert samples.some_stars(df, 5).collect() == samples.some_stars(df.repartition(7), 5).collect()


def test_ready_to_scan(spark):
    df = spark.createDataFrame([("1", "2", "yes"), ("x", "2", "yes"), ("1", "2", None)], "ra_deg string, dec_deg string, has_tess_lightcurve string")
    assert samples.ready_to_scan(df).count() == 1


def test_positions_and_names(spark):
    e = spark.createDataFrame([(1,), (2,), (3,)], "star long")
    a = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0)], "star long, ra double, dec double")
    b = spark.createDataFrame([(2, 9.0, 9.0), (1, None, 1.0)], "star long, ra double, dec double")
    assert {r["star"]: r["ra"] for r in review.attach_positions(e, a, b).collect()} == {1: 1.0, 2: 9.0, 3: None}
    assert {r["star"]: r["star_name"] for r in review.attach_names(e, a.select("star", F.lit("n").alias("name"))).collect()} == {1: "n", 2: "n", 3: "TIC 3"}


def test_whole_run_and_resume(spark, sf):
    lc = spark.sql("SELECT user_id AS star, unix_micros(cast(ts as timestamp)) / 86400e6D AS t, 1 - value / 1000D AS flux FROM {e}", e=spark.read.parquet(f"{sf}/events.parquet"))
    pairs = lc.select((F.col("star") - F.col("star") % 2).alias("target_id")).distinct().select((F.col("target_id") / 2).cast("long").alias("pair_id"), "target_id", F.lit("t").alias("target_name"), (F.col("target_id") + 1).alias("control_id"))
    one = pipeline.run(lc, pairs, window=5.0, many=3, fits=False)
    assert one.events.count() > 0 and one.statistics.count() == 2
    assert one.stars.agg(F.sum("n_events")).first()[0] == one.events.count()
    again = pipeline.run(lc, pairs, status=one.status, window=5.0, many=3, fits=False)
    assert again.events.count() == 0


def test_registered_runs_fit_models(spark, sf, monkeypatch):
    from faintdip import queries
    from faintdip.plans import pipeline

    deltas = [r["delta_chi2"] for r in queries.scan_outcomes(spark, sf).filter("status is null").collect()]
    assert any(x is not None and x == x for x in deltas)
    seen, run = [], pipeline.run
    monkeypatch.setattr(pipeline, "run", lambda *a, **b: seen.append(run(*a, **b)) or seen[-1])
    assert queries.full_run_statistics(spark, sf).count() == 2
    assert seen[0].events.filter("delta_chi2 is not null and not isnan(delta_chi2)").count() > 0


def test_range_scan_of_a_dense_field(spark, monkeypatch):
    """Near stars first, in several levels, and the same rows as by looking at all."""
    import random

    rng, cuts = random.Random(5), []
    monkeypatch.setattr(samples, "cut", lambda df, real=samples.cut: cuts.append(1) or real(df))
    stars = [(i, round(8 + rng.random() ** 3, 3), 5000.0 + 100 * (i % 9)) for i in range(600)]
    targets = [(1000 + i, round(7.8 + 1.4 * rng.random(), 3), 5000.0 + 100 * (i % 12)) for i in range(60)]
    want = {}
    for k, m, e in sorted(targets):
        near = sorted((abs(s[1] - m), s[0]) for s in stars if abs(s[1] - m) <= 0.5 and e - 300 <= s[2] <= e + 300)[:2]
        for _, s in near:
            want.setdefault(s, k)
    kind = "id long, tmag double, teff double"
    got = samples.range_scan(spark.createDataFrame(targets, kind), spark.createDataFrame(stars, kind), each=2)
    assert {r["id"]: r["target_id"] for r in got.collect()} == want and cuts


def test_target_sample_keeps_the_first_name_of_a_catalog(spark):
    rows = [(f"{n}{i:02}", 10.0 + i, 5.0) for i in range(30) for n in ("B", "A")]
    got = samples.target_sample({"chen_2014": spark.createDataFrame(rows, "name string, ra double, dec double")}).collect()
    assert sorted(r["target_name"] for r in got) == [f"A{i:02}" for i in range(30)]
