"""The two jobs: growing input, runs that come again, odd rows, and their command lines."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import matched_study, nightly_scan
from jobs.common import config

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    """Sorted rows; sums of doubles hang on the order of rows in their last digits."""
    plain = lambda x: f"{x:.9g}" if isinstance(x, float) else x
    return sorted(str(sorted((k, plain(v)) for k, v in r.asDict().items())) for r in df.collect())


def tables(pair):
    return [rows(df.drop("batch")) for df in pair]


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.fixture(scope="module")
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").cache()


def test_scan_of_growing_input(spark, events, tmp_path):
    new, late, out, state = (str(tmp_path / x) for x in ("in", "late", "out", "state"))
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    odd = events.filter("false").unionByName(spark.createDataFrame([(-1, None, 5), (-2, None, None)], "event_id long, value double, user_id long"), allowMissingColumns=True)
    events.filter(third == 0).unionByName(odd).write.parquet(new)
    first = nightly_scan.run(spark, new, out, state)
    assert tables(first)[0] and len(files(f"{out}/samples/batch=0")) > 0
    before = files(out)
    again = nightly_scan.run(spark, new, out, state)
    assert tables(again) == tables(first) and [f for f in files(out) if "/review/" not in f] == [f for f in before if "/review/" not in f]
    # new samples, some of the old ones once more, and a star that was not there
    extra = events.filter("user_id = 1").limit(12).withColumn("user_id", F.lit(10**9).cast("long"))
    events.filter(third != 0).unionByName(events.filter(third == 0).limit(40)).unionByName(extra).write.mode("append").parquet(new)
    grown = nightly_scan.run(spark, new, out, state)
    events.unionByName(extra).write.parquet(late)
    whole = nightly_scan.run(spark, late, str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert tables(grown) == tables(whole) != tables(first)
    batches = {r["batch"] for r in spark.read.parquet(f"{out}/stars").select("batch").distinct().collect()}
    assert batches == {0, 1}
    review = lambda path: rows(spark.read.parquet(f"{path}/review"))
    assert review(out) == review(tmp_path / "out2") != []


def test_untouched_stars_are_not_scanned_again(spark, events, tmp_path):
    new, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    one = events.filter("user_id is not null").select(F.min("user_id")).first()[0]
    events.filter(F.col("user_id") != one).write.parquet(new)
    nightly_scan.run(spark, new, out, state)
    events.filter(F.col("user_id") == one).write.mode("append").parquet(new)
    stars, _ = nightly_scan.run(spark, new, out, state)
    assert [r["star"] for r in stars.filter("batch = 1").collect()] == [one] and stars.filter("batch = 0").count() == events.select("user_id").distinct().count() - 1


def test_a_batch_that_comes_again(spark, events, tmp_path):
    out, settings = str(tmp_path / "out"), config("nightly_scan")
    for number, part in ((0, events.filter("event_id % 2 = 0")), (1, events.filter("event_id % 2 = 1")), (1, events.filter("event_id % 2 = 1"))):
        nightly_scan.take_batch(part, number, out, settings)
        last = tables(nightly_scan.current(spark, out))
        if number == 1:
            kept = last
    assert last == kept
    # the first batch again, after the second: as it was, for its own samples only
    stars = rows(spark.read.parquet(f"{out}/stars").filter("batch = 0"))
    nightly_scan.take_batch(events.filter("event_id % 2 = 0"), 0, out, settings)
    assert rows(spark.read.parquet(f"{out}/stars").filter("batch = 0")) == stars and tables(nightly_scan.current(spark, out)) == last


def test_scan_of_an_empty_table(spark, events, tmp_path):
    events.limit(0).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stars, dips = nightly_scan.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
        assert stars.count() == dips.count() == 0


STUDY = {"chars_apart": 10.0, "replicates": 50}
DOCS = "doc_id long, text string, lang string, n_chars long, role int, `group` string"


def study_input(spark, path, more=()):
    docs = [(1, "AAA bb cc dd", "en", 0, 9, "x"), (2, "bb cc dd ee", "en", 0, 9, "x"), (3, "bb cc AAA BBB ee", "en", 0, 9, "x"), (4, "aa bb cc", "de", 0, 9, "x"), (5, "aa CCC cc", "de", 0, 9, "x"), (6, None, None, 0, 9, "x"), (7, "", None, 0, 9, "x"), (8, "AAA " * 200, "en", 0, 9, "x"), (2, "bb cc dd ee", "en", 0, 9, "x"), (None, "AAA", "en", 0, 9, "x"), (9, "no label", "en", 0, 9, "x"), *more]
    labels = [(1, 1, 0), (2, 0, 1), (3, 0, 1), (4, 1, 1), (5, 0, 1), (6, 1, 1), (7, 0, 1), (8, 0, 0), (1, 0, 0), (3, None, 0), (None, 1, 1), *((d[0], d[0] % 2, 1) for d in more)]
    spark.createDataFrame(docs, DOCS).write.mode("overwrite").parquet(f"{path}/documents")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.mode("overwrite").parquet(f"{path}/labels")
    return f"{path}/documents", f"{path}/labels"


def test_study(spark, tmp_path):
    settings, out = config("matched_study") | STUDY, str(tmp_path / "out")
    docs, labels = study_input(spark, tmp_path)
    pairs, rates = matched_study.run(spark, docs, labels, out, settings)
    got = {(r["group"], r["target_id"], r["control_id"], r["target_events"], r["control_events"]) for r in pairs.collect()}
    # 1 takes 2, which is as long but for a letter; 8 is too long for anything; unlabelled and null ids take no part
    assert got == {("en", 1, 2, 1, 0), ("de", 4, 5, 0, 1), ("unknown", 6, 7, 0, 0)}
    r = {x["group"]: x for x in rates.collect()}
    assert (r["en"]["target_candidates"], r["en"]["control_candidates"], r["en"]["ratio"]) == (1, 0, None) and r["de"]["ratio"] == 0.0
    first = tables((pairs, rates))
    assert tables(matched_study.run(spark, docs, labels, out, settings)) == first
    # only one language of grown input: the others stay as they were
    grown = study_input(spark, tmp_path, [(21, "aa bb cc", "de", 0, 9, "x"), (22, "aa bb cc", "de", 0, 9, "x"), (31, "aa bb cc dd", "en", 0, 9, "x"), (32, "aa bb cc dd", "en", 0, 9, "x")])
    pairs, _ = matched_study.run(spark, *grown, out, settings | {"only": ["de", "fr"]})
    got = {(x["group"], x["target_id"], x["control_id"]) for x in pairs.collect()}
    assert got == {("en", 1, 2), ("unknown", 6, 7), ("de", 4, 22), ("de", 21, 5)}
    pairs, _ = matched_study.run(spark, *grown, out, settings)
    assert {x["group"] for x in pairs.collect() if x["target_id"] == 31} == {"en"}
    # a language that lost its pairs
    spark.createDataFrame([(4, 1, 1)], "doc_id long, toxic int, quality int").write.mode("overwrite").parquet(labels)
    pairs, rates = matched_study.run(spark, *grown, out, settings | {"only": ["de"]})
    assert {x["group"] for x in pairs.collect()} == {x["group"] for x in rates.collect()} == {"en", "unknown"}
    pairs, rates = matched_study.run(spark, *grown, out, settings)
    assert pairs.count() == rates.count() == 0


def test_command_lines(spark, events, tmp_path):
    docs, labels = study_input(spark, tmp_path)
    events.limit(200).write.parquet(str(tmp_path / "in"))
    (tmp_path / "study.json").write_text(json.dumps(STUDY))
    lines = (
        ["jobs.nightly_scan", "--samples", f"{tmp_path}/in", "--out", f"{tmp_path}/out1", "--state", f"{tmp_path}/state"],
        ["jobs.matched_study", "--documents", docs, "--labels", labels, "--out", f"{tmp_path}/out2", "--config", f"{tmp_path}/study.json"],
    )
    for line in lines:
        done = subprocess.run([sys.executable, "-m", *line], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "wrote" in done.stderr and "read" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/out1/stars").count() > 0 and spark.read.parquet(f"{tmp_path}/out2/pairs").count() == 3
    with pytest.raises(ValueError):
        (tmp_path / "bad.json").write_text('{"colour": 1}')
        config("matched_study", spark, f"{tmp_path}/bad.json")


def test_registered(spark):
    import __spark_entry__ as entry

    for name in ("job1_nightly_scan", "job2_matched_study"):
        assert name in entry.queries() and name in entry.oracle_sql()
