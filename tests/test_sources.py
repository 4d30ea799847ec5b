import gzip
import io
import tarfile

from pyspark.sql import functions as F

from faintdip.sources import sinks, tables
from faintdip.streaming.scan import read_samples, scan_batches, window_dips


def test_csv_with_placeholders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("star,t,flux\n1,2.5,N/A\nx,3,1\n")
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), tables.SERIES).collect()
    assert [(r["star"], r["t"], r["flux"]) for r in got] == [(1, 2.5, None), (None, 3.0, 1.0)]
    assert tables.sniff(spark, str(tmp_path / "a.csv")) == "csv"


def test_series_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    wanted = spark.createDataFrame([(1,), (2,)], "star long")
    asked = []

    def fetch(missing):
        asked.append(sorted(r["star"] for r in missing.collect()))
        return missing.select("star", F.lit(1.0).alias("t"), F.lit(1.0).alias("flux"))

    assert tables.read_cached_or_fetch(spark, path, wanted, fetch).count() == 2
    assert tables.read_cached_or_fetch(spark, path, wanted.unionByName(spark.createDataFrame([(3,)], "star long")), fetch).count() == 3
    assert asked == [[1, 2], [3]]
    assert tables.read_series(spark, path, [3]).count() == 1


def test_text_tables(spark, tmp_path):
    row = "|".join(f" c{i} " for i in range(17))
    (tmp_path / "p.txt").write_text(f"# note\n----\n{row}\na|b\n")
    assert tables.read_pipe_table(spark, str(tmp_path / "p.txt")).first()["cells"][16] == "c16"
    line = "x" * 16 + "12 30 45.00" + " " + "-10 20 30.0"
    (tmp_path / "f.txt").write_text(line + "\n")
    cols = {"ra": (16, 27), "dec": (28, 39)}
    assert tuple(tables.read_fixed_width(spark, str(tmp_path / "f.txt"), cols).first()) == ("12 30 45.00", "-10 20 30.0")
    with tarfile.open(tmp_path / "t.tar", "w") as tar:
        raw = gzip.compress((line + "\n").encode())
        info = tarfile.TarInfo("d/t.dat.gz")
        info.size = len(raw)
        tar.addfile(info, io.BytesIO(raw))
    assert tuple(tables.read_tar_member(spark, str(tmp_path / "t.tar"), ".dat.gz", cols).first()) == ("12 30 45.00", "-10 20 30.0")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "star long, reasons array<string>")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["reasons"] == "a,b"
    sinks.write_json(df, str(tmp_path / "j"))
    assert tables.read_metadata(spark, str(tmp_path / "j")).first()["star"] == 1
    sinks.write_gallery(df.drop("reasons").withColumn("x", F.lit(1)), df.select("star", F.lit("{}").alias("metadata")), str(tmp_path / "g"))
    assert (tmp_path / "g/events/star=1").is_dir() and (tmp_path / "g/metadata/star=1").is_dir()
    sinks.append_log(df, str(tmp_path / "l"))
    sinks.append_log(df, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2


def test_products(spark):
    p = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "star long, product string")
    assert sorted(r["product"] for r in tables.first_products(p, 1).collect()) == ["a", "c"]
    assert tables.union_with_source({"x": p, "y": p.drop("product")}).filter("product is null").count() == 3


def test_streams(spark, sf, tmp_path):
    samples = read_samples(spark, f"{sf}/events*.parquet")
    q = window_dips(samples).writeStream.format("memory").queryName("dips_test").outputMode("append").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dips_test").filter("depth < 4 * noise").count() == 0
    q = scan_batches(samples, str(tmp_path / "out"), str(tmp_path / "b"), lambda df: df.groupBy("star").count())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
