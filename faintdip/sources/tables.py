"""Reading catalogs, series and metadata from files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import conform, meaningful, number
from ..functions.coords import six_numbers

SERIES = T.StructType([T.StructField("star", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("flux", T.DoubleType()), T.StructField("flux_err", T.DoubleType()), T.StructField("quality", T.IntegerType()), T.StructField("product", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV table with a header. Cells are read as text, placeholders become null, and then cast where they can be."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    raw = raw.select(*(meaningful(F.col(f"`{c}`")).alias(c) for c in raw.columns))
    return conform(raw, schema) if schema else raw


def read_series(spark: SparkSession, path: str, stars: list[int] | None = None) -> DataFrame:
    """Cached series, written by star; with stars only their folders are read. Corrupt and missing files are skipped."""
    df = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)
    df = conform(df, SERIES)
    return df.filter(F.col("star").isin(*stars)) if stars is not None else df


def read_cached_or_fetch(spark: SparkSession, path: str, wanted: DataFrame, fetch) -> DataFrame:
    """Series of all wanted stars: the cached ones, and those that fetch(stars) gives for the rest, which are cached too."""
    from .sinks import write_series

    try:
        have = read_series(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = spark.createDataFrame([], SERIES)
    missing = wanted.select("star").distinct().join(have.select("star").distinct(), "star", "left_anti")
    got = conform(fetch(missing), SERIES)
    write_series(got, path)
    return read_series(spark, path).join(wanted.select("star").distinct(), "star", "left_semi")


def read_pipe_table(spark: SparkSession, path: str, least: int = 17) -> DataFrame:
    """Rows of a pipe-delimited text table as an array column `cells`; comments, rules and short lines are skipped."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|[-=+|\s]*$)"))
    cells = F.transform(F.split("value", r"\|"), lambda x: meaningful(F.trim(x)))
    return lines.select(cells.alias("cells")).filter(F.size("cells") >= least)


#: The cells of a pipe-delimited table of targets that are text or a number, and what such rows are.
PIPE_TEXT, PIPE_NUMBERS, PIPE_POSITION = {"target_name": 0, "sp_type": 3, "reference": 16}, {"teff_catalog": 4, "disk_temperature": 6, "disk_radius": 7, "distance_pc": 11}, 2
PIPE_ROLE = "disk_or_ir_excess_target"
TARGET_COLUMNS = ("target_name", "source_catalog", "ra_deg", "dec_deg", "sp_type", "teff_catalog", "disk_temperature", "disk_radius", "distance_pc", "reference", "sample_role")


def read_pipe_targets(spark: SparkSession, path: str, source: str) -> DataFrame:
    """TARGET_COLUMNS of a pipe-delimited table; the heading, and rows without a name, go. The position is six numbers in one cell."""
    cells = read_pipe_table(spark, path).filter("cells[0] is not null and cells[0] <> 'Name' and not rlike(cells[0], '^-+$')")
    cell = lambda i: F.get("cells", F.lit(i))
    ra, dec = six_numbers(cell(PIPE_POSITION))
    own = {n: cell(i) for n, i in PIPE_TEXT.items()} | {n: number(cell(i)) for n, i in PIPE_NUMBERS.items()}
    own |= {"source_catalog": F.lit(source), "ra_deg": ra, "dec_deg": dec, "sample_role": F.lit(PIPE_ROLE)}
    return cells.select(*(own[c].alias(c) for c in TARGET_COLUMNS))


def local_targets(spark: SparkSession, csv_path: str, text_path: str, source: str, most: int = 50) -> DataFrame:
    """The first `most` targets by name of the CSV file, or, where that is absent, a web page or without rows, of the pipe-delimited file."""
    from ..operators.catalogs import normalize

    if most < 1:
        raise ValueError("most must be at least 1")
    rows = None
    if exists(spark, csv_path) and sniff(spark, csv_path) == "csv":
        rows = normalize(read_csv(spark, csv_path), source)
        rows = None if rows.isEmpty() else rows
    if rows is None:
        if not exists(spark, text_path):
            raise FileNotFoundError(f"no table of targets at {csv_path} or {text_path}")
        rows = read_pipe_targets(spark, text_path, source)
    rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in TARGET_COLUMNS))
    return rows.orderBy(F.col("target_name").asc_nulls_last(), "ra_deg", "dec_deg").limit(most)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def sibling(path: str, name: str) -> str:
    """The path of a file beside another."""
    return f"{path.rstrip('/').rpartition('/')[0] or '.'}/{name}"


def read_sibling_csv(spark: SparkSession, path: str, name: str = "target_sample_enriched.csv") -> DataFrame | None:
    """The CSV table of that name beside path; None where there is none."""
    beside = sibling(path, name)
    return read_csv(spark, beside) if exists(spark, beside) else None


def read_run_metadata(spark: SparkSession, events_path: str, given: str | None = None) -> DataFrame | None:
    """A run's JSON metadata: the given file, else the one beside its table of events, else None.

    A vetted table's metadata are those of the detector's table of the same name.
    """
    stem = events_path.rstrip("/").rpartition("/")[2].rsplit(".", 1)[0].replace("vetted_candidate_events", "detector_candidate_events")
    for path in (given, sibling(events_path, f"{stem}.meta.json")):
        if path and exists(spark, path):
            return read_metadata(spark, path)
    return None


def read_fixed_width(spark: SparkSession, path: str, columns: dict[str, tuple[int, int]]) -> DataFrame:
    """Columns cut out of text lines at [begin, end), counted from 0; gz files are unpacked as they are read."""
    return spark.read.text(path).select(*(meaningful(F.trim(F.substring("value", a + 1, b - a))).alias(n) for n, (a, b) in columns.items()))


def read_tar_member(spark: SparkSession, path: str, suffix: str, columns: dict[str, tuple[int, int]]) -> DataFrame:
    """Fixed-width columns of the gz member of a tar file whose name ends so."""
    import pandas as pd

    def unpack(batches):
        import gzip
        import io
        import tarfile

        for pdf in batches:
            for content in pdf.content:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.name.endswith(suffix):
                            raw = tar.extractfile(m).read()
                            text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
                            yield pd.DataFrame([[line[a:b].strip() or None for a, b in columns.values()] for line in text.splitlines() if line.strip()], columns=list(columns))

    kind = ", ".join(f"`{n}` string" for n in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, kind)


def sniff(spark: SparkSession, path: str) -> str:
    """csv or text: a page of HTML instead of a table counts as text."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(5).collect())[:512]
    return "text" if "<html" in head.lower() or ("|" in head and "," not in head.split("\n")[0]) else "csv"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def union_with_source(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables by column name, with their names in source_table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("source_table", F.lit(n)) for n, t in tables.items()])


def first_products(products: DataFrame, most: int) -> DataFrame:
    """The first products of each star by name; product number k is the last of the first k + 1."""
    from pyspark.sql import Window as W

    return products.withColumn("__k", F.row_number().over(W.partitionBy("star").orderBy("product"))).filter(F.col("__k") <= most).drop("__k")


def photometry(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({n: number(F.col(n)) for n in names})
