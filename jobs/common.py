"""What the jobs share: their config, their command line's session, and an empty table where none was written yet."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def config(name: str, spark: SparkSession | None = None, path: str | None = None) -> dict:
    """The job's own config, with the values of the file at path, which Spark reads, in their place."""
    with open(f"{HERE}/{name}.json") as f:
        out = json.load(f)
    if path:
        given = json.loads(spark.read.text(path, wholetext=True).first()[0])
        if unknown := set(given) - set(out):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= given
    return out


def ready(spark: SparkSession, path: str, schema: str) -> None:
    """Leaves an empty table at path where there is nothing, so that it can be read."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def written(df: DataFrame, path: str, log: logging.Logger, *by: str, dynamic: bool = False) -> DataFrame:
    """df, put in the place of the table at path (of its partitions, if dynamic), read again and counted in the log."""
    out = df.write.mode("overwrite").partitionBy(*by)
    (out.option("partitionOverwriteMode", "dynamic") if dynamic else out).parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    log.info("wrote %s: %d rows", path, again.count())
    return again


def command_line(name: str, about: str, paths: dict[str, str], run) -> None:
    """Parses paths and --config, creates a session, runs and stops it."""
    parser = argparse.ArgumentParser(description=about)
    for path, text in paths.items():
        parser.add_argument(f"--{path}", required=True, help=text)
    parser.add_argument("--config", help=f"JSON that changes settings of jobs/{name}.json")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        settings = config(name, spark, args.pop("config"))
        run(spark, *args.values(), settings)
    finally:
        spark.stop()
