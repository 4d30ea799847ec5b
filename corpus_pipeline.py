"""A corpus pipeline: from raw documents to token ids, stage by stage.

Every stage takes a table with the columns of documents, in any order and with null in any of them, and works on all of it; an
empty table stays empty, and other columns, whatever their names, are kept by all stages but the last. Rows that repeat are judged each.

Rows are whole texts, so stages lower two settings of the session, which hold when their rows are computed: see small_batches().
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintdip.llm.bpe import encode_and_decode
from faintdip.llm.decontaminate import clean
from faintdip.llm.ngram_join import one_of_each
from faintdip.llm.quality import quality_filter
from faintdip.llm.secret_scan import redact
from faintdip.llm.state import forget, shared_folder


#: Rows of a batch to and from Python, and of one that is read from Parquet, at most. Executors hold several such batches for
#: each task at once, outside the heap and in workers; by Spark's settings a batch of 10,000 texts of 2 KB has 20 MB.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 1024}
#: Bytes of text whose distinct pieces are encoded once.
BLOCK = 1 << 20


def small_batches(spark: SparkSession) -> dict[str, str]:
    """Lowers the session's BATCHES where they are larger; returns what they were. No result depends on them."""
    were = {k: spark.conf.get(k) for k in BATCHES}
    for k, most in BATCHES.items():
        if not 0 < int(were[k]) <= most:
            spark.conf.set(k, most)
    return were


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio. Null and empty texts have no words, so they go."""
    small_batches(spark)
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles; null and empty texts and null ids are in no group and stay."""
    small_batches(spark)
    return one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts hold none and stay."""
    small_batches(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced; n_chars is counted anew, null for a null text."""
    small_batches(spark)
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and what they decode to by digest; a null text is an empty one."""
    small_batches(spark)
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, block=BLOCK, lists=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL can't say the likelihood ratio, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's rows are written to the shared folder, which goes when the session's JVM ends, and read again."""
    docs, were = spark.read.parquet(f"{sf_dir}/documents.parquet"), small_batches(spark)
    try:
        for name, stage in STAGES:
            path = shared_folder(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            forget(spark, path)
            docs = spark.read.parquet(path)
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    return docs
