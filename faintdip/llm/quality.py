"""Quality rules: base rules and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are estimated: one from trusted
documents (labelled good), one from the whole raw corpus. A document's score is the mean
log ratio of its n-grams, so length does not matter. One threshold, taken from labelled
documents, decides for every document alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut, running
from .flat import WHITE, mix, neighbours, per_text, repeated, shingle_hash, slices, span_hash, words
from .state import having

#: Hash buckets of the two multinomials.
BUCKETS = 1 << 16
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def ngrams(buf, start, end, text, buckets):
    """Bucket and text number of every unigram and bigram."""
    word = span_hash(buf, start, end)
    two = neighbours(text, 2)
    pair = shingle_hash(word, 2)[two] if len(two) else np.empty(0, np.uint64)
    at = np.concatenate([mix(word + np.uint64(1)), pair]) % np.uint64(buckets)
    return at.astype(np.int64), np.concatenate([text, text[:-1][two] if len(two) else text[:0]]), word


def base_counts(buf, off, text, word):
    """The counts that the base rules use, for each text of a slice."""
    n = len(off) - 1
    n_words = np.bincount(text, minlength=n)
    ink = ~WHITE[buf]
    chars = per_text(ink & ((buf & 0xC0) != 0x80), off)
    symbols = per_text(SYMBOL[buf], off)
    # lines
    cut = np.zeros(len(buf) + 1, bool)
    cut[np.flatnonzero(buf == 10)] = True
    begin = np.unique(np.concatenate([off[:-1], np.flatnonzero(cut) + 1])) if len(buf) else np.empty(0, np.int64)
    begin = begin[begin < len(buf)]
    inked = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(ink, out=inked[1:])
    text_of = np.searchsorted(off, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(buf)), off[1:][text_of]) if len(begin) else begin
    full = inked[stop] > inked[begin]
    begin, stop, text_of = begin[full], stop[full], text_of[full]
    stop = stop - ((stop > begin) & (buf[stop - 1] == 10))
    key = mix(span_hash(buf, begin, stop) ^ mix(text_of.astype(np.uint64)))
    first = np.unique(key, return_index=True)[1]
    dup = np.bincount(text_of, minlength=n) - np.bincount(text_of[first], minlength=n)
    # windows of three words
    three = neighbours(text, 3)
    hit = np.zeros(len(text), bool)
    if len(three):
        key = mix(shingle_hash(word, 3) ^ mix(text[:-2].astype(np.uint64)))
        at = np.flatnonzero(three)
        at = at[repeated(key[at])]
        for i in range(3):
            hit[at + i] = True
    again = np.bincount(text[hit], minlength=n)
    return n_words, chars, symbols, dup, again


def ngram_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Counts of each bucket over all rows of (doc_id, text)."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, buf, off in slices(batch.column(1)):
                total += np.bincount(ngrams(buf, *words(buf, off), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    # at most one row for each bucket
    for r in docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log of the trusted over the raw probability of each bucket, each with one added count."""
    p = (counts + 1) / (counts.sum(1, keepdims=True) + counts.shape[1])
    return np.log(p[1]) - np.log(p[0])


def measured(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Base counts and score of each row of (doc_id, text), with any further columns as they are."""
    buckets, more = len(weights), docs.columns[2:]

    def run(batches):
        for batch in batches:
            for i, buf, off in slices(batch.column(1)):
                start, end, text = words(buf, off)
                at, of, word = ngrams(buf, start, end, text, buckets)
                n = len(off) - 1
                score = np.bincount(of, weights[at], n) / np.maximum(np.bincount(of, minlength=n), 1)
                cols = base_counts(buf, off, text, word)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), *(pa.array(c.astype(np.int64)) for c in cols), pa.array(score), *(batch.column(c).slice(i, n) for c in more)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", *more],
                )

    kind = T._parse_datatype_string("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    return docs.mapInArrow(run, T.StructType([*kind, *(docs.schema[c] for c in more)]))


def best_cut(scores: DataFrame) -> float:
    """The score that best parts good from bad rows of (score, quality), the least of equals; minus infinity if either is missing."""
    each = cut(scores.groupBy("score").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")))
    n = each.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    if not n["good"] or not n["bad"]:
        return float("-inf")
    below = running(each, [F.col("score")], g=F.col("good"), b=F.col("bad"))
    gain = (F.col("b") - F.col("bad")) / n["bad"] - (F.col("g") - F.col("good")) / n["good"]
    edge = below.orderBy(gain.desc(), "score").first()["score"]
    before = each.filter(F.col("score") < edge).agg(F.max("score")).first()[0]
    return float(edge if before is None else (edge + before) / 2)


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that quality_rules() keeps.

    Null and empty texts have no words, so their rows go; repeated rows and null ids are judged row by row; an empty table stays empty.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return quality_rules(docs.select("doc_id", "text", row), labels, carry=("row",), **options).filter("kept").select("row.*")


def quality_rules(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text): base counts, score, base_failed, kept.

    labels has doc_id and quality (1 good, 0 bad; good where an id has both). All labelled documents count, for the
    threshold each by the lowest score of its rows.
    Null texts have no words, so they fail the base rules; null ids stay null. Repeated rows
    give repeated results. Without labels of both kinds only the base rules decide. Columns
    beyond doc_id, text and those named in carry are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *carry)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    marks = cut(labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality")))
    of = lambda some: having(docs, some, "doc_id")
    weights = log_ratio(np.stack([ngram_counts(docs, buckets), ngram_counts(of(marks.filter("quality = 1")), buckets)]))
    scores = measured(of(marks), weights).filter("n_words > 0").groupBy("doc_id").agg(F.min("score").alias("score"))
    threshold = best_cut(scores.join(marks, "doc_id"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        measured(rows, weights)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
        .withColumn("threshold", F.lit(threshold))
    )
