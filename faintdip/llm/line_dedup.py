"""Line dedup: lines that several documents hold stay in the first of them only.

Lines are exploded with their positions, normalised and hashed to 128 bits; distinct documents are counted
per hash, and what is over the threshold is dropped by position. Texts cross the network once, to meet the
positions that they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import written

#: What is stripped from the ends of a line: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
#: A hash with more than this share of all lines is met in SALTS places, so at most 1 / HOT hashes are broadcast.
HOT, SALTS = 1 / 2000, 64


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, and r1 and r2, which tell the texts of one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("r1"), F.hash(text).alias("r2"))


def _lines(texts: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, r1, r2, pos, h1, h2) of the lines whose key has least_chars code points."""
    lines = texts.select("doc_id", "r1", "r2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "r1", "r2", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    return keys.select("doc_id", "r1", "r2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(docs: DataFrame, least_docs: int = 2, least_chars: int = 10) -> DataFrame:
    """(h1, h2, n_docs, first_doc, n_lines) of the keys that least_docs documents hold, written to the shared folder."""
    by_doc = _lines(_texts(docs), least_chars).groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    keys = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.sum("n").alias("n_lines"))
    return written(keys.filter(F.col("n_docs") >= least_docs), "shared-lines")


def dedup_lines(docs: DataFrame, least_docs: int = 2, least_chars: int = 10) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), one row for each row of docs: its text without the lines that it repeats.

    docs has doc_id and text; other columns, whatever their names, are left out. A text is split at \\n; a null or
    empty one is one empty line. Lines whose keys have at least least_chars code points and are held by at least
    least_docs documents are dropped but in the smallest doc_id that holds them; there all of them stay. The rest is
    joined by \\n in its old order, and is empty where nothing is left. Rows of one doc_id count as one document, so
    repeated rows come out alike; null ids are one document, behind all others. An empty table gives no rows.
    """
    texts = _texts(docs)
    shared = shared_lines(docs, least_docs, least_chars)
    total = shared.agg(F.sum("n_lines")).first()[0] or 0
    hot = shared.filter(F.col("n_lines") > total * HOT).select("h1", "h2", F.lit(SALTS).alias("salts"))
    spread = F.pmod(F.xxhash64("r1", "pos"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    lines = _lines(texts, least_chars).join(F.broadcast(hot), ["h1", "h2"], "left").select("doc_id", "r1", "r2", "pos", "h1", "h2", spread)
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    keys = shared.join(F.broadcast(hot), ["h1", "h2"], "left").select("h1", "h2", "first_doc", salts)
    gone = lines.join(keys, ["h1", "h2", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = gone.groupBy(F.col("doc_id").alias("of"), F.col("r1").alias("of1"), F.col("r2").alias("of2")).agg(F.collect_set("pos").alias("gone"))
    same = [F.col("doc_id").eqNullSafe(F.col("of")), F.col("r1") == F.col("of1"), F.col("r2") == F.col("of2")]
    out = texts.join(gone, same, "left").select("doc_id", "text", "gone")
    # the lines are bound by the outer transform, so a text is split once
    rest = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda p: F.get(ls, p)), "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(F.split("text", "\n", -1)), rest), 0))
    n_lines = (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return out.select("doc_id", kept.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
