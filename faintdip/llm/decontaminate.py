"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every benchmark item gives windows of consecutive words. A window can only occur where its
rarest word occurs, so that one word is the necessary prefix of the window's words ordered
by rarity over the corpus. Documents look up each of their words among the prefix words,
bounds on position and length drop places where the window can't lie, and what is left is
compared word by word.

Rows are numbered and cut into words once, in a table of the shared folder; all steps read that
table, so it does not matter whether the input's rows come in the same order twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import SMALL, cut, is_small, written

#: Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] in lower-cased text; these part them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, -1), "")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct (item_id, win) of the items' windows; a shorter item is one window."""
    w = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.expr(f"sequence(1, greatest(size(w) - {size} + 1, 1))")
    return w.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.expr(f"slice(w, i, {size})").alias("win")).distinct()


def numbered(docs: DataFrame, *carry: Column) -> DataFrame:
    """(rid, n_words, w, ...): every row of docs with a number, its words, and what is to be carried along."""
    w = words_of(F.col("text")).alias("w")
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), w, *carry).withColumn("n_words", F.size("w").cast("long")), "words")


def word_counts(rows: DataFrame, vocabulary: DataFrame, bound: int) -> DataFrame:
    """How often each word of the vocabulary occurs in the corpus; words that don't occur are left out."""
    every = rows.select(F.explode("w").alias("word"))
    if is_small(vocabulary, F.octet_length("word") + 32, bound):
        return every.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return every.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")


def rarest_words(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, win, word, shift): each window's rarest word and where in it that first is.

    A window with a word that the corpus lacks is dropped: it can't occur.
    """
    each = windows.select("item_id", "win", F.posexplode("win").alias("shift", "word")).join(counts, "word")
    best = each.groupBy("item_id", "win").agg(F.count("*").alias("m"), F.min(F.struct("n", "word", "shift")).alias("best"))
    return best.filter(F.col("m") == F.size("win")).select("item_id", "win", "best.word", "best.shift")


def matches(rows: DataFrame, items: DataFrame, window: int, bound: int = SMALL) -> DataFrame:
    """(rid, start, long, item_id): where windows occur in numbered() rows.

    The corpus is read once to count the benchmark's words and once to look up the prefixes,
    whatever the size of the benchmark. Its vocabulary and its prefixes are broadcast while
    they stay under bound bytes; beyond it the corpus meets them by shuffles.
    """
    windows = cut(item_windows(items, window))
    vocabulary = cut(windows.select(F.explode("win").alias("word")).distinct())
    prefixes = cut(rarest_words(windows, word_counts(rows, vocabulary, bound)))
    inside = F.expr("at >= shift and at - shift + size(win) <= n_words")
    same = F.expr("slice(w, at - shift + 1, size(win)) = win")
    found = (F.col("rid"), (F.col("at") - F.col("shift")).alias("start"), F.size("win").alias("long"), F.col("item_id"))
    if is_small(prefixes, F.octet_length("item_id") + F.octet_length(F.array_join("win", " ")) + 128, bound):
        places = rows.select("rid", "n_words", "w", F.posexplode("w").alias("at", "word"))
        return places.join(F.broadcast(prefixes), "word").filter(inside & same).select(*found)
    places = rows.select("rid", "n_words", F.posexplode("w").alias("at", "word")).join(prefixes, "word").filter(inside)
    return places.join(rows.select("rid", "w"), "rid").filter(same).select(*found)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, bound: int = SMALL) -> DataFrame:
    """One row for each row of docs (doc_id, text): rid (a number of the row), doc_id, n_words, n_hit, n_items, item_ids
    (array<string>, sorted), contaminated.

    items has item_id and text. Null and empty texts have no words, so they are clean and
    no item's window; items without an id are skipped; an empty benchmark leaves every
    document clean. Repeated documents give repeated rows, repeated items count once for an
    id. Other columns are ignored. bound is that of matches().
    """
    rows = numbered(docs, F.col("doc_id"))
    found = matches(rows, items, window, bound)
    base = rows.select("rid", "doc_id", "n_words", *(F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("long", "int"), ("item_id", "string"))))
    every = base.unionByName(found.select("rid", F.lit(None).cast(base.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("n_words"), "start", "long", "item_id"))
    # nulls are left out of the sets
    every = every.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "long")))).alias("hits"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    covered = F.expr(
        "aggregate(hits, struct(0L as n, 0L as upto), (a, h) -> struct(a.n + greatest(h.start + h.long - greatest(a.upto, h.start), 0L) as n, "
        "greatest(a.upto, h.start + h.long) as upto)).n"
    )
    return every.select("rid", "doc_id", "n_words", covered.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.size("hits") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, *, window: int = 10, bound: int = SMALL) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns, whatever their names.

    Null and empty texts and an empty benchmark are clean, as in decontaminate(); repeated
    rows stay or go together; an empty table stays empty.
    """
    rows = numbered(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    bad = cut(matches(rows, items, window, bound).select("rid").distinct())
    bad = F.broadcast(bad) if is_small(bad, F.lit(16), bound) else bad
    return rows.join(bad, "rid", "left_anti").select("row.*")
