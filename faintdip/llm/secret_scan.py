"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Patterns find candidate values in whole texts. For every candidate value the corpus is asked
how many repositories and owners hold it: widely copied examples are told from values that
look like live credentials of their owner.

Rows are numbered and scanned once, into a table of the shared folder that holds hashes of
the values; all steps read that table, so it does not matter whether the input's rows come
in the same order twice. Only rows with candidates take part in any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .state import cut, is_small, written

#: Kind, pattern, the group whose length counts, and its least length.
BASE_KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs of any length, of which only these pass
)
#: Candidates without a telling context: added only where they are owner-specific.
MORE_KINDS = (
    ("prefixed", r"(?<![A-Za-z0-9_])(?:gh[pousr]_|glpat-|sk_live_|sk-|xox[abprs]-|hf_|AIza|eyJ)[A-Za-z0-9_.-]{16,}", 0, 20),
    ("opaque", r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*[0-9])(?=[A-Z0-9_+/-]*[a-z])(?=[a-z0-9_+/-]*[A-Z])[A-Za-z0-9_+/-]{24,}={0,2}", 0, 24),
)
KINDS = BASE_KINDS + MORE_KINDS
#: A value that this many owners hold is a copied example, and so is one that two owners hold in so many repositories.
COPIED, SPREAD = 3, 10
#: Tasks that a value's rows are dealt to where copied values are too many to broadcast.
SALTS = 16


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct(gap, long, value)> of the leftmost matches, from left to right; value is a hash, and null where too short."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    hashed = lambda v: F.when(F.length(v) >= least, F.unhex(F.sha2(v.cast("binary"), 256)))
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("g"), whole.alias("w"), value.alias("v")),
        lambda x: F.struct(F.length(x["g"]).cast("long").alias("gap"), F.length(x["w"]).cast("long").alias("long"), hashed(x["v"]).alias("value")),
    )
    return F.when(text.rlike(pattern), rows)


def scanned(docs: DataFrame, repo: str | None, owner: str | None, *carry: Column) -> DataFrame:
    """(rid, repo, owner, kinds, ...): every row with a number, its matches by kind, and what is to be carried along."""
    name = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    d = docs.select(F.monotonically_increasing_id().alias("rid"), name(repo).alias("repo"), name(owner).alias("owner"), F.coalesce("text", F.lit("")).alias("whole"), *carry)
    each = F.array(*(F.struct(F.lit(i).alias("order"), _found(F.col("whole"), p, g, n).alias("found")) for i, (_, p, g, n) in enumerate(KINDS)))
    return written(d.withColumn("kinds", F.filter(each, lambda x: x["found"].isNotNull())).drop("whole"), "secrets")


def candidates(rows: DataFrame) -> DataFrame:
    """(rid, repo, owner, kind, order, at, until, value): every candidate of scanned() rows."""
    d = rows.filter(F.size("kinds") > 0).select("rid", "repo", "owner", F.inline("kinds"))
    d = d.select("rid", "repo", "owner", "order", F.posexplode("found").alias("i", "x"))
    w = W.partitionBy("rid", "order").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("until", F.sum(F.col("x.gap") + F.col("x.long")).over(w)).withColumn("at", F.col("until") - F.col("x.long"))
    kind = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("order") + 1)
    return d.filter(F.col("x.value").isNotNull()).select("rid", "repo", "owner", kind.alias("kind"), "order", "at", "until", F.col("x.value").alias("value"))


def ownership(found: DataFrame) -> DataFrame:
    """(value, repos, owners): how many distinct repositories and owners hold each value."""
    held = found.groupBy("value", "repo", "owner").agg(F.lit(1).alias("one"))  # a row for a repository, however many copies
    return held.groupBy("value").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))


def judged(found: DataFrame, copied: int, spread: int) -> DataFrame:
    """candidates() with their verdict, "live" or "copied"."""
    wide = cut(ownership(found).filter((F.col("owners") >= copied) | ((F.col("owners") >= 2) & (F.col("repos") >= spread))).select("value", F.lit("copied").alias("verdict")))
    if is_small(wide, F.lit(64)):
        out = found.join(F.broadcast(wide), "value", "left")
    else:
        # a widely copied value's rows meet it in several tasks
        wide = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = found.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(wide, ["value", "salt"], "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("live")))


def _spans(found: DataFrame) -> DataFrame:
    """(rid, spans) of judged candidates: base kinds, and of the others those that are live and overlap no base span."""
    out = found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "order", "until", "kind", "verdict"))).alias("all"))
    out = out.withColumn("base", F.expr(f"filter(all, x -> x.order < {len(BASE_KINDS)})"))
    more = F.expr(f"filter(all, x -> x.order >= {len(BASE_KINDS)} and x.verdict = 'live' and not exists(base, b -> b.at < x.until and x.at < b.until))")
    return out.select("rid", F.array_sort(F.concat("base", more)).alias("spans"))


def scan(docs: DataFrame, *, repo: str | None = "doc_id", owner: str | None = "source", copied: int = COPIED, spread: int = SPREAD) -> DataFrame:
    """One row for each row of docs: rid (a number of the row), doc_id, spans (array of struct(at, order,
    until, kind, verdict), sorted), offsets in code points with exclusive ends.

    verdict is "copied" for a value that `copied` or more owners hold, or two or more owners in
    `spread` or more repositories, else "live": a value that spreads over the repositories of one
    owner is that owner's. Base kinds are always spans; the other kinds only where they are live
    and overlap no base span. repo and owner name columns of docs, or are None; null repositories
    and owners count as none, so a value held only by them is live. Null and empty texts have no
    spans. Repeated rows each give a row; other columns are ignored; an empty table gives none.
    """
    rows = scanned(docs, repo, owner, F.col("doc_id"))
    spans = _spans(judged(candidates(rows), copied, spread))
    some = rows.filter(F.size("kinds") > 0).select("rid", "doc_id").join(spans, "rid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))
    none = rows.filter(F.size("kinds") == 0).select("rid", "doc_id", F.array().cast(spans.schema["spans"].dataType).alias("spans"))
    return some.unionByName(none)


def span_text(spans: str, condition: str = "true") -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform(filter({spans}, x -> {condition}), x -> concat_ws(':', x.kind, x.at, x.until)), ',')")


def redact(docs: DataFrame, mark: str = "[SECRET]", *, repo: str | None = "doc_id", owner: str | None = "source", copied: int = COPIED, spread: int = SPREAD) -> DataFrame:
    """docs with every live span of text replaced by mark; copied examples and all rows and columns stay, whatever their names.

    Overlapping and touching spans become one mark. Null and empty texts stay as they are,
    repeated rows are treated alike, an empty table stays empty; the rest is as in scan().
    """
    rows = scanned(docs, repo, owner, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    live = _spans(judged(candidates(rows), copied, spread)).select("rid", F.inline("spans")).filter("verdict = 'live'").select("rid", "at", "until")
    by = W.partitionBy("rid").orderBy("at", "until")
    before = F.max("until").over(by.rowsBetween(W.unboundedPreceding, -1))
    live = live.withColumn("new", F.when(F.col("at") <= before, 0).otherwise(1))
    live = live.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    live = live.groupBy("rid", "run").agg(F.min("at").cast("int").alias("at"), F.max("until").cast("int").alias("until"))
    live = live.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "until"))).alias("s"))
    start = "if(i = 0, 0, get(s, i - 1).until)"
    mark = mark.replace("\\", "\\\\").replace("'", "\\'")
    parts = F.expr(f"concat(array_join(transform(s, (x, i) -> concat(substring(row.text, {start} + 1, x.at - {start}), '{mark}')), ''), substring(row.text, element_at(s, -1).until + 1))")
    out = lambda d, text: d.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
    some = rows.filter(F.size("kinds") > 0).select("rid", "row").join(live, "rid", "left")
    return out(some, F.when(F.col("s").isNotNull(), parts).otherwise(F.col("row.text"))).unionByName(out(rows.filter(F.size("kinds") == 0), F.col("row.text")))
