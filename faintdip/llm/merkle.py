"""Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree of the groups' roots, and proofs.

Trees are built and looked up in tiers of TIER levels. Within a tier, leaves explode the coordinates of the siblings
that they need, which follow from index and group size, and join the written table of nodes; a proof goes on
with that of the block's root one tier up. So no node is asked for by more than 2 ** TIER rows, and no task holds
more than the nodes of one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .state import broadcast_if_small, written

#: Levels of a tier; a block has 2 ** TIER items.
TIER = 8
BLOCK = 1 << TIER
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<left boolean, digest string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row's fields: - for null, else UTF-8 byte count, colon and value."""
    as_text = [fields[name].cast("string") for name in FIELDS]
    return digest(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in as_text))


def fold(start: Column, siblings: Column) -> Column:
    """The root that start and its siblings, from the lowest level up, amount to."""
    side = lambda s, left: F.when(s["left"] == left, s["digest"]).otherwise("")
    return F.aggregate(siblings, start, lambda h, s: digest(side(s, True), h, side(s, False)))


def proof_text(siblings: Column) -> Column:
    """The siblings' digests put together, level by level; runs of one have none."""
    return F.array_join(F.transform(siblings, lambda s: s["digest"]), "")


def _levels(n: Column) -> Column:
    """Levels between n items and their root, within one tier."""
    return F.when(n <= 1, 0).otherwise(F.least(F.length(F.bin(n - 1)), F.lit(TIER))).cast("int")


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, the number of earlier rows of the group in this order, and n, the size of the group.

    rows has copies, how many equal rows each stands for. Rows are dealt out by ranges and numbered within each,
    behind those of earlier ranges, so no task sees a whole group. Written to the shared folder.
    """
    placed = written(rows.repartitionByRange(group, *order).withColumn("__range", F.spark_partition_id()), "merkle-placed")
    counts = placed.groupBy(group, "__range").agg(F.sum("copies").alias("__here"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("__here").over(whole.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select(group, "__range", before.alias("__before"), F.sum("__here").over(whole).alias("n")), "merkle-ranges")
    here = W.partitionBy(group, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.col("__before") + F.sum("copies").over(here) - F.col("copies")
    out = placed.join(broadcast_if_small(counts, F.octet_length(group) + 32), [group, "__range"]).withColumn("__first", first)
    # equal rows take the places from __first on, block by block
    last = F.col("__first") + F.col("copies") - 1
    out = out.withColumn("__block", F.explode(F.sequence(F.shiftright("__first", TIER), F.shiftright(last, TIER))))
    start, end = F.greatest("__first", F.col("__block") * BLOCK), F.least(last, F.col("__block") * BLOCK + BLOCK - 1)
    out = out.repartition(group, "__block").withColumn("idx", F.explode(F.sequence(start, end)))
    return written(out.drop("copies", "__range", "__before", "__here", "__first", "__block"), "merkle-items")


def _nodes(items: DataFrame) -> DataFrame:
    """(g, block, n, level, at, digest) of all nodes of a tier, its items (g, idx, n, digest) at level 0, written to the shared folder."""
    blocks = items.groupBy("g", F.shiftright("idx", TIER).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("items"))
    hexes = F.transform("items", lambda x: F.lower(F.hex(x["digest"])))

    def up(levels, _):
        below = F.element_at(levels, -1)
        above = F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int")), lambda i: digest(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit(""))))
        return F.concat(levels, F.array(above))

    tree = F.when(F.col("n") > 1, F.aggregate(F.sequence(F.lit(1), _levels(F.col("n"))), F.array(hexes), up)).otherwise(F.array(hexes))
    level = blocks.select("g", "block", "n", F.posexplode(tree).alias("level", "row"))
    node = level.select("g", "block", "n", "level", F.posexplode("row").alias("place", "digest"))
    at = F.expr(f"shiftright(shiftleft(block, {TIER}), level) + place").alias("at")
    return written(node.select("g", "block", "n", "level", at, F.unhex("digest").alias("digest")), "merkle-nodes")


def _tiers(items: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The tiers of all groups' trees, as (items, nodes), and (g, tier, digest) of their roots; tier is how many tiers a group has."""
    biggest = items.agg(F.max("n")).first()[0] or 0
    tiers, roots = [], items.filter("n = 1").select("g", F.lit(0).alias("tier"), "digest")
    while biggest > 1:
        items = items.filter("n > 1").select("g", "idx", "n", "digest")
        nodes = _nodes(items)
        tiers.append((items, nodes))
        above = nodes.filter(F.col("level") == _levels(F.col("n")))
        items = above.select("g", F.col("block").alias("idx"), F.shiftright(F.col("n") + (BLOCK - 1), TIER).alias("n"), "digest")
        roots = roots.unionByName(items.filter("n = 1").select("g", F.lit(len(tiers)).alias("tier"), "digest"))
        biggest = (biggest + BLOCK - 1) // BLOCK
    return tiers, written(roots, "merkle-roots")


def _siblings(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, idx, own) of a tier's items: their siblings within the tier, level by level, with an empty digest where a run has one node."""
    asked = items.select("g", "idx", F.explode(F.sequence(F.lit(0), _levels(F.col("n")) - 1)).alias("level"))
    asked = asked.select("g", "idx", "level", F.expr("shiftright(idx, level) ^ 1").alias("at"), F.expr("shiftright(idx, level) & 1 = 1").alias("left"))
    found = asked.join(nodes.select("g", "level", "at", "digest"), ["g", "level", "at"], "left")
    rows = F.sort_array(F.collect_list(F.struct("level", "left", "digest")))
    hexed = F.transform(rows, lambda s: F.struct(s["left"].alias("left"), F.coalesce(F.lower(F.hex(s["digest"])), F.lit("")).alias("digest")))
    return found.groupBy("g", "idx").agg(hexed.alias("own"))


def _proofs(tiers: list[tuple[DataFrame, DataFrame]], roots: DataFrame) -> DataFrame:
    """(g, idx, siblings, subroot, root) of the lowest tier's items; roots has g, tier and what lies above each group's root."""
    above = ["siblings", "subroot", "root"]
    at = lambda tier: roots.filter(F.col("tier") == tier).select("g", F.lit(0).cast("long").alias("idx"), *above)
    out = at(len(tiers))
    for tier in reversed(range(len(tiers))):
        own = _siblings(*tiers[tier]).withColumn("block", F.shiftright("idx", TIER))
        both = own.join(out.withColumnRenamed("idx", "block"), ["g", "block"])
        both = both.select("g", "idx", F.concat("own", "siblings").alias("siblings"), "subroot", "root")
        out = both.unionByName(at(tier))
    return out


def manifest(docs: DataFrame, claims: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang, idx, leaf, claimed, subroot, root, siblings), one row for each row of docs.

    docs has the columns of FIELDS; others, whatever their names, are left out. A leaf is the digest of a row's
    fields, and claimed the same with some of them replaced by claims. Rows of one lang, null being one, ascend by
    doc_id (null first, equal ones by leaf, then claimed), each at its idx; every two consecutive nodes become the
    digest of both, a last lone one of itself, until one is left: subroot. Subroots ascend by lang (null first, bytewise)
    and make root likewise. siblings, from the leaf through subroot to root, tells for each level whether the sibling
    is left, and its digest, empty where there is none. Empty texts are fields of no bytes; repeated rows have leaves
    of their own, next to each other. An empty table gives no rows.
    """
    own = {name: F.col(name) for name in FIELDS}
    claimed = own | (claims or {})
    same = F.lit(True)
    for name in claims or {}:
        same = same & claimed[name].eqNullSafe(own[name])
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = docs.select(group.alias("g"), "doc_id", F.unhex(leaf(own)).alias("digest"), F.when(~same, F.unhex(leaf(claimed))).alias("claimed"))
    leaves = leaves.groupBy("g", "doc_id", "digest", "claimed").agg(F.count("*").alias("copies"))
    items = _numbered(leaves, "g", ["doc_id", "digest", "claimed"])
    tiers, roots = _tiers(items)
    subroots = _numbered(roots.select(F.lit("").alias("top"), "g", "digest", "tier", F.lit(1).cast("long").alias("copies")), "top", ["g"])
    one = subroots.select(F.col("top").alias("g"), "idx", "n", "digest")
    top_tiers, top_root = _tiers(one)
    nothing = F.array().cast(SIBLINGS).alias("siblings")
    top = _proofs(top_tiers, top_root.select("g", "tier", nothing, F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root")))
    named = subroots.select("idx", F.col("g").alias("lang_key"), "tier", F.lower(F.hex("digest")).alias("own_root"))
    above = top.join(named, "idx").select(F.col("lang_key").alias("g"), "tier", "siblings", F.col("own_root").alias("subroot"), "root")
    proofs = _proofs(tiers, written(above, "merkle-above"))
    out = items.join(proofs, ["g", "idx"])
    hexed = lambda c: F.lower(F.hex(c))
    lang = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("lang")
    return out.select("doc_id", lang, "idx", hexed("digest").alias("leaf"), hexed(F.coalesce("claimed", "digest")).alias("claimed"), "subroot", "root", "siblings")
