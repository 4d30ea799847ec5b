"""Connected components of a graph of integer nodes, contracted level by level."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import cut

#: Nodes that hang on one root from which it counts as hot in a small graph; in a larger one it has this share of all nodes or more.
HOT = 2000
#: Edges (16 bytes each) that a task contracts at a time.
CHUNK = 1 << 20


def small_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges (a, b), and the smallest node that each can reach: roots hang on smaller roots until none can."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, parent = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while ((up := parent[parent]) != parent).any():
            parent = up


def contracted(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b), a > b, that connect the same nodes as edges (a, b): each chunk of a partition becomes stars around its smallest nodes.

    That needs no shuffle and holds one chunk at a time. Nulls and loops go.
    """

    def stars(pairs):
        node, least = small_components(*map(np.concatenate, zip(*pairs)))
        some = node != least
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(least[some])], ["a", "b"])

    def run(batches):
        held, n = [], 0
        for t in batches:
            held.append((np.asarray(t.column(0)), np.asarray(t.column(1))))
            n += t.num_rows
            if n >= chunk:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return edges.select("a", "b").filter("a <> b").mapInArrow(run, "a long, b long")


def _through(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, component) of nodes (a, m): the component of m in labels, else m. Roots with very many nodes meet their label by broadcast."""
    total = nodes.count()
    hot = cut(nodes.groupBy("m").agg(F.count("*").alias("n")).filter(F.col("n") > max(HOT, total // HOT)).select("m"))  # at most HOT
    known = labels.select(F.col("node").alias("m"), "component")
    if not hot.isEmpty():
        some = F.broadcast(hot.join(known, "m", "left"))
        nodes, often = nodes.join(F.broadcast(hot), "m", "left_anti"), nodes.join(some, "m").select("a", "m", "component")
    both = nodes.join(known, "m", "left").select("a", "m", "component")
    both = both if hot.isEmpty() else both.unionByName(often)
    return both.select(F.col("a").alias("node"), F.coalesce("component", "m").alias("component"))


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is its smallest reachable node.

    Edges are contracted to stars where they lie. A node hangs on the smallest of its stars' roots, and what ties roots to one
    another is the next level's graph, of at most half as many nodes: levels grow with the logarithm of the nodes, and all of
    them together shuffle a few rows a node, not an edge. Then labels are taken from the last level down. Nulls, loops
    and repeated edges do no harm. Nodes are gathered with map-side combination and have at most one star a chunk, and roots
    of very many nodes are joined by broadcast, so none is a hot key. Graphs of all sizes are done alike; an
    empty one has no components.
    """
    stars, levels = cut(contracted(edges, chunk)), []
    while not stars.isEmpty():
        roots = stars.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(True).alias("root"))
        nodes = stars.select("a", "b", F.lit(False).alias("root")).unionByName(roots).groupBy("a").agg(F.collect_set("b").alias("on"), F.bool_or("root").alias("root"))
        nodes = cut(nodes.filter(F.size("on") > 0).select("a", "on", "root", F.array_min("on").alias("m")))
        levels.append(nodes.select("a", "m"))
        # the roots of a node belong together, and so does it where it is a root itself
        tied = nodes.select(F.explode(F.when(F.col("root"), F.array_append("on", F.col("a"))).otherwise(F.col("on"))).alias("a"), F.col("m").alias("b"))
        stars = cut(contracted(tied, chunk))
    labels = edges.sparkSession.createDataFrame([], "node long, component long")
    for nodes in reversed(levels):
        # a root that was a node as well has the same component twice
        labels = cut(_through(nodes, labels).unionByName(labels).groupBy("node").agg(F.min("component").alias("component")))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
