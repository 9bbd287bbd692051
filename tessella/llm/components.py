"""Connected components of an edge table, by alternating large and small stars.

Each round rewires every node's neighbours to its smallest neighbour, so edges become stars whose
centre is the component's smallest node; the work is joins and grouped minima over the edge table,
a row for each key and task after pre-aggregation, and a busy node's join side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import store

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v), u > v, distinct.  One star step, in the same form."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; component: the smallest node reachable.

    ``edges`` has two integer columns a, b in any order, with repeats and loops allowed; null ends
    are no edge.  Each round's edges are written to the shared folder; the loop ends when a round
    changes nothing, which a count and a sum of hashes of the edges tell."""
    now = store.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = store.written(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
