"""Connected components of a graph of edges, by alternating large-star and small-star steps.

Both steps replace the edges of a vertex by edges to its smallest neighbour (Kiveris et al., 2014). Minima
are gathered with map-side partial aggregation and joined back, so a vertex with a third of all edges
splits like any skewed join key, and no vertex's neighbours meet in one task. Each round is written to the
shared folder: lineage stays short, and lost executors cost a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _stars(directed: DataFrame) -> DataFrame:
    """(node, least) for the edges u → v: the smallest of u and its neighbours."""
    return directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _stars(both).withColumnRenamed("u", "_u")
    return both.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _stars(down).withColumnRenamed("u", "_u")
    joined = down.join(least, F.col("u") == F.col("_u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of ``edges`` (u, v of one orderable type): root is the smallest vertex
    of its component. Loops and repeated edges don't matter; null ends are left out. It runs until a round
    changes nothing, and each round but the last brings vertices nearer to their root, so it ends; a round's
    table goes when the next one is written."""
    now = written(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        last, now = now, written(_small(_large(now)), "edges")
        dropped(last)
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == before:
            pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return pairs.union(pairs.select(F.col("root").alias("node"), "root")).distinct()
        before = print_of
