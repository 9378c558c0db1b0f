"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from doclake.llm.common import staged

ROUNDS = 60


def _edges(df: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    larger, smaller = F.greatest("node", "near").alias("node"), F.least("node", "near").alias("near")
    return df.where("node <> near").select(larger, smaller).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) of every node of ``edges(node, near)``.

    Every round hangs nodes on the smallest neighbour seen from either side, until the edges stay as they
    are: then they are stars. Minima are combined before the shuffle, and the joins that follow have a
    unique side, so a star's centre with many edges is split like any skewed join. Edges between a node
    and itself are ignored; nulls are not allowed.
    """
    current = staged(_edges(edges), "edges")
    seen = _checksum(current)
    for _ in range(ROUNDS):
        both = current.unionByName(current.select(F.col("near").alias("node"), F.col("node").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("_low"))
        least = least.select("node", F.least("node", "_low").alias("_low"))
        large = _edges(
            both.where("near > node").join(least, "node").select(F.col("near").alias("node"), F.col("_low").alias("near"))
        )
        least = large.groupBy("node").agg(F.min("near").alias("_low"))
        hung = large.join(least, "node")
        small = hung.select(F.col("near").alias("node"), F.col("_low").alias("near"))
        current = staged(_edges(small.unionByName(least.select("node", F.col("_low").alias("near")))), "edges")
        before, seen = seen, _checksum(current)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    centres = current.select(F.col("near").alias("node"), F.col("near").alias("label")).distinct()
    return current.select("node", F.col("near").alias("label")).unionByName(centres)


def _checksum(edges: DataFrame) -> tuple:
    mark = F.xxhash64("node", "near")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mark), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF)))).first())
