"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padron.session import saved


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    ).first()
    return row["n"], row["x"] or 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours with the smallest of all.

    The smallest neighbour is an aggregate with a row per node and task; the join back may be
    skewed at a node with very many links, which adaptive execution splits.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.where("v < u")
        smallest = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(smallest.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every linked node; component is the smallest node reachable.

    Rounds go on until the links no longer change (their number grows with the logarithm of the
    longest chain). Each round is a written table, so a lost executor costs one round at most.
    """
    u, v = F.col(left), F.col(right)
    edges = saved(
        links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .where("u <> v")
        .distinct(),
        "links",
    )
    state = _checksum(edges)
    while state[0]:
        edges = saved(_star(_star(edges, large=True), large=False), "stars")
        before, state = state, _checksum(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
