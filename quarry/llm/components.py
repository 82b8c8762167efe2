"""Connected components by alternating large-star and small-star steps.

Both steps need only the smallest neighbour of each node, which is a min() that Spark combines
before its shuffle, and a join back on the node; no task ever holds a neighbourhood. Rounds end
when an order-free checksum over the edges stands still. Every round is written to the shared folder, and
the one before is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import remove, written_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. large: every larger neighbour of a node joins the smallest around it.
    small: the node and its smaller neighbours join the smallest of these."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        near = both.filter("v > u")
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges
    out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in an edge; root is the smallest node of its component.

    Nulls and self-loops carry no link and are left out; repeated edges count once; an empty
    table gives an empty result. Any orderable type of node will do.
    """
    u, v = F.col(src), F.col(dst)
    now = edges.filter(u.isNotNull() & v.isNotNull() & (u != v))
    now, path = written_path(now.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    was = _checksum(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        now, after = written_path(_star(_star(now, True), False), "edges")
        check = _checksum(now)
        remove(edges.sparkSession, path)
        path = after
        if check == was:
            break
        was = check
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
