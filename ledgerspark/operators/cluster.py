"""Connected components by alternating large-star and small-star steps
(Kiveris et al., SoCC 2014), as joins and aggregations.

Each step is one grouped minimum and one join. The edge table is written to a
shared folder after each round, so plans stay short and a lost executor costs a
re-read. Labels are the smallest member, so they are deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.shared import dropped, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest node beside it.

    The large step moves the neighbours above a node, the small step those below
    it and the node itself."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    # Edges are kept as (u, v) with u > v.
    near = edges.union(turned) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    moved = moved.where("u > v")
    # An edge becomes one by the large step; what is twice goes with the small step, which follows.
    return moved if large else moved.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component for every node of an edge; component is its smallest node.

    Null ends and loops make no edge. No edges give no rows."""
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")
    # Sums of a hash of all edges tell whether a round changed the table.
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        before, now = now, stored(_star(_star(now, True), False), "components")
        dropped(before)
        new = mark(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
