"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import materialise


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` with the smallest node reachable, for every node of ``edges``.

    Large-star links every larger neighbour of a node to the smallest node of its neighbourhood;
    small-star does so for the smaller neighbours.  Both keep connectivity and shrink the graph to
    stars in a logarithmic number of rounds.  The minimum of a neighbourhood is a partially
    aggregated ``groupBy``, joined back to the edges, so a node with very many neighbours is
    combined before the shuffle and its join partition can be split.  Self loops and rows with a
    null end are ignored; repeated edges count once; an empty table gives an empty result.
    """
    u, v = F.col("u"), F.col("v")
    now = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    now = materialise(now)
    before = None
    for _ in range(max_rounds):
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before or state[0] == 0:
            break
        before = state
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.join(least, "u").where((v > u) & (v != F.col("m"))).select(v.alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        now = materialise(moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(u.alias("node"), v.alias("component")).unionByName(
        now.select(v.alias("node"), v.alias("component")).distinct()
    )
