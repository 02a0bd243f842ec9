"""Connected components by alternating large-star and small-star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v BIGINT); root is the smallest node that can be reached.

    Self loops, repeated and reversed edges are allowed; edges with a null end are ignored. Nothing but counts reaches
    the driver, each round is written to the shared folder, and a hub is summed by partial aggregation and joined as
    two plain scans, which adaptive execution can split.
    """
    now = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if seen == state or not seen["n"]:
            break
        state = seen
        large = _star(now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "w > u")
        now, old = _star(large, None), now
        discard(old, large)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _star(edges: DataFrame, keep: str | None) -> DataFrame:
    """Links the neighbours w of each u to the smallest of u and its neighbours: those that `keep` admits, or all and u."""
    least = cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    linked = edges.withColumnRenamed("v", "w").join(least, "u")
    pairs = linked.where(keep).select("w", "m") if keep else linked.select("w", "m").union(least.select("u", "m"))
    out = cut(pairs.where("w <> m").select(F.greatest("w", "m").alias("u"), F.least("w", "m").alias("v")).distinct())
    discard(least)
    return out
