"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the smallest node that links reach.

    Alternates the large-star and small-star steps: every node's larger (then smaller) neighbours are hooked onto its
    smallest one. Each step is a grouped minimum and an equi-join. The minima are written before they are joined, so that a
    node with very many links is combined on the map side and its join can be split. Rounds grow with the logarithm of the
    longest path. Empty input gives no rows.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hooked = large.join(least, "u")
        small = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hooked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(small, "edges")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, after)]
        discard(now, low, large, least)
        now = after
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    least = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = stored(least.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).distinct(), "roots")
    discard(now)
    return roots
