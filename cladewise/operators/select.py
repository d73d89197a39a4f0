"""Choice among trees: first maximum, best by size, elbow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_max(rows: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """The row with the largest value in each group, the earliest of equals; a grouped aggregate, no sort."""
    key = F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o"))
    best = F.max_by(F.struct(*rows.columns), key).alias("best")
    return (rows.groupBy(*by).agg(best) if by else rows.agg(best)).select("best.*")


def best_by_size(scores: DataFrame) -> DataFrame:
    """scores: num_nodes, norm. Least negative log-likelihood by number of nodes."""
    return scores.groupBy("num_nodes").agg(F.min(-F.col("norm")).alias("nll"))


def elbow(best: DataFrame, eps: float = 0.025) -> DataFrame:
    """best: num_nodes, nll. Adds one point past the end at nll (1 - eps), and for each size the relative gain on the size
    before (delta1) less that of the size after (delta2): f. The elbow is the first size with the largest f."""
    last = best.agg(F.max_by("nll", "num_nodes").alias("nll"), (F.max("num_nodes") + 1).alias("num_nodes"))
    every = best.select("num_nodes", "nll").union(last.select("num_nodes", (F.col("nll") * (1 - eps)).alias("nll")))
    w = Window.orderBy("num_nodes")  # a row for each size of tree
    out = every.withColumn("before", F.lag("nll").over(w)).withColumn("after", F.lead("nll").over(w))
    d1 = (F.col("before") - F.col("nll")) / F.col("before")
    d2 = (F.col("nll") - F.col("after")) / F.col("nll")
    return out.where("before is not null and after is not null").select("num_nodes", "nll", d1.alias("delta1"), d2.alias("delta2"), (d1 - d2).alias("f"))
