"""Between lists by node and one row per member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, column: str, ident: str) -> DataFrame:
    """A column map<cluster, array<id>> as rows: id, cluster, subcluster (always 0), by id."""
    each = df.select(F.explode(column).alias("cluster", "ids"))
    return each.select(F.explode("ids").alias(ident), "cluster", F.lit(0).alias("subcluster")).orderBy(ident)


def to_lists(rows: DataFrame, node: str, ident: str) -> DataFrame:
    return rows.groupBy(node).agg(F.sort_array(F.collect_list(ident)).alias("ids"))


def inverted(lists: DataFrame, key: str, values: str) -> DataFrame:
    return lists.select(F.explode(values).alias("k"), F.col(key).alias("v"))


def state_series(by_state: DataFrame) -> DataFrame:
    """(state, bins array) as (bin, state) in bin order."""
    return by_state.select(F.explode("bins").alias("bin"), "state").orderBy("bin")


def state_table(bin_state: DataFrame, nodes: list[int]) -> DataFrame:
    """A row for each bin and a column node_k for each node."""
    wide = bin_state.groupBy("bin").pivot("node", nodes).agg(F.first("state"))
    return wide.select("bin", *[F.col(str(n)).alias(f"node_{n}") for n in nodes])
