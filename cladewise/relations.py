"""The relations the engine works on, and how the benchmark tables stand in for them.

reads(cell_id, snv_id, var, total): sparse, unique in (cell_id, snv_id); a missing pair has no reads.
bins(cell_id, bin, n), embedding(cell_id, vec), edges(parent, child), cell_node(cell_id, node), snv_node(snv_id, node).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table


def reads(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return line.groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("snv_id")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("var"), F.count("*").alias("total")
    )


def bins(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    return line.groupBy(F.col("l_suppkey").alias("cell_id"), month.alias("bin")).agg(F.count("*").alias("n"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"))


def snvs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("snv_id"))


def cell_node(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).withColumn("node", (F.col("cell_id") % 5).cast("int"))


def snv_node(spark: SparkSession, d: str) -> DataFrame:
    return snvs(spark, d).withColumn("node", (F.col("snv_id") % 5).cast("int"))


def _heap(keys: DataFrame, key: str) -> DataFrame:
    """Edges of the tree in which k hangs under (k - 1) div 2."""
    return keys.where(f"{key} > 0").select(F.expr(f"cast(({key} - 1) div 2 as int)").alias("parent"), F.col(key).cast("int").alias("child"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The clonal tree: a node for each region."""
    return _heap(table(spark, d, "region"), "r_regionkey")


def large_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree that grows with the tables: a node for each cell."""
    return _heap(table(spark, d, "supplier"), "s_suppkey")


def embedding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"))


def loaded(spark: SparkSession, d: str) -> DataFrame:
    """reads with their log-likelihoods."""
    from .functions.likelihood import with_likelihoods

    return with_likelihoods(reads(spark, d))


#: The same relations for DuckDB, by name.
SQL = {
    "reads": "select l_suppkey cell_id, l_partkey snv_id, sum(case when l_returnflag = 'R' then 1 else 0 end)::bigint var, count(*) total from lineitem group by 1, 2",
    "bins": "select l_suppkey cell_id, year(l_shipdate) * 12 + month(l_shipdate) - 1 bin, count(*) n from lineitem group by 1, 2",
    "cells": "select s_suppkey cell_id from supplier",
    "snvs": "select p_partkey snv_id from part",
    "cell_node": "select s_suppkey cell_id, cast(s_suppkey % 5 as int) node from supplier",
    "snv_node": "select p_partkey snv_id, cast(p_partkey % 5 as int) node from part",
    "edges": "select cast((r_regionkey - 1) // 2 as int) parent, cast(r_regionkey as int) child from region where r_regionkey > 0",
    "large": "select cast((s_suppkey - 1) // 2 as int) parent, cast(s_suppkey as int) child from supplier where s_suppkey > 0",
    "embedding": "select vec_id cell_id, embedding::double[] vec from embeddings",
    "lattice": "select v * (1 - 1e-3) + (1 - v) * 1e-3 / 3e0 v, count(*) / 15e0 w from (select i / c::double v from range(1, 6) a(c), range(1, 6) b(i) where i <= c) group by v",
    "lik": """select r.*, lnc + var * ln(1e-3) + (total - var) * ln(1 - 1e-3) ll0,
        (select ln(sum(w * exp(lnc + var * ln(v) + (total - var) * ln(1 - v)))) from lattice) ll1
        from (select *, lgamma(total + 1) - lgamma(var + 1) - lgamma(total - var + 1) lnc from reads) r""",
    "closure": "select parent anc, child node, 1 depth from edges union all select c.anc, e.child, c.depth + 1 from closure c join edges e on e.parent = c.node",
    "nodes": "select parent node from edges union select child from edges",
}
NEEDS = {"lik": ["reads", "lattice"], "closure": ["edges"], "nodes": ["edges"]}


def with_sql(*names: str) -> str:
    """`with recursive ...` that defines the named relations and what they need."""
    order: list[str] = []

    def add(n: str):
        for x in NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in order) + " "
