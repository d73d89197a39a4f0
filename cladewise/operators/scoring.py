"""Likelihood of trees: variants along root paths, read depth by node, and the splits' normalised likelihoods."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree


def variant_by_node(facts: DataFrame, edges: DataFrame, cell_node: DataFrame, snv_node: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """(node, variant): over all SNVs of the data; an SNV on the node's path or gained there counts as present.

    One pass over the facts, summed up by (node, SNV) where they lie; only these sums meet what is present.
    """
    at = facts.join(cell_node.select("cell_id", "node"), "cell_id")
    sums = at.groupBy("node", "snv_id").agg(F.sum("ll0").alias("ll0"), F.sum("ll1").alias("ll1"))
    here = tree.presence(edges, snv_node, "snv_id", lost).withColumn("here", F.lit(True))
    each = sums.join(here, ["node", "snv_id"], "left")
    return each.groupBy("node").agg(F.sum(F.when(F.col("here"), F.col("ll1")).otherwise(F.col("ll0"))).alias("variant"))


def depth_by_node(embedding: DataFrame, cell_node: DataFrame) -> DataFrame:
    """(node, depth): independent normal densities with the node's own mean and population variance in each dimension.

    A dimension without variance adds nothing. With the moments fitted to the same cells the sum has a closed form:
    -n/2 (ln(2 pi s2) + 1) for each dimension, so one aggregation is enough.
    """
    x = embedding.join(cell_node.select("cell_id", "node"), "cell_id").select("node", F.posexplode("vec").alias("dim", "x"))
    by = x.groupBy("node", "dim").agg(F.count("*").alias("n"), F.var_pop("x").alias("s2"))
    term = F.when(F.col("s2") > 1e-12, -F.col("n") / 2 * (F.ln(2 * pi * F.col("s2")) + 1)).otherwise(0.0)
    return by.groupBy("node").agg(F.sum(term).alias("depth"))


def tree_loglik(facts: DataFrame, edges: DataFrame, cell_node: DataFrame, snv_node: DataFrame, embedding: DataFrame | None = None) -> DataFrame:
    """One row: loglik over nodes with cells, and norm: loglik / (cells in the tree x SNVs in the tree)."""
    by = variant_by_node(facts, edges, cell_node, snv_node)
    score = F.col("variant")
    if embedding is not None:
        by = by.join(depth_by_node(embedding, cell_node), "node", "left")
        score = score + F.coalesce("depth", F.lit(0.0))
    total = by.agg(F.sum(score).alias("loglik"))
    size = cell_node.agg(F.count("*").alias("n")).crossJoin(snv_node.agg(F.count("*").alias("m")))  # one row each
    return total.crossJoin(size).select("loglik", (F.col("loglik") / (F.col("n") * F.col("m"))).alias("norm"))


def trees_loglik(facts: DataFrame, edges: DataFrame, cell_node: DataFrame, snv_node: DataFrame, embedding: DataFrame | None = None) -> DataFrame:
    """(tree_id, loglik, norm) for all candidate trees in one job; every table carries tree_id.

    Cells that all trees treat alike are one class, and so are SNVs. The facts are summed up by pairs of classes once, and
    trees are scored from these sums, so that facts are not multiplied by the number of trees.
    """
    spark = edges.sparkSession
    spark.conf.set(tree.ROWS, "-1")
    edges.createOrReplaceTempView("_forest")
    every = cell_node.select("tree_id", "node").union(snv_node.select("tree_id", "node")).distinct()
    up = spark.sql(
        f"with recursive c(tree_id, anc, node) {tree.DEEP} as (select tree_id, parent, child from _forest union all "
        "select c.tree_id, c.anc, e.child from c join _forest e on e.tree_id = c.tree_id and e.parent = c.node) select * from c"
    ).union(every.select("tree_id", "node", "node"))
    cells, cell_class = _alike(cell_node, "cell_id")
    snvs, snv_class = _alike(snv_node, "snv_id")
    # SNVs that no tree has stay without a class and count as absent.
    sums = facts.join(cells.withColumnRenamed("kind", "ck"), "cell_id").join(snvs.withColumnRenamed("kind", "sk"), "snv_id", "left").groupBy("ck", "sk").agg(F.sum("ll0").alias("ll0"), F.sum("ll1").alias("ll1"))
    here = up.join(snv_class.withColumnRenamed("node", "anc"), ["tree_id", "anc"]).select("tree_id", "node", F.col("kind").alias("sk"), F.lit(True).alias("here")).distinct()
    each = sums.join(cell_class.withColumnRenamed("kind", "ck"), "ck").join(here, ["tree_id", "node", "sk"], "left")
    by = each.groupBy("tree_id", "node").agg(F.sum(F.when(F.col("here"), F.col("ll1")).otherwise(F.col("ll0"))).alias("score"))
    if embedding is not None:
        x = embedding.join(cell_node.select("tree_id", "cell_id", "node"), "cell_id").select("tree_id", "node", F.posexplode("vec").alias("dim", "x"))
        s = x.groupBy("tree_id", "node", "dim").agg(F.count("*").alias("n"), F.var_pop("x").alias("s2"))
        term = F.when(F.col("s2") > 1e-12, -F.col("n") / 2 * (F.ln(2 * pi * F.col("s2")) + 1)).otherwise(0.0)
        depth = s.groupBy("tree_id", "node").agg(F.sum(term).alias("depth"))
        by = by.join(depth, ["tree_id", "node"], "left").select("tree_id", "node", (F.col("score") + F.coalesce("depth", F.lit(0.0))).alias("score"))
    total = by.groupBy("tree_id").agg(F.sum("score").alias("loglik"))
    n = cell_node.groupBy("tree_id").agg(F.count("*").alias("n"))
    m = snv_node.groupBy("tree_id").agg(F.count("*").alias("m"))
    return total.join(n, "tree_id").join(m, "tree_id").select("tree_id", "loglik", (F.col("loglik") / (F.col("n") * F.col("m"))).alias("norm"))


def _alike(owned: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """(id, kind) and (kind, tree_id, node): members that are at the same nodes of all trees have one kind."""
    kinds = owned.groupBy(ident).agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("tree_id", "node")))).alias("kind"))
    return kinds, owned.join(kinds, ident).select("kind", "tree_id", "node").distinct()


def linear_term():
    """ll0 of cells A at SNVs B, ll1 of all cells at SNVs A."""
    return F.when((F.col("cp") == "A") & (F.col("sp") == "B"), F.col("ll0")).when(F.col("sp") == "A", F.col("ll1"))


def branching_term():
    """SNVs C present in all cells, SNVs A and B absent from the other side's cells."""
    other = ((F.col("cp") == "A") & (F.col("sp") == "B")) | ((F.col("cp") == "B") & (F.col("sp") == "A"))
    return F.when(F.col("sp") == "C", F.col("ll1")).when(other, F.col("ll0"))


def norm_of(term):
    """Likelihood over the observations that count."""
    return F.try_divide(F.sum(term), F.count_if(term.isNotNull() & (F.col("total") > 0)).cast("double"))


def linear_norm(parts: DataFrame) -> DataFrame:
    """parts: facts with cp in A, B and sp in A, B."""
    return parts.agg(norm_of(linear_term()).alias("norm"))


def branching_norm(parts: DataFrame) -> DataFrame:
    """sp in A, B, C."""
    return parts.agg(norm_of(branching_term()).alias("norm"))


def variant_norm_by_cell(facts: DataFrame, snv_part: DataFrame) -> DataFrame:
    """(cell_id, norm): a cell's ll1 at SNVs A and ll0 at SNVs B over its observations there."""
    x = facts.join(snv_part.select("snv_id", "sp"), "snv_id").where(F.col("sp").isin("A", "B"))
    term = F.when(F.col("sp") == "A", F.col("ll1")).otherwise(F.col("ll0"))
    return x.groupBy("cell_id").agg(F.try_divide(F.sum(term), F.count_if(F.col("total") > 0).cast("double")).alias("norm"))
