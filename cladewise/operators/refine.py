"""Refinement of a tree: unplaced and doubtful cells and SNVs go where they are likeliest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree
from .counts import fraction_by


def unplaced(universe: DataFrame, owned: DataFrame, ident: str) -> DataFrame:
    return universe.select(ident).join(owned.select(ident), ident, "left_anti")


def sums_by_node(facts: DataFrame, cell_node: DataFrame) -> DataFrame:
    """(snv_id, node of the cells, ll0, more, n, v): facts summed up over the cells of each node. All that is asked of the
    SNVs of a tree whose cells stay follows from this."""
    at = facts.join(cell_node.select("cell_id", "node"), "cell_id")
    more = F.sum(F.col("ll1") - F.col("ll0")) if "ll1" in facts.columns else F.lit(None).cast("double")
    ll0 = F.sum("ll0") if "ll0" in facts.columns else F.lit(None).cast("double")
    return at.groupBy("snv_id", "node").agg(ll0.alias("ll0"), more.alias("more"), F.count_if(F.col("total") > 0).alias("n"), F.count_if(F.col("var") > 0).alias("v"))


def bad_snvs(facts: DataFrame, edges: DataFrame, cell_node: DataFrame, snv_node: DataFrame, q: float = 0.1) -> DataFrame:
    """(node, snv_id): of a node's SNVs, those unobserved in its clade and those whose binary fraction there is at most the
    q quantile."""
    return _bad_snvs(sums_by_node(facts, cell_node), edges, snv_node, q)


def _bad_snvs(sums: DataFrame, edges: DataFrame, snv_node: DataFrame, q: float) -> DataFrame:
    down = tree.closure(edges, itself=True).select(F.col("anc").alias("clade"), "node")
    own = sums.select("snv_id", "node", "n", "v").join(snv_node.select("snv_id", F.col("node").alias("clade")), "snv_id").join(down, ["clade", "node"])
    f = own.groupBy(F.col("clade").alias("node"), "snv_id").agg(F.try_divide(F.sum("v").cast("double"), F.sum("n").cast("double")).alias("f"))
    f = snv_node.select("node", "snv_id").join(f, ["node", "snv_id"], "left")
    cut = f.groupBy("node").agg(F.percentile("f", F.lit(q)).alias("cut"))
    return f.join(cut, "node").where("f is null or f <= cut").select("node", "snv_id")


def bad_cells(facts: DataFrame, edges: DataFrame, cell_node: DataFrame, snv_node: DataFrame, q: float = 0.1) -> DataFrame:
    """(node, cell_id): of a node's cells, those unobserved at its SNVs and those whose burden is at most the q quantile."""
    mine = facts.join(cell_node, "cell_id").join(snv_node, ["node", "snv_id"])
    f = cell_node.join(fraction_by(mine, "cell_id"), "cell_id", "left")
    cut = f.groupBy("node").agg(F.percentile("f", F.lit(q)).alias("cut"))
    return f.join(cut, "node").where("f is null or f <= cut").select("node", "cell_id")


def cell_scores(facts: DataFrame, edges: DataFrame, snv_node: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, node, score) at nodes with at most one child: ll1 of SNVs present there and ll0 of the others."""
    busy = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n")).where("n > 1")
    open_ = tree.nodes(edges).join(busy, "node", "left_anti")
    mine = facts.join(cells.select("cell_id"), "cell_id", "left_semi")
    sums = mine.join(snv_node.select("snv_id", "node"), "snv_id", "left").groupBy("cell_id", "node").agg(F.sum("ll0").alias("ll0"), F.sum(F.col("ll1") - F.col("ll0")).alias("more"))
    base = cells.select("cell_id").join(sums.groupBy("cell_id").agg(F.sum("ll0").alias("base")), "cell_id", "left").na.fill(0.0)
    down = tree.closure(edges, itself=True).join(open_, "node", "left_semi")
    more = sums.join(down.select(F.col("anc"), F.col("node").alias("at")), F.col("node") == F.col("anc")).groupBy("cell_id", F.col("at").alias("node")).agg(F.sum("more").alias("more"))
    every = base.crossJoin(F.broadcast(open_))  # cells x nodes of the tree
    return every.join(more, ["cell_id", "node"], "left").select("cell_id", "node", (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("score"))


def snv_scores(facts: DataFrame, edges: DataFrame, cell_node: DataFrame, snvs: DataFrame) -> DataFrame:
    """(snv_id, node, score) at all nodes: ll1 over the node's clade and ll0 over the other cells of the tree."""
    return _snv_scores(sums_by_node(facts, cell_node), edges, snvs)


def _snv_scores(sums: DataFrame, edges: DataFrame, snvs: DataFrame) -> DataFrame:
    mine = sums.join(snvs.select("snv_id"), "snv_id", "left_semi")
    base = snvs.select("snv_id").join(mine.groupBy("snv_id").agg(F.sum("ll0").alias("base")), "snv_id", "left").na.fill(0.0)
    down = tree.closure(edges, itself=True)
    more = mine.join(down, "node").groupBy("snv_id", F.col("anc").alias("node")).agg(F.sum("more").alias("more"))
    every = base.crossJoin(F.broadcast(tree.nodes(edges)))  # SNVs x nodes of the tree
    return every.join(more, ["snv_id", "node"], "left").select("snv_id", "node", (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("score"))


def best_nodes(scores: DataFrame, ident: str, current: DataFrame | None = None) -> DataFrame:
    """(id, node): the smallest node with the best score (to 9 decimals), or the current one unless another is better."""
    scores = scores.withColumn("s", F.round("score", 9))
    stay = F.lit(0)
    if current is not None:
        scores = scores.join(current.select(ident, F.col("node").alias("_now")), ident, "left")
        stay = F.coalesce((F.col("node") == F.col("_now")).cast("int"), F.lit(0))
    best = F.max_by("node", F.struct("s", stay.alias("k"), (-F.col("node")).alias("n")))
    return scores.groupBy(ident).agg(best.alias("node"))


def _gains(scores: DataFrame, current: DataFrame) -> bool:
    """Whether an SNV has a better node (to 9 decimals) than it has now, or than none."""
    now = scores.join(current.select("snv_id", F.col("node").alias("_now")), "snv_id", "left").withColumn("s", F.round("score", 9))
    by = now.groupBy("snv_id").agg((F.max("s") > F.max(F.when(F.col("node") == F.col("_now"), F.col("s")))).alias("more"))
    return bool(by.agg(F.bool_or("more")).first()[0])


def post_process(facts: DataFrame, edges: DataFrame, cell_node: DataFrame, snv_node: DataFrame, q: float = 0.1, iterations: int = 1, store=None) -> tuple[DataFrame, DataFrame]:
    """Place what is missing, cells and then SNVs, and reassign the bad SNVs of the nodes, children first.

    In each iteration the nodes but the root are taken in postorder; all bad SNVs of a node move at once, which is what
    moving them one by one gives, since the clades are fixed. An iteration ends at the first node that leaves the likelihood
    as it was: at the first one, as it was before anything was placed. Whether it changed is told by the SNVs that moved and
    their scores, not by comparing sums over all facts. Facts are read twice, to place cells and to sum up by the nodes of
    cells; the rest works on the sums. `store` writes a table and reads it back.
    """
    from ..storage import keep

    store = store or keep
    cells, snvs = facts.select("cell_id").distinct(), facts.select("snv_id").distinct()
    lost = store(unplaced(cells, cell_node, "cell_id"))
    cell_node = store(cell_node.select("cell_id", "node").union(best_nodes(cell_scores(facts, edges, snv_node, lost), "cell_id").select("cell_id", "node")))
    sums = store(sums_by_node(facts, cell_node))
    new_cells = not lost.isEmpty()
    lost = store(unplaced(snvs, snv_node, "snv_id"))
    scores = store(_snv_scores(sums, edges, lost))
    absent = sums.join(lost, "snv_id", "left_semi").groupBy("snv_id").agg(F.round(F.sum("ll0"), 9).alias("absent"))
    better = scores.groupBy("snv_id").agg(F.max(F.round("score", 9)).alias("s")).join(absent, "snv_id").where("s <> absent")
    changed = new_cells or not better.isEmpty()
    snv_node = store(snv_node.select("snv_id", "node").union(best_nodes(scores, "snv_id").select("snv_id", "node")))
    edges = store(edges)
    top = tree.roots(edges)
    order = [r["node"] for r in tree.postorder(edges).join(top, "node", "left_anti").orderBy("place").collect()]  # nodes of a tree
    for _ in range(iterations):
        for node in order:
            bad = store(_bad_snvs(sums, edges, snv_node.where(F.col("node") == node), q))
            scores = store(_snv_scores(sums, edges, bad))
            if not _gains(scores, snv_node.where(F.col("node") == node)) and not changed:
                break
            changed = False
            kept = snv_node.join(bad.select("snv_id"), "snv_id", "left_anti")
            snv_node = store(kept.select("snv_id", "node").union(best_nodes(scores, "snv_id").select("snv_id", "node")))
    return cell_node, snv_node
