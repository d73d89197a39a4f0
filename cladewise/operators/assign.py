"""Orientation of cell clusters, assignment of SNVs to parts, and acceptance of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from . import bipartition
from .counts import counts_over, fraction_by


def orient_linear(facts: DataFrame, labels: DataFrame, snvs_b: DataFrame) -> DataFrame:
    """(cell_id, cp): A is the cluster with fewer variant SNVs of B per cell; a tie makes the second cluster A.

    labels: cell_id, k in 0, 1. Cells without reads count with 0.
    """
    hits = facts.where("var > 0").join(snvs_b.select("snv_id"), "snv_id", "left_semi").groupBy("cell_id").agg(F.count("*").alias("n"))
    means = labels.join(hits, "cell_id", "left").agg(F.avg(F.when(F.col("k") == 0, F.coalesce("n", F.lit(0)))).alias("m0"), F.avg(F.when(F.col("k") == 1, F.coalesce("n", F.lit(0)))).alias("m1"))
    return labels.crossJoin(F.broadcast(means)).select("cell_id", F.when((F.col("k") == 0) == (F.col("m0") < F.col("m1")), "A").otherwise("B").alias("cp"))


def orient_branching(features: DataFrame, labels: DataFrame) -> DataFrame:
    """features: cell_id, fa, fb (burden over SNVs A and B). Cluster 0 is A iff its mean fa exceeds its mean fb."""
    own = features.join(labels, "cell_id")
    means = own.agg((F.avg(F.when(F.col("k") == 0, F.col("fa"))) > F.avg(F.when(F.col("k") == 0, F.col("fb")))).alias("first"))
    return labels.crossJoin(F.broadcast(means)).select("cell_id", F.when((F.col("k") == 0) == F.coalesce("first", F.lit(False)), "A").otherwise("B").alias("cp"))


def snvs_linear(facts: DataFrame, cells_a: DataFrame, snvs: DataFrame, nobs: int = 3) -> DataFrame:
    """(snv_id, sp): B where absence is at least as likely as presence over the cells A, else A. An SNV without reads is
    B. If the upper quartile of observations per SNV is below nobs, all are A."""
    mine = facts.join(cells_a.select("cell_id"), "cell_id", "left_semi")
    sums = mine.groupBy("snv_id").agg(F.sum("ll0").alias("s0"), F.sum("ll1").alias("s1"), F.count_if(F.col("total") > 0).alias("n"))
    every = snvs.select("snv_id").join(sums, "snv_id", "left").na.fill(0)
    gate = every.agg((F.percentile("n", F.lit(0.75)) >= nobs).alias("enough"))
    return every.crossJoin(F.broadcast(gate)).select("snv_id", F.when(F.col("enough") & (F.round("s0", 9) >= F.round("s1", 9)), "B").otherwise("A").alias("sp"))


def snvs_linear_by_state(facts: DataFrame, cells_a: DataFrame, snvs: DataFrame, by_state: DataFrame, snv_bin: DataFrame, bin_state: DataFrame) -> DataFrame:
    """(snv_id, sp): B where absence is likelier than presence over the cells A, the presence under the state of the SNV's
    bin in these cells. Bins without a state, and SNVs without a bin, are neutral; an SNV without reads is A.

    by_state: cell_id, snv_id, state, ll; bin_state: bin, state.
    """
    states = snvs.select("snv_id").join(snv_bin, "snv_id", "left").join(bin_state, "bin", "left").select("snv_id", F.coalesce("state", F.lit("neutral")).alias("state"))
    inside = cells_a.select("cell_id")
    s0 = facts.join(inside, "cell_id", "left_semi").groupBy("snv_id").agg(F.sum("ll0").alias("s0"))
    s1 = by_state.join(inside, "cell_id", "left_semi").join(states, ["snv_id", "state"]).groupBy("snv_id").agg(F.sum("ll").alias("s1"))
    every = states.select("snv_id").join(s0, "snv_id", "left").join(s1, "snv_id", "left").na.fill(0.0, ["s0", "s1"])
    return every.select("snv_id", F.when(F.round("s0", 9) > F.round("s1", 9), "B").otherwise("A").alias("sp"))


def cluster_snvs(facts: DataFrame, cells_a: DataFrame, snvs: DataFrame) -> DataFrame:
    """(snv_id, sp): SNVs cut in two by their variant fraction over the cells A; the cluster with the smaller mean is A.

    SNVs that no cell A observes are left out. Where there is no cut, all are A.
    """
    mine = facts.join(cells_a.select("cell_id"), "cell_id", "left_semi").join(snvs.select("snv_id"), "snv_id", "left_semi")
    f = keep(fraction_by(mine, "snv_id").where("f is not null"), "fractions")
    graph = f.select(F.col("snv_id").alias("cell_id"), F.array("f").alias("x"), F.lit(None).cast("array<double>").alias("vec"))
    labels = bipartition.cut_by_blocks(graph, False, 1.0, False)
    if labels is None:
        return f.select("snv_id", F.lit("A").alias("sp"))
    own = f.join(labels.select(F.col("cell_id").alias("snv_id"), "k"), "snv_id")
    first = own.agg((F.avg(F.when(F.col("k") == 0, F.col("f"))) <= F.avg(F.when(F.col("k") == 1, F.col("f")))).alias("first"))
    return own.crossJoin(F.broadcast(first)).select("snv_id", F.when((F.col("k") == 0) == F.col("first"), "A").otherwise("B").alias("sp"))  # one row


def snvs_branching(facts: DataFrame, cell_part: DataFrame, snvs: DataFrame, nobs: int = 3) -> DataFrame:
    """(snv_id, sp): the likeliest of A (present in cells A only), B (in B only) and C (in both), ties in this order. If on
    either side the upper quartile of observations per SNV is below nobs, all are C."""
    x = facts.join(cell_part.select("cell_id", "cp"), "cell_id")
    on = lambda c, p: F.sum(F.when(F.col("cp") == p, F.col(c)).otherwise(0.0))
    n = lambda p: F.count_if((F.col("cp") == p) & (F.col("total") > 0))
    sums = x.groupBy("snv_id").agg((on("ll1", "A") + on("ll0", "B")).alias("a"), (on("ll0", "A") + on("ll1", "B")).alias("b"), (on("ll1", "A") + on("ll1", "B")).alias("c"), n("A").alias("na"), n("B").alias("nb"))
    every = snvs.select("snv_id").join(sums, "snv_id", "left").na.fill(0)
    gate = every.agg(((F.percentile("na", F.lit(0.75)) >= nobs) & (F.percentile("nb", F.lit(0.75)) >= nobs)).alias("enough"))
    a, b, c = (F.round(k, 9) for k in "abc")
    best = F.when((a >= b) & (a >= c), "A").when(b >= c, "B").otherwise("C")
    return every.crossJoin(F.broadcast(gate)).select("snv_id", F.when(F.col("enough"), best).otherwise("C").alias("sp"))


def read_checks(facts: DataFrame, cell_part: DataFrame, snv_part: DataFrame, nobs: int = 3) -> DataFrame:
    """(axis, cp, sp, median, ok): for the blocks of parts A and B, the median number of observations per cell and per SNV."""
    x = facts.join(cell_part.select("cell_id", "cp"), "cell_id").join(snv_part.select("snv_id", "sp"), "snv_id")
    x = x.where(F.col("cp").isin("A", "B") & F.col("sp").isin("A", "B"))
    out = None
    for axis, ident, universe, part, other in (("cell", "cell_id", cell_part, "cp", "sp"), ("snv", "snv_id", snv_part, "sp", "cp")):
        n = x.groupBy(ident, other).agg(F.count_if(F.col("total") > 0).alias("n"))
        sides = universe.where(F.col(part).isin("A", "B")).select(ident, part).crossJoin(F.broadcast(cell_part.sparkSession.createDataFrame([("A",), ("B",)], f"{other} string")))
        med = sides.join(n, [ident, other], "left").groupBy("cp", "sp").agg(F.median(F.coalesce("n", F.lit(0))).alias("median"))
        one = med.select(F.lit(axis).alias("axis"), "cp", "sp", "median", (F.col("median") >= nobs).alias("ok"))
        out = one if out is None else out.union(one)
    return out


def accept(facts: DataFrame, cell_part: DataFrame, snv_part: DataFrame, kind: str, low: float = 0.05, high: float = 0.15, nobs: int = 3, compat: bool = True) -> DataFrame:
    """One row: accepted, and the medians it rests on.

    Linear: burden of cells A at SNVs B at most low, burden of all cells at SNVs A at least high. Branching in compat mode
    only looks at the first; else also burden of cells B at SNVs A at most low, of all cells at SNVs C at least high. All
    eight read checks must hold.
    """
    cell = lambda p: cell_part if p is None else cell_part.where(F.col("cp") == p)

    def burden(cp, sp):
        mine = facts.join(cell(cp).select("cell_id"), "cell_id", "left_semi").join(snv_part.where(F.col("sp") == sp).select("snv_id"), "snv_id", "left_semi")
        return fraction_by(mine, "cell_id").agg(F.median("f").alias("m"))

    out = burden("A", "B").withColumnRenamed("m", "low_a")
    good = F.col("low_a") <= low
    if kind == "linear":
        out = out.crossJoin(burden(None, "A").withColumnRenamed("m", "high"))
        good = good & (F.col("high") >= high)
    elif not compat:
        out = out.crossJoin(burden("B", "A").withColumnRenamed("m", "low_b")).crossJoin(burden(None, "C").withColumnRenamed("m", "high"))
        good = good & (F.col("low_b") <= low) & (F.col("high") >= high)
    checks = read_checks(facts, cell_part, snv_part, nobs).agg((F.bool_and("ok") & (F.count("*") == 8)).alias("reads_ok"))
    return out.crossJoin(checks).withColumn("accepted", F.coalesce(good & F.col("reads_ok"), F.lit(False)))


def quality_vote(stats: DataFrame, jump: float, passes: int) -> DataFrame:
    """stats: jump_pct, first_gap, k. Votes for a real split: jump_pct > jump, first_gap <= jump, k > 1."""
    votes = (F.col("jump_pct") > jump).cast("int") + (F.col("first_gap") <= jump).cast("int") + (F.col("k") > 1).cast("int")
    return stats.withColumn("votes", votes).withColumn("ok", votes >= passes)


def observation_median(universe: DataFrame, facts: DataFrame, ident: str) -> DataFrame:
    return counts_over(universe, facts, ident).agg(F.median("n_obs").alias("median"))
