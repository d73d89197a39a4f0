"""Copy-number states along chromosomes: emissions, transitions, path likelihood as column sums, decoding as scans over blocks of bins."""

from __future__ import annotations

from collections.abc import Callable
from math import log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep

# Fixed value: the states in the order that ties follow.
STATES = ["gain", "loss", "neutral"]


def fit_emissions(values: DataFrame, value: str = "x", mean: float = 1.0, eps: float = 0.15) -> DataFrame:
    """(state, mu, var) for all three states: values under mean - 2 eps are losses, above mean + 2 eps gains, others neutral.
    A state with one value or none gets its default mean and variance 1."""
    low, high = mean - 2 * eps, mean + 2 * eps
    state = F.when(F.col(value) < low, "loss").when(F.col(value) > high, "gain").otherwise("neutral")
    got = values.where(F.col(value).isNotNull()).groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    default = values.sparkSession.createDataFrame([("gain", high + 2 * eps), ("loss", low - 2 * eps), ("neutral", mean)], "state string, mu0 double")
    return default.join(got, "state", "left").select("state", F.when(F.col("n") > 1, F.col("m")).otherwise(F.col("mu0")).alias("mu"), F.when(F.col("n") > 1, F.col("v")).otherwise(1.0).alias("var"))


def log_normal(x: Column, mu, var) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return -0.5 * (F.ln(2 * pi * lit(var)) + (x - lit(mu)) * (x - lit(mu)) / lit(var))


def step(beta: float) -> list[list[float]]:
    """Log transition matrix: stay 1 - beta, move beta / 2."""
    return [[log(1 - beta) if i == j else log(beta / 2) for j in range(3)] for i in range(3)]


def transition_loglik(states: DataFrame, beta: float = 0.1) -> DataFrame:
    """(chrom, loglik) of a state per bin: ln 1/3 to start, then each step."""
    before = F.lag("state").over(Window.partitionBy("chrom").orderBy("bin"))
    cost = F.when(before.isNull(), log(1 / 3)).when(before == F.col("state"), log(1 - beta)).otherwise(log(beta / 2))
    return states.withColumn("cost", cost).groupBy("chrom").agg(F.sum("cost").alias("loglik"))


def path_loglik(rdr: DataFrame, states: DataFrame, emissions: DataFrame, beta: float = 0.1) -> DataFrame:
    """(cell_id, loglik): emissions of a cell's values under the path, plus the path's transitions once per cell."""
    moves = transition_loglik(states, beta).agg(F.sum("loglik").alias("moves"))
    fit = rdr.join(states.select("bin", "state"), "bin").join(F.broadcast(emissions), "state")
    by = fit.groupBy("cell_id").agg(F.sum(log_normal(F.col("value"), F.col("mu"), F.col("var"))).alias("fit"))
    return by.crossJoin(F.broadcast(moves)).select("cell_id", (F.col("fit") + F.col("moves")).alias("loglik"))


def mean_profile(rdr: DataFrame) -> DataFrame:
    return rdr.groupBy("chrom", "bin").agg(F.avg("value").alias("x"))


#: Elements that one fold takes; longer chromosomes are folded block by block, in as many levels as it takes.
SCAN_BLOCK = 256
#: Scores of a decoding are whole multiples of this, so that sums are the same in whatever order blocks are put together.
UNIT = 2.0**-30


def _scan(rows: DataFrame, span: int, start: Column, apply: Callable, merge: Callable) -> DataFrame:
    """(chrom, at, m, v): v is what the elements m at smaller places make of `start`, one after another.

    apply(v, m) is one step, merge(m1, m2) the element that does m1, then m2. at: whole numbers, distinct in a chromosome, at
    most `span` from end to end. A block's rows are one array; blocks meet only through their merged elements.
    """
    blocks = rows.groupBy("chrom", F.floor(F.col("at") / SCAN_BLOCK).alias("blk") if span > SCAN_BLOCK else F.lit(0).cast("long").alias("blk"))
    blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("o"))
    if span > SCAN_BLOCK:
        blocks = keep(blocks, "scan")  # read twice in each level
        whole = F.aggregate(F.slice("o", 2, F.size("o")), F.col("o")[0]["m"], lambda acc, o: merge(acc, o["m"]))
        outer = _scan(blocks.select("chrom", F.col("blk").alias("at"), whole.alias("m")), span // SCAN_BLOCK + 2, start, apply, merge)
        blocks = blocks.join(outer.select("chrom", F.col("at").alias("blk"), "v"), ["chrom", "blk"])
    else:
        blocks = blocks.withColumn("v", start)
    first = F.struct(F.col("v"), F.array(F.col("v")).alias("vs"))

    def one(acc: Column, o: Column) -> Column:
        v = apply(acc["v"], o["m"])
        return F.struct(v.alias("v"), F.concat(acc["vs"], F.array(v)).alias("vs"))

    vs = F.aggregate("o", first, one)["vs"]
    return blocks.select("chrom", F.explode(F.arrays_zip("o", F.slice(vs, 1, F.size("o")).alias("vs"))).alias("r")).select("chrom", "r.o.at", "r.o.m", F.col("r.vs").alias("v"))


def decode(profile: DataFrame, emissions: dict[str, tuple[float, float]], beta: float = 0.1) -> DataFrame:
    """(chrom, bin, state, emission, move): the likeliest states for the values x of each chromosome (a row a bin, whole numbers).

    Two scans that put blocks of bins together in any order: products of max-plus matrices give the scores in front of each
    bin, hence where each state came from; chained from the end, those choices give the states. Ties take the first state on
    the way and the last one at the end. Values that are null or not finite say nothing. move is the log-probability of the
    step into the bin (ln 1/3 for the first). Scores count in UNITs; more than 2^63 of them are an error.
    """
    x = F.when(F.isnan("x") | (F.abs("x") == float("inf")), None).otherwise(F.col("x"))
    e = F.array(*[F.coalesce(log_normal(x, *emissions[s]), F.lit(0.0)) for s in STATES])
    rows = keep(profile.where("bin is not null").select("chrom", F.col("bin").cast("long").alias("at"), e.alias("e")), "profile")
    ends = rows.groupBy("chrom").agg(F.min("at").alias("a"), F.max("at").alias("z"))
    span = (ends.agg(F.max(F.col("z") - F.col("a"))).first()[0] or 0) + 2
    units = lambda v: F.round(v / UNIT).cast("long")
    t = [[round(v / UNIT) for v in r] for r in step(beta)]
    m = F.array(*[units(F.col("e")[j]) + t[i][j] for i in range(3) for j in range(3)])
    # A row past the end takes the final scores; its element changes nothing that is read.
    every = rows.select("chrom", "at", m.alias("m")).unionByName(ends.select("chrom", (F.col("z") + 1).alias("at"), F.array_repeat(F.lit(0).cast("long"), 9).alias("m")))
    forward = _scan(
        every,
        span,
        F.array_repeat(F.lit(0).cast("long"), 3),  # all steps into a state cost alike at best, so the first bin needs no rule
        lambda v, o: F.array(*[F.greatest(*[v[i] + o[3 * i + j] for i in range(3)]) for j in range(3)]),
        lambda a, b: F.array(*[F.greatest(*[a[3 * i + k] + b[3 * k + j] for k in range(3)]) for i in range(3) for j in range(3)]),
    )
    v = F.col("v")

    def came(j: int) -> Column:
        a, b, c = (v[i] + t[i][j] for i in range(3))
        return F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)

    last = F.when((v[2] >= v[1]) & (v[2] >= v[0]), 2).when(v[1] >= v[0], 1).otherwise(0)
    scored = forward.join(ends.select("chrom", (F.col("z") + 1).alias("past"), "a"), "chrom")
    choice = F.when(F.col("at") == F.col("past"), F.array_repeat(last, 3)).otherwise(F.array(*[came(j) for j in range(3)]))
    back = keep(scored.select("chrom", (-F.col("at")).alias("at"), choice.alias("m")), "choices")
    states = _scan(back, span, F.lit(0), lambda s, c: c[s], lambda a, b: F.transform(a, lambda s: b[s]))
    names = F.array(*[F.lit(s) for s in STATES])
    found = states.select("chrom", (-F.col("at")).alias("at"), F.col("v").alias("s"), F.col("m")[F.col("v")].alias("p"))
    found = found.join(rows, ["chrom", "at"]).join(ends.select("chrom", "a"), "chrom")
    move = F.when(F.col("at") == F.col("a"), log(1 / 3)).when(F.col("p") == F.col("s"), log(1 - beta)).otherwise(log(beta / 2))
    return found.select("chrom", F.col("at").alias("bin"), names[F.col("s")].alias("state"), F.col("e")[F.col("s")].alias("emission"), move.alias("move"))


def decoded_score(decoded: DataFrame) -> DataFrame:
    """(chrom, loglik) of decoded states."""
    return decoded.groupBy("chrom").agg(F.sum(F.col("emission") + F.col("move")).alias("loglik"))


def viterbi(profile: DataFrame, emissions: dict[str, tuple[float, float]], beta: float = 0.1) -> DataFrame:
    """(chrom, loglik, path array<struct<bin, state>>): decode() with a chromosome's bins in one row."""
    path = F.sort_array(F.collect_list(F.struct("bin", "state"))).alias("path")
    return decode(profile, emissions, beta).groupBy("chrom").agg(F.sum(F.col("emission") + F.col("move")).alias("loglik"), path)


def bins_by_state(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.sort_array(F.collect_list("bin")).alias("bins"))


def genotype(bin_state: DataFrame, universe: DataFrame) -> DataFrame:
    """(bin, state): neutral where a node names no state."""
    return universe.select("bin").join(bin_state.select("bin", "state"), "bin", "left").select("bin", F.coalesce("state", F.lit("neutral")).alias("state"))


def edge_events(edges: DataFrame, bin_state: DataFrame) -> DataFrame:
    """(parent, child, bin, before, after) where a child's state differs from its parent's; unnamed bins are neutral."""
    s = bin_state.select("node", "bin", "state")
    up = edges.join(s.withColumnRenamed("node", "parent"), "parent").withColumnRenamed("state", "before")
    down = edges.join(s.withColumnRenamed("node", "child"), "child").withColumnRenamed("state", "after")
    both = up.join(down, ["parent", "child", "bin"], "full").na.fill("neutral", ["before", "after"])
    return both.where("before <> after").select("parent", "child", "bin", "before", "after")


def ancestral_states(closure: DataFrame, bin_state: DataFrame, state: str) -> DataFrame:
    return closure.join(bin_state.where(F.col("state") == state).withColumnRenamed("node", "anc"), "anc").select("node", "anc", "bin")


def presence_by_state(facts: DataFrame, cell_node: DataFrame, bin_state: DataFrame, snv_bin: DataFrame, by_state: DataFrame, present: DataFrame) -> DataFrame:
    """(node, variant) where a present SNV's likelihood depends on its bin's state at the node.

    by_state: cell_id, snv_id, state, ll; absent SNVs count ll0; bins without a state are neutral.
    """
    at = facts.join(cell_node.select("cell_id", "node"), "cell_id").join(snv_bin, "snv_id", "left")
    at = at.join(bin_state, ["node", "bin"], "left").withColumn("state", F.coalesce("state", F.lit("neutral")))
    here = present.select("node", "snv_id", F.lit(True).alias("here"))
    at = at.join(here, ["node", "snv_id"], "left").join(by_state, ["cell_id", "snv_id", "state"], "left")
    return at.groupBy("node").agg(F.sum(F.when(F.col("here"), F.coalesce("ll", F.lit(0.0))).otherwise(F.col("ll0"))).alias("variant"))


def arms(runs: DataFrame, arm_table: DataFrame, slack: int = 1) -> DataFrame:
    """Runs of bins that are a whole arm: the same start, ends at most `slack` apart."""
    return runs.join(F.broadcast(arm_table), (F.col("l") == F.col("start")) & (F.abs(F.col("r") - F.col("end")) <= slack))


