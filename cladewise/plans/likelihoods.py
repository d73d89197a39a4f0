"""Reads, keys, counts and likelihoods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import relations as R
from ..functions import likelihood as L
from ..functions import uniform as U
from ..operators import counts as C
from ..operators import features as X
from ..session import table
from .registry import query

W = R.with_sql


@query("p1_composite_key", W("reads") + "select cell_id, snv_id, concat_ws('_', 'chr' || cast(snv_id % 22 + 1 as varchar), cast(snv_id as varchar)) chr_mutation from reads")
def p1(s, d):
    r = R.reads(s, d).select("cell_id", "snv_id", F.concat(F.lit("chr"), (F.col("snv_id") % 22 + 1).cast("string")).alias("chr"), F.col("snv_id").alias("mutation_id"))
    return C.composite_key(r).select("cell_id", "snv_id", "chr_mutation")


@query("p2_dense_ids", W("reads") + "select snv_id, row_number() over (order by snv_id) - 1 snv_idx from (select distinct snv_id from reads)")
def p2(s, d):
    return C.dense_ids(R.reads(s, d), "snv_id", "snv_idx", 16).select("snv_id", F.col("snv_idx").cast("long").alias("snv_idx"))


@query(
    "p3_pivot_counts",
    W("reads") + ", u as (select distinct cell_id from reads), m as (select distinct snv_id from reads) "
    "select m.snv_id, array_to_string(list(cast(coalesce(total, 0) as bigint) order by u.cell_id), ',') totals from m cross join u left join reads r on r.snv_id = m.snv_id and r.cell_id = u.cell_id group by 1",
)
def p3(s, d):
    """One wide row for each SNV: its totals in all cells, in order of cells."""
    return C.pivot_text(R.reads(s, d), "snv_id", "cell_id", "total").withColumnRenamed("text", "totals")


@query("p4_normalised_bins", W("bins") + "select cell_id, bin, round(n / sum(n) over (partition by cell_id), 9) share from bins")
def p4(s, d):
    return C.normalised_bins(R.bins(s, d)).select("cell_id", "bin", F.round("share", 9).alias("share"))


@query(
    "p5_bin_vectors",
    W("bins") + ", u as (select distinct bin from bins), c as (select distinct cell_id from bins) "
    "select c.cell_id, array_to_string(list(cast(coalesce(n, 0) as bigint) order by u.bin), ',') vec from c cross join u left join bins b on b.cell_id = c.cell_id and b.bin = u.bin group by 1",
)
def p5(s, d):
    return C.bin_vectors(R.bins(s, d)).select("cell_id", F.array_join(F.transform("vec", lambda x: x.cast("long").cast("string")), ",").alias("vec"))


@query("p6_block", W("reads") + "select * from reads where cell_id % 5 = 1 and snv_id % 5 = 2")
def p6(s, d):
    cells, snvs = R.cell_node(s, d).where("node = 1"), R.snv_node(s, d).where("node = 2")
    return C.block(R.reads(s, d), cells, snvs).select("cell_id", "snv_id", "var", "total")


@query("p7_mask", W("lik") + "select snv_id, case when sum(ll0) >= sum(ll1) then 'B' else 'A' end part from lik group by 1")
def p7(s, d):
    return R.loaded(s, d).groupBy("snv_id").agg(F.when(F.sum("ll0") >= F.sum("ll1"), "B").otherwise("A").alias("part"))


@query(
    "p8_strip",
    W("reads") + ", b as (select * from reads where cell_id % 5 = 1 and snv_id % 5 = 2 and var > 0), m as (select distinct snv_id from b), c as (select distinct cell_id from b join m using (snv_id)) "
    "select 'snv' kind, snv_id id from m union all select 'cell', cell_id from c",
)
def p8(s, d):
    c, m = C.strip(R.reads(s, d), R.cell_node(s, d).where("node = 1"), R.snv_node(s, d).where("node = 2"))
    return m.select(F.lit("snv").alias("kind"), F.col("snv_id").alias("id")).union(c.select(F.lit("cell"), "cell_id"))


@query("p9_cells_without_reads", W("reads") + "select c_custkey cell_id from customer where c_custkey not in (select cell_id from reads)")
def p9(s, d):
    """Customers stand for a list of cells that is longer than the cells read."""
    return C.without_reads(table(s, d, "customer").select(F.col("c_custkey").alias("cell_id")), R.reads(s, d), "cell_id")


@query("p10_snvs_without_reads", W("reads") + "select o_orderkey snv_id from orders where o_orderkey not in (select snv_id from reads)")
def p10(s, d):
    return C.without_reads(table(s, d, "orders").select(F.col("o_orderkey").alias("snv_id")), R.reads(s, d), "snv_id")


@query("j1_encode", W("reads") + ", i as (select cell_id, row_number() over (order by cell_id) - 1 cell_idx from (select distinct cell_id from reads)) select cell_idx, count(*) n, cast(sum(total) as bigint) total from reads join i using (cell_id) group by 1")
def j1(s, d):
    r = R.reads(s, d)
    return r.join(C.dense_ids(r, "cell_id", "cell_idx", 4), "cell_id").groupBy(F.col("cell_idx").cast("long").alias("cell_idx")).agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query("j2_decode", W("cell_node") + "select cell_id, s_name, node from cell_node join supplier on s_suppkey = cell_id")
def j2(s, d):
    names = table(s, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), "s_name")
    return R.cell_node(s, d).join(names, "cell_id").select("cell_id", "s_name", "node")


@query("j3_semi", W("reads", "snv_node") + "select count(*) n, cast(sum(total) as bigint) total from reads where snv_id in (select snv_id from snv_node where node = 3)")
def j3(s, d):
    return C.block(R.reads(s, d), snvs=R.snv_node(s, d).where("node = 3")).agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query("j4_anti", W("reads", "snv_node") + "select count(*) n, cast(sum(total) as bigint) total from reads where snv_id not in (select snv_id from snv_node where node = 3)")
def j4(s, d):
    r, m = R.reads(s, d), R.snv_node(s, d).where("node = 3")
    return r.join(m, "snv_id", "left_anti").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query("j7_lattice_join", W("reads", "lattice") + "select snv_id, round(sum(w * v * total), 6) expected from reads cross join lattice group by 1")
def j7(s, d):
    lattice = s.createDataFrame(L.lattice(), "v double, w double")
    return R.reads(s, d).crossJoin(F.broadcast(lattice)).groupBy("snv_id").agg(F.round(F.sum(F.col("w") * F.col("v") * F.col("total")), 6).alias("expected"))


@query("a1_observations", W("reads") + "select count(*) filter (total > 0) n from reads where cell_id % 5 = 1")
def a1(s, d):
    return C.block(R.reads(s, d), R.cell_node(s, d).where("node = 1")).agg(C.observed().alias("n"))


@query("a2_counts_by_cell", W("reads") + "select cell_id, count(*) filter (total > 0) n_obs, count(*) filter (var > 0) n_var from reads group by 1")
def a2(s, d):
    return C.counts_by(R.reads(s, d), "cell_id")


@query("a2_counts_by_snv", W("reads") + "select snv_id, count(*) filter (total > 0) n_obs, count(*) filter (var > 0) n_var from reads group by 1")
def a2s(s, d):
    return C.counts_by(R.reads(s, d), "snv_id")


@query("a3_burden", W("reads") + "select cell_id, round(count(*) filter (var > 0) / nullif(count(*) filter (total > 0), 0)::double, 9) f from reads where snv_id % 5 = 2 group by 1")
def a3(s, d):
    return C.fraction_by(C.block(R.reads(s, d), snvs=R.snv_node(s, d).where("node = 2")), "cell_id").select("cell_id", F.round("f", 9).alias("f"))


@query("a4_fraction", W("reads") + "select snv_id, round(count(*) filter (var > 0) / nullif(count(*) filter (total > 0), 0)::double, 9) f from reads group by 1")
def a4(s, d):
    return C.fraction_by(R.reads(s, d), "snv_id").select("snv_id", F.round("f", 9).alias("f"))


@query("a5_block_sums", W("lik", "cell_node", "snv_node") + "select c.node cp, s.node sp, round(sum(ll0), 4) s0, round(sum(ll1), 4) s1 from lik join cell_node c using (cell_id) join snv_node s using (snv_id) group by 1, 2")
def a5(s, d):
    x = C.labelled(R.loaded(s, d), R.cell_node(s, d).withColumnRenamed("node", "cp"), R.snv_node(s, d).withColumnRenamed("node", "sp"))
    return x.groupBy("cp", "sp").agg(F.round(F.sum("ll0"), 4).alias("s0"), F.round(F.sum("ll1"), 4).alias("s1"))


@query("a6_mean_over_set", W("lik", "cells") + "select snv_id, round(sum(ll0) / (select count(*) from cells), 6) m0, round(sum(ll1) / (select count(*) from cells), 6) m1 from lik group by 1")
def a6(s, d):
    n = R.cells(s, d).agg(F.count("*").alias("n"))
    return R.loaded(s, d).groupBy("snv_id").agg(F.sum("ll0").alias("s0"), F.sum("ll1").alias("s1")).crossJoin(F.broadcast(n)).select("snv_id", F.round(F.col("s0") / F.col("n"), 6).alias("m0"), F.round(F.col("s1") / F.col("n"), 6).alias("m1"))


@query("a7_quantile", W("reads", "snvs") + ", c as (select snv_id, count(total) n from snvs left join (select * from reads where cell_id % 5 = 1) using (snv_id) group by 1) select quantile_cont(n, 0.75) q75, quantile_cont(n, 0.1) q10 from c")
def a7(s, d):
    n = C.counts_over(R.snvs(s, d), C.block(R.reads(s, d), R.cell_node(s, d).where("node = 1")), "snv_id")
    return n.agg(F.percentile("n_obs", F.lit(0.75)).alias("q75"), F.percentile("n_obs", F.lit(0.1)).alias("q10"))


@query("a8_median", W("reads") + ", f as (select c.cell_id, count(*) filter (var > 0) / nullif(count(*) filter (total > 0), 0)::double f from (select c_custkey cell_id from customer) c left join reads using (cell_id) group by 1) select round(median(f), 9) m, count(*) n from f")
def a8(s, d):
    """The fraction of customers that are no cells is undefined and does not move the median."""
    f = table(s, d, "customer").select(F.col("c_custkey").alias("cell_id")).join(C.fraction_by(R.reads(s, d), "cell_id"), "cell_id", "left")
    return f.agg(F.round(F.median("f"), 9).alias("m"), F.count("*").alias("n"))


@query("a9_moments", W("embedding", "cell_node") + "select node, i dim, round(avg(vec[i + 1]), 6) m, round(var_pop(vec[i + 1]), 6) v from embedding join cell_node using (cell_id), range(4) r(i) group by 1, 2")
def a9(s, d):
    x = R.embedding(s, d).join(R.cell_node(s, d), "cell_id").select("node", F.posexplode(F.slice("vec", 1, 4)).alias("dim", "x"))
    return x.groupBy("node", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 6).alias("m"), F.round(F.var_pop("x"), 6).alias("v"))


@query("a12_range", W("bins") + "select max(n) - min(n) span from bins")
def a12(s, d):
    return R.bins(s, d).agg((F.max("n") - F.min("n")).alias("span"))


@query("a14_weighted_support", W("reads") + "select round(var / total::double, 12) v, count(*) n from reads group by 1")
def a14(s, d):
    """The distinct variant fractions of all observations, and how often each comes."""
    return R.reads(s, d).groupBy(F.round(F.col("var") / F.col("total"), 12).alias("v")).agg(F.count("*").alias("n"))


@query("a15_all", W("reads") + "select cell_id, bool_and(total <= 3) ok from reads group by 1")
def a15(s, d):
    return R.reads(s, d).groupBy("cell_id").agg(F.bool_and(F.col("total") <= 3).alias("ok"))


@query("l1_binomial", W("lik") + "select cell_id, snv_id, round(exp(lnc + var * ln(0.3e0) + (total - var) * ln(0.7e0)), 8) p from lik")
def l1(s, d):
    return R.reads(s, d).select("cell_id", "snv_id", F.round(F.exp(L.ln_binomial(F.col("var"), F.col("total"), 0.3)), 8).alias("p"))


@query("l2_absent_loglik", W("lik") + "select cell_id, snv_id, round(ll0, 6) ll0 from lik")
def l2(s, d):
    return R.loaded(s, d).select("cell_id", "snv_id", F.round("ll0", 6).alias("ll0"))


@query("l3_lattice", W("lattice", "reads") + "select round(v, 12) v, round(w, 12) w, (select count(*) from reads where var > v * total) above from lattice")
def l3(s, d):
    """The support of the variant fraction, its weights, and how many observations lie above each point."""
    points = s.createDataFrame(L.lattice(), "v double, w double")
    seen = R.reads(s, d).groupBy("var", "total").agg(F.count("*").alias("n"))
    met = seen.crossJoin(F.broadcast(points))  # points of the lattice
    return met.groupBy("v", "w").agg(F.sum(F.when(F.col("var") > F.col("v") * F.col("total"), F.col("n")).otherwise(0)).alias("above")).select(F.round("v", 12).alias("v"), F.round("w", 12).alias("w"), "above")


@query("l4_adjusted_fraction", W("reads") + "select snv_id, round(f * (1 - 1e-3) + (1 - f) * 1e-3 / 3, 9) v from (select snv_id, sum(var) / sum(total)::double f from reads group by 1)")
def l4(s, d):
    f = F.col("f")
    return R.reads(s, d).groupBy("snv_id").agg((F.sum("var") / F.sum("total")).alias("f")).select("snv_id", F.round(L.adjusted(f, 1e-3), 9).alias("v"))


@query("l5_present_loglik", W("lik") + "select cell_id, snv_id, round(ll1, 6) ll1 from lik")
def l5(s, d):
    return R.loaded(s, d).select("cell_id", "snv_id", F.round("ll1", 6).alias("ll1"))


@query("r1_thirds", W("snvs") + f"select snv_id, case when u < 1 / 3e0 then 'A' when u < 2 / 3e0 then 'B' else 'C' end part from (select snv_id, {U.uniform_sql(1026, 3, 'snv_id')} u from snvs)")
def r1(s, d):
    u = U.uniform(1026, 3, F.col("snv_id"))
    return R.snvs(s, d).withColumn("u", u).select("snv_id", F.when(F.col("u") < 1 / 3, "A").when(F.col("u") < 2 / 3, "B").otherwise("C").alias("part"))


@query("r2_bernoulli", W("snvs") + f"select snv_id, {U.uniform_sql(1026, 4, 'snv_id')} <= 0.5e0 a from snvs")
def r2(s, d):
    return R.snvs(s, d).select("snv_id", (U.uniform(1026, 4, F.col("snv_id")) <= 0.5).alias("a"))


@query(
    "r3_weighted_sample",
    W("reads") + ", f as (select snv_id, count(*) filter (var > 0) / count(*)::double f from reads group by 1), "
    f"k as (select snv_id, ln({U.uniform_sql(1026, 5, 'snv_id')} + 1e-12) / f k from f where f > 0) "
    "select snv_id from (select snv_id, row_number() over (order by k desc, snv_id) r from k) where r <= (select count(*) // 2 from f)",
)
def r3(s, d):
    from ..search.starts import weighted_sample

    return weighted_sample(C.fraction_by(R.reads(s, d), "snv_id"), 0.5, 1026, 5).select("snv_id")


_SEEN = W("reads") + ", o as (select distinct count(*) n from reads group by cell_id) "


def _seen(s, d):
    """The distinct numbers of observations that cells have."""
    return R.reads(s, d).groupBy("cell_id").agg(F.count("*").alias("n")).select("n").distinct()


@query("r4_success_probability", _SEEN + "select n, case when n < 60 then 0e0 else round(exp(lgamma(n - 60 + 6) - lgamma(n - 60 + 1) - lgamma(n + 6) + lgamma(n + 1)), 6) end p from o")
def r4(s, d):
    """For each number of observations that a cell has: the share of ways in which six parts get ten or more each."""
    rows = lambda batches: (pdf.assign(p=[round(U.success_probability(n, 6, 10), 6) for n in pdf["n"].tolist()]) for pdf in batches)
    return _seen(s, d).mapInPandas(rows, "n long, p double")


@query("r5_required_observations", _SEEN + ", q as (select distinct 1 + n // 60 d from o) select d, min(t.n) n from q, range(1, 20000) t(n) where t.n >= 6 * d and exp(lgamma(t.n - 6 * d + 6) - lgamma(t.n - 6 * d + 1) - lgamma(t.n + 6) + lgamma(t.n + 1)) >= 0.95e0 group by 1")
def r5(s, d):
    """For what each of six parts would get of a cell's observations: how many it takes for that at 95 %."""
    want = _seen(s, d).select(F.expr("1 + n div 60").alias("d")).distinct()
    rows = lambda batches: (pdf.assign(n=[U.required_observations(6, k, 0.95, 10**6) for k in pdf["d"].tolist()]) for pdf in batches)
    return want.mapInPandas(rows, "d long, n long")


@query("u1_union", W("reads") + "select snv_id from reads where cell_id = 1 union select snv_id from reads where cell_id = 2")
def u1(s, d):
    r = R.reads(s, d)
    return r.where("cell_id = 1").select("snv_id").union(r.where("cell_id = 2").select("snv_id")).distinct()


@query("u2_concat", W("cell_node") + "select cell_id from cell_node where node = 1 union all select cell_id from cell_node where node >= 1")
def u2(s, d):
    c = R.cell_node(s, d)
    return c.where("node = 1").select("cell_id").unionByName(c.where("node >= 1").select("cell_id"))


@query("u3_difference", W("reads") + "select snv_id from reads where cell_id = 1 except select snv_id from reads where cell_id = 2")
def u3(s, d):
    r = R.reads(s, d)
    return r.where("cell_id = 1").select("snv_id").subtract(r.where("cell_id = 2").select("snv_id"))


@query("u4_intersection", W("reads") + "select snv_id from reads where cell_id = 1 intersect select snv_id from reads where cell_id = 2")
def u4(s, d):
    r = R.reads(s, d)
    return r.where("cell_id = 1").select("snv_id").intersect(r.where("cell_id = 2").select("snv_id"))


@query("u5_same_sets", W("cell_node") + "select a.node x, b.node y, count(*) filter (a.k = b.k) = count(*) and count(*) > 0 same from (select node, cell_id // 5 k from cell_node) a join (select node, cell_id // 5 k from cell_node) b on a.k = b.k and a.node < b.node group by 1, 2")
def u5(s, d):
    c = R.cell_node(s, d).select("node", F.floor(F.col("cell_id") / 5).alias("k"))
    a, b = c.withColumnRenamed("node", "x"), c.withColumnRenamed("node", "y")
    met = a.join(b, "k").where("x < y").groupBy("x", "y").agg(F.count("*").alias("n"))
    return met.select("x", "y", (F.col("n") > 0).alias("same"))


@query("u6_seed_key", W("cell_node") + "select node, md5(array_to_string(list(cell_id order by cell_id), ',')) seed_key from cell_node group by 1")
def u6(s, d):
    ids = F.transform(F.sort_array(F.collect_list("cell_id")), lambda x: x.cast("string"))
    return R.cell_node(s, d).groupBy("node").agg(F.md5(F.array_join(ids, ",").cast("binary")).alias("seed_key"))


@query("o1_sorted", W("bins") + "select cell_id, bin, row_number() over (partition by cell_id order by n desc, bin) r from bins")
def o1(s, d):
    return R.bins(s, d).select("cell_id", "bin", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("n"), "bin")).alias("r"))


@query("o2_top1", W("bins") + "select bin, cell_id, n from bins order by n desc, cell_id, bin limit 1")
def o2(s, d):
    return R.bins(s, d).orderBy(F.desc("n"), "cell_id", "bin").limit(1).select("bin", "cell_id", "n")


_V = "(select cell_id, vec from embedding)"
_D = f", v as {_V}, p as (select a.cell_id a, b.cell_id b, list_distance(a.vec, b.vec) d from v a join v b on a.cell_id < b.cell_id)"


@query("j5_distances", W("embedding") + _D + " select a, b, round(d, 6) d from p")
def j5(s, d):
    return X.distances(R.embedding(s, d)).select("a", "b", F.round("d", 6).alias("d"))


@query("w5_neighbours", W("embedding") + _D + ", t as (select a c, b o, d from p union all select b, a, d from p) select c cell_id, row_number() over (partition by c order by d, o) rank, o other from t qualify rank <= 5")
def w5(s, d):
    return X.neighbours(R.embedding(s, d), 5)


@query("f4_kernel_width", W("embedding") + _D + " select round(0.2e0 * max(d), 9) width from p")
def f4(s, d):
    return X.kernel_width(R.embedding(s, d)).select(F.round("width", 9).alias("width"))


@query("w4_largest_gap", W("embedding") + ", g as (select cell_id, x, row_number() over (partition by cell_id order by x) place, lead(x) over (partition by cell_id order by x) - x gap from (select cell_id, unnest(vec) x from embedding)) select cell_id, round(arg_max(gap, gap), 9) gap, arg_max(place, gap) place from g where gap is not null group by 1")
def w4(s, d):
    return X.largest_gap(R.embedding(s, d).select("cell_id", F.explode("vec").alias("x")), ["cell_id"], "x").select("cell_id", F.round("gap", 9).alias("gap"), "place")
