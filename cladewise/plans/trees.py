"""Trees: structure, memberships, pair relations, scores, refinement, choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import relations as R
from ..operators import refine, scoring, select, tree
from ..storage import keep
from .registry import query

W = R.with_sql
_LARGE = W("large")
_PRES = ", pres as (select distinct c.node, s.snv_id from (select anc, node from closure union all select node, node from nodes) c join snv_node s on s.node = c.anc)"
_CLADE = ", clade as (select c.anc node, m.cell_id from (select anc, node from closure union all select node, node from nodes) c join cell_node m on m.node = c.node)"


@query("g1_roots", _LARGE + "select distinct parent node from large where parent not in (select child from large)")
def g1(s, d):
    return tree.roots(R.large_tree(s, d))


@query("g2_leaves", _LARGE + "select distinct child node from large where child not in (select parent from large)")
def g2(s, d):
    return tree.leaves(R.large_tree(s, d))


@query("g3_ancestral_snvs", W("closure", "snv_node") + "select c.node, s.snv_id from closure c join snv_node s on s.node = c.anc where not exists (select 1 from snv_node l where l.snv_id = s.snv_id and l.snv_id % 11 = 0 and l.node = 0 and c.node = 1)")
def g3(s, d):
    lost = R.snv_node(s, d).where("snv_id % 11 = 0 and node = 0").select(F.lit(1).alias("node"), "snv_id")
    # lost at node 1 only: its children get them back, so that the anti join is seen at one node
    got = tree.ancestral(R.edges(s, d), R.snv_node(s, d), "snv_id")
    return got.join(lost, ["node", "snv_id"], "left_anti")


@query("j8_ancestor_join", W("closure", "snv_node") + "select c.node, count(*) n, cast(sum(s.snv_id) as bigint) ids from closure c join snv_node s on s.node = c.anc group by 1")
def j8(s, d):
    return tree.ancestral(R.edges(s, d), R.snv_node(s, d), "snv_id").groupBy("node").agg(F.count("*").alias("n"), F.sum("snv_id").alias("ids"))


@query("g5_snv_genotypes", W("closure", "nodes", "snv_node") + _PRES + "select n.node, s.snv_id, (p.snv_id is not null)::int y from nodes n cross join snv_node s left join pres p on p.node = n.node and p.snv_id = s.snv_id")
def g5(s, d):
    p = tree.presence(R.edges(s, d), R.snv_node(s, d), "snv_id").withColumn("y", F.lit(1))
    every = R.snv_node(s, d).select("snv_id").crossJoin(F.broadcast(tree.nodes(R.edges(s, d))))
    return every.join(p, ["node", "snv_id"], "left").select("node", "snv_id", F.coalesce("y", F.lit(0)).alias("y"))


@query("g6_clade_members", W("closure", "nodes", "cell_node") + _CLADE + "select node, cell_id from clade")
def g6(s, d):
    return tree.clade_members(R.edges(s, d), R.cell_node(s, d), "cell_id")


_PATH = ", path as (select parent node, [parent] p from large where parent not in (select child from large) group by 1 union all select e.child, list_append(p, e.child) from path join large e on e.parent = path.node)"


@query("g7_preorder", _LARGE + _PATH + "select node, row_number() over (order by p) - 1 label from path")
def g7(s, d):
    return tree.preorder(R.large_tree(s, d)).select("node", F.col("label").cast("long").alias("label"))


@query("g7_postorder", _LARGE + _PATH + "select node, row_number() over (order by list_append(p, 2147483647)) - 1 place from path")
def g7p(s, d):
    return tree.postorder(R.large_tree(s, d)).select("node", F.col("place").cast("long").alias("place"))


@query("t13_relabel", _LARGE.replace("from supplier", "from supplier, (select max(s_suppkey) m from supplier)").replace("cast((s_suppkey - 1) // 2 as int)", "cast(m - (s_suppkey - 1) // 2 as int)").replace("cast(s_suppkey as int)", "cast(m - s_suppkey as int)") + _PATH + ", l as (select node, row_number() over (order by p) - 1 label from path) select cast(a.label as int) parent, cast(b.label as int) child from large join l a on a.node = parent join l b on b.node = child")
def t13(s, d):
    """The large tree with its labels turned round, relabelled."""
    big = R.large_tree(s, d)
    top = big.agg(F.max("child").alias("m"))
    mixed = big.crossJoin(F.broadcast(top)).select((F.col("m") - F.col("parent")).alias("parent"), (F.col("m") - F.col("child")).alias("child"))  # one row
    return tree.relabel(mixed).select(F.col("parent").cast("int").alias("parent"), F.col("child").cast("int").alias("child"))


@query("g8_seed_of_node", W("cell_node", "snv_node") + "select 'cell' kind, count(*) n, cast(sum(cell_id) as bigint) ids from cell_node where node = 3 union all select 'snv', count(*), cast(sum(snv_id) as bigint) from snv_node where node = 3")
def g8(s, d):
    from ..search.trees import seed_of

    c, m = seed_of(3, R.cell_node(s, d), R.snv_node(s, d))
    one = lambda df, k, i: df.agg(F.count("*").alias("n"), F.sum(i).alias("ids")).select(F.lit(k).alias("kind"), "n", "ids")
    return one(c, "cell", "cell_id").union(one(m, "snv", "snv_id"))


@query("g9_cell_ancestor_pairs", W("closure", "cell_node") + "select x.cell_id id1, y.cell_id id2 from closure c join cell_node x on x.node = c.anc join cell_node y on y.node = c.node")
def g9(s, d):
    return tree.ancestor_pairs(R.edges(s, d), R.cell_node(s, d), "cell_id")


@query("g9_snv_ancestor_pairs", W("closure", "snv_node") + "select x.snv_id id1, y.snv_id id2 from closure c join snv_node x on x.node = c.anc join snv_node y on y.node = c.node")
def g9s(s, d):
    return tree.ancestor_pairs(R.edges(s, d), R.snv_node(s, d), "snv_id")


@query("g10_cell_cluster_pairs", W("cell_node") + "select x.cell_id id1, y.cell_id id2 from cell_node x join cell_node y on x.node = y.node and x.cell_id < y.cell_id")
def g10(s, d):
    return tree.cluster_pairs(R.cell_node(s, d), "cell_id")


@query("g10_snv_cluster_pairs", W("snv_node") + "select x.snv_id id1, y.snv_id id2 from snv_node x join snv_node y on x.node = y.node and x.snv_id < y.snv_id")
def g10s(s, d):
    return tree.cluster_pairs(R.snv_node(s, d), "snv_id")


_APART = ", apart as (select a.node a, b.node b from nodes a join nodes b on a.node < b.node where not exists (select 1 from closure c where (c.anc = a.node and c.node = b.node) or (c.anc = b.node and c.node = a.node)))"


@query("g11_cell_incomparable_pairs", W("closure", "nodes", "cell_node") + _APART + "select least(x.cell_id, y.cell_id) id1, greatest(x.cell_id, y.cell_id) id2 from apart join cell_node x on x.node = a join cell_node y on y.node = b")
def g11(s, d):
    return tree.incomparable_pairs(R.edges(s, d), R.cell_node(s, d), "cell_id")


@query("g11_snv_incomparable_pairs", W("closure", "nodes", "snv_node") + _APART + "select least(x.snv_id, y.snv_id) id1, greatest(x.snv_id, y.snv_id) id2 from apart join snv_node x on x.node = a join snv_node y on y.node = b")
def g11s(s, d):
    return tree.incomparable_pairs(R.edges(s, d), R.snv_node(s, d), "snv_id")


@query("g12_incomparable_nodes", _LARGE + ", closure as (select parent anc, child node from large union all select c.anc, e.child from closure c join large e on e.parent = c.node), nodes as (select parent node from large union select child from large)" + _APART + "select a, b from apart")
def g12(s, d):
    return tree.incomparable_nodes(R.large_tree(s, d))


@query(
    "a13_pair_counts",
    W("closure", "nodes", "snv_node") + _APART + ", z as (select node, count(*) n from snv_node group by 1) "
    "select 'ancestor' relation, cast(sum(x.n * y.n) as bigint) n from closure c join z x on x.node = anc join z y on y.node = c.node union all "
    "select 'cluster', cast(sum(n * (n - 1) // 2) as bigint) from z union all select 'incomparable', cast(sum(x.n * y.n) as bigint) from apart join z x on x.node = a join z y on y.node = b",
)
def a13(s, d):
    return tree.pair_counts(R.edges(s, d), R.snv_node(s, d))


@query("j10_related_memberships", W("closure", "cell_node") + "select anc, c.node, count(*) n from closure c join cell_node x on x.node = anc join cell_node y on y.node = c.node group by 1, 2")
def j10(s, d):
    n = R.cell_node(s, d).groupBy("node").agg(F.count("*").alias("k"))
    up = tree.closure(R.edges(s, d)).join(n.select(F.col("node").alias("anc"), F.col("k").alias("m")), "anc").join(n, "node")
    return up.select("anc", "node", (F.col("m") * F.col("k")).alias("n"))


@query("j11_pairs_in_group", W("cell_node") + "select node, count(*) n from (select x.node, x.cell_id from cell_node x join cell_node y on x.node = y.node and x.cell_id < y.cell_id) group by 1")
def j11(s, d):
    """Counted by sizes; no pair is listed."""
    n = F.col("n") * (F.col("n") - 1) / 2
    return R.cell_node(s, d).groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", n.cast("long").alias("n"))


@query("g16_missing", W("reads", "cells", "snvs") + "select 'cell' kind, count(*) n from cells where cell_id not in (select s_suppkey from supplier where s_suppkey % 5 < 4) union all select 'snv', count(*) from snvs where snv_id % 5 = 4")
def g16(s, d):
    c = refine.unplaced(R.cells(s, d), R.cell_node(s, d).where("node < 4"), "cell_id")
    m = refine.unplaced(R.snvs(s, d), R.snv_node(s, d).where("node < 4"), "snv_id")
    return c.agg(F.count("*").alias("n")).select(F.lit("cell").alias("kind"), "n").union(m.agg(F.count("*")).select(F.lit("snv"), "*"))


@query(
    "g17_bad_snvs",
    W("reads", "closure", "nodes", "cell_node", "snv_node") + _CLADE + ", f as (select s.node, s.snv_id, x.f from snv_node s left join (select c.node, r.snv_id, count(*) filter (var > 0) / count(*)::double f from reads r join clade c using (cell_id) group by 1, 2) x on x.node = s.node and x.snv_id = s.snv_id), "
    "q as (select node, quantile_cont(f, 0.1) cut from f group by 1) select f.node, snv_id from f join q using (node) where f is null or f <= cut",
)
def g17(s, d):
    return refine.bad_snvs(R.reads(s, d), R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d))


@query(
    "g18_bad_cells",
    W("reads", "cell_node", "snv_node") + ", f as (select c.node, c.cell_id, x.f from cell_node c left join (select r.cell_id, count(*) filter (var > 0) / count(*)::double f from reads r join cell_node c using (cell_id) join snv_node s on s.snv_id = r.snv_id and s.node = c.node group by 1) x using (cell_id)), "
    "q as (select node, quantile_cont(f, 0.1) cut from f group by 1) select f.node, cell_id from f join q using (node) where f is null or f <= cut",
)
def g18(s, d):
    return refine.bad_cells(R.reads(s, d), R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d))


@query(
    "g19_reassigned_cells",
    W("lik", "closure", "nodes", "snv_node") + _PRES + ", o as (select node from nodes where node not in (select parent from edges group by 1 having count(*) > 1)), "
    "sc as (select l.cell_id, o.node, sum(case when p.snv_id is null then ll0 else ll1 end) s from lik l cross join o left join pres p on p.node = o.node and p.snv_id = l.snv_id group by 1, 2) "
    "select cell_id, node from (select *, row_number() over (partition by cell_id order by round(s, 9) desc, node) r from sc) where r = 1",
)
def g19(s, d):
    scores = refine.cell_scores(R.loaded(s, d), R.edges(s, d), R.snv_node(s, d), R.cells(s, d))
    return refine.best_nodes(scores, "cell_id")


@query(
    "g20_reassigned_snvs",
    W("lik", "closure", "nodes", "cell_node") + _CLADE + ", sc as (select l.snv_id, n.node, sum(case when c.cell_id is null then ll0 else ll1 end) s from lik l cross join nodes n left join clade c on c.node = n.node and c.cell_id = l.cell_id group by 1, 2) "
    "select snv_id, node from (select *, row_number() over (partition by snv_id order by round(s, 9) desc, node) r from sc) where r = 1",
)
def g20(s, d):
    facts = R.loaded(s, d)
    return refine.best_nodes(refine.snv_scores(facts, R.edges(s, d), R.cell_node(s, d), facts.select("snv_id").distinct()), "snv_id")


@query("g21_post_process")
def g21(s, d):
    c, m = refine.post_process(R.loaded(s, d), R.edges(s, d), R.cell_node(s, d).where("cell_id % 10 <> 9"), R.snv_node(s, d).where("snv_id % 10 <> 9"))
    return m.groupBy("node").agg(F.count("*").alias("n")).withColumn("kind", F.lit("snv")).union(c.groupBy("node").agg(F.count("*").alias("n")).withColumn("kind", F.lit("cell")))


_BYNODE = _PRES + ", var as (select c.node, sum(case when p.snv_id is null then ll0 else ll1 end) v from lik l join cell_node c using (cell_id) left join pres p on p.node = c.node and p.snv_id = l.snv_id group by 1)"
_DEPTH = (
    ", x as (select node, i dim, vec[i + 1] x from embedding join cell_node using (cell_id), range(64) r(i)), mo as (select node, dim, avg(x) m, var_pop(x) s2 from x group by 1, 2), "
    "dep as (select x.node, sum(case when s2 > 1e-12 then -0.5e0 * (ln(2 * pi() * s2) + (x - m) * (x - m) / s2) else 0 end) v from x join mo using (node, dim) group by 1)"
)
_TREE = W("lik", "closure", "nodes", "cell_node", "snv_node", "embedding") + _BYNODE + _DEPTH


@query("l10_depth_by_node", W("cell_node", "embedding") + _DEPTH + "select node, round(v, 4) depth from dep")
def l10(s, d):
    return scoring.depth_by_node(R.embedding(s, d), R.cell_node(s, d)).select("node", F.round("depth", 4).alias("depth"))


@query("l11_variant_by_node", W("lik", "closure", "nodes", "cell_node", "snv_node") + _BYNODE + "select node, round(v, 4) variant from var")
def l11(s, d):
    return scoring.variant_by_node(R.loaded(s, d), R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d)).select("node", F.round("variant", 4).alias("variant"))


_NM = "((select count(*) from cell_node) * (select count(*) from snv_node))"


@query("l13_tree_loglik", _TREE + f"select round(v, 3) loglik, round(v / {_NM}, 9) norm from (select (select sum(v) from var) + (select sum(v) from dep) v)")
def l13(s, d):
    out = scoring.tree_loglik(R.loaded(s, d), R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d), R.embedding(s, d))
    return out.select(F.round("loglik", 3).alias("loglik"), F.round("norm", 9).alias("norm"))


@query("l14_variant_only", _TREE + f"select round(v, 3) loglik, round(v / {_NM}, 9) norm from (select sum(v) v from var)")
def l14(s, d):
    out = scoring.tree_loglik(R.loaded(s, d), R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d))
    return out.select(F.round("loglik", 3).alias("loglik"), F.round("norm", 9).alias("norm"))


def _forest(s, d):
    """Three candidates: the tree of five nodes, a chain, a single node."""
    e = R.edges(s, d).withColumn("tree_id", F.lit(0)).union(s.createDataFrame([(0, 1, 1), (1, 2, 1)], "parent int, child int, tree_id int")).select("tree_id", "parent", "child")
    c, m = R.cells(s, d), R.snvs(s, d)
    parts = [(0, 5), (1, 3), (2, 1)]
    cn, sn = None, None
    for t, k in parts:
        x = c.select(F.lit(t).alias("tree_id"), "cell_id", (F.col("cell_id") % k).cast("int").alias("node"))
        y = m.select(F.lit(t).alias("tree_id"), "snv_id", (F.col("snv_id") % k).cast("int").alias("node"))
        cn, sn = (x, y) if cn is None else (cn.union(x), sn.union(y))
    return e, cn, sn


_SCORED = (
    "up as (select tree_id, parent anc, child node from fe union all select u.tree_id, u.anc, e.child from up u join fe e on e.tree_id = u.tree_id and e.parent = u.node), "
    "au as (select * from up union all select distinct tree_id, node, node from fs), "
    "fp as (select distinct u.tree_id, u.node, s.snv_id from au u join fs s on s.tree_id = u.tree_id and s.node = u.anc), "
    "sc as (select c.tree_id, sum(case when p.snv_id is null then ll0 else ll1 end) v from lik l join fc c using (cell_id) left join fp p on p.tree_id = c.tree_id and p.node = c.node and p.snv_id = l.snv_id group by 1), "
    "res as (select tree_id, v loglik, v / ((select count(*) from cells) * (select count(*) from snvs)) norm from sc) "
)
_FOREST = (
    W("lik", "cells", "snvs")
    + ", fe as (select * from (values (0, 0, 1), (0, 0, 2), (0, 1, 3), (0, 1, 4), (1, 0, 1), (1, 1, 2)) t(tree_id, parent, child)), "
    "k as (select * from (values (0, 5), (1, 3), (2, 1)) t(tree_id, k)), "
    "fc as (select tree_id, cell_id, cast(cell_id % k as int) node from cells, k), fs as (select tree_id, snv_id, cast(snv_id % k as int) node from snvs, k), "
    + _SCORED
)
#: Eight candidates of one to five nodes, whose cells and SNVs are dealt by their ids and the tree's number.
_SIZED = (
    W("lik", "cells", "snvs")
    + ", fe as (select t tree_id, (c - 1) // 2 parent, c child from range(8) a(t), range(1, 5) b(c) where c <= t % 5), k as (select t tree_id, 1 + t % 5 k from range(8) a(t)), "
    "fc as (select tree_id, cell_id, cast((cell_id + tree_id) % k as int) node from cells, k), fs as (select tree_id, snv_id, cast((snv_id + tree_id) % k as int) node from snvs, k), "
    + _SCORED
    + ", scores as (select k.k num_nodes, norm from res join k using (tree_id)) "
)


@query("l13_batched_trees", _FOREST + "select tree_id, round(loglik, 3) loglik, round(norm, 9) norm from res")
def l13b(s, d):
    e, c, m = _forest(s, d)
    return scoring.trees_loglik(R.loaded(s, d), e, c, m).select("tree_id", F.round("loglik", 3).alias("loglik"), F.round("norm", 9).alias("norm"))


@query("t15_best_tree", _FOREST + "select tree_id, round(norm, 9) norm from res order by norm desc, tree_id limit 1")
def t15(s, d):
    e, c, m = _forest(s, d)
    return select.first_max(scoring.trees_loglik(R.loaded(s, d), e, c, m), "norm", "tree_id").select("tree_id", F.round("norm", 9).alias("norm"))


@query("a11_first_max", W("bins") + "select cell_id, bin, n from (select *, row_number() over (partition by cell_id order by n desc, bin) r from bins) where r = 1")
def a11(s, d):
    return select.first_max(R.bins(s, d), "n", "bin", ["cell_id"]).select("cell_id", "bin", "n")


def _scores(s, d):
    """(num_nodes, norm) of the eight candidates, scored on all reads in one job."""
    trees = s.range(8).select(F.col("id").cast("int").alias("tree_id"), (F.col("id") % 5 + 1).cast("int").alias("k"))
    edges = trees.where("k > 1").select("tree_id", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("child"))
    edges = edges.select("tree_id", F.expr("cast((child - 1) div 2 as int)").alias("parent"), "child")
    dealt = lambda df, c: df.crossJoin(F.broadcast(trees)).select("tree_id", c, ((F.col(c) + F.col("tree_id")) % F.col("k")).cast("int").alias("node"))  # noqa: E731  x trees
    norms = scoring.trees_loglik(R.loaded(s, d), edges, dealt(R.cells(s, d), "cell_id"), dealt(R.snvs(s, d), "snv_id"))
    return keep(norms.join(trees, "tree_id").select(F.col("k").alias("num_nodes"), "norm"), "scores")


@query("a10_best_by_size", _SIZED + "select num_nodes, round(min(-norm), 8) nll from scores group by 1")
def a10(s, d):
    return select.best_by_size(_scores(s, d)).select("num_nodes", F.round("nll", 8).alias("nll"))


_ELBOW = (
    _SIZED + ", b as (select num_nodes, min(-norm) nll from scores group by 1), e as (select * from b union all select max(num_nodes) + 1, arg_max(nll, num_nodes) * (1 - 0.025e0) from b), "
    "w as (select num_nodes, nll, lag(nll) over (order by num_nodes) p, lead(nll) over (order by num_nodes) x from e), "
    "f as (select num_nodes, nll, (p - nll) / p delta1, (nll - x) / nll delta2, (p - nll) / p - (nll - x) / nll f from w where p is not null and x is not null) "
)


@query("w1_elbow_table", _ELBOW + "select num_nodes, round(nll, 6) nll, round(delta1, 9) delta1, round(delta2, 9) delta2, round(f, 9) f from f")
def w1(s, d):
    return select.elbow(select.best_by_size(_scores(s, d))).select("num_nodes", *[F.round(c, k).alias(c) for c, k in (("nll", 6), ("delta1", 9), ("delta2", 9), ("f", 9))])


@query("t16_elbow", _ELBOW + "select num_nodes, round(f, 9) f from f order by f.f desc, num_nodes limit 1")
def t16(s, d):
    return select.first_max(select.elbow(select.best_by_size(_scores(s, d))), "f", "num_nodes").select("num_nodes", F.round("f", 9).alias("f"))


@query("t20_next_label", _LARGE + "select greatest(max(parent), max(child)) + 1 label from large")
def t20(s, d):
    return tree.nodes(R.large_tree(s, d)).agg((F.max("node") + 1).alias("label"))


@query("p11_long_mapping", W("cell_node") + "select cell_id, node cluster, 0 subcluster from cell_node order by cell_id")
def p11(s, d):
    from ..sources.mappings import to_long

    grouped = R.cell_node(s, d).groupBy("node").agg(F.collect_list("cell_id").alias("ids"))
    as_map = grouped.agg(F.map_from_entries(F.collect_list(F.struct("node", "ids"))).alias("m"))
    return to_long(as_map, "m", "cell_id")


@query("p12_mapping", W("cell_node") + "select node cluster, array_to_string(list(cell_id order by cell_id), ',') ids from cell_node group by 1")
def p12(s, d):
    from ..sources.mappings import to_lists

    return to_lists(R.cell_node(s, d), "node", "cell_id").select(F.col("node").alias("cluster"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("p13_inverted", W("snv_node") + "select snv_id k, node v from snv_node")
def p13(s, d):
    from ..sources.mappings import inverted, to_lists

    return inverted(to_lists(R.snv_node(s, d), "node", "snv_id"), "node", "ids")


@query("p16_cell_vector", W("cells") + "select cell_id, case when cell_id % 5 < 3 then cast(cell_id % 5 as int) else 0 end node from cells")
def p16(s, d):
    own = R.cell_node(s, d).where("node < 3")
    return R.cells(s, d).join(own, "cell_id", "left").select("cell_id", F.coalesce("node", F.lit(0)).alias("node"))


@query("p17_snv_vector", W("snvs") + "select snv_id, case when snv_id % 5 < 3 then cast(snv_id % 5 as int) else -1 end node from snvs")
def p17(s, d):
    own = R.snv_node(s, d).where("node < 3")
    return R.snvs(s, d).join(own, "snv_id", "left").select("snv_id", F.coalesce("node", F.lit(-1)).alias("node"))


@query("p18_owner", W("cell_node", "snv_node") + "select 'cell' kind, node from cell_node where cell_id = 7 union all select 'snv', node from snv_node where snv_id = 11")
def p18(s, d):
    c, m = R.cell_node(s, d).where("cell_id = 7"), R.snv_node(s, d).where("snv_id = 11")
    return c.select(F.lit("cell").alias("kind"), "node").union(m.select(F.lit("snv"), "node"))


@query("p19_tip_members", W("edges", "cell_node") + "select cell_id from cell_node where node in (select child from edges where child not in (select parent from edges))")
def p19(s, d):
    return R.cell_node(s, d).join(tree.leaves(R.edges(s, d)), "node", "left_semi").select("cell_id")


@query(
    "k3_edge_text",
    _LARGE + ", e as (select child node from large where child not in (select parent from large)), "
    "t as (select 0 p, 0 a, 0 b, count(*) || ' #edges' line from large union all select 1, parent, child, parent || ' ' || child from large union all select 2, 0, 0, count(*) || ' #leaves' from e union all select 3, node, 0, node::varchar from e) "
    "select row_number() over (order by p, a, b) place, line from t",
)
def k3(s, d):
    t = tree.edge_text(R.large_tree(s, d))
    return t.select(F.row_number().over(Window.orderBy("ord")).alias("place"), "line")  # a row for each node


@query("k11_summary", W("cell_node", "snv_node") + "select node, (select count(*) from cell_node c where c.node = n.node) n_cells, (select count(*) from snv_node s where s.node = n.node) n_snvs from (select distinct node from cell_node) n")
def k11(s, d):
    c = R.cell_node(s, d).groupBy("node").agg(F.count("*").alias("n_cells"))
    return c.join(R.snv_node(s, d).groupBy("node").agg(F.count("*").alias("n_snvs")), "node", "full").select("node", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("n_snvs", F.lit(0)).alias("n_snvs"))


@query(
    "w3_bin_strings",
    W("bins") + ", b as (select distinct cell_id, bin from bins where n >= 10), g as (select cell_id, bin, bin - row_number() over (partition by cell_id order by bin) k from b), "
    "i as (select cell_id, min(bin) l, max(bin) r, count(*) n from g group by cell_id, k), t as (select cell_id, sum(n) n, min(l) l, max(r) r, array_to_string(list(l::varchar || '-' || r::varchar order by l), ', ') s from i group by 1) "
    "select cell_id, case when n = 1 then l::varchar when n = 2 then l::varchar || '-' || r::varchar else s end bins from t",
)
def w3(s, d):
    return tree.strings_of_runs(R.bins(s, d).where("n >= 10"), ["cell_id"])
