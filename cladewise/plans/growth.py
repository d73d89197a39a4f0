"""Elementary and composite trees, seeds, older rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import relations as R
from ..config import Params
from ..functions.uniform import uniform_sql
from ..search import split, starts, trees
from ..sources import files
from .registry import query
from .splits import planted

W = R.with_sql


def _cp(s, d):
    return R.cells(s, d).select("cell_id", F.when(F.col("cell_id") % 2 == 0, "A").otherwise("B").alias("cp"))


def _sp(s, d):
    r = F.col("snv_id") % 3
    return R.snvs(s, d).select("snv_id", F.when(r == 0, "A").when(r == 1, "B").otherwise("C").alias("sp"))


def _sizes(t: trees.Tree, name: str):
    c = t.cell_node.groupBy("node").agg(F.count("*").alias("cells"))
    m = t.snv_node.groupBy("node").agg(F.count("*").alias("snvs"))
    return c.join(m, "node", "full").select(F.lit(name).alias("tree"), "node", F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("snvs", F.lit(0)).alias("snvs"))


_C = "(select cast(cell_id % 2 as int) p, count(*) n from cells group by 1)"
_M = "(select cast(snv_id % 3 as int) p, count(*) n from snvs group by 1)"


@query(
    "t18_elementary_trees",
    W("cells", "snvs") + f", c as {_C}, m as {_M} "
    "select 'linear' tree, 0 node, (select n from c where p = 0) cells, (select n from m where p = 0) snvs union all select 'linear', 1, (select n from c where p = 1), (select cast(sum(n) as bigint) from m where p > 0) union all "
    "select 'branching', 0, 0, (select n from m where p = 2) union all select 'branching', 1, (select n from c where p = 0), (select n from m where p = 0) union all select 'branching', 2, (select n from c where p = 1), (select n from m where p = 1) union all "
    "select 'identity', 0, (select count(*) from cells), (select count(*) from snvs)",
)
def t18(s, d):
    c, m = _cp(s, d), _sp(s, d)
    out = _sizes(trees.linear_tree(c, m), "linear").union(_sizes(trees.branching_tree(c, m), "branching"))
    return out.union(_sizes(trees.identity_tree(c, m), "identity"))


@query(
    "t12_merged_tree",
    W("cells", "snvs") + "select node, count(*) cells, (select count(*) from snvs where case when snv_id % 3 = 2 then 0 when snv_id % 3 = 1 then 2 when snv_id % 2 = 0 then 1 else 3 end = node) snvs "
    "from (select case when cell_id % 2 = 1 then 2 when cell_id % 4 = 0 then 1 else 3 end node from cells) group by 1 union all select 0, 0, (select count(*) from snvs where snv_id % 3 = 2)",
)
def t12(s, d):
    big = trees.branching_tree(_cp(s, d), _sp(s, d))
    c = R.cells(s, d).where("cell_id % 2 = 0").select("cell_id", F.when(F.col("cell_id") % 4 == 0, "A").otherwise("B").alias("cp"))
    m = R.snvs(s, d).where("snv_id % 3 = 0").select("snv_id", F.when(F.col("snv_id") % 2 == 0, "A").otherwise("B").alias("sp"))
    return _sizes(trees.merge(big, 1, trees.linear_tree(c, m)), "").drop("tree")


@query("t6_chain_nodes", W("cells") + "select cell_id, case when cell_id % 8 = 0 then 0 when cell_id % 4 = 0 then 1 when cell_id % 2 = 0 then 2 else 3 end node from cells")
def t6(s, d):
    c = R.cells(s, d)
    part = lambda k: c.where(F.col("cell_id") % k == 0).select("cell_id", F.when(F.col("cell_id") % (2 * k) == 0, "A").otherwise("B").alias("part"))
    return split.chain_nodes([part(1), part(2), part(4)], "cell_id")


_SEEDS = {"all": "true", "even": "cell_id % 2 = 0", "twos": "cell_id & 1 = 0", "late": "cell_id > 3", "fours": "cell_id % 4 = 0"}


@query(
    "t10_seed_lookup",
    W("cells") + ", seed as (" + " union all ".join(f"select '{n}' name, cell_id from cells where {w}" for n, w in _SEEDS.items()) + "), k as (select name, list(cell_id order by cell_id) ids from seed group by 1) "
    "select a.name a, b.name b, a.ids = b.ids same from k a, k b where a.name < b.name",
)
def t10(s, d):
    """Which of several seeds have the same key. Cells come in another order each time."""
    snvs = R.snvs(s, d)
    keys = {n: trees.Seed(R.cells(s, d).where(w).orderBy(F.xxhash64("cell_id", F.lit(n))), snvs).key() for n, w in _SEEDS.items()}
    return s.createDataFrame([(a, b, keys[a] == keys[b]) for a in keys for b in keys if a < b], "a string, b string, same boolean")


@query(
    "t17_tree_list",
    W("cells") + f", c as {_C}, n as (select count(*) n from cells) "
    "select 0 place, 3 total, true known, 1 node, (select n from c where p = 0) cells union all select 0, 3, true, 2, (select n from c where p = 1) union all select 0, 3, true, 0, 0 union all select 1, 3, true, 0, n from n",
)
def t17(s, d):
    """What is left of a list of three trees, the first taken, and whether each is known by its form."""
    c, m = _cp(s, d), _sp(s, d)
    items = trees.TreeList()
    for t in (trees.linear_tree(c, m), trees.branching_tree(c, m), trees.identity_tree(c, m)):
        items.insert(t)
    items.pop()
    again = trees.branching_tree(c, m), trees.identity_tree(c, m)
    rows = [(items.index(t), items.total, items.contains(t), node, n) for t in again for node, n in t.ncells.items()]
    return s.createDataFrame(rows, "place int, total int, known boolean, node int, cells long")


@query("t11_grown_trees")
def t11(s, d):
    """A branching tree whose two leaves can each be split once more: four shapes."""
    c, m = _cp(s, d), _sp(s, d)
    big = trees.branching_tree(c, m)
    memo, start = {}, trees.Seed(c.select("cell_id"), m.select("snv_id")).key()
    memo[start] = [big]
    for node, seed in big.seeds().items():
        k = 3 if node == 1 else 5
        cells = seed.cells.select("cell_id", F.when(F.col("cell_id") % k == 0, "A").otherwise("B").alias("cp"))
        snvs = seed.snvs.select("snv_id", F.when(F.col("snv_id") % 2 == 0, "A").otherwise("B").alias("sp"))
        memo[seed.key()] = [trees.linear_tree(cells, snvs)]
    grown = trees.grow(memo, start)
    return s.createDataFrame([(i, len(t.ncells), len(t.edges)) for i, t in enumerate(grown)], "tree_id int, nodes int, edges int")


@query("t9_tree_search", W("reads") + "select distinct 'cell' kind, cell_id id, cell_id % 3 node from reads union all select distinct 'snv', snv_id, snv_id % 3 from reads")
def t9(s, d):
    """Three clones of a path, planted on all cells and SNVs: seeds, elementary and composite trees, the best of them."""
    facts, vec = planted(s, d, "path", 3, errors=False)
    tree = trees.best_of_runs(trees.Data(facts, vec), Params(starts=2, iterations=4, seed=7, min_obs=1), runs=1).tree
    cells = tree.cell_node.select(F.lit("cell").alias("kind"), F.col("cell_id").alias("id"), F.col("node").cast("long").alias("node"))
    return cells.union(tree.snv_node.select(F.lit("snv"), "snv_id", F.col("node").cast("long")))


@query("r1_thirds_by_start", W("snvs") + ", u as (" + " union all ".join(f"select {i} start_id, snv_id, {uniform_sql(7, i, 'snv_id')} u from snvs" for i in (1, 2)) + ") select start_id, snv_id, case when u < 1 / 3e0 then 'A' when u < 2 / 3e0 then 'B' else 'C' end sp from u")
def r1(s, d):
    pool = R.snvs(s, d).crossJoin(F.broadcast(s.createDataFrame([(1,), (2,)], "start_id int")))
    return starts.thirds(pool, 7)


@query("s3_preview", W("reads") + "select * from reads order by cell_id, snv_id limit 3")
def s3(s, d):
    """The first rows, as a caller sees them."""
    return s.createDataFrame(files.preview(R.reads(s, d).orderBy("cell_id", "snv_id"), 3), "cell_id long, snv_id long, var long, total long")
