"""Sources and sinks, each written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import relations as R
from ..operators import scoring, tree
from ..sources import files, pictures
from ..storage import new_folder
from ..streaming import ingest
from .registry import query

W = R.with_sql


def _folder(s) -> str:
    return new_folder(s, "files")


@query("s1_variant_file", W("reads") + "select 'chr' || cast(snv_id % 22 + 1 as varchar) chr, cast(snv_id as varchar) mutation_id, cast(cell_id as varchar) cell_id, 'A' base, var, total from reads")
def s1(s, d):
    at = _folder(s)
    rows = R.reads(s, d).select(F.concat(F.lit("chr"), (F.col("snv_id") % 22 + 1).cast("string")).alias("chr"), F.col("snv_id").alias("mutation_id"), "cell_id", F.lit("A").alias("base"), "var", "total", F.lit("x").alias("copies"))
    rows.write.option("sep", "\t").option("header", True).csv(at)
    return files.read_variants(s, at)


@query("s2_bins_file", W("bins") + ", u as (select distinct bin from bins), c as (select distinct cell_id from bins) select cast(c.cell_id as int) cell_id, cast(u.bin - (select min(bin) from bins) as int) bin, cast(coalesce(n, 0) as double) n from c cross join u left join bins b on b.cell_id = c.cell_id and b.bin = u.bin")
def s2(s, d):
    at = _folder(s) + ".csv"
    first = R.bins(s, d).agg(F.min("bin").alias("m"))
    b = R.bins(s, d).crossJoin(F.broadcast(first)).select("cell_id", (F.col("bin") - F.col("m")).alias("bin"), "n")
    wide = b.groupBy("cell_id").pivot("bin", list(range(83))).agg(F.first("n")).na.fill(0)
    files.write_csv(wide.withColumnRenamed("cell_id", "cell").coalesce(1), at)
    return files.read_bins(s, at)


@query("s4_arm_file", W("bins") + "select 'chr' || (bin // 12)::varchar chrom, case when bin % 12 < 6 then 'p' else 'q' end arm, min(bin)::bigint as start, max(bin)::bigint as \"end\" from bins group by 1, 2")
def s4(s, d):
    """Arms of the chromosomes that the bins lie on, written as a headerless file and read back."""
    at = _folder(s)
    arm = F.when(F.col("bin") % 12 < 6, "p").otherwise("q")
    found = R.bins(s, d).groupBy(F.concat(F.lit("chr"), F.expr("bin div 12")).alias("chrom"), arm.alias("arm")).agg(F.min("bin").cast("long").alias("start"), F.max("bin").cast("long").alias("end"))
    found.write.csv(at)
    return files.read_arms(s, at)


@query("k1_cell_assignment", W("cell_node") + "select cast(node as varchar) cluster, '0' subcluster, s_name cell from cell_node join supplier on s_suppkey = cell_id")
def k1(s, d):
    names = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("cell_id"), F.col("s_name").alias("cell"))
    files.write_csv(files.cell_assignment(R.cell_node(s, d), names), at := _folder(s))
    return s.read.option("header", True).csv(at)


@query("k2_snv_assignment", W("snv_node") + "select cast(node as varchar) cluster, p_name mutation from snv_node join part on p_partkey = snv_id")
def k2(s, d):
    names = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("snv_id"), F.col("p_name").alias("mutation"))
    files.write_csv(files.snv_assignment(R.snv_node(s, d), names), at := _folder(s))
    return s.read.option("header", True).csv(at)


@query("k4_likelihood_series", W("lik") + "select cast(cell_id % 3 as varchar) tree, round(sum(ll0), 4) likelihood from lik group by 1")
def k4(s, d):
    series = R.loaded(s, d).groupBy((F.col("cell_id") % 3).alias("tree")).agg(F.sum("ll0").alias("likelihood"))
    files.write_csv(series, at := _folder(s))
    return s.read.option("header", True).schema("tree string, likelihood double").csv(at).select("tree", F.round("likelihood", 4).alias("likelihood"))


@query("k5_embedding_file", W("embedding") + "select cell_id cell, round(vec[1], 6) v1, round(vec[2], 6) v2 from embedding")
def k5(s, d):
    files.write_csv(files.embedding_table(R.embedding(s, d)), at := _folder(s))
    return s.read.option("header", True).schema("cell long, v1 double, v2 double").csv(at).select("cell", F.round("v1", 6).alias("v1"), F.round("v2", 6).alias("v2"))


@query("k6_tree_snapshot", W("edges", "cell_node", "snv_node") + "select 'edge' kind, cast(parent as bigint) id, child node from edges union all select 'cell', cell_id, node from cell_node union all select 'snv', snv_id, node from snv_node")
def k6(s, d):
    files.save_tree(at := _folder(s), R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d))
    e, c, m = files.load_tree(s, at)
    rows = e.select(F.lit("edge").alias("kind"), F.col("parent").cast("long").alias("id"), F.col("child").alias("node"))
    return rows.union(c.select(F.lit("cell"), "cell_id", "node")).union(m.select(F.lit("snv"), "snv_id", "node"))


_NODE = "n.node || chr(92) || 'ncells: ' || (select count(*) from cell_node c where c.node = n.node) || chr(92) || 'nSNVs: ' || (select count(*) from snv_node s where s.node = n.node)"
_LINES = (
    "select 0 part, 0 node, 0 \"to\", 'digraph T {{ label=\"{label}\";' line union all select 1, n.node, 0, '  ' || n.node || ' [label=\"' || " + _NODE + " || {more} || '\"];' from nodes n {join} "
    "union all select 2, parent, child, '  ' || parent || ' -> ' || child || ';' from edges union all select 3, 0, 0, '}}'"
)
_BYNODE = (
    ", pres as (select c.node, s.snv_id from (select anc, node from closure union select node, node from nodes) c join snv_node s on s.node = c.anc), "
    "v as (select c.node, sum(case when p.snv_id is null then ll0 else ll1 end) v from lik join cell_node c using (cell_id) left join pres p on p.node = c.node and p.snv_id = lik.snv_id group by 1) "
)


@query("k7_dot", W("lik", "closure", "nodes", "cell_node", "snv_node") + _BYNODE + _LINES.format(label="tree", more="chr(92) || 'n' || format('{:,.2f}', v)", join="left join v using (node)"))
def k7(s, d):
    scores = scoring.variant_by_node(R.loaded(s, d), R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d)).withColumnRenamed("variant", "score")
    return files.dot_lines(R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d), scores, label="tree").select("ord.part", "ord.node", "ord.to", "line")


_SAID = "select n.tree_id, n.node, n.node || '|cells: ' || (select count(*) from c where c.tree_id = n.tree_id and c.node = n.node) || '|SNVs: ' || (select count(*) from m where m.tree_id = n.tree_id and m.node = n.node)"


def _two_trees(s, d):
    """Edges, cells and SNVs of two trees: that of five nodes, and one that has odd ids below even ones."""
    at = lambda df, i: df.withColumn("tree_id", F.lit(i).cast("long"))
    by = lambda df, c: df.select(c, (F.col(c) % 2).cast("int").alias("node"))
    edges = at(R.edges(s, d), 0).unionByName(at(s.createDataFrame([(0, 1)], "parent int, child int"), 1))
    cells = at(R.cell_node(s, d), 0).unionByName(at(by(R.cells(s, d), "cell_id"), 1))
    return edges, cells, at(R.snv_node(s, d), 0).unionByName(at(by(R.snvs(s, d), "snv_id"), 1))


@query(
    "k7_box_lines",
    W("nodes", "cell_node", "snv_node", "lik", "closure")
    + _BYNODE.rstrip()
    + ", c as (select 0 tree_id, node from cell_node union all select 1, cell_id % 2 from cell_node), m as (select 0 tree_id, node from snv_node union all select 1, snv_id % 2 from snv_node), "
    + "n as (select 0 tree_id, node, v from nodes left join v using (node) union all values (1, 0, null), (1, 1, null)) "
    + _SAID
    + " || case when v is null then '' else '|' || format('{:,.2f}', v) end line from n",
)
def k7_lines(s, d):
    """What the boxes of a picture say: two trees, of which one has scores."""
    edges, cells, snvs = _two_trees(s, d)
    scores = scoring.variant_by_node(R.loaded(s, d), R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d)).select(F.lit(0).cast("long").alias("tree_id"), "node", F.col("variant").alias("score"))
    return pictures.node_lines(edges, cells, snvs, scores).select("tree_id", "node", F.array_join("lines", "|").alias("line"))


@query("k8_candidate_pictures", "select 0::bigint tree_id, true is_png union all select 1, true")
def k8_pictures(s, d):
    """Two trees drawn, written as PNG files and read back."""
    edges, cells, snvs = _two_trees(s, d)
    at = _folder(s)
    pictures.write_pictures(pictures.pictures(edges, pictures.node_lines(edges, cells, snvs)), lambda i: f"{at}/tree{i}.png")
    back = s.read.format("binaryFile").load(at)
    return back.select(F.regexp_extract("path", r"tree(\d+)\.png$", 1).cast("long").alias("tree_id"), (F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A").alias("is_png"))


@query("g23_labels", W("cell_node", "snv_node", "nodes") + "select n.node, n.node || '|' || (select count(*) from cell_node c where c.node = n.node) || '|' || (select count(*) from snv_node s where s.node = n.node) label from nodes n")
def g23(s, d):
    lines = files.dot_lines(R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d)).where("ord.part = 1")
    part = lambda i: F.regexp_extract("line", r'label="(\d+)\\ncells: (\d+)\\nSNVs: (\d+)', i)
    return lines.select("ord.node", F.concat_ws("|", part(1), part(2), part(3)).alias("label"))


_ONE = W("closure", "nodes", "cell_node", "snv_node") + ", five as (" + _LINES.format(label="", more="''", join="") + "), two as (select 0 part, 0 node, 0 \"to\", 'digraph T { label=\"\";' line union all "
_TWO = "select 1, p, 0, '  ' || p || ' [label=\"' || p || chr(92) || 'ncells: ' || (select count(*) from cell_node where cell_id % 2 = p) || chr(92) || 'nSNVs: ' || (select count(*) from snv_node where snv_id % 2 = p) || '\"];' from (values (0), (1)) t(p) union all select 2, 0, 1, '  0 -> 1;' union all select 3, 0, 0, '}') "


@query("k8_candidate_dots", _ONE + _TWO + "select 0 tree_id, line from five union all select 1, line from two")
def k8(s, d):
    """The texts of two candidate trees, each in its folder."""
    five = files.dot_lines(R.edges(s, d), R.cell_node(s, d), R.snv_node(s, d))
    by = lambda df, c: df.select(c, (F.col(c) % 2).cast("int").alias("node"))
    two = files.dot_lines(s.createDataFrame([(0, 1)], "parent int, child int"), by(R.cells(s, d), "cell_id"), by(R.snvs(s, d), "snv_id"))
    files.candidate_dots(five.withColumn("tree_id", F.lit(0)).union(two.withColumn("tree_id", F.lit(1))), at := _folder(s))
    return s.read.text(at).select("tree_id", F.col("value").alias("line"))


@query(
    "k9_results",
    W("cell_node", "snv_node", "nodes") + "select 'cells' name, cell_id id, cast(node as varchar) what from cell_node union all select 'snvs', snv_id, cast(node as varchar) from snv_node "
    "union all select 'losses', snv_id, '1' from snv_node where snv_id % 7 = 0 union all select 'events', node, case when node % 2 = 0 then 'gain' else 'loss' end from nodes",
)
def k9(s, d):
    lost = R.snv_node(s, d).where("snv_id % 7 = 0").withColumn("node", F.lit(1))
    events = tree.nodes(R.edges(s, d)).withColumn("state", F.when(F.col("node") % 2 == 0, "gain").otherwise("loss"))
    files.save_results(at := _folder(s), R.cell_node(s, d), R.snv_node(s, d), lost, events)
    back = None
    for name, ident, what in (("cells", "cell_id", "node"), ("snvs", "snv_id", "node"), ("losses", "snv_id", "node"), ("events", "node", "state")):
        one = s.read.option("header", True).csv(f"{at}/{name}").select(F.lit(name).alias("name"), F.col(ident).cast("long").alias("id"), F.col(what).alias("what"))
        back = one if back is None else back.union(one)
    return back


@query("x1_streamed_reads", W("reads") + "select * from reads")
def x1(s, d):
    """Extension: the reads arrive as a stream of files and are added up by key."""
    at = _folder(s)
    R.reads(s, d).repartition(3).write.parquet(f"{at}/in")
    stream = s.readStream.schema("cell_id long, snv_id long, var long, total long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    ingest.ingest(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return ingest.ingested(s, f"{at}/out").select("cell_id", "snv_id", "var", "total")
