"""Command line: variant reads and binned reads in, clonal tree out."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Params
from .functions.likelihood import with_likelihoods
from .operators import bipartition, counts, layout
from .search import trees
from .sources import files, pictures
from .storage import keep

# Names, short forms and defaults of the options of the tool this one stands in for.
NUMBERS = [
    ("-a", "--alpha", float, 1e-3, "error rate of a base"),
    ("-j", "--iterations", int, 50, "turns of a restart at most"),
    ("-s", "--starts", int, 16, "restarts of a split"),
    ("-d", "--seed", int, 99059, "seed"),
    (None, "--radius", float, 1.0, "quantile of the copy distance at which the kernel is cut"),
    ("-c", "--copies", int, 5, "copies at most"),
    (None, "--runs", int, 1, "searches, of which the best counts"),
    ("-g", "--gamma", float, 0.95, "power asked of the number of observations"),
    (None, "--min_obs", int, 10, "observations wanted in each part"),
    (None, "--low_cmb", float, 0.05, "burden that parts without an SNV may have at most"),
    (None, "--high_cmb", float, 0.15, "burden that parts with an SNV must have at least"),
    (None, "--nobs_per_cluster", int, 3, "median observations that a part must have"),
]
OUTPUTS = [
    ("-n", "--pred_cell", "clusters of cells"),
    ("-m", "--pred-mut", "clusters of SNVs"),
    (None, "--tree", "the best tree: a PNG file if the name ends with .png, else DOT text"),
    (None, "--tree_pickle", "the best tree as a folder of tables"),
    (None, "--tree_path", "PNG files of all candidate trees, and DOT text in a folder for each"),
    (None, "--tree_list", "all candidate trees as folders of tables"),
    (None, "--tree_text", "edges of the best tree"),
    (None, "--likelihood", "normalised likelihoods of all candidate trees"),
    (None, "--embedding", "coordinates of the cells"),
]


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladewise", allow_abbrev=False)
    p.add_argument("-f", "--file", required=True, help="variant reads, tab-separated")
    p.add_argument("--bin_count_data", required=True, help="binned reads, a row for each cell")
    for short, name, kind, default, text in NUMBERS:
        p.add_argument(*filter(None, (short, name)), type=kind, default=default, help=text)
    for short, name, text in OUTPUTS:
        p.add_argument(*filter(None, (short, name)), help=text)
    p.add_argument("--post_process", action="store_true", help="refine the best tree")
    p.add_argument("--no-umap", action="store_true", help="take the bins as coordinates")
    p.add_argument("--principal_components", action="store_true", help="extension: place cells by two principal components")
    p.add_argument("--keep_first_line", action="store_true", help="extension: the variant file has no header to drop")
    p.add_argument("--no_copy_kernel", action="store_true", help="extension: begin without the copy kernel")
    p.add_argument("--documented", action="store_true", help="extension: behave as documented where the two differ")
    p.add_argument("--mode", choices=["rd", "var"], default="rd", help="extension: score read depth and variants, or variants only")
    return p


def drawn(some: list[trees.Tree]) -> DataFrame:
    """Pictures of the trees, numbered from 0."""
    parts = [[df.withColumn("tree_id", F.lit(i).cast("long")) for df in (t.edge_table(), t.cell_node, t.snv_node)] for i, t in enumerate(some)]
    edges, cells, snvs = (reduce(DataFrame.unionByName, side) for side in zip(*parts))
    return pictures.pictures(edges, pictures.node_lines(edges, cells, snvs))


def run(spark: SparkSession, argv: list[str] | None = None) -> trees.Found:
    o = options().parse_args(argv)
    raw = counts.composite_key(files.read_variants(spark, o.file, not o.keep_first_line))
    bins = files.read_bins(spark, o.bin_count_data).withColumn("cell", F.col("cell_id").cast("string")).drop("cell_id")
    cells, snvs = keep(counts.dense_ids(raw, "cell_id", "idx", 16)), keep(counts.dense_ids(raw, "chr_mutation", "idx", 16))
    cells = cells.select(F.col("idx").cast("long").alias("cell_id"), F.col("cell_id").alias("cell"))
    snvs = snvs.select(F.col("idx").cast("long").alias("snv_id"), F.col("chr_mutation").alias("mutation"))
    facts = raw.select(F.col("cell_id").alias("cell"), F.col("chr_mutation").alias("mutation"), "var", "total").join(cells, "cell").join(snvs, "mutation").select("cell_id", "snv_id", "var", "total")
    by_cell = bins.join(cells, "cell", "left").select("cell_id", "bin", "n")
    files.validate(facts, by_cell)
    facts = keep(with_likelihoods(facts, o.alpha, o.copies))
    if o.no_umap:
        vectors = counts.bin_vectors(by_cell)
    else:
        shares = counts.bin_vectors(counts.normalised_bins(by_cell), "share")
        vectors = bipartition.pca(shares) if o.principal_components else layout.layout(shares)
    data = trees.Data(facts, keep(vectors))
    params = Params(o.alpha, o.copies, o.gamma, o.min_obs, o.radius, o.low_cmb, o.high_cmb, o.nobs_per_cluster, o.starts, o.iterations, o.seed, not o.no_copy_kernel, o.post_process, not o.documented)
    found = trees.best_of_runs(data, params, o.runs, o.mode == "rd")
    tree = found.tree
    print(f"normalised log-likelihood {found.norm}, {len(tree.ncells)} nodes")
    dot = lambda t: files.dot_lines(t.edge_table(), t.cell_node, t.snv_node)
    if o.pred_cell:
        files.write_csv(files.cell_assignment(tree.cell_node, cells), o.pred_cell)
    if o.pred_mut:
        files.write_csv(files.snv_assignment(tree.snv_node, snvs), o.pred_mut)
    if o.tree and o.tree.lower().endswith(".png"):
        pictures.write_pictures(drawn([tree]), lambda _: o.tree)
    elif o.tree:
        dot(tree).orderBy("ord").select("line").coalesce(1).write.text(o.tree)
    if o.tree_pickle:
        files.save_tree(o.tree_pickle, tree.edge_table(), tree.cell_node, tree.snv_node)
    for lo in range(0, len(found.candidates) if o.tree_path else 0, trees.BATCH):
        some = found.candidates[lo : lo + trees.BATCH]
        scores = {r["tree_id"]: r["loglik"] for r in trees.score(some, data, o.mode == "rd").collect()} if found.series else {}  # a row for each tree
        pictures.write_pictures(drawn(some), lambda i: f"{o.tree_path}/{pictures.candidate_name(lo + i, scores.get(i), params.compat)}")  # noqa: B023
    for i, t in enumerate(found.candidates):
        if o.tree_path:
            dot(t).orderBy("ord").select("line").coalesce(1).write.text(f"{o.tree_path}/tree_{i}")
        if o.tree_list:
            files.save_tree(f"{o.tree_list}/tree_{i}", t.edge_table(), t.cell_node, t.snv_node)
    if o.tree_text:
        files.write_edges(tree.edge_table(), o.tree_text)
    if o.likelihood:
        files.write_csv(spark.createDataFrame(sorted(found.series.items()), "tree long, likelihood double"), o.likelihood)
    if o.embedding:
        files.write_csv(files.embedding_table(data.vec), o.embedding)
    return found


def main() -> None:
    run(SparkSession.builder.getOrCreate())


if __name__ == "__main__":
    main()
