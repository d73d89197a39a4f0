"""Files in and out: variant reads, binned reads, arms, assignments, edge lists, embeddings, tree snapshots, DOT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree
from ..operators.counts import check_cells, check_unique

VARIANTS = "chr string, mutation_id string, cell_id string, base string, var long, total long, copies string"


def read_variants(spark: SparkSession, path: str, skip_first: bool = True, sep: str = "\t") -> DataFrame:
    """Variant reads without a header: chr, mutation_id, cell_id, base, var, total; a seventh field is ignored.

    With skip_first the first line of each file is dropped, as for a header.
    """
    got = spark.read.schema(VARIANTS).option("sep", sep).option("header", skip_first).option("enforceSchema", True).csv(path)
    return got.drop("copies")


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """A wide table (cell, one column for each bin) as rows (cell_id, bin, n): commas if the path has .csv, else tabs. Bins
    are numbered as their columns stand."""
    wide = spark.read.option("header", True).option("inferSchema", True).option("sep", "," if ".csv" in path else "\t").csv(path)
    names = [c for c in wide.columns if c != "cell"]
    pairs = F.array(*[F.struct(F.lit(i).alias("bin"), F.col(f"`{c}`").cast("double").alias("n")) for i, c in enumerate(names)])
    return wide.select(F.col("cell").alias("cell_id"), F.explode(pairs).alias("p")).select("cell_id", "p.bin", "p.n")


def read_arms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, arm string, start long, end long").csv(path)


def read_snv_bins(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("snv_idx long, chrom string, bin int").csv(path)


def validate(reads: DataFrame, bins: DataFrame) -> None:
    """Raise if a (cell, SNV) pair repeats or if a cell is in one input only."""
    if bad := check_unique(reads).take(1):
        raise ValueError(f"pairs repeat, such as {bad[0].asDict()}")
    if bad := check_cells(reads, bins).take(1):
        raise ValueError(f"cells differ, such as {bad[0].asDict()}")


def preview(df: DataFrame, n: int = 5) -> list:
    return df.limit(n).collect()


def cell_assignment(cell_node: DataFrame, names: DataFrame) -> DataFrame:
    """cluster, subcluster, cell, in the order of cell indexes. names: cell_id, cell."""
    return cell_node.join(names, "cell_id").orderBy("cell_id").select(F.col("node").alias("cluster"), F.lit(0).alias("subcluster"), "cell")


def snv_assignment(snv_node: DataFrame, names: DataFrame) -> DataFrame:
    return snv_node.join(names, "snv_id").orderBy("snv_id").select(F.col("node").alias("cluster"), "mutation")


def embedding_table(embedding: DataFrame) -> DataFrame:
    return embedding.orderBy("cell_id").select(F.col("cell_id").alias("cell"), F.col("vec")[0].alias("V1"), F.col("vec")[1].alias("V2"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edge list as text in one file: a few lines for each node of a tree."""
    tree.edge_text(edges).orderBy("ord").select("line").coalesce(1).write.text(path)


def save_tree(path: str, edges: DataFrame, cell_node: DataFrame, snv_node: DataFrame, lost: DataFrame | None = None) -> None:
    edges.write.parquet(f"{path}/edges")
    cell_node.write.parquet(f"{path}/cell_node")
    snv_node.write.parquet(f"{path}/snv_node")
    if lost is not None:
        lost.write.parquet(f"{path}/lost")


def load_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("edges", "cell_node", "snv_node"))


def save_results(path: str, cells: DataFrame, snvs: DataFrame, lost: DataFrame, states: DataFrame) -> None:
    for name, df in (("cells", cells), ("snvs", snvs), ("losses", lost), ("events", states)):
        write_csv(df, f"{path}/{name}")


def dot_lines(edges: DataFrame, cell_node: DataFrame, snv_node: DataFrame, scores: DataFrame | None = None, events: DataFrame | None = None, label: str = "") -> DataFrame:
    """(ord, line) of a DOT graph: a node shows its numbers of cells and SNVs and its rounded score, an edge its events.

    scores: node, score; events: parent, child, bin, before, after.
    """
    size = tree.nodes(edges).join(cell_node.groupBy("node").agg(F.count("*").alias("c")), "node", "left").join(snv_node.groupBy("node").agg(F.count("*").alias("m")), "node", "left").na.fill(0)
    size = size.withColumn("s", F.lit(None).cast("double")) if scores is None else size.join(scores.select("node", F.col("score").alias("s")), "node", "left")
    text = F.concat(F.format_string("%d\\ncells: %d\\nSNVs: %d", "node", "c", "m"), F.coalesce(F.concat(F.lit("\\n"), F.format_number("s", 2)), F.lit("")))
    body = size.select(F.struct(F.lit(1).alias("part"), "node", F.lit(0).alias("to")).alias("ord"), F.concat(F.format_string('  %d [label="', "node"), text, F.lit('"];')).alias("line"))
    named = edges.withColumn("e", F.lit(""))
    if events is not None:
        runs = tree.strings_of_runs(events.withColumn("kind", F.concat_ws(">", "before", "after")), ["parent", "child", "kind"])
        by = runs.groupBy("parent", "child").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "kind", "bins"))), "\\n").alias("e"))
        named = edges.join(by, ["parent", "child"], "left").na.fill("", ["e"])
    links = named.select(F.struct(F.lit(2).alias("part"), F.col("parent").alias("node"), F.col("child").alias("to")).alias("ord"), F.concat(F.format_string("  %d -> %d", "parent", "child"), F.when(F.col("e") != "", F.concat(F.lit(' [label="'), "e", F.lit('"]'))).otherwise(""), F.lit(";")).alias("line"))
    one = lambda part, line: edges.sparkSession.range(1).select(F.struct(F.lit(part).alias("part"), F.lit(0).alias("node"), F.lit(0).alias("to")).alias("ord"), F.lit(line).alias("line"))
    return one(0, f'digraph T {{ label="{label}";').union(body).union(links).union(one(3, "}"))


def candidate_dots(trees: DataFrame, path: str) -> None:
    """One folder of DOT text for each tree. trees: tree_id, ord, line."""
    trees.repartition("tree_id").sortWithinPartitions("tree_id", "ord").select("tree_id", "line").write.partitionBy("tree_id").text(path)
