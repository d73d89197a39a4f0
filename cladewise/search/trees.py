"""Tree search: seeds, elementary trees, composite trees, choice.

The driver keeps the metadata of a search: keys, edges, numbers of cells. Cells and SNVs stay in tables.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from math import inf
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions.uniform import required_observations
from ..operators import counts, refine, scoring
from ..operators.tree import canonical_form
from ..storage import keep
from . import split


#: Trees that one job scores.
BATCH = 64


def seed_of(node: int, cell_node: DataFrame, snv_node: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cell_node.where(F.col("node") == node).select("cell_id"), snv_node.where(F.col("node") == node).select("snv_id")


@dataclass
class Seed:
    """A sub-problem. `linear` tells that its linear tree is known, so that only branching is tried."""

    cells: DataFrame
    snvs: DataFrame
    linear: Tree | None = None

    def set_linear(self, tree: Tree) -> None:
        self.linear = tree

    def has_linear(self) -> bool:
        return self.linear is not None

    def key(self) -> tuple:
        """Equal for seeds of the same cells and SNVs, in any order."""
        sums = [df.agg(F.count("*"), F.sum(F.xxhash64(c).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(c))).first() for df, c in ((self.cells, "cell_id"), (self.snvs, "snv_id"))]
        return tuple(map(tuple, sums))


@dataclass
class Tree:
    edges: list[tuple[int, int]]
    cell_node: DataFrame
    snv_node: DataFrame
    kind: str = "identity"
    ncells: dict[int, int] = field(default_factory=dict)
    lost: DataFrame | None = None  # node, snv_id
    label: str = ""

    def set_key(self, label: str) -> None:
        self.label = label

    def has_loss(self) -> bool:
        return self.lost is not None and not self.lost.isEmpty()

    def __post_init__(self):
        if not self.ncells:
            nodes = {x for e in self.edges for x in e} or {0}
            got = {r["node"]: r["n"] for r in self.cell_node.groupBy("node").agg(F.count("*").alias("n")).collect()}
            self.ncells = {n: got.get(n, 0) for n in nodes}

    def form(self) -> str:
        return canonical_form(self.edges, self.ncells)

    def leaves(self) -> list[int]:
        return sorted(set(self.ncells) - {p for p, _ in self.edges})

    def next_label(self) -> int:
        return max(self.ncells) + 1

    def edge_table(self) -> DataFrame:
        return self.cell_node.sparkSession.createDataFrame(self.edges, "parent int, child int")

    def seeds(self) -> dict[int, Seed]:
        """The sub-problems that an elementary tree leaves open, by node."""
        nodes = {"linear": [max(self.ncells)], "branching": [1, 2]}.get(self.kind, [])
        return {n: Seed(*seed_of(n, self.cell_node, self.snv_node)) for n in nodes}


def linear_tree(cells: DataFrame, snvs: DataFrame) -> Tree:
    """Node 0: parts A; node 1: parts B. cells with cp, snvs with sp."""
    to = lambda df, c, i: keep(df.select(i, F.when(F.col(c) == "A", 0).otherwise(1).alias("node")))
    return Tree([(0, 1)], to(cells, "cp", "cell_id"), to(snvs, "sp", "snv_id"), "linear")


def branching_tree(cells: DataFrame, snvs: DataFrame) -> Tree:
    """Node 0: SNVs C and no cells; nodes 1 and 2: parts A and B."""
    at = lambda c: F.when(F.col(c) == "A", 1).when(F.col(c) == "B", 2).otherwise(0)
    return Tree([(0, 1), (0, 2)], keep(cells.select("cell_id", at("cp").alias("node"))), keep(snvs.select("snv_id", at("sp").alias("node"))), "branching")


def identity_tree(cells: DataFrame, snvs: DataFrame) -> Tree:
    return Tree([], keep(cells.select("cell_id", F.lit(0).alias("node"))), keep(snvs.select("snv_id", F.lit(0).alias("node"))))


def chain_trees(chain: list[split.Split]) -> tuple[Tree, list[Seed]]:
    """The innermost of nested linear splits as a tree, and the seeds that it leaves open, from the inside out.

    Each of these seeds holds what is outside a split's part A. All but the last have their linear tree preset: the next
    split outwards, whose node 0 is what that has in A more than the one inside.
    """
    first = linear_tree(chain[-1].cells, chain[-1].snvs)
    seeds, tree, inner = [], first, chain[-1]
    for outer in reversed(chain[:-1]):
        part = lambda o, i, c, ident: o.join(i.where(F.col(c) == "A").select(ident), ident, "left_anti")
        preset = linear_tree(part(outer.cells, inner.cells, "cp", "cell_id"), part(outer.snvs, inner.snvs, "sp", "snv_id"))
        seeds.append(Seed(*seed_of(1, tree.cell_node, tree.snv_node), linear=preset))
        tree, inner = preset, outer
    return first, [*seeds, Seed(*seed_of(1, tree.cell_node, tree.snv_node))]


def merge(big: Tree, leaf: int, small: Tree) -> Tree:
    """Put `small` in the place of a leaf of `big`; its root takes the leaf's label and its other nodes new ones."""
    top = big.next_label()
    root = next(n for n in sorted(small.ncells) if n not in {c for _, c in small.edges})
    names = {root: leaf} | {n: top + i for i, n in enumerate(sorted(set(small.ncells) - {root}))}
    to = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    swap = lambda a, b, i: keep(a.where(F.col("node") != leaf).select(i, "node").union(b.select(i, F.element_at(to, F.col("node")).alias("node"))))
    ncells = {n: k for n, k in big.ncells.items() if n != leaf} | {names[n]: k for n, k in small.ncells.items()}
    return Tree(big.edges + [(names[p], names[c]) for p, c in small.edges], swap(big.cell_node, small.cell_node, "cell_id"), swap(big.snv_node, small.snv_node, "snv_id"), "composite", ncells)


class TreeList:
    """Trees in order of arrival, with running keys; equal forms count as one tree."""

    def __init__(self):
        self.queue: deque[Tree] = deque()
        self.forms: set[str] = set()
        self.total = 0

    def insert(self, tree: Tree) -> int:
        self.queue.append(tree)
        self.forms.add(tree.form())
        self.total += 1
        return self.total - 1

    def contains(self, tree: Tree) -> bool:
        return tree.form() in self.forms

    def pop(self) -> Tree:
        return self.queue.popleft()

    def get(self, place: int) -> Tree:
        return self.queue[place]

    def index(self, tree: Tree) -> int:
        return next((i for i, t in enumerate(self.queue) if t.form() == tree.form()), -1)

    def all(self) -> list[Tree]:
        return list(self.queue)

    def __len__(self) -> int:
        return len(self.queue)


@dataclass
class Data:
    """The tables of a run: facts with ll0 and ll1, and cell vectors."""

    facts: DataFrame
    vec: DataFrame


def plant(data: Data, params: Params, min_obs: int) -> tuple[dict[tuple, list[Tree]], tuple]:
    """Elementary trees for each seed reached from all cells and SNVs, by seed key; and the key of the first seed.

    Seeds are taken last in, first out. A seed with a preset linear tree has that one, and only branching is tried.
    """
    first = Seed(keep(data.facts.select("cell_id").distinct()), keep(data.facts.select("snv_id").distinct()))
    work, memo = [(first, first.key())], {}
    start = work[0][1]
    while work:
        seed, key = work.pop()
        if key in memo:
            continue
        memo[key] = [seed.linear] if seed.has_linear() else []
        cells, snvs = counts.strip(data.facts, seed.cells, seed.snvs)
        cells, snvs = keep(cells), keep(snvs)
        mine = keep(counts.block(data.facts, cells, snvs))
        if mine.where("total > 0").count() < min_obs:
            continue
        more: list[Seed] = []
        if not seed.has_linear():
            if chain := split.linear_chain(mine, cells, snvs, data.vec, params, min_obs):
                tree, more = chain_trees(chain)
                seed.set_linear(tree)
                memo[key].append(tree)
        if got := split.search("branching", mine, cells, snvs, data.vec, params):
            tree = branching_tree(got.cells, got.snvs)
            memo[key].append(tree)
            more += tree.seeds().values()
        work += [(s, s.key()) for s in more]
    return memo, start


def grow(memo: dict[tuple, list[Tree]], start: tuple, most: float = inf) -> list[Tree]:
    """All trees that arise by putting elementary trees in the place of leaves, one for each form; growing stops once there
    are more than `most`."""
    every, queue = TreeList(), TreeList()
    for t in memo[start]:
        queue.insert(t)
        every.insert(t)
    while len(queue) and every.total <= most:
        t = queue.pop()
        for leaf in t.leaves():
            key = Seed(*seed_of(leaf, t.cell_node, t.snv_node)).key()
            for small in memo.get(key, []):
                made = merge(t, leaf, small)
                if not every.contains(made):
                    every.insert(made)
                    queue.insert(made)
    return every.all()


def score(trees: list[Tree], data: Data, depth: bool = True) -> DataFrame:
    """(tree_id, loglik, norm) in one job."""
    spark = data.facts.sparkSession
    edges = spark.createDataFrame([(i, p, c) for i, t in enumerate(trees) for p, c in t.edges], "tree_id int, parent int, child int")
    cells = snvs = None
    for i, t in enumerate(trees):
        c, m = (df.select(F.lit(i).alias("tree_id"), x, "node") for df, x in ((t.cell_node, "cell_id"), (t.snv_node, "snv_id")))
        cells, snvs = (c, m) if cells is None else (cells.union(c), snvs.union(m))
    return scoring.trees_loglik(data.facts, edges, cells, snvs, data.vec if depth else None)


class Found(NamedTuple):
    """The best tree, its normalised likelihood (None for the one-node tree), those of all candidates, and these."""

    tree: Tree
    norm: float | None
    series: dict[int, float]
    candidates: list[Tree]


def search(data: Data, params: Params, depth: bool = True) -> Found:
    """Best of all trees that can be grown from the data."""
    observed = data.facts.where("total > 0").count()
    min_obs = required_observations(6, params.min_obs, params.gamma, observed)
    memo, start = plant(data, params, min_obs)
    trees = grow(memo, start)
    if not trees:
        only = identity_tree(data.facts.select("cell_id").distinct(), data.facts.select("snv_id").distinct())
        return Found(only, None, {}, [only])
    series = {}
    for lo in range(0, len(trees), BATCH):  # a row for each tree
        series |= {lo + r["tree_id"]: r["norm"] for r in score(trees[lo : lo + BATCH], data, depth).collect()}
    best = max(sorted(series), key=lambda i: series[i])
    tree, norm = trees[best], series[best]
    if params.post_process:
        cells, snvs = refine.post_process(data.facts, tree.edge_table(), tree.cell_node, tree.snv_node, store=keep)
        tree = Tree(tree.edges, cells, snvs, "refined")
        norm = score([tree], data, depth).first()["norm"]
    return Found(tree, norm, series, trees)


def best_of_runs(data: Data, params: Params, runs: int, depth: bool = True) -> Found:
    """The best of several searches; run i has seed 100 x seed + i."""
    best = None
    for i in range(runs):
        got = search(data, params.but(seed=100 * params.seed + i), depth)
        if best is None or (got.norm is not None and (best.norm is None or got.norm > best.norm)):
            best = got
    return best
