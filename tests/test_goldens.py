"""Values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from cladewise.functions.likelihood import lattice, with_likelihoods
from cladewise.functions.uniform import required_observations, success_probability
from cladewise.operators import cna, scoring, select, tree
from cladewise.operators.bipartition import normalised_cut
from cladewise.operators.tree import canonical_form
from cladewise.search import split


def test_likelihoods(spark):
    want = {
        (0, 0): (0, 0), (0, 1): (-0.0010005003, -1.0969470093), (1, 1): (-6.9077552790, -0.4062987889), (0, 2): (-0.0020010007, -1.6492601077),
        (1, 2): (-6.2156085988, -1.2609183130), (2, 2): (-13.8155105580, -0.6454732970), (1, 3): (-5.8111439910, -1.5505206086),
        (3, 3): (-20.7232658369, -0.7909144872), (2, 5): (-11.5159269660, -1.8730342991),
    }
    rows = spark.createDataFrame(list(want), "var long, total long")
    for r in with_likelihoods(rows).collect():
        assert (r["ll0"], r["ll1"]) == pytest.approx(want[(r["var"], r["total"])], abs=1e-9)
    deep = with_likelihoods(spark.createDataFrame([(120, 120)], "var long, total long")).first()
    assert math.isfinite(deep["ll0"]) and math.isfinite(deep["ll1"])
    assert len(lattice()) == 10 and sum(w for _, w in lattice()) == pytest.approx(1)


def test_power():
    assert required_observations(6, 7, 0.95, 10**6) == 4113
    assert required_observations(6, 10, 0.95, 10**6) == 5876
    assert required_observations(6, 10, 0.95, 100) == 100
    assert success_probability(59, 6, 10) == 0
    with pytest.raises(ValueError):
        required_observations(6, 10, 0.95, 0)


def test_tree_score(spark):
    reads = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 0, 1), (1, 0, 1, 2), (1, 1, 1, 1), (2, 0, 0, 2), (2, 1, 2, 2), (2, 2, 1, 3)], "cell_id long, snv_id long, var long, total long")
    edges = spark.createDataFrame([(0, 1)], "parent int, child int")
    cells = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "cell_id long, node int")
    snvs = spark.createDataFrame([(0, 0), (1, 1)], "snv_id long, node int")
    vec = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])], "cell_id long, vec array<double>")
    facts = with_likelihoods(reads)
    by = {r["node"]: r["variant"] for r in scoring.variant_by_node(facts, edges, cells, snvs).collect()}
    assert by == pytest.approx({0: -0.407299289, 1: -9.773094498}, abs=1e-8)
    depth = {r["node"]: r["depth"] for r in scoring.depth_by_node(vec, cells).collect()}
    assert depth == pytest.approx({0: 0, 1: -2.837877066}, abs=1e-8)
    total = scoring.tree_loglik(facts, edges, cells, snvs, vec).first()
    assert (total["loglik"], total["norm"]) == pytest.approx((-13.018270853, -2.169711809), abs=1e-8)


def test_relations(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4)], "parent int, child int")
    assert {tuple(r)[:2] for r in tree.closure(edges).collect()} == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 3), (1, 4)}
    assert {tuple(r) for r in tree.incomparable_nodes(edges).collect()} == {(1, 2), (2, 3), (2, 4), (3, 4)}
    owned = spark.range(100).select(F.col("id").alias("cell_id"), (F.col("id") % 5).cast("int").alias("node"))
    assert {r["relation"]: r["n"] for r in tree.pair_counts(edges, owned).collect()} == {"ancestor": 2400, "cluster": 950, "incomparable": 1600}
    assert tree.ancestor_pairs(edges, owned, "cell_id").count() == 2400 and tree.incomparable_pairs(edges, owned, "cell_id").count() == 1600
    with pytest.raises(NotImplementedError):
        tree.ancestor_pairs(edges, owned, "cell_id", lost=owned)
    assert [r["line"] for r in tree.edge_text(spark.createDataFrame([(0, 1), (1, 2)], "parent int, child int")).orderBy("ord").collect()] == ["2 #edges", "0 1", "1 2", "1 #leaves", "2"]


def test_elbow(spark):
    best = spark.createDataFrame([(1, 1000.0), (2, 900.0), (3, 700.0), (4, 690.0), (5, 685.0)], "num_nodes int, nll double")
    got = {r["num_nodes"]: r["f"] for r in select.elbow(best).collect()}
    assert got == pytest.approx({2: -0.122222222, 3: 0.207936508, 4: 0.007039337, 5: -0.017753623}, abs=1e-8)
    assert select.first_max(select.elbow(best), "f", "num_nodes").first()["num_nodes"] == 3


def test_viterbi(spark):
    profile = spark.createDataFrame([(0, i, x) for i, x in enumerate([1.0, 1.45, 1.55, 0.55])], "chrom int, bin int, x double")
    got = cna.viterbi(profile, {"gain": (1.5, 0.04), "loss": (0.5, 0.04), "neutral": (1.0, 0.04)}).first()
    assert [p["state"] for p in got["path"]] == ["neutral", "gain", "gain", "loss"]
    assert got["loglik"] == pytest.approx(-4.527189835, abs=1e-8)
    one = cna.viterbi(profile.where("bin = 0"), {"gain": (1.5, 0.04), "loss": (0.5, 0.04), "neutral": (1.0, 0.04)}).first()
    assert len(one["path"]) == 1


def test_bin_strings(spark):
    rows = [(0, 7)] + [(1, b) for b in (3, 9)] + [(2, b) for b in (1, 2, 3, 7, 8)] + [(3, b) for b in (1, 2, 5)]
    got = {r["g"]: r["bins"] for r in tree.strings_of_runs(spark.createDataFrame(rows, "g int, bin int"), ["g"]).collect()}
    assert got == {0: "7", 1: "3-9", 2: "1-3, 7-8", 3: "1-2, 5-5"}


def test_isomorphism():
    a = canonical_form([(0, 1), (0, 2), (2, 3)], {0: 1, 1: 5, 2: 2, 3: 4})
    b = canonical_form([(0, 1), (0, 2), (1, 3)], {0: 1, 1: 2, 2: 5, 3: 4})
    c = canonical_form([(0, 1), (0, 2), (1, 3)], {0: 1, 1: 5, 2: 2, 3: 4})
    assert a == b != c


def test_cut_recovers_clusters():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, m in ((30, 30), (10, 90)):
        x = np.concatenate([rng.normal(0, 0.05, n), rng.normal(1, 0.05, m)])
        d = np.abs(x[:, None] - x[None, :])
        labels = normalised_cut(np.exp(-d / (0.2 * d.max())))
        assert len(set(labels[:n])) == 1 and len(set(labels[n:])) == 1 and labels[0] != labels[-1]
    assert normalised_cut(np.ones((1, 1))) is None


def test_nested_splits_become_a_chain(spark):
    outer = spark.createDataFrame([(i, "A" if i < 6 else "B") for i in range(9)], "cell_id long, part string")
    mid = spark.createDataFrame([(i, "A" if i < 4 else "B") for i in range(6)], "cell_id long, part string")
    inner = spark.createDataFrame([(i, "A" if i < 1 else "B") for i in range(4)], "cell_id long, part string")
    got = {r["cell_id"]: r["node"] for r in split.chain_nodes([outer, mid, inner], "cell_id").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 3}
