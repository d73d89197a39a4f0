"""Nearest donors against comparing all pairs."""

import numpy as np
import pytest

from cladewise.operators import donors


def brute(vectors, have):
    """{cell: nearest donor} by all pairs."""
    usable = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v)}
    return {i: min((float(np.sqrt(((usable[j] - usable[i]) ** 2).sum())), j) for j in usable if have[j])[1] for i in usable if not have[i]}


def tables(spark, vectors, have):
    v = spark.createDataFrame([(i, x) for i, x in vectors.items()], "cell_id long, vec array<double>")
    f = spark.createDataFrame([(i, 0.5 + i if h else None, float(i)) for i, h in have.items()], "cell_id long, fa double, fb double")
    return v, f


@pytest.mark.parametrize("block", [7, 500])
def test_nearest_donor(spark, monkeypatch, block):
    """Clusters, ties, a third of all vectors alike, vectors without a distance; in one block a ball and in many."""
    monkeypatch.setattr(donors, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 5, (8, 3))
    vectors = {i: [float(x) for x in np.round(centres[i % 8] + rng.normal(0, 0.4, 3), 1)] for i in range(300)}
    vectors |= {i: [0.0, 0.0, 0.0] for i in range(300, 450)}
    vectors |= {450: None, 451: [], 452: [1.0, None, 2.0], 453: [float("nan"), 0.0, 0.0], 454: [float("inf"), 0.0, 0.0], 455: None}
    have = {i: i % 4 > 0 for i in vectors}
    v, f = tables(spark, vectors, have)
    got = {r["cell_id"]: r["donor"] for r in donors.nearest_donor(v, f, ["fa", "fb"]).collect()}
    assert got == brute(vectors, have)
    filled = {r["cell_id"]: (r["fa"], r["fb"]) for r in donors.impute(f, v, ["fa", "fb"]).collect()}
    assert filled == {i: (0.5 + i, float(i)) if have[i] else (0.5 + got[i], float(got[i])) if i in got else (None, float(i)) for i in vectors}


def test_few_rows_are_compared(spark, monkeypatch):
    """On clustered vectors a cell meets less than a fifth of the donors."""
    met = []
    plain = donors._compare

    def counting(cells, balls):
        sizes = balls.selectExpr("pivot", "size(y_rows) n").groupBy("pivot").sum("n").toDF("pivot", "n")
        met.append(cells.join(sizes, "pivot").groupBy().sum("n").first()[0] or 0)
        return plain(cells, balls)

    monkeypatch.setattr(donors, "_compare", counting)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 6, (20, 8))
    vectors = {i: [float(x) for x in centres[i % 20] + rng.normal(0, 0.3, 8)] for i in range(2000)}
    have = {i: i % 5 > 0 for i in vectors}
    v, f = tables(spark, vectors, have)
    got = {r["cell_id"]: r["donor"] for r in donors.nearest_donor(v, f, ["fa", "fb"]).collect()}
    assert got == brute(vectors, have)
    assert sum(met) < 0.2 * sum(have.values()) * sum(not h for h in have.values())


def test_nothing_to_give(spark):
    v, f = tables(spark, {1: [0.0], 2: [1.0]}, {1: False, 2: False})
    assert donors.nearest_donor(v, f, ["fa", "fb"]).count() == 0
    assert {tuple(r) for r in donors.impute(f, v, ["fa", "fb"]).collect()} == {(1, None, 1.0), (2, None, 2.0)}
    v, f = tables(spark, {1: None, 2: [1.0]}, {1: True, 2: False})
    assert [r["fa"] for r in donors.impute(f, v, ["fa", "fb"]).orderBy("cell_id").collect()] == [1.5, None]
    empty = f.where("false")
    assert donors.nearest_donor(v, empty, ["fa"]).count() == 0 and donors.impute(empty, v, ["fa"]).count() == 0
