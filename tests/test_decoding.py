"""Decoding in blocks against a plain decoder."""

from math import log, pi

import numpy as np
import pytest

from cladewise.operators import cna

EM = {"gain": (1.5, 0.04), "loss": (0.5, 0.04), "neutral": (1.0, 0.04)}


def plain(xs, beta=0.1):
    """(states, log-likelihood), in the units of the scores; ties as described."""
    t = [[round(v / cna.UNIT) for v in r] for r in cna.step(beta)]

    def emission(x):
        if x is None or not np.isfinite(x):
            return [0.0] * 3
        return [-0.5 * (log(2 * pi * v) + (x - m) ** 2 / v) for m, v in (EM[s] for s in cna.STATES)]

    e = [emission(x) for x in xs]
    scores, came = [round(v / cna.UNIT) for v in e[0]], []
    for row in e[1:]:
        came.append([max(range(3), key=lambda i: (scores[i] + t[i][j], -i)) for j in range(3)])
        scores = [scores[came[-1][j]] + t[came[-1][j]][j] + round(row[j] / cna.UNIT) for j in range(3)]
    path = [max(range(3), key=lambda i: (scores[i], i))]
    for c in reversed(came):
        path.append(c[path[-1]])
    path.reverse()
    total = log(1 / 3) + sum(e[k][s] for k, s in enumerate(path)) + sum(log(1 - beta) if a == b else log(beta / 2) for a, b in zip(path, path[1:]))
    return [cna.STATES[s] for s in path], total


@pytest.mark.parametrize("block", [8, 256])
def test_blocks_do_not_matter(spark, monkeypatch, block):
    """Gaps, negative places, ties, single bins, missing values; blocks of 8 make four levels."""
    monkeypatch.setattr(cna, "SCAN_BLOCK", block)
    rng = np.random.default_rng(3)
    levels = np.repeat(rng.choice([0.5, 1.0, 1.5], 12), 5)
    noisy = [float(v) for v in levels + rng.normal(0, 0.2, len(levels))]
    chroms = {
        "noisy": list(enumerate(noisy, -7)),
        "gaps": [(3 * k if k < 20 else 1000 + k, x) for k, x in enumerate(noisy[:40])],
        "ties": [(k, [1.25, 0.75][k % 2]) for k in range(9)],
        "one": [(4, 1.6)],
        "missing": [(0, None), (1, 1.5), (2, float("nan")), (3, None), (4, 0.5), (5, float("inf"))],
        "nothing": [(0, None), (1, None), (2, None)],
    }
    rows = [(c, k, x) for c, v in chroms.items() for k, x in v]
    got = cna.viterbi(spark.createDataFrame(rows, "chrom string, bin long, x double"), EM).collect()
    assert {r["chrom"] for r in got} == set(chroms)
    for r in got:
        bins, xs = zip(*chroms[r["chrom"]])
        states, total = plain(xs)
        assert [p["bin"] for p in r["path"]] == list(bins) and [p["state"] for p in r["path"]] == states, r["chrom"]
        assert r["loglik"] == pytest.approx(total, abs=1e-9)


def test_empty_profile(spark):
    empty = spark.createDataFrame([], "chrom string, bin long, x double")
    assert cna.decode(empty, EM).count() == 0 and cna.viterbi(empty, EM).count() == 0


def test_long_chromosome(spark):
    """A chromosome of 60,000 bins, over several tasks."""
    rng = np.random.default_rng(5)
    xs = np.repeat(rng.choice([0.5, 1.0, 1.5], 600), 100) + rng.normal(0, 0.2, 60_000)
    rows = spark.createDataFrame([("c", k, float(x)) for k, x in enumerate(xs)], "chrom string, bin long, x double")
    got = {r["bin"]: r["state"] for r in cna.decode(rows, EM).collect()}
    assert [got[k] for k in range(len(xs))] == plain([float(x) for x in xs])[0]
