"""Vector codes against brute force in Python's integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.llm import vector_codes


def brute(rows, parts, entries, rounds):
    """rows: (vec_id, label, vector), all kept."""
    v = [(i, lab, [math.floor(256 * x) for x in vec]) for i, lab, vec in rows]
    size = len(v[0][2]) // parts
    order = sorted(v, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p * size : (p + 1) * size] for r in order] for p in range(parts)]
    closest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, x in v:
                cut = x[p * size : (p + 1) * size]
                own[closest(cut, books[p])[1]].append(cut)
            for k, found in own.items():
                books[p][k] = [sum(c) // len(found) for c in zip(*found)]
    out, by = [], defaultdict(int)
    for i, lab, x in v:
        got = [closest(x[p * size : (p + 1) * size], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
        by[lab] += out[-1][3]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i is None, i, code, e, by[lab], digest) for i, lab, code, e in out), key=repr)


def of(df):
    return sorted(((r["vec_id"] is None, *r) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "x", "code", "error", "l", "part", "entry", "n", "s")})


def test_nearest_is_exact():
    """Bounds lose no nearest entry, ties go to the first, and most exact distances are saved."""
    rng = np.random.default_rng(4)
    for width in (1, 2, 4, 7, 32):
        entries = rng.integers(-300, 300, (64, width))
        entries[40] = entries[3]
        x = np.concatenate([entries[rng.integers(0, 64, 500)] + rng.integers(-20, 20, (500, width)), rng.integers(-2, 2, (200, width)), entries])
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        at, found, counted = vector_codes.nearest(x, entries)
        assert (at == d.argmin(1)).all() and (found == d.min(1)).all() and counted < 0.35 * d.size
    far = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    at, found, _ = vector_codes.nearest(far, np.array([[0, 0], [1 << 41, 0]]))
    assert at.tolist() == [0, 0] and [int(d) for d in found] == [2 << 80, 25]


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vec = lambda n=16: [float(x) for x in rng.standard_normal(n)]
    rows = [(i if i % 40 else None, [1, 1, 2, None][i % 4], vec()) for i in range(150)]
    rows += [(500, 3, [0.25] * 16)] * 40 + [(7, 2, vec()), (7, 2, vec()), (-3, None, [0.0] * 16), (-2, 9, [-0.001] * 16)]
    bad = [(900, 1, None), (901, 1, []), (902, 1, [float("nan")] * 16), (903, 1, [None] + [1.0] * 15), (904, 1, [float("inf")] * 16), (905, 1, [1.0] * 8), (-900, 1, None)]
    df = table(spark, rows + bad).repartition(5)
    for parts, entries, rounds in ((4, 8, 2), (8, 64, 1), (16, 3, 0), (2, 500, 2)):
        assert of(vector_codes.compress(df, parts, entries, rounds)) == brute(rows, parts, entries, rounds) or entries > 256
    assert vector_codes.compress(df.limit(0)).count() == 0 and vector_codes.compress(table(spark, bad[:5])).count() == 0
    assert of(vector_codes.compress(table(spark, rows[:5]), 4)) == brute(rows[:5], 4, 64, 2)
    with pytest.raises(ValueError):
        vector_codes.compress(df, parts=5)
    large = [(i, 1, [float(x) * 2.0**19 for x in rng.standard_normal(16)]) for i in range(8)]
    assert of(vector_codes.compress(table(spark, large), 4, 4)) == brute(large, 4, 4, 2)


def test_codes_stand_for_vectors(spark):
    """Decoded codes lie as far from the vectors as the error says."""
    rng = np.random.default_rng(9)
    rows = vector_codes.quantised(table(spark, [(i, 0, [float(x) for x in rng.standard_normal(16)]) for i in range(200)]), "embedding")
    books = vector_codes.codebooks(rows, 4, 16)
    both = vector_codes.decode(vector_codes.encode(rows, books), books).join(rows.select("vec_id", "v"), "vec_id")
    for r in both.collect():
        assert sum((a - b) ** 2 for a, b in zip(r["approx"], r["v"])) == r["error"]
