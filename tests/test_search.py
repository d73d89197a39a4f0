"""Searches on planted clones, with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladewise.config import Params
from cladewise.functions.likelihood import with_likelihoods
from cladewise.functions.uniform import uniform
from cladewise.operators import assign, bipartition, refine, scoring, tree
from cladewise.search import split, starts, trees

#: Clones: cells 0-19, 20-39, 40-59 in order of a path; SNVs 0-29 in all, 30-59 from the second on, 60-89 in the third.
PATH = {0: 0, 1: 1, 2: 2}
FEW = Params(starts=2, iterations=4, min_obs=1)


def planted(spark, has, cells=60, snvs=90):
    """facts and vectors: 3 of 6 reads vary where has(cell, snv)."""
    rows = [(c, m, 3 if has(c, m) else 0, 6) for c in range(cells) for m in range(snvs)]
    facts = with_likelihoods(spark.createDataFrame(pd.DataFrame(rows, columns=["cell_id", "snv_id", "var", "total"])))
    # Seven points: two cells of a clone have not quite the same bins.
    vec = spark.createDataFrame([(c, [float(c // 20), (c % 7) / 100]) for c in range(cells)], "cell_id long, vec array<double>")
    return trees.keep(facts), trees.keep(vec)


def on_path(c, m):
    return m // 30 <= c // 20


def on_branches(c, m):
    """SNVs 0-29 everywhere, 30-59 in cells 0-29, 60-89 in the others."""
    return m < 30 or (m < 60) == (c < 30)


def groups(df, ident, col):
    out = {}
    for r in df.collect():
        out.setdefault(r[col], set()).add(r[ident])
    return out


def test_linear_and_branching_search(spark):
    """T1, T2, T4: the split that was planted."""
    facts, vec = planted(spark, lambda c, m: m < 45 or c >= 30)
    cells, snvs = facts.select("cell_id").distinct(), facts.select("snv_id").distinct()
    got = split.search("linear", facts, cells, snvs, vec, FEW)
    assert groups(got.cells, "cell_id", "cp") == {"A": set(range(30)), "B": set(range(30, 60))}
    assert groups(got.snvs, "snv_id", "sp") == {"A": set(range(45)), "B": set(range(45, 90))}
    lab = facts.join(got.cells, "cell_id").join(got.snvs, "snv_id")
    assert got.norm == pytest.approx(scoring.linear_norm(lab).first()["norm"])
    facts, vec = planted(spark, on_branches)
    got = split.search("branching", facts, cells, snvs, vec, Params(starts=6, iterations=6))
    sides = groups(got.cells, "cell_id", "cp")
    assert {frozenset(x) for x in sides.values()} == {frozenset(range(30)), frozenset(range(30, 60))}
    parts = groups(got.snvs, "snv_id", "sp")
    assert parts["C"] == set(range(30)) and parts["A" if 0 in sides["A"] else "B"] == set(range(30, 60))


def test_nested_linear_splits_preset_seeds(spark):
    """T2, T6, T9, T21: each inner split presets the linear tree of the seed outside it."""
    facts, vec = planted(spark, on_path)
    cells, snvs = facts.select("cell_id").distinct(), facts.select("snv_id").distinct()
    part = lambda df, ident, cut, c: df.select(ident, F.when(F.col(ident) < cut, "A").otherwise("B").alias(c))
    chain = [split.Split(-0.5, part(cells, "cell_id", 40, "cp"), part(snvs, "snv_id", 60, "sp")), split.Split(-0.4, part(cells, "cell_id", 20, "cp"), part(snvs, "snv_id", 30, "sp"))]
    first, seeds = trees.chain_trees(chain)
    assert groups(first.cell_node, "cell_id", "node") == {0: set(range(20)), 1: set(range(20, 60))}
    assert [s.has_linear() for s in seeds] == [True, False]
    assert groups(seeds[0].linear.cell_node, "cell_id", "node") == {0: set(range(20, 40)), 1: set(range(40, 60))}
    assert groups(seeds[0].linear.snv_node, "snv_id", "node") == {0: set(range(30, 60)), 1: set(range(60, 90))}
    assert {r["cell_id"] for r in seeds[1].cells.collect()} == set(range(40, 60))
    # the preset is found under the key of the leaf, so growing gives the whole path
    start = trees.Seed(cells, snvs).key()
    memo = {start: [first], seeds[0].key(): [seeds[0].linear]}
    grown = trees.grow(memo, start)
    assert [len(t.ncells) for t in grown] == [2, 3] and grown[1].edges == [(0, 1), (1, 2)]
    assert groups(grown[1].cell_node, "cell_id", "node") == {i: set(range(20 * i, 20 * i + 20)) for i in range(3)}


def test_search_finds_the_path(spark):
    """T7, T8, T11, T19: plant, grow, score, choose the best run."""
    facts, vec = planted(spark, on_path)
    data = trees.Data(facts, vec)
    best, norm, series, candidates = trees.best_of_runs(data, FEW.but(post_process=True), runs=1)
    assert sorted(map(frozenset, groups(best.cell_node, "cell_id", "node").values()), key=min) == [frozenset(range(20 * i, 20 * i + 20)) for i in range(3)]
    assert sorted(map(frozenset, groups(best.snv_node, "snv_id", "node").values()), key=min) == [frozenset(range(30 * i, 30 * i + 30)) for i in range(3)]
    assert len(series) == len(candidates) > 1 and norm == pytest.approx(max(series.values()))
    tree_, norm, series, _ = trees.search(trees.Data(trees.keep(with_likelihoods(facts.select("cell_id", "snv_id", F.lit(0).cast("long").alias("var"), "total"))), vec), FEW)
    assert (tree_.kind, norm, series) == ("identity", None, {})
    with pytest.raises(ValueError):
        trees.search(trees.Data(facts.limit(0), vec), FEW)


def test_growing_has_no_cap(spark):
    """T11: every leaf can be split in two; all shapes come, unless a limit is asked for."""
    cells, snvs = spark.range(64).select(F.col("id").alias("cell_id")), spark.range(64).select(F.col("id").alias("snv_id"))
    memo, work = {}, [(trees.Seed(cells, snvs), 64)]
    start = work[0][0].key()
    while work:
        seed, n = work.pop()
        low = seed.cells.agg(F.min("cell_id")).first()[0]
        cut = low + n // 4  # sides of different sizes, so that shapes differ
        t = trees.branching_tree(*(df.select(i, F.when(F.col(i) < cut, "A").otherwise("B").alias(c)) for df, i, c in ((seed.cells, "cell_id", "cp"), (seed.snvs, "snv_id", "sp"))))
        memo[seed.key()] = [t]
        if n > 16:
            work += [(s, k) for s, k in zip(t.seeds().values(), (n // 4, n - n // 4)) if k > 16]
    grown = trees.grow(memo, start)
    assert len({t.form() for t in grown}) == len(grown) > 2
    assert len(trees.grow(memo, start, most=1)) < len(grown)


def test_weighted_starts(spark):
    """T1: the same SNVs as drawing by keys in Python; coins where a fraction is missing."""
    f = [(i, (i % 7) / 10) for i in range(40)]
    pool = spark.range(40).select(F.col("id").alias("snv_id")).crossJoin(spark.createDataFrame([(0,), (1,)], "start_id int"))
    u = {(r["start_id"], r["snv_id"]): r["u"] for r in pool.withColumn("u", uniform(5, F.col("start_id"), F.col("snv_id"))).collect()}
    got = groups(starts.weighted_starts(pool, spark.createDataFrame(f, "snv_id long, f double"), 0.5, 5).where("sp = 'A'"), "snv_id", "start_id")
    for s in (0, 1):
        keys = sorted(((-np.log(u[s, i] + 1e-12) / x, i) for i, x in f if x > 0))
        assert got[s] == {i for _, i in keys[:20]}
    got = groups(starts.weighted_starts(pool, spark.createDataFrame(f[:-1], "snv_id long, f double"), 0.5, 5).where("sp = 'A'"), "snv_id", "start_id")
    assert all(got[s] == {i for i in range(40) if u[s, i] <= 0.5} for s in (0, 1))


def test_all_starts_are_judged_alike(spark):
    """F20, F21 for many starts in one job."""
    facts, _ = planted(spark, on_branches)
    rng = np.random.default_rng(1)
    for kind in ("linear", "branching"):
        for params in (Params(low_cmb=0.6, high_cmb=0.1), Params(low_cmb=0.6, high_cmb=0.1, compat=False)):
            cp = [(s, c, "AB"[int(rng.random() < 0.5) if s else int(c >= 30)]) for s in range(3) for c in range(60)]
            sp = [(s, m, ("AB" if kind == "linear" else "ABC")[int(rng.integers(0, 2 if kind == "linear" else 3)) if s else (m // 30 % 2)]) for s in range(3) for m in range(90)]
            c, m = spark.createDataFrame(cp, "start_id int, cell_id long, cp string"), spark.createDataFrame(sp, "start_id int, snv_id long, sp string")
            got = {r["start_id"]: r["accepted"] for r in split.judge(facts, c, m, kind, params).collect()}
            norm = {r["start_id"]: r["norm"] for r in split.norms(facts, c, m, kind).collect()}
            for s in range(3):
                own = [df.where(F.col("start_id") == s).drop("start_id") for df in (c, m)]
                assert got[s] == assign.accept(facts, *own, kind, params.low_cmb, params.high_cmb, params.nobs_per_cluster, params.compat).first()["accepted"]
                lab = facts.join(own[0], "cell_id").join(own[1], "snv_id")
                assert norm[s] == pytest.approx((scoring.linear_norm if kind == "linear" else scoring.branching_norm)(lab).first()["norm"])


def test_cut_by_blocks_is_the_dense_cut(spark, monkeypatch):
    """F7-F10 for graphs that no task holds."""
    monkeypatch.setattr(bipartition, "BLOCK", 25)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(1, 0.1, (45, 2))])
    vec = np.concatenate([rng.normal(0, 0.3, (30, 3)), rng.normal(1, 0.3, (45, 3))])
    gaps = x.copy()
    gaps[[3, 40], 0] = np.nan
    for rows, copy, radius, strict in ((gaps, True, 0.7, True),):
        want = bipartition.normalised_cut(bipartition.affinity_of(bipartition.impute_rows(rows, vec), vec if copy else None, radius, strict))
        cells = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r], [float(v) for v in c]) for i, (r, c) in enumerate(zip(rows, vec))], "cell_id long, x array<double>, vec array<double>")
        got = {r["cell_id"]: r["k"] for r in bipartition.cut_by_blocks(cells, copy, radius, strict).collect()}
        assert [got[i] for i in range(75)] == (want ^ want[0]).tolist()
    assert bipartition.cut_by_blocks(cells.withColumn("x", F.array(F.lit(None).cast("double"))), True, 1.0, True) is None


def test_deep_trees(spark):
    """A path of more than a hundred edges."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(104)], "parent int, child int")
    assert tree.closure(edges).agg(F.count("*"), F.max("depth")).first()[:] == (104 * 105 // 2, 104)


def brute_post_process(facts, edges, cell_at, snv_at, q=0.1):
    """Places and reassigns SNV by SNV, as described."""
    kids = {}
    for p, c in edges:
        kids.setdefault(p, []).append(c)
    nodes = sorted({x for e in edges for x in e})
    below = lambda n: {n}.union(*[below(c) for c in kids.get(n, [])])
    clade = {n: below(n) for n in nodes}
    order = []

    def walk(n):
        for c in kids.get(n, []):
            walk(c)
        order.append(n)

    walk(0)
    cell_at, snv_at = dict(cell_at), dict(snv_at)
    ll0, ll1 = ({(f["cell_id"], f["snv_id"]): f[k] for f in facts} for k in ("ll0", "ll1"))
    pairs = {(f["cell_id"], f["snv_id"]): (f["var"], f["total"]) for f in facts}
    here = lambda s, n: any(n in clade[a] for a in [snv_at[s]]) if s in snv_at else False
    total = lambda: round(sum(ll1[p] if here(p[1], cell_at[p[0]]) else ll0[p] for p in pairs if p[0] in cell_at), 9)
    before = total()
    for c in sorted({c for c, _ in pairs} - set(cell_at)):
        open_ = [n for n in nodes if len(kids.get(n, [])) < 2]
        cell_at[c] = max(open_, key=lambda n: (round(sum(ll1[p] if here(p[1], n) else ll0[p] for p in pairs if p[0] == c), 9), -n))
    best = lambda s: max(nodes, key=lambda n: (round(sum(ll1[p] if cell_at[p[0]] in clade[n] else ll0[p] for p in pairs if p[1] == s), 9), -n))
    for s in sorted({s for _, s in pairs} - set(snv_at)):
        snv_at[s] = best(s)
    for n in order[:-1]:
        mine = [s for s in snv_at if snv_at[s] == n]
        f = {}
        for s in mine:
            seen = [v for (c, m), (v, t) in pairs.items() if m == s and t > 0 and cell_at[c] in clade[n]]
            f[s] = sum(v > 0 for v in seen) / len(seen) if seen else None
        known = [v for v in f.values() if v is not None]
        bad = [s for s in mine if f[s] is None or f[s] <= np.quantile(known, q)]
        moved = {s: best(s) for s in bad}
        snv_at.update(moved)
        after = total()
        if after == before:
            break
        before = after
    return cell_at, snv_at


def test_post_process_against_brute_force(spark):
    """G19-G21."""
    rng = np.random.default_rng(3)
    edges = [(0, 1), (0, 2), (1, 3), (1, 4)]
    rows = [(c, m, int(rng.integers(0, 4)) if rng.random() < 0.7 else 0, 4) for c in range(20) for m in range(40) if rng.random() < 0.4]
    facts = trees.keep(with_likelihoods(spark.createDataFrame(rows, "cell_id long, snv_id long, var long, total long")))
    cell_at, snv_at = [(c, c % 5) for c in range(17)], [(m, m % 5) for m in range(36)]
    want = brute_post_process(facts.collect(), edges, cell_at, snv_at)
    got = refine.post_process(facts, spark.createDataFrame(edges, "parent int, child int"), spark.createDataFrame(cell_at, "cell_id long, node int"), spark.createDataFrame(snv_at, "snv_id long, node int"))
    assert tuple({r[i]: r["node"] for r in df.collect()} for df, i in zip(got, ("cell_id", "snv_id"))) == want


def test_post_process_goes_on(spark):
    """What was missing changes the likelihood, so that a first node without moves does not end it; without anything missing
    it does."""
    edges = [(0, 1), (0, 2)]
    at = [(c, 1 + c // 10) for c in range(20)]
    shows = lambda c, m: c < 10 if m < 11 else c >= 10
    rows = [(c, m, 4 * shows(c, m), 4) for c in range(21) for m in range(20)]
    facts = trees.keep(with_likelihoods(spark.createDataFrame(rows, "cell_id long, snv_id long, var long, total long")))
    tables = lambda cells, snvs: (spark.createDataFrame(cells, "cell_id long, node int"), spark.createDataFrame(snvs, "snv_id long, node int"))
    snv_at = [(m, 1 if m < 10 else 2) for m in range(19)]
    e = spark.createDataFrame(edges, "parent int, child int")
    for cells, snvs, node in ((at, snv_at, 1), (at + [(20, 2)], snv_at + [(19, 2)], 2)):
        want = brute_post_process(facts.collect(), edges, cells, snvs)
        got = refine.post_process(facts, e, *tables(cells, snvs))
        got = tuple({r[i]: r["node"] for r in df.collect()} for df, i in zip(got, ("cell_id", "snv_id")))
        assert got == want and got[1][10] == node


def test_keys_and_losses(spark):
    """G13, G22, T17, T21."""
    cells, snvs = spark.range(4).select(F.col("id").alias("cell_id")), spark.range(4).select(F.col("id").alias("snv_id"))
    t = trees.identity_tree(cells, snvs)
    assert not t.has_loss()
    t.set_key("7")
    t.lost = t.snv_node.where("snv_id = 1")
    assert t.has_loss() and t.label == "7"
    for f in (tree.cluster_pairs, lambda *a, **k: tree.incomparable_pairs(spark.createDataFrame([(0, 1)], "parent int, child int"), *a, **k)):
        with pytest.raises(NotImplementedError):
            f(t.snv_node, "snv_id", lost=t.lost)


def test_snv_clusters(spark):
    """SNVs that the cells A have and those that they lack."""
    rows = [(c, m, int(m >= 20 and (c + m) % 4 > 0), 1) for c in range(30) for m in range(50)] + [(99, 60, 1, 1)]
    facts = spark.createDataFrame(rows, "cell_id long, snv_id long, var long, total long")
    snvs = spark.range(70).select(F.col("id").alias("snv_id"))
    got = groups(assign.cluster_snvs(facts, facts.where("cell_id < 30").select("cell_id").distinct(), snvs), "snv_id", "sp")
    assert got == {"A": set(range(20)), "B": set(range(20, 50))}


def test_command_line(spark, tmp_path):
    """K10: files in, files out, with the options of the tool that this one stands in for."""
    from cladewise import cli

    with open(tmp_path / "reads.tsv", "w") as f:
        f.write("chr\tmutation\tcell\tbase\tvar\ttotal\tcopies\n")
        for c in range(40):
            for m in range(60):
                f.write(f"1\t{m}\tc{c:02d}\tA\t{3 if m < 30 or c >= 20 else 0}\t6\t2\n")
    with open(tmp_path / "bins.csv", "w") as f:
        f.write("cell,bin1,bin2,bin3\n" + "".join(f"c{c:02d},{10 + c // 20 * 5},{20 + c % 7},{30}\n" for c in range(40)))
    at = lambda x: str(tmp_path / x)
    found = cli.run(spark, ["-f", at("reads.tsv"), "--bin_count_data", at("bins.csv"), "-s", "2", "-j", "3", "-d", "3", "--min_obs", "1", "--radius", "1", "-n", at("cells"), "--pred-mut", at("snvs"), "--tree_text", at("text"), "--tree", at("tree.png"), "--tree_pickle", at("best"), "--tree_list", at("all"), "--tree_path", at("dots"), "--likelihood", at("likelihood"), "--embedding", at("xy"), "--no-umap"])
    assert len(found.tree.ncells) == 2
    by = groups(spark.read.option("header", True).csv(at("cells")), "cell", "cluster")
    assert set(map(frozenset, by.values())) == {frozenset(f"c{c:02d}" for c in range(a, a + 20)) for a in (0, 20)}
    assert spark.read.option("header", True).csv(at("snvs")).count() == 60
    assert [r["value"] for r in spark.read.text(at("text")).collect()] == ["1 #edges", "0 1", "1 #leaves", "1"]
    assert spark.read.option("header", True).csv(at("likelihood")).count() == len(found.candidates)
    assert (tmp_path / "tree.png").read_bytes()[:4] == b"\x89PNG"
    assert len(list((tmp_path / "dots").glob("tree*_*.png"))) == len(found.candidates)
    assert spark.read.text(at("dots/tree_0")).count() > 2
    from cladewise.sources import files

    edges, cells, _ = files.load_tree(spark, at("all/tree_0"))
    assert edges.count() >= 1 and cells.count() == 40


def test_search_with_errors(spark):
    """T9 on reads of which one in five variants is dropped: clones come out, but for SNVs that lost what tells them apart."""
    from cladewise.plans import splits

    facts, vec = splits.planted(spark, "/root/testdata/sf0.01", "path", 3)
    found = trees.best_of_runs(trees.Data(facts, vec), Params(starts=2, iterations=4, seed=7, min_obs=1), runs=1).tree
    for df, ident in ((found.cell_node, "cell_id"), (found.snv_node, "snv_id")):
        rows = df.select(ident, "node").collect()
        assert np.mean([r["node"] == r[ident] % 3 for r in rows]) >= 0.99
