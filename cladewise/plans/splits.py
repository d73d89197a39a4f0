"""Splits: kernels, imputation, orientation, assignment, acceptance, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import relations as R
from ..config import Params
from ..functions.likelihood import with_likelihoods
from ..functions.uniform import uniform
from ..operators import assign, bipartition, donors, layout, line, scoring
from ..operators import counts as C
from ..operators import features as X
from ..search import split
from ..storage import keep
from .registry import query

W = R.with_sql
#: Fixed parts of the benchmark tables: cells by parity, SNVs by remainder.
_CP = "(select cell_id, case when cell_id % 2 = 0 then 'A' else 'B' end cp from cells)"
_SP = "(select snv_id, case snv_id % 3 when 0 then 'A' when 1 then 'B' else 'C' end sp from snvs)"
_LAB = ", lab as (select * from lik join " + _CP + " c using (cell_id) join " + _SP + " s using (snv_id))"


def _cp(s, d):
    return R.cells(s, d).select("cell_id", F.when(F.col("cell_id") % 2 == 0, "A").otherwise("B").alias("cp"))


def _sp(s, d):
    r = F.col("snv_id") % 3
    return R.snvs(s, d).select("snv_id", F.when(r == 0, "A").when(r == 1, "B").otherwise("C").alias("sp"))


def _lab(s, d):
    return C.labelled(R.loaded(s, d), _cp(s, d), _sp(s, d))


@query("l7_linear_norm", W("lik", "cells", "snvs") + _LAB + "select round(sum(case when cp = 'A' and sp = 'B' then ll0 when sp = 'A' then ll1 end) / count(*) filter (total > 0 and ((cp = 'A' and sp = 'B') or sp = 'A')), 8) norm from lab")
def l7(s, d):
    return scoring.linear_norm(_lab(s, d)).select(F.round("norm", 8).alias("norm"))


_OTHER = "((cp = 'A' and sp = 'B') or (cp = 'B' and sp = 'A'))"


@query("l8_branching_norm", W("lik", "cells", "snvs") + _LAB + f"select round(sum(case when sp = 'C' then ll1 when {_OTHER} then ll0 end) / count(*) filter (total > 0 and (sp = 'C' or {_OTHER})), 8) norm from lab")
def l8(s, d):
    return scoring.branching_norm(_lab(s, d)).select(F.round("norm", 8).alias("norm"))


@query("l9_norm_by_cell", W("lik", "cells", "snvs") + _LAB + "select cell_id, round(sum(case sp when 'A' then ll1 else ll0 end) / count(*) filter (total > 0), 8) norm from lab where sp in ('A', 'B') group by 1")
def l9(s, d):
    return scoring.variant_norm_by_cell(R.loaded(s, d), _sp(s, d)).select("cell_id", F.round("norm", 8).alias("norm"))


_F = ", f as (select cell_id, count(*) filter (var > 0 and snv_id % 3 = 0) / nullif(count(*) filter (total > 0 and snv_id % 3 = 0), 0)::double fa, count(*) filter (var > 0 and snv_id % 3 = 1) / nullif(count(*) filter (total > 0 and snv_id % 3 = 1), 0)::double fb from reads group by 1)"


def _f(s, d):
    """Each cell's burden over the SNVs A and over the SNVs B."""
    part = lambda k: F.try_divide(F.count_if((F.col("snv_id") % 3 == k) & (F.col("var") > 0)).cast("double"), F.count_if((F.col("snv_id") % 3 == k) & (F.col("total") > 0)).cast("double"))
    return R.reads(s, d).groupBy("cell_id").agg(part(0).alias("fa"), part(1).alias("fb"))


@query("f5_snv_kernel", W("reads") + _F + ", p as (select a.cell_id a, b.cell_id b, abs(a.fb - b.fb) d from f a join f b on a.cell_id < b.cell_id) select a, b, round(exp(-d / (select 0.2e0 * max(d) from p)), 8) w from p")
def f5(s, d):
    return X.affinity(_f(s, d).select("cell_id", "fb"), ["fb"]).select("a", "b", F.round("w", 8).alias("w"))


_COPY = (
    ", v as (select cell_id, vec from embedding where cell_id in (select cell_id from f)), p as (select a.cell_id a, b.cell_id b, sqrt((a.fa - b.fa) * (a.fa - b.fa) + (a.fb - b.fb) * (a.fb - b.fb)) d from f a join f b on a.cell_id < b.cell_id), "
    "c as (select a.cell_id a, b.cell_id b, list_distance(a.vec, b.vec) c from v a join v b on a.cell_id < b.cell_id), sq as (select c from c union all select c from c union all select 0e0 from f), "
    "cut as (select 0.2e0 * max(c) cw, quantile_cont(c, 0.5e0) q from sq) select a, b, round(exp(-d / (select 0.2e0 * max(d) from p)) * case when c {op} q then 0 else exp(-c / cw) end, 8) w from p join c using (a, b), cut"
)


@query("f6_copy_kernel_branching", W("reads", "embedding") + _F + _COPY.format(op=">="))
def f6(s, d):
    return X.affinity(_f(s, d), ["fa", "fb"], R.embedding(s, d), radius=0.5).select("a", "b", F.round("w", 8).alias("w"))


@query("f6_copy_kernel_linear", W("reads", "embedding") + _F + _COPY.format(op=">"))
def f6l(s, d):
    return X.affinity(_f(s, d), ["fa", "fb"], R.embedding(s, d), radius=0.5, strict=True).select("a", "b", F.round("w", 8).alias("w"))


_GAPS = ", g as (select cell_id, case when cell_id % 10 = 3 then null else fa end fa, fb from f), v as (select cell_id, vec from embedding where cell_id in (select cell_id from g)), n as (select a.cell_id, b.cell_id donor, list_distance(a.vec, b.vec) d from v a join v b on a.cell_id <> b.cell_id join g ga on ga.cell_id = a.cell_id join g gb on gb.cell_id = b.cell_id where (ga.fa is null or ga.fb is null) and gb.fa is not null and gb.fb is not null), best as (select cell_id, donor from n qualify row_number() over (partition by cell_id order by d, donor) = 1)"


def _gaps(s, d):
    return _f(s, d).select("cell_id", F.when(F.col("cell_id") % 10 != 3, F.col("fa")).alias("fa"), "fb")


@query("j6_nearest_donor", W("reads", "embedding") + _F + _GAPS + " select cell_id, donor from best")
def j6(s, d):
    return donors.nearest_donor(R.embedding(s, d), _gaps(s, d), ["fa", "fb"])


@query("f9_imputed", W("reads", "embedding") + _F + _GAPS + " select g.cell_id, round(case when donor is null then g.fa else h.fa end, 9) fa, round(case when donor is null then g.fb else h.fb end, 9) fb from g left join best using (cell_id) left join g h on h.cell_id = donor")
def f9(s, d):
    return donors.impute(_gaps(s, d), R.embedding(s, d), ["fa", "fb"]).select("cell_id", F.round("fa", 9).alias("fa"), F.round("fb", 9).alias("fb"))


@query("f9_not_imputed", W("reads") + _F + " select cell_id, cast(null as double) fa, round(fb, 9) fb from f")
def f9n(s, d):
    mostly = _f(s, d).select("cell_id", F.lit(None).cast("double").alias("fa"), "fb")
    return donors.impute(mostly, R.embedding(s, d), ["fa", "fb"]).select("cell_id", "fa", F.round("fb", 9).alias("fb"))


@query("f2_raw_embedding", W("embedding") + "select cell_id, round(vec[1], 6) x, len(vec) n from embedding")
def f2(s, d):
    return R.embedding(s, d).select("cell_id", F.round(F.col("vec")[0], 6).alias("x"), F.size("vec").alias("n"))


@query("f1_pca_embedding")
def f1(s, d):
    return bipartition.pca(C.bin_vectors(C.normalised_bins(R.bins(s, d)), "share"))


@query("f1_layout")
def f1l(s, d):
    """The default embedding: a layout of all cells by their shares of reads in bins."""
    out = layout.layout(C.bin_vectors(C.normalised_bins(R.bins(s, d)), "share"))
    return out.select("cell_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


@query("f1_neighbours", W("bins") + ", p as (select cell_id, bin, n / sum(n) over (partition by cell_id)::double s from bins), g as (select c.cell_id, b.bin, coalesce(s, 0) s from (select distinct cell_id from bins) c cross join (select distinct bin from bins) b left join p using (cell_id, bin)), "
       "d as (select x.cell_id, y.cell_id other, sum(abs(x.s - y.s)) d from g x join g y on x.bin = y.bin and x.cell_id <> y.cell_id group by 1, 2) select cell_id, count(*) n, round(sum(d), 9) total, round(max(d), 9) last from (select *, row_number() over (partition by cell_id order by d) r from d) where r <= 39 group by 1")
def f1n(s, d):
    """Each cell's 39 nearest others by Manhattan distance: how many, their distances added up, the last one's."""
    near = layout.exact_neighbours(C.bin_vectors(C.normalised_bins(R.bins(s, d)), "share"))
    total = F.aggregate("near.d", F.lit(0.0), lambda a, b: a + b)
    return near.select("cell_id", F.size("near").cast("long").alias("n"), F.round(total, 9).alias("total"), F.round(F.array_max("near.d"), 9).alias("last"))


_BY_PARITY = W("reads") + _F + ", g as (select cell_id from f where fb is not null) select cell_id, cast((cell_id - (select min(cell_id) from g)) % 2 as int) k from g"


def _on_a_line(s, d):
    """Cells with their burden over the SNVs B."""
    return _f(s, d).where("fb is not null").select("cell_id", F.col("fb").alias("x"), F.lit(0).alias("g"))


def _two_groups(s, d):
    """The same, moved far up for even cells."""
    return _on_a_line(s, d).withColumn("x", F.when(F.col("cell_id") % 2 == 0, F.col("x") + 5).otherwise(F.col("x")))


@query("f10_bipartition", _BY_PARITY)
def f10(s, d):
    """Two groups of cells, told apart by the normalised cut of the kernel of all pairs."""
    return line.cut(_two_groups(s, d))


@query("f11_fiedler_cut", _BY_PARITY)
def f11(s, d):
    """The same groups by the older cut."""
    return line.older_cut(_two_groups(s, d))[0]


@query("f11_statistics")
def f11s(s, d):
    """What the older cut measures on the kernel of all cells as they are."""
    _, stats = line.older_cut(_on_a_line(s, d))
    return s.createDataFrame([(*[float(stats[c]) for c in ("jump_pct", "first_gap", "largest_gap")], int(stats["k"]))], "jump_pct double, first_gap double, largest_gap double, k int")


@query("f18_snv_clusters")
def f18(s, d):
    """SNVs of the whole table cut in two by their variant fraction over the even cells."""
    return assign.cluster_snvs(R.reads(s, d), R.cells(s, d).where("cell_id % 2 = 0"), R.snvs(s, d))


_STEPS = ", g as (select cell_id, n, lead(n) over (partition by cell_id order by n, bin) - n g, row_number() over (partition by cell_id order by n, bin) i from bins), t as (select cell_id, max(g) / (max(n) - min(n))::double jump_pct, min(g) filter (i = 1) / (max(n) - min(n))::double first_gap, cast(arg_max(i, g * 100000 - i) as int) k from g group by 1 having max(n) > min(n)) "


@query("f12_quality_vote", W("bins") + _STEPS + "select cell_id, round(jump_pct, 9) jump_pct, round(first_gap, 9) first_gap, k, (jump_pct > 0.3)::int + (first_gap <= 0.3)::int + (k > 1)::int votes, (jump_pct > 0.3)::int + (first_gap <= 0.3)::int + (k > 1)::int >= 2 ok from t")
def f12(s, d):
    """The vote over the steps between each cell's sorted counts: widest and first step over the span, place of the widest."""
    b = R.bins(s, d)
    span = b.groupBy("cell_id").agg((F.max("n") - F.min("n")).alias("span"), F.sort_array(F.collect_list("n")).alias("all")).where("span > 0")
    wide = X.largest_gap(b, ["cell_id"], "n")
    stats = span.join(wide, "cell_id").select("cell_id", (F.col("gap") / F.col("span")).alias("jump_pct"), ((F.col("all")[1] - F.col("all")[0]) / F.col("span")).alias("first_gap"), F.col("place").cast("int").alias("k"))
    return assign.quality_vote(stats, 0.3, 2).select("cell_id", F.round("jump_pct", 9).alias("jump_pct"), F.round("first_gap", 9).alias("first_gap"), "k", "votes", "ok")


_K = "(select cell_id, cast(cell_id % 2 as int) k from cells)"


def _k(s, d):
    return R.cells(s, d).select("cell_id", (F.col("cell_id") % 2).cast("int").alias("k"))


@query("f13_orient_linear", W("reads", "cells") + f", n as (select k.cell_id, k, count(r.var) n from {_K} k left join (select * from reads where var > 0 and snv_id % 3 = 1) r using (cell_id) group by 1, 2), m as (select avg(n) filter (k = 0) m0, avg(n) filter (k = 1) m1 from n) select cell_id, case when (k = 0) = (m0 < m1) then 'A' else 'B' end cp from n, m")
def f13(s, d):
    return assign.orient_linear(R.reads(s, d), _k(s, d), _sp(s, d).where("sp = 'B'"))


@query("f14_orient_branching", W("reads", "cells") + _F + f", m as (select avg(fa) filter (k = 0) > avg(fb) filter (k = 0) ok from f join {_K} using (cell_id)) select cell_id, case when (k = 0) = ok then 'A' else 'B' end cp from {_K}, m")
def f14(s, d):
    return assign.orient_branching(_f(s, d), _k(s, d))


@query("f15_snvs_linear", W("lik", "snvs") + ", t as (select snv_id, coalesce(sum(ll0), 0) s0, coalesce(sum(ll1), 0) s1, count(total) n from snvs left join (select * from lik where cell_id % 2 = 0) using (snv_id) group by 1), g as (select quantile_cont(n, 0.75) >= 3 ok from t) select snv_id, case when ok and round(s0, 9) >= round(s1, 9) then 'B' else 'A' end sp from t, g")
def f15(s, d):
    return assign.snvs_linear(R.loaded(s, d), _cp(s, d).where("cp = 'A'"), R.snvs(s, d))


@query(
    "f16_snvs_branching",
    W("lik", "snvs") + ", x as (select *, cell_id % 2 = 0 a from lik), t as (select snv_id, coalesce(sum(case when a then ll1 else ll0 end), 0) sa, coalesce(sum(case when a then ll0 else ll1 end), 0) sb, coalesce(sum(ll1), 0) sc, count(*) filter (a and total > 0) na, count(*) filter (not a and total > 0) nb from snvs left join x using (snv_id) group by 1), "
    "g as (select quantile_cont(na, 0.75) >= 3 and quantile_cont(nb, 0.75) >= 3 ok from t) select snv_id, case when not ok then 'C' when round(sa, 9) >= round(sb, 9) and round(sa, 9) >= round(sc, 9) then 'A' when round(sb, 9) >= round(sc, 9) then 'B' else 'C' end sp from t, g",
)
def f16(s, d):
    return assign.snvs_branching(R.loaded(s, d), _cp(s, d), R.snvs(s, d))


_CHECKS = (
    _LAB + ", ab as (select * from lab where sp in ('A', 'B')), cc as (select c.cell_id, cp, s.sp, (select count(*) from ab where ab.cell_id = c.cell_id and ab.sp = s.sp) n from " + _CP + " c, (values ('A'), ('B')) s(sp)), "
    "ss as (select m.snv_id, m.sp, c.cp, (select count(*) from ab where ab.snv_id = m.snv_id and ab.cp = c.cp) n from " + _SP + " m, (values ('A'), ('B')) c(cp) where m.sp in ('A', 'B')), "
    "ck as (select 'cell' axis, cp, sp, median(n) median, median(n) >= 3 ok from cc group by 2, 3 union all select 'snv', cp, sp, median(n), median(n) >= 3 from ss group by 2, 3) "
)


@query("f20_read_checks", W("lik", "cells", "snvs") + _CHECKS + "select axis, cp, sp, median, ok from ck")
def f20c(s, d):
    return assign.read_checks(R.loaded(s, d), _cp(s, d), _sp(s, d))


_B = "(select median(f) from (select cell_id, count(*) filter (var > 0) / count(*)::double f from lab where {w} group by 1))"


@query("f20_accept_linear", W("lik", "cells", "snvs") + _CHECKS + "select round(" + _B.format(w="cp = 'A' and sp = 'B'") + ", 9) low_a, round(" + _B.format(w="sp = 'A'") + ", 9) high, (select bool_and(ok) from ck) reads_ok, " + _B.format(w="cp = 'A' and sp = 'B'") + " <= 0.5 and " + _B.format(w="sp = 'A'") + " >= 0.15 and (select bool_and(ok) from ck) accepted")
def f20(s, d):
    out = assign.accept(R.loaded(s, d), _cp(s, d), _sp(s, d), "linear", low=0.5)
    return out.select(F.round("low_a", 9).alias("low_a"), F.round("high", 9).alias("high"), "reads_ok", "accepted")


@query("f21_accept_branching", W("lik", "cells", "snvs") + _CHECKS + "select round(" + _B.format(w="cp = 'A' and sp = 'B'") + ", 9) low_a, (select bool_and(ok) from ck) reads_ok, " + _B.format(w="cp = 'A' and sp = 'B'") + " <= 0.5 and (select bool_and(ok) from ck) accepted")
def f21(s, d):
    return assign.accept(R.loaded(s, d), _cp(s, d), _sp(s, d), "branching", low=0.5).select(F.round("low_a", 9).alias("low_a"), "reads_ok", "accepted")


@query("f21_accept_branching_documented", W("lik", "cells", "snvs") + _CHECKS + "select round(" + _B.format(w="cp = 'B' and sp = 'A'") + ", 9) low_b, round(" + _B.format(w="sp = 'C'") + ", 9) high, " + _B.format(w="cp = 'A' and sp = 'B'") + " <= 0.5 and " + _B.format(w="cp = 'B' and sp = 'A'") + " <= 0.5 and " + _B.format(w="sp = 'C'") + " >= 0.15 and (select bool_and(ok) from ck) accepted")
def f21d(s, d):
    out = assign.accept(R.loaded(s, d), _cp(s, d), _sp(s, d), "branching", low=0.5, compat=False)
    return out.select(F.round("low_b", 9).alias("low_b"), F.round("high", 9).alias("high"), "accepted")


@query("f19_largest_component", W("cells") + ", l as (select cell_id a, cell_id + 7 b from cells where cell_id % 3 <> 0 and cell_id + 7 <= (select max(cell_id) from cells)), e as (select a, b from l union all select b, a from l), r as (select cell_id, cell_id root from cells union select r.cell_id, e.b from r join e on e.a = r.root), m as (select cell_id, min(root) root from r group by 1), t as (select root from m group by 1 order by count(*) desc, root limit 1) select cell_id from m join t using (root)")
def f19(s, d):
    cells = R.cells(s, d)
    top = cells.agg(F.max("cell_id").alias("m"))
    links = cells.crossJoin(F.broadcast(top)).where("cell_id % 3 <> 0 and cell_id + 7 <= m").select(F.col("cell_id").alias("a"), (F.col("cell_id") + 7).alias("b"))
    return bipartition.largest_component(keep(links), cells)


#: Clones planted on the observations of the whole table: which SNVs a cell's reads show, by remainders of both ids.
_SHOWS = {
    "linear": "snv_id % 2 = 0 or cell_id % 2 = 1",
    "branching": "snv_id % 3 = 2 or snv_id % 3 = cell_id % 2",
    "path": "snv_id % 3 <= cell_id % 3",
}


def _shown(kind: str):
    """Variant reads with errors: one in five of the variants that a clone has is dropped, one absent in a thousand shows."""
    u = uniform(11, F.col("cell_id"), F.col("snv_id"))
    return F.when(F.expr(_SHOWS[kind]), F.when(u < 0.8, F.col("total")).otherwise(0)).otherwise(F.when(u < 0.001, 1).otherwise(0)).cast("long")


def planted(s, d, kind: str, clones: int, errors: bool = True):
    """facts and vectors of all cells, for clones planted on all observations."""
    shown = _shown(kind) if errors else F.when(F.expr(_SHOWS[kind]), F.col("total")).otherwise(0)
    facts = keep(with_likelihoods(R.reads(s, d).withColumn("var", shown)))
    vec = facts.select("cell_id").distinct().select("cell_id", F.array((F.col("cell_id") % clones).cast("double"), (F.col("cell_id") % 7 / 100).cast("double")).alias("vec"))
    return facts, keep(vec)


def _found(s, d, kind: str):
    facts, vec = planted(s, d, kind, 2)
    got = split.search(kind, facts, facts.select("cell_id").distinct(), facts.select("snv_id").distinct(), vec, Params(starts=4, iterations=4))
    if got is None:
        return s.createDataFrame([], "kind string, id long, part string")
    cells = got.cells.select(F.lit("cell").alias("kind"), F.col("cell_id").alias("id"), F.col("cp").alias("part"))
    return cells.union(got.snvs.select(F.lit("snv"), "snv_id", "sp"))


@query("t1_linear_search", W("reads") + "select distinct 'cell' kind, cell_id id, case when cell_id % 2 = 0 then 'A' else 'B' end part from reads union all select distinct 'snv', snv_id, case when snv_id % 2 = 0 then 'A' else 'B' end from reads")
def t1(s, d):
    """Two clones of a path, planted on all cells and SNVs."""
    return _found(s, d, "linear")


@query("t4_branching_search", W("reads") + "select distinct 'cell' kind, cell_id id, cell_id % 2 part from reads union all select distinct 'snv', snv_id, snv_id % 3 from reads")
def t4(s, d):
    """Two clones that branch; sides are named by the remainder of most of their cells."""
    out = keep(_found(s, d, "branching"))
    name = out.where("kind = 'cell'").groupBy("part").agg(F.round(F.avg(F.col("id") % 2)).cast("long").alias("name"))
    return out.join(F.broadcast(name), "part", "left").select("kind", "id", F.coalesce("name", F.lit(2)).cast("long").alias("part"))  # a row for each side


@query("t3_linear_search", W("reads") + "select distinct cell_id, case when cell_id % 2 = 0 then 'A' else 'B' end cp from reads")
def t3(s, d):
    """The cells of the best of the restarts that T1 runs."""
    return _found(s, d, "linear").where("kind = 'cell'").select(F.col("id").alias("cell_id"), F.col("part").alias("cp"))
