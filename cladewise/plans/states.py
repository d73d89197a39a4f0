"""Copy-number states and texts."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import relations as R
from ..functions.likelihood import present_by_state
from ..operators import assign, cna, tree
from ..sources import mappings
from .registry import query

W = R.with_sql
#: A profile from the bins: a year is a chromosome, the value is a month's reads over the mean of all months.
_PROFILE = ", rdr as (select cell_id, bin // 12 chrom, bin, n / (select avg(n) from bins) v from bins), prof as (select chrom, bin, avg(v) x from rdr group by 1, 2)"
_EM = {"gain": (1.2, 0.04), "loss": (0.8, 0.04), "neutral": (1.0, 0.04)}
_STATE = ", st as (select chrom, bin, case when x < 0.95 then 'loss' when x > 1.05 then 'gain' else 'neutral' end s from prof)"
_EMSQL = "(values ('gain', 1.2e0, 0.04e0), ('loss', 0.8e0, 0.04e0), ('neutral', 1e0, 0.04e0))"


def _rdr(s, d):
    b = R.bins(s, d)
    mean = b.agg(F.avg("n").alias("m"))
    return b.crossJoin(F.broadcast(mean)).select("cell_id", F.floor(F.col("bin") / 12).cast("long").alias("chrom"), "bin", (F.col("n") / F.col("m")).alias("value"))


def _states(s, d):
    p = cna.mean_profile(_rdr(s, d))
    return p.select("chrom", "bin", F.when(F.col("x") < 0.95, "loss").when(F.col("x") > 1.05, "gain").otherwise("neutral").alias("state"))


@query("h1_emission_fit", W("bins") + _PROFILE + ", l as (select case when v < 0.7e0 then 'loss' when v > 1.3e0 then 'gain' else 'neutral' end state, count(*) n, avg(v) m, var_pop(v) s from rdr group by 1) select state, round(case when n > 1 then m else d.mu end, 6) mu, round(case when n > 1 then s else 1 end, 6) var from (values ('gain', 1.6e0), ('loss', 0.4e0), ('neutral', 1e0)) d(state, mu) left join l using (state)")
def h1(s, d):
    return cna.fit_emissions(_rdr(s, d), "value").select("state", F.round("mu", 6).alias("mu"), F.round("var", 6).alias("var"))


@query("h2_log_density", W("bins") + _PROFILE + f" select bin, state, round(-0.5e0 * (ln(2 * pi() * s2) + (x - mu) * (x - mu) / s2), 6) e from prof, {_EMSQL} t(state, mu, s2)")
def h2(s, d):
    em = s.createDataFrame([(k, m, v) for k, (m, v) in _EM.items()], "state string, mu double, var double")
    return cna.mean_profile(_rdr(s, d)).crossJoin(F.broadcast(em)).select("bin", "state", F.round(cna.log_normal(F.col("x"), F.col("mu"), F.col("var")), 6).alias("e"))


@query(
    "h3_transitions",
    W("bins") + _PROFILE + _STATE + ", nm as (select * from (values (0, 'gain'), (1, 'loss'), (2, 'neutral')) t(i, s)), lg as (select s, lag(s) over (partition by chrom order by bin) p from st), mv as (select p, s, count(*) n from lg where p is not null group by 1, 2) "
    "select a.i, b.i j, round(case when a.i = b.i then ln(0.9e0) else ln(0.05e0) end, 9) t, coalesce(n, 0) n from nm a cross join nm b left join mv on mv.p = a.s and mv.s = b.s",
)
def h3(s, d):
    """Log-probabilities of all steps, beside how often the states of the mean profile take each."""
    steps = s.createDataFrame([(i, j, a, b, x) for (i, a), r in zip(enumerate(cna.STATES), cna.step(0.1)) for (j, b), x in zip(enumerate(cna.STATES), r)], "i int, j int, p string, state string, t double")
    w = Window.partitionBy("chrom").orderBy("bin")
    seen = _states(s, d).withColumn("p", F.lag("state").over(w)).where("p is not null").groupBy("p", "state").agg(F.count("*").alias("n"))
    return steps.join(seen, ["p", "state"], "left").select("i", "j", F.round("t", 9).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))


_MOVES = ", lg as (select chrom, bin, s, lag(s) over (partition by chrom order by bin) p from st), mv as (select chrom, sum(case when p is null then ln(1 / 3e0) when p = s then ln(0.9e0) else ln(0.05e0) end) t from lg group by 1)"


@query("h4_transition_loglik", W("bins") + _PROFILE + _STATE + _MOVES + " select chrom, round(t, 6) loglik from mv")
def h4(s, d):
    return cna.transition_loglik(_states(s, d)).select("chrom", F.round("loglik", 6).alias("loglik"))


@query("w2_previous_state", W("bins") + _PROFILE + _STATE + " select chrom, count(*) filter (s <> p) changes from (select *, lag(s) over (partition by chrom order by bin) p from st) group by 1")
def w2(s, d):
    from pyspark.sql import Window

    before = F.lag("state").over(Window.partitionBy("chrom").orderBy("bin"))
    return _states(s, d).withColumn("p", before).groupBy("chrom").agg(F.count_if(F.col("state") != F.col("p")).alias("changes"))


@query("h5_path_loglik", W("bins") + _PROFILE + _STATE + _MOVES + f" select cell_id, round(sum(-0.5e0 * (ln(2 * pi() * s2) + (v - mu) * (v - mu) / s2)) + (select sum(t) from mv), 5) loglik from rdr join st using (bin) join {_EMSQL} e(state, mu, s2) on e.state = st.s group by 1")
def h5(s, d):
    em = s.createDataFrame([(k, m, v) for k, (m, v) in _EM.items()], "state string, mu double, var double")
    return cna.path_loglik(_rdr(s, d), _states(s, d), em).select("cell_id", F.round("loglik", 5).alias("loglik"))


@query("h8_node_rdr_loglik", W("bins", "cell_node") + _PROFILE + _STATE + _MOVES + f", c as (select cell_id, sum(-0.5e0 * (ln(2 * pi() * s2) + (v - mu) * (v - mu) / s2)) + (select sum(t) from mv) l from rdr join st using (bin) join {_EMSQL} e(state, mu, s2) on e.state = st.s group by 1) select node, round(sum(l), 4) loglik from c join cell_node using (cell_id) group by 1")
def h8(s, d):
    em = s.createDataFrame([(k, m, v) for k, (m, v) in _EM.items()], "state string, mu double, var double")
    by = cna.path_loglik(_rdr(s, d), _states(s, d), em).join(R.cell_node(s, d), "cell_id")
    return by.groupBy("node").agg(F.round(F.sum("loglik"), 4).alias("loglik"))


def _ln(mu, var):
    return f"(-0.5e0 * ({log(2 * pi * var)!r} + (x - {mu}e0) * (x - {mu}e0) / {var}e0))"


_A, _M = "ln(0.9e0)", "ln(0.05e0)"
_VITERBI = (
    _PROFILE + ", o as (select chrom, bin, row_number() over (partition by chrom order by bin) i, " + ", ".join(f"{_ln(*_EM[s])} {s[0]}" for s in cna.STATES) + " from prof), "
    "f as (select chrom, i, g + ln(1 / 3e0) a, l + ln(1 / 3e0) b, n + ln(1 / 3e0) c from o where i = 1 union all "
    f"select o.chrom, o.i, greatest(a + {_A}, b + {_M}, c + {_M}) + g, greatest(a + {_M}, b + {_A}, c + {_M}) + l, greatest(a + {_M}, b + {_M}, c + {_A}) + n from f join o on o.chrom = f.chrom and o.i = f.i + 1), "
    "e as (select chrom, max(i) k from o group by 1), "
    "z as (select f.chrom, f.i, case when c >= b and c >= a then 2 when b >= a then 1 else 0 end s from f join e on e.chrom = f.chrom and e.k = f.i union all "
    f"select z.chrom, f.i, case z.s when 0 then (case when a + {_A} >= b + {_M} and a + {_A} >= c + {_M} then 0 when b >= c then 1 else 2 end) when 1 then (case when a + {_M} >= b + {_A} and a >= c then 0 when b + {_A} >= c + {_M} then 1 else 2 end) else (case when a >= b and a + {_M} >= c + {_A} then 0 when b + {_M} >= c + {_A} then 1 else 2 end) end from z join f on f.chrom = z.chrom and f.i = z.i - 1) "
)


@query("h6_viterbi_path", W("bins") + _VITERBI + "select o.chrom, o.bin, ['gain', 'loss', 'neutral'][s + 1] state from z join o on o.chrom = z.chrom and o.i = z.i")
def h6(s, d):
    return cna.decode(cna.mean_profile(_rdr(s, d)), _EM).select("chrom", "bin", "state")


@query("w6_viterbi_score", W("bins") + _VITERBI + "select f.chrom, round(greatest(a, b, c), 6) loglik from f join e on e.chrom = f.chrom and e.k = f.i")
def w6(s, d):
    return cna.decoded_score(cna.decode(cna.mean_profile(_rdr(s, d)), _EM)).select("chrom", F.round("loglik", 6).alias("loglik"))


@query("h7_bins_by_state", W("bins") + _PROFILE + _STATE + " select s state, array_to_string(list(bin order by bin), ',') bins from st group by 1")
def h7(s, d):
    return cna.bins_by_state(_states(s, d)).select("state", F.array_join(F.transform("bins", lambda x: x.cast("string")), ",").alias("bins"))


#: States by node: node and bin decide.
_BS = ", bs as (select n.node, b.bin, case (n.node + b.bin) % 4 when 0 then 'gain' when 1 then 'loss' else 'neutral' end state from nodes n, (select distinct bin from bins where bin % 2 = 0) b)"


def _bs(s, d):
    bins = R.bins(s, d).where("bin % 2 = 0").select("bin").distinct()
    r = (F.col("node") + F.col("bin")) % 4
    return tree.nodes(R.edges(s, d)).crossJoin(F.broadcast(bins)).select("node", "bin", F.when(r == 0, "gain").when(r == 1, "loss").otherwise("neutral").alias("state"))


@query("g4_ancestral_states", W("bins", "closure", "nodes") + _BS + " select c.node, c.anc, b.bin from closure c join bs b on b.node = c.anc where b.state = 'gain'")
def g4(s, d):
    return cna.ancestral_states(tree.closure(R.edges(s, d)), _bs(s, d), "gain")


@query("g14_edge_events", W("bins", "edges", "nodes") + _BS + ' select parent, child, u.bin, u.state "before", v.state "after" from edges join bs u on u.node = parent join bs v on v.node = child and v.bin = u.bin where u.state <> v.state')
def g14(s, d):
    return cna.edge_events(R.edges(s, d), _bs(s, d))


@query("j13_state_changes", W("bins", "edges", "nodes") + _BS + " select parent, child, count(*) n from edges join bs u on u.node = parent join bs v on v.node = child and v.bin = u.bin where u.state <> v.state group by 1, 2")
def j13(s, d):
    return cna.edge_events(R.edges(s, d), _bs(s, d)).groupBy("parent", "child").agg(F.count("*").alias("n"))


@query("g15_cna_genotype", W("bins", "nodes") + _BS + " select u.bin, coalesce(state, 'neutral') state from (select distinct bin from bins) u left join bs on bs.bin = u.bin and node = 3")
def g15(s, d):
    return cna.genotype(_bs(s, d).where("node = 3"), R.bins(s, d).select("bin").distinct())


@query("j12_bin_states", W("bins", "nodes") + _BS + " select cell_id, count(*) filter (coalesce(state, 'neutral') <> 'neutral') n from bins b left join bs on bs.bin = b.bin and node = 2 group by 1")
def j12(s, d):
    return R.bins(s, d).join(_bs(s, d).where("node = 2"), "bin", "left").groupBy("cell_id").agg(F.count_if(F.coalesce("state", F.lit("neutral")) != "neutral").alias("n"))


@query("p14_state_series", W("bins") + _PROFILE + _STATE + " select bin, s state from st")
def p14(s, d):
    return mappings.state_series(cna.bins_by_state(_states(s, d)))


@query("p15_state_table", W("bins", "nodes") + _BS + " select bin, max(state) filter (node = 0) node_0, max(state) filter (node = 1) node_1, max(state) filter (node = 2) node_2 from bs group by 1")
def p15(s, d):
    return mappings.state_table(_bs(s, d), [0, 1, 2])


_ARM = "(select * from (values ('c1', 'p', 23940, 23980), ('c1', 'q', 23981, 24023)) t(chrom, arm, \"start\", \"end\"))"


@query("j9_arm_join", W("bins") + f", r as (select cell_id, min(bin) l, max(bin) r from bins group by 1) select cell_id, arm from r join {_ARM} a on l = a.\"start\" and abs(a.\"end\" - r) <= 43")
def j9(s, d):
    arms = s.createDataFrame([("c1", "p", 23940, 23980), ("c1", "q", 23981, 24023)], "chrom string, arm string, start long, end long")
    runs = R.bins(s, d).groupBy("cell_id").agg(F.min("bin").alias("l"), F.max("bin").alias("r"))
    return cna.arms(runs, arms, 43).select("cell_id", "arm")


_BY = (
    ", points as (select state, i / c::double v from (values ('loss', 1, 1), ('neutral', 2, 2), ('gain', 3, 5)) t(state, lo, hi), range(1, 6) a(c), range(1, 6) b(i) where c between lo and hi and i <= c), "
    "mix as (select state, v * (1 - 1e-3) + (1 - v) * 1e-3 / 3e0 v, count(*) / (sum(count(*)) over (partition by state))::double w from points group by state, v), "
    "by_state as (select cell_id, snv_id, state, any_value(lnc) + ln(sum(w * exp(var * ln(v) + (total - var) * ln(1 - v)))) ll from lik, mix group by cell_id, snv_id, state)"
)
_PRES = ", pres as (select distinct c.node, s.snv_id from (select anc, node from closure union all select node, node from nodes) c join snv_node s on s.node = c.anc)"


def _by(s, d):
    return present_by_state(R.reads(s, d))


@query("l6_likelihood_by_state", W("lik") + _BY + " select state, round(sum(ll), 3) ll from by_state group by 1")
def l6(s, d):
    return _by(s, d).groupBy("state").agg(F.round(F.sum("ll"), 3).alias("ll"))


@query(
    "l12_variant_with_states",
    W("lik", "bins", "closure", "nodes", "snv_node", "cell_node") + _BS + _BY + _PRES + ", sb as (select snv_id, 23940 + snv_id % 83 bin from snv_node), "
    "x as (select l.*, c.node, coalesce(b.state, 'neutral') state from lik l join cell_node c using (cell_id) join sb on sb.snv_id = l.snv_id left join bs b on b.node = c.node and b.bin = sb.bin) "
    "select x.node, round(sum(case when p.snv_id is null then x.ll0 else y.ll end), 3) variant from x left join pres p on p.node = x.node and p.snv_id = x.snv_id left join by_state y on y.cell_id = x.cell_id and y.snv_id = x.snv_id and y.state = x.state group by 1",
)
def l12(s, d):
    snv_bin = R.snvs(s, d).select("snv_id", (23940 + F.col("snv_id") % 83).alias("bin"))
    here = tree.presence(R.edges(s, d), R.snv_node(s, d), "snv_id")
    return cna.presence_by_state(R.loaded(s, d), R.cell_node(s, d), _bs(s, d), snv_bin, _by(s, d), here).select("node", F.round("variant", 3).alias("variant"))


@query(
    "f17_snvs_by_state",
    W("lik", "bins", "snvs") + _BY + ", sb as (select snv_id, 23940 + snv_id % 83 bin from snvs where snv_id % 5 > 0), ba as (select distinct bin, case bin % 4 when 0 then 'gain' when 1 then 'loss' end state from bins where bin % 4 < 2), "
    "st as (select m.snv_id, coalesce(ba.state, 'neutral') state from snvs m left join sb using (snv_id) left join ba on ba.bin = sb.bin), a as (select snv_id, sum(ll0) s0 from lik where cell_id % 2 = 0 group by 1), "
    "b as (select snv_id, sum(ll) s1 from by_state join st using (snv_id, state) where cell_id % 2 = 0 group by 1) select snv_id, case when round(coalesce(s0, 0), 9) > round(coalesce(s1, 0), 9) then 'B' else 'A' end sp from st left join a using (snv_id) left join b using (snv_id)",
)
def f17(s, d):
    """A fifth of the SNVs have no bin, and half of the bins no state."""
    snvs = R.snvs(s, d)
    snv_bin = snvs.where("snv_id % 5 > 0").select("snv_id", (23940 + F.col("snv_id") % 83).alias("bin"))
    states = R.bins(s, d).where("bin % 4 < 2").select("bin").distinct().select("bin", F.when(F.col("bin") % 4 == 0, "gain").otherwise("loss").alias("state"))
    return assign.snvs_linear_by_state(R.loaded(s, d), R.cells(s, d).where("cell_id % 2 = 0"), snvs, _by(s, d), snv_bin, states)
