"""Genotype log-likelihoods as column expressions, in log space."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Copies that a state stands for, from and to.
COPIES = {"loss": (1, 1), "neutral": (2, 2), "gain": (3, 5)}


def lattice(max_copies: int = 5, alpha: float = 1e-3, min_copies: int = 1) -> list[tuple[float, float]]:
    """(error-adjusted variant fraction, weight): all i/c for c copies and 1 <= i <= c, equal ones merged."""
    seen = Counter(i / c for c in range(min_copies, max_copies + 1) for i in range(1, c + 1))
    total = sum(seen.values())
    return [(adjusted(v, alpha), n / total) for v, n in sorted(seen.items())]


def adjusted(v: float, alpha: float) -> float:
    return v * (1 - alpha) + (1 - v) * alpha / 3


def ln_choose(n: Column, k: Column) -> Column:
    """ln of n over k, by the shorter side; 0 for k = 0 or k = n."""
    k = F.least(k, n - k)
    terms = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.lit(0.0), lambda s, i: s + F.ln((n - k + i) / i))
    return F.when(k > 0, terms).otherwise(0.0)


def ln_binomial(k: Column, n: Column, p: float | Column, ln_c: Column | None = None) -> Column:
    ln_c = ln_choose(n, k) if ln_c is None else ln_c
    if isinstance(p, Column):
        return ln_c + k * F.ln(p) + (n - k) * F.ln(1 - p)
    return ln_c + k * log(p) + (n - k) * log(1 - p)


def absent(var: Column, total: Column, alpha: float = 1e-3, ln_c: Column | None = None) -> Column:
    return ln_binomial(var, total, alpha, ln_c)


def present(var: Column, total: Column, alpha: float = 1e-3, max_copies: int = 5, ln_c: Column | None = None, min_copies: int = 1) -> Column:
    """Mixture over the lattice; the largest term is taken out of the sum, so that deep reads do not underflow."""
    ln_c = ln_choose(total, var) if ln_c is None else ln_c
    terms = [var * log(v) + (total - var) * log(1 - v) + log(w) for v, w in lattice(max_copies, alpha, min_copies)]
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return ln_c + top + F.ln(reduce(lambda a, b: a + b, [F.exp(t - top) for t in terms]))


def with_likelihoods(reads: DataFrame, alpha: float = 1e-3, max_copies: int = 5) -> DataFrame:
    """Adds ll0 (absent) and ll1 (present). A narrow projection: no shuffle."""
    k, n, c = F.col("var"), F.col("total"), F.col("_ln_c")
    out = reads.withColumn("_ln_c", ln_choose(n, k))
    return out.withColumn("ll0", absent(k, n, alpha, c)).withColumn("ll1", present(k, n, alpha, max_copies, c)).drop("_ln_c")


def present_by_state(reads: DataFrame, alpha: float = 1e-3, copies: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(cell_id, snv_id, state, ll): presence under the copies that each state stands for. A narrow projection."""
    k, n, c = F.col("var"), F.col("total"), F.col("_ln_c")
    each = [F.struct(F.lit(s).alias("state"), present(k, n, alpha, hi, c, lo).alias("ll")) for s, (lo, hi) in (copies or COPIES).items()]
    return reads.withColumn("_ln_c", ln_choose(n, k)).select("cell_id", "snv_id", F.inline(F.array(*each)))
