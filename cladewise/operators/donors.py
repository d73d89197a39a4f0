"""Nearest donors for cells that lack a feature: a metric join over balls around pivots, without a table of all pairs."""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep

#: Rows on each side of a comparison; more of a ball go to further blocks.
BLOCK = 500
#: Most pivots, which every task gets a copy of; below that, the square root of the number of donors.
PIVOTS = 2000


def _measured(vectors: DataFrame) -> DataFrame:
    """Cells whose vectors have a distance: not null, empty or with components that are null or not finite."""
    vec = F.col("vec").cast("array<double>")
    odd = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where((F.size("vec") > 0) & ~odd).select("cell_id", vec.alias("vec"))


def _to_pivots(batch: pa.RecordBatch, pivots: np.ndarray):
    """(vector, its distances to all pivots) row by row."""
    for v in batch.column("vec").to_pylist():
        yield v, np.sqrt(((pivots - np.array(v)) ** 2).sum(1))


def _packed(rows: DataFrame, name: str, block: str) -> DataFrame:
    """Rows (pivot, `name`, vec) as blocks of about BLOCK rows of one ball."""
    sizes = rows.groupBy("pivot").agg(F.count("*").alias("n"))  # a row a pivot
    place = F.pmod(F.xxhash64(name), F.ceil(F.col("n") / BLOCK))
    packed = rows.join(F.broadcast(sizes), "pivot").groupBy("pivot", place.alias(block)).agg(F.collect_list(F.struct(name, "vec")).alias(f"{block}_rows"))
    return keep(packed, "packed")


def _compare(cells: DataFrame, balls: DataFrame) -> DataFrame:
    """(cell_id, d, donor): the nearest donor in the balls that a cell is listed for."""
    left = _packed(cells, "cell_id", "x")
    keys = left.select("pivot", "x").join(balls.select("pivot", "y"), "pivot")
    met = keys.join(left, ["pivot", "x"]).join(balls, ["pivot", "y"])

    def nearest(batches):
        for batch in batches:
            ids, ds, found = [], [], []
            for xs, ys in zip(batch.column("x_rows"), batch.column("y_rows")):
                xs, ys = xs.as_py(), ys.as_py()
                donors, y = np.array([r["donor"] for r in ys]), np.array([r["vec"] for r in ys])
                for r in xs:
                    d = np.sqrt(((y - np.array(r["vec"])) ** 2).sum(1))
                    ids.append(r["cell_id"])
                    ds.append(d.min())
                    found.append(donors[d == d.min()].min())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ds, pa.float64()), pa.array(found, pa.int64())], ["cell_id", "d", "donor"])

    by = met.select("x_rows", "y_rows").mapInArrow(nearest, "cell_id long, d double, donor long")
    return by.groupBy("cell_id").agg(F.min(F.struct("d", "donor")).alias("best"))


def _further(cells: DataFrame, pivots: np.ndarray, bounds: list) -> DataFrame:
    """(pivot, cell_id, vec) for the other balls that may hold a donor as near as `d`, the best so far. By the triangle
    inequality, members of a ball lie at least as far as the gap between the cell's distance to the pivot and theirs."""
    low, high = (np.array([b[k] for b in bounds]) for k in ("low", "high"))

    def list_balls(batches):
        for batch in batches:
            ids, own, best = (batch.column(c).to_pylist() for c in ("cell_id", "pivot", "d"))
            out = []
            for i, p, d, (v, far) in zip(ids, own, best, _to_pivots(batch, pivots)):
                least = np.maximum(far - high, low - far)
                slack = 1e-9 * (1 + d + far)  # rounding must not lose a ball
                out += [(int(q), i, v) for q in np.flatnonzero(least <= d + slack) if q != p]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64()))], ["pivot", "cell_id", "vec"])

    return cells.mapInArrow(list_balls, "pivot int, cell_id long, vec array<double>")


def whole(names: list[str]) -> Column:
    """Whether a cell has all features."""
    return F.expr(" and ".join(f"{n} is not null" for n in names))


def nearest_donor(vectors: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """(cell_id, donor): the nearest cell with all features, for each cell that lacks some; ties to the smallest id.

    Donors are dealt to the nearest of some pivots, donors themselves. A cell meets the donors of its own ball first, then
    those of the balls that could hold one as near. Equal vectors count once, under their smallest id. Exact whatever the
    pivots; how many balls are met depends on how clustered the vectors are. Cells whose vectors are null, empty or hold
    components that are null or not finite neither give nor receive; all other vectors have the same length.
    """
    at = _measured(vectors)
    all_donors = at.join(features.where(whole(names)).select("cell_id"), "cell_id", "left_semi")
    donors = keep(all_donors.groupBy("vec").agg(F.min("cell_id").cast("long").alias("donor")).select("donor", "vec"), "donors")
    lacking = at.join(features.where(~whole(names)).select("cell_id"), "cell_id", "left_semi").select(F.col("cell_id").cast("long").alias("cell_id"), "vec")
    many = min(PIVOTS, ceil(sqrt(donors.count())))
    chosen = donors.orderBy(F.xxhash64("donor"), "donor").limit(many).select("vec").collect()  # at most PIVOTS
    if not chosen:
        return lacking.where("false").select("cell_id", F.lit(None).cast("long").alias("donor"))
    pivots = np.array([r["vec"] for r in chosen])

    def deal(name):
        def own_ball(batches):
            for batch in batches:
                near = [(int(far.argmin()), float(far.min())) for _, far in _to_pivots(batch, pivots)]
                yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in near], pa.int32()), batch.column(name), batch.column("vec"), pa.array([n[1] for n in near], pa.float64())], ["pivot", name, "vec", "far"])

        return own_ball

    dealt = keep(donors.mapInArrow(deal("donor"), "pivot int, donor long, vec array<double>, far double"), "dealt")
    found = {r["pivot"]: r for r in dealt.groupBy("pivot").agg(F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    bounds = [found.get(p, {"low": float("inf"), "high": float("-inf")}) for p in range(len(pivots))]
    balls = _packed(dealt.select("pivot", "donor", "vec"), "donor", "y")
    cells = keep(lacking.mapInArrow(deal("cell_id"), "pivot int, cell_id long, vec array<double>, far double").select("pivot", "cell_id", "vec"), "lacking")
    first = keep(_compare(cells, balls), "first")
    again = cells.join(first.select("cell_id", F.col("best.d").alias("d")), "cell_id")
    second = _compare(keep(_further(again, pivots, bounds), "further"), balls)
    both = first.union(second).groupBy("cell_id").agg(F.min("best").alias("best"))
    return both.select("cell_id", F.col("best.donor").alias("donor"))


def impute(features: DataFrame, vectors: DataFrame, names: list[str]) -> DataFrame:
    """Copy the whole feature row of the nearest donor into cells that lack a feature. If more than half of the cells lack
    some, or no donor has a distance, nothing is imputed."""
    share = features.agg(F.avg((~whole(names)).cast("double"))).first()[0]
    own = features.select("cell_id", *names)
    if share is None or share > 0.5:
        return own
    given = nearest_donor(vectors, features, names).join(features.select(F.col("cell_id").alias("donor"), *[F.col(n).alias(f"{n}_d") for n in names]), "donor")
    out = own.join(given, "cell_id", "left")
    return out.select("cell_id", *[F.when(F.col("donor").isNotNull(), F.col(f"{n}_d")).otherwise(F.col(n)).alias(n) for n in names])
