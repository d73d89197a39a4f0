"""Near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors at cosine c lie sqrt(2 - 2c) apart. A hash is floor((a.v + b) / w) with a normal and b uniform in [0, w); a
table's key joins several hashes, and several tables make up for what one table parts. The number of hashes follows the
logarithm of the number of vectors, so that buckets of unrelated vectors stay small, and the number of tables follows
from the recall asked for at the threshold itself; closer pairs are found more surely.

Buckets are cut into blocks of bounded size and all pairs of blocks are compared with exact cosines in double precision.
A pair counts only in the first table whose keys agree, so that links are counted once without listing pairs; for the
components a block pair sends on a spanning forest of its links, fewer edges than vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest, key_runs, mix, signed, small_batches, stored
from .components import connected_components

#: Vectors in a block; a task holds two blocks.
BLOCK = 512
WIDTH = 2.0


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one hash agrees on two points so far apart."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_sizes(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Hashes in a key, so that a vector meets about one unrelated other in a table, and the number of tables."""
    hashes = max(4, math.ceil(math.log(max(n, 2)) / -math.log(collision(math.sqrt(2)))))
    hit = collision(math.sqrt(2 - 2 * cosine)) ** hashes
    return hashes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


class Hasher:
    def __init__(self, width: int, hashes: int, tables: int, seed: int):
        rng = np.random.default_rng(seed)
        self.hashes, self.tables = hashes, tables
        self.a = rng.standard_normal((width, hashes * tables))
        self.b = rng.random(hashes * tables) * WIDTH

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit key for each vector and table."""
        q = np.floor((unit @ self.a + self.b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.hashes)
        out = np.zeros(q.shape[:2], np.uint64)
        for i in range(self.hashes):
            out = mix(out * np.uint64(31) + q[:, :, i])
        return out


def units(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision, divided by their norms."""
    flat = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995, seed: int = 11, column: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Only vectors of the same
    length are compared. Equal vectors are one class, compared once; each member counts. vec_id may be null or repeat: rows
    are compared as rows, and component_id is the smallest vec_id of the component (null only if all are null). kept is
    vec_id = component_id. A tie at the threshold itself is a link. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(column).cast("array<double>")
    usable = v.isNotNull() & ~F.exists(F.coalesce(v, F.array().cast("array<double>")), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(F.coalesce(v, F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable & (norm > 0), v).alias("v"))
    classes = (
        rows.where("v is not null")
        .groupBy("v")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .select(F.monotonically_increasing_id().alias("node"), F.size("v").alias("width"), "*")
    )
    classes = stored(classes, "vectors")
    results = []
    for r in classes.groupBy("width").count().collect():  # one row for each vector length
        results.append(_links(classes.where(F.col("width") == r["width"]), r["width"], *table_sizes(r["count"], cosine, recall), cosine, seed))
    if not results:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts, edges = results[0]
    for c, e in results[1:]:
        counts, edges = counts.union(c), edges.union(e)
    roots = connected_components(edges)
    named = (
        classes.join(counts, "node", "left")
        .join(roots, "node", "left")
        .select("v", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("v", "links", "component")
    out = rows.join(named, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _links(classes: DataFrame, width: int, hashes: int, tables: int, cosine: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(node, links: rows of other classes that it links with) and a spanning set of edges (a, b)."""
    hasher = Hasher(width, hashes, tables, seed)

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                k = hasher.keys(units(batch.column("v")))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.asarray(batch.column("node")), tables)),
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), len(k))),
                        pa.array(signed(k.ravel())),
                    ],
                    ["node", "tab", "key"],
                )

    keys = stored(classes.select("node", "v").mapInArrow(keyed, "node long, tab int, key long"), "keys")
    # Stored, so that a large bucket is a large key of `keys` alone and its join can be split.
    full = stored(keys.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = keys.join(full, ["tab", "key"]).select("tab", "key", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("blk"))
    met = met.join(classes.select("node", "v", "copies"), "node")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = met.select("tab", "key", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), "blk", "node", "copies", "v")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["tab", "key", "x", "y"]
    dealt = pair.repartition(parts, *group).sortWithinPartitions(*group, "blk")

    def compare(rows: pa.RecordBatch, tab: int, x: int, y: int):
        blk, node, copies = (np.asarray(rows.column(c)) for c in ("blk", "node", "copies"))
        unit = units(rows.column("v"))
        cut = int(np.count_nonzero(blk == x)) if x != y else len(blk)
        left, right = (unit[:cut], unit[cut:]) if x != y else (unit, unit)
        i, j = np.nonzero(left @ right.T >= cosine)
        if x == y:
            i, j = i[i < j], j[i < j]
        else:
            j = j + cut
        if tab and len(i):
            some = np.unique(np.concatenate([i, j]))
            keys = np.zeros((len(unit), tab), np.uint64)
            keys[some] = hasher.keys(unit[some])[:, :tab]
            fresh = np.concatenate([~(keys[i[s : s + 50_000]] == keys[j[s : s + 50_000]]).any(axis=1) for s in range(0, len(i), 50_000)])
            i, j = i[fresh], j[fresh]
        if not len(i):
            return
        links = np.bincount(i, copies[j], len(unit)) + np.bincount(j, copies[i], len(unit))
        has = np.flatnonzero(links)
        a, b = forest(i, j)
        yield pa.array(node[has]), pa.array(links[has].astype(np.int64)), pa.nulls(len(has), pa.int64())
        yield pa.array(node[a]), pa.nulls(len(a), pa.int64()), pa.array(node[b])

    def blocks_of(batches):
        for rows in key_runs(batches, group):
            for part in compare(rows, *(rows.column(c)[0].as_py() for c in ("tab", "x", "y"))):
                yield pa.RecordBatch.from_arrays(list(part), ["node", "links", "other"])

    found = stored(dealt.mapInArrow(blocks_of, "node long, links long, other long"), "found")
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    return counts, edges
