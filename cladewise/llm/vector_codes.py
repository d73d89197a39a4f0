"""Vectors as short codes: each part of a vector by its nearest entry in a small codebook, in exact integers.

Nearest entries are found from coarse to fine. A block of w components with sums S, T and residual norms r, s (what is left
of the block without its mean) lies at a squared distance of at least (S - T)**2 / w + (r - s)**2, and blocks add up. The
whole part is one block at first, then halves, quarters and so on; an entry goes when its bound lies above the exact
distance of the entry that looked nearest. Bounds are lowered by more than floating-point error, so no nearest entry is
lost, and the entries that remain get exact integer distances.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows compared at a time, and sums by label that are broadcast at most.
ROWS, BROADCAST_ROWS = 2048, 200_000
#: Components up to here have exact distances in 64 bits; larger ones are counted as Python's integers.
MACHINE = 1 << 26
#: Components from here on do not fit in 64 bits once scaled; they are an error.
LARGEST = float(1 << 54)


class Blocks:
    """Sums and residual norms of the rows of x (n, width) over 1, 2, 4, ... blocks."""

    def __init__(self, x: np.ndarray):
        self.levels = []
        width, many = x.shape[1], 1
        while True:
            edges = np.arange(many) * width // many
            sizes = np.diff(np.append(edges, width))
            sums = np.add.reduceat(x, edges, axis=1)
            left = np.add.reduceat(x * x, edges, axis=1) - sums * sums / sizes
            self.levels.append((sums, np.sqrt(np.maximum(left, 0)), sizes))
            if many * 2 > width // 2 or many >= 8:
                break
            many *= 2


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest row of entries (ties: the first) for each row of x, its squared distance, and exact distances counted."""
    n, k = len(x), len(entries)
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) > MACHINE:
        x, entries = x.astype(object), entries.astype(object)
        best = np.array([min((sum((a - b) ** 2 for a, b in zip(row, e)), j) for j, e in enumerate(entries)) for row in x.tolist()], object).reshape(n, 2)
        return best[:, 1].astype(np.int64), best[:, 0], n * k
    mine, theirs = Blocks(x.astype(np.float64)), Blocks(entries.astype(np.float64))
    row, entry, most, counted = np.repeat(np.arange(n), k), np.tile(np.arange(k), n), None, 0
    for (sums, rest, sizes), (sums_e, rest_e, _) in zip(mine.levels, theirs.levels):
        bound = np.zeros(len(row))
        for b, size in enumerate(sizes.tolist()):
            bound += (sums[row, b] - sums_e[entry, b]) ** 2 / size + (rest[row, b] - rest_e[entry, b]) ** 2
        bound -= 1e-6 * bound + 1e-3
        if most is None:
            looks = bound.reshape(n, k).argmin(1)
            gap = x - entries[looks]
            most, counted = (gap * gap).sum(1), n
        near = bound <= most[row]
        row, entry = row[near], entry[near]
    gap = x[row] - entries[entry]
    d = (gap * gap).sum(1)
    order = np.lexsort((entry, d, row))
    first = order[np.searchsorted(row[order], np.arange(n))]
    return entry[first], d[first], counted + len(row)


def _columns(batch: pa.RecordBatch, width: int) -> np.ndarray:
    v = batch.column("v")
    return np.asarray(v.flatten(), np.int64).reshape(len(v), width)


def quantised(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, label, v: floor(SCALE * x) for each component), stored. Rows whose vector is null, empty or holds null or
    non-finite components are left out, and so are vectors of another length than that of the smallest vec_id."""
    x = F.col(column).cast("array<double>")
    whole = x.isNotNull() & (F.size(x) > 0) & ~F.exists(F.coalesce(x, F.array().cast("array<double>")), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.when(whole, x).alias("x")).where("x is not null")
    ints = F.transform("x", lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * SCALE).cast("long")).otherwise(F.raise_error("a component is beyond 64 bits").cast("long")))
    out = stored(kept.select("vec_id", "label", ints.alias("v")), "quantised")
    first = out.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    same = out.where(F.size("v") == (first[0] if first else 0))
    same._stored_at = out._stored_at
    return same


def _first_entries(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width / parts) from the rows with the smallest vec_ids (nulls last; ties by vector)."""
    got = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]  # the codebook
    return np.array(got, np.int64).reshape(len(got), parts, width // parts).transpose(1, 0, 2)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of its parts; sums are made task by task, then added."""
    parts, entries, size = books.shape

    def sums(batches):
        n, s, wide = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), object), np.zeros((parts, entries, size), np.int64)
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _columns(batch, parts * size)
            for lo in range(0, len(v), ROWS):
                cut = v[lo : lo + ROWS]
                for p in range(parts):
                    own = cut[:, p * size : (p + 1) * size]
                    at = nearest(own, books[p])[0]
                    n[p] += np.bincount(at, minlength=entries)
                    if np.abs(own).max() > MACHINE:
                        np.add.at(s[p], at, own.astype(object))
                    else:
                        np.add.at(wide[p], at, own)
                seen += len(cut)
                if seen > 1 << 30:  # far from where 64 bits end
                    s, wide, seen = s + wide, np.zeros_like(wide), 0
        s = s + wide
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array([[str(x) for x in r] for r in s[p, e].tolist()], pa.list_(pa.string()))], ["part", "entry", "n", "s"])

    found = rows.select("v").mapInArrow(sums, "part int, entry int, n long, s array<string>")
    total = [F.sum(F.col("s")[i].cast("decimal(38,0)")).cast("string") for i in range(size)]
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*total).alias("s")).collect():  # the codebook
        out[r["part"], r["entry"]] = [int(x) // r["n"] for x in r["s"]]
    return out


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Integers (parts, entries, components of a part) fitted on all rows: vec_id, v. Fewer rows than entries: as many."""
    first = rows.select("v").first()
    if first is None:
        return np.zeros((parts, 0, 0), np.int64)
    if len(first["v"]) % parts:
        raise ValueError(f"{len(first['v'])} components cannot be cut into {parts} equal parts")
    books = _first_entries(rows, len(first["v"]), parts, entries)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (vec_id, label, v) with codes: vec_id, label, code (an index of two hex digits or more for each part), error."""
    parts, entries, size = books.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    names = np.array([f"{i:0{digits}x}" for i in range(entries)])

    def scan(batches):
        for batch in batches:
            v = _columns(batch, parts * size)
            for lo in range(0, len(v), ROWS):
                cut = v[lo : lo + ROWS]
                got = [nearest(cut[:, p * size : (p + 1) * size], books[p])[:2] for p in range(parts)]
                code = ["".join(x) for x in zip(*(names[at].tolist() for at, _ in got))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[lo : lo + ROWS], batch.column("label")[lo : lo + ROWS], pa.array(code, pa.string()), pa.array([int(x) for x in sum(d for _, d in got)], pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(scan, f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with `approx`: the entries that a code stands for, as integers."""
    parts, entries, _ = books.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    tables = [F.array(*[F.array(*[F.lit(int(c)) for c in e]) for e in book]) for book in books]
    found = [F.element_at(tables[p], F.conv(F.substring("code", p * digits + 1, digits), 16, 10).cast("int") + 1) for p in range(parts)]
    return codes.withColumn("approx", F.concat(*found))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, column: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null, empty, or hold null or non-finite components are left out, as are vectors of another length than
    that of the smallest kept vec_id; a length that `parts` does not divide is an error. vec_id may be null (after all
    others) and may repeat: rows are coded one by one, and the codebook starts from the first rows by vec_id, then vector.
    Ties go to the lower entry; with fewer rows than entries there are as many entries as rows. error is the squared distance
    to what the code stands for; label_error adds it up over rows with equal labels, nulls together. An empty table gives no
    rows. Components of 2**54 and more are an error, and so is an error that 64 bits cannot hold. Other columns are ignored,
    whatever their names.
    """
    rows = quantised(vectors, column)
    books = codebooks(rows, parts, entries, rounds)
    codes = stored(encode(rows, books), "codes")
    discard(rows)
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "l")
    met = codes.join(broadcast_if_small(sums, BROADCAST_ROWS), F.col("label").eqNullSafe(F.col("l")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
