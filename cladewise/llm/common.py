"""What the corpus operators share: the shared folder, word codes from Arrow buffers, rolling hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker splits into words at a time. A longer text is taken whole, alone.
SLICE_BYTES = 2 << 20
#: Rows in an Arrow batch; documents of 100 kB then make batches of 50 MB.
BATCH_ROWS = "500"

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Spark's switch for removing an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share when the session is built")
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go at once; nothing reads them again.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what stored() wrote, once nothing will read it again."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Texts can be long, so Arrow batches hold few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """df (stored) for a join: sent to all executors if it has at most so many rows, else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def row_hash(docs: DataFrame):
    """A hash of all columns that can be hashed: what tells rows apart where doc_ids are missing or repeat."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])


def apart(docs: DataFrame) -> str:
    """A prefix that no column of docs begins with, for columns of an operator's own beside them."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def rows_within(docs: DataFrame, keys: DataFrame, how: str, most: int) -> DataFrame:
    """docs joined (left_semi or left_anti) with stored keys: doc_id and row, a row_hash() of docs. All columns of docs stay."""
    row, doc, r, d = (apart(docs) + c for c in ("row", "doc", "r", "d"))
    keys = broadcast_if_small(keys.select(F.col("row").alias(r), F.col("doc_id").alias(d)), most)
    keyed = docs.withColumns({row: row_hash(docs), doc: F.col("doc_id").cast("long")})
    met = keyed.join(keys, (F.col(row) == F.col(r)) & F.col(doc).eqNullSafe(F.col(d)), how)
    return met.select(*[F.col(f"`{c}`") for c in docs.columns])


def bytes_of(col: str):
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


# --- inside tasks -----------------------------------------------------------------------------------------------------


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    lo, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(size):
        yield lo, len(size)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: offsets by text, and all words dictionary-encoded. Null: no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, ends = flat.filter(pa.array(full)), kept[ends]
    return ends, flat.dictionary_encode()


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and a 64-bit code for each word."""
    ends, words = split_words(texts)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return ends, own[np.asarray(words.indices)] if len(words) else np.empty(0, np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Hash of any run of codes in O(1), by prefix sums modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(len(codes), _BASE)[:-1], out=self.sums[1:])
        self.back = powers(len(codes), _INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of each key (integers) as one batch, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([np.asarray(batch.column(c), np.int64) for c in keys], 1)
        edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(ids[lo].tolist())
            if held and key != last:
                yield joined()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield joined()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a - b."""
    parent: dict[int, int] = {}

    def top(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        u, v = top(x), top(y)
        if u != v:
            parent[u] = v
            kept.append(i)
    return a[kept], b[kept]
