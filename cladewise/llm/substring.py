"""Substring dedup by seed and extend, over word windows.

Seeds: winnowing picks one k-word gram in every window of `length` words, by content alone, so equal windows pick the same
gram at the same place. Only seeds met twice can lie in repeated windows.

Extension runs over classes instead of pairs, so that a passage in very many documents costs its number of occurrences
and not its square. A seed's occurrence stands for the windows that picked it: a run of neighbouring starts, and its
context is all words that these windows cover. Occurrences with equal seed and context agree in every window, to both
sides: they form a class, and a class of two or more is repeated as a whole. Where a seed has several classes, one member
of each is extended window by window, and windows that two classes share are repeated. What is covered is then merged
into maximal repeats, each at least `length` words long.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, broadcast_if_small, discard, signed, slices, small_batches, stored, word_codes

#: Ids of documents to extend that may be sent to all executors; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
NO_ID = -(1 << 63)


class Seeds:
    """Winnowed seeds of a batch of texts, as parallel arrays: text, start and number of windows, seed and context."""

    def __init__(self, texts: pa.Array, length: int, gram: int):
        ends, codes = word_codes(texts)
        self.length, self.roll = length, Rolling(codes)
        n, most = len(codes), len(codes) - length + 1
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        if most <= 0:
            self.text = self.at = self.first = self.windows = np.empty(0, np.int64)
            self.seed = self.context = np.empty(0, np.uint64)
            return
        at = np.arange(n - gram + 1)
        grams = self.roll.of(at, at + gram)
        starts = np.arange(most)
        picked = starts + np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1).argmin(axis=1)
        inside = starts + length <= ends[doc[starts] + 1]
        starts, picked = starts[inside], picked[inside]
        new = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]])) if len(starts) else np.empty(0, np.int64)
        self.at = starts[new]
        self.windows = np.diff(np.concatenate([new, [len(starts)]]))
        self.text = doc[self.at]
        self.first = self.at - ends[self.text]
        self.seed = grams[picked[new]]
        offset = (picked[new] - self.at).astype(np.uint64)
        self.context = self.roll.of(self.at, self.at + self.windows - 1 + length) ^ (offset * np.uint64(0x9E3779B97F4A7C15))

    def window_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the seeds `which`: index into which, offset of the window, hash of the window."""
        times = self.windows[which]
        index = np.repeat(np.arange(len(which)), times)
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start = self.at[which][index] + offset
        return index, offset, self.roll.of(start, start + self.length)


def repeated_windows(docs: DataFrame, length: int = 35, gram: int = 12) -> DataFrame:
    """Runs of repeated windows: doc, text_hash, windows array<struct<start, n, mask>>; one row per document that has any.

    `doc` is doc_id with null as the least long. Bit i of mask tells that the window at word start + i occurs elsewhere.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not gram < length <= gram + 63:
        raise ValueError("length must be above gram and at most gram + 63")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def seeds(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                s = Seeds(batch.column("text")[lo:hi], length, gram)
                take = pa.array(s.text + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(take), batch.column("text_hash").take(take), pa.array(signed(s.seed)), pa.array(signed(s.context)), pa.array(s.first.astype(np.int32)), pa.array(s.windows.astype(np.int32))],
                    ["doc", "text_hash", "seed", "context", "start", "n"],
                )

    occurrences = rows.mapInArrow(seeds, "doc long, text_hash long, seed long, context long, start int, n int")
    repeated = (
        occurrences.groupBy("seed")
        .agg(F.count("*").alias("times"), F.min("context").alias("low"), F.max("context").alias("high"))
        .where("times > 1")
        .select("seed", (F.col("low") != F.col("high")).alias("several"))
    )
    # Written first: a join that follows straight on the grouping could not split a frequent seed.
    repeated = stored(repeated, "repeated")
    met = stored(occurrences.join(repeated, "seed"), "seeds")
    discard(repeated)
    one = F.min(F.struct("doc", "text_hash"))
    classes = stored(met.where("several").groupBy("seed", "context").agg(F.count("*").alias("times"), one.alias("member")), "classes")

    # One member of each class is extended; its text is read again and told which contexts to extend. A text has no more
    # contexts than seeds, whatever the number of its copies.
    key = ["doc", "text_hash"]
    wanted = stored(classes.groupBy(F.col("member.doc").alias("doc"), F.col("member.text_hash").alias("text_hash")).agg(F.collect_list("context").alias("contexts")), "wanted")
    at = broadcast_if_small(wanted.select(*key), BROADCAST_IDS)
    read_again = rows.join(at, key, "left_semi").join(wanted.hint("shuffle_merge"), key).select("text", "contexts")

    def extend(batches):
        for batch in batches:
            asked = batch.column("contexts")
            for lo, hi in slices(batch.column("text")):
                s = Seeds(batch.column("text")[lo:hi], length, gram)
                mine = asked[lo:hi]
                ends = np.asarray(mine.offsets, np.int64)
                flat = np.asarray(mine.flatten(), np.int64)
                pairs = np.stack([np.repeat(np.arange(hi - lo), np.diff(ends)), flat], 1)
                have = np.stack([s.text, signed(s.context)], 1)
                kind = [("a", np.int64), ("b", np.int64)]
                keep = np.flatnonzero(np.isin(np.ascontiguousarray(have).view(kind).ravel(), np.ascontiguousarray(pairs).view(kind).ravel()))
                index, offset, hashes = s.window_hashes(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(s.seed[keep][index])), pa.array(signed(s.context[keep][index])), pa.array(offset.astype(np.int32)), pa.array(signed(hashes))],
                    ["seed", "context", "at", "hash"],
                )

    windows = read_again.mapInArrow(extend, "seed long, context long, at int, hash long")
    # Windows that several classes of a seed share; copies of a member say the same of one class.
    shared = windows.groupBy("seed", "hash").agg(F.min("context").alias("low"), F.max("context").alias("high")).where("low <> high").select("seed", "hash")
    bit = F.expr("shiftleft(1L, at)")
    partial = windows.join(shared, ["seed", "hash"]).groupBy("seed", "context").agg(F.bit_or(bit).alias("mask"))
    masks = classes.join(partial, ["seed", "context"], "left").select(
        "seed", "context", F.when(F.col("times") > 1, F.lit(-1)).otherwise(F.coalesce("mask", F.lit(0))).cast("long").alias("mask")
    )
    # Written first, like the seeds: a frequent context can then be split.
    masks = stored(masks.where("mask <> 0"), "masks")
    hits = met.join(masks, ["seed", "context"], "left").select(
        "doc", "text_hash", F.struct("start", "n", F.when(F.col("several"), F.coalesce("mask", F.lit(0))).otherwise(F.lit(-1)).cast("long").alias("mask")).alias("w")
    )
    # Rows with the same doc_id and text have the same windows.
    hits = stored(hits.where("w.mask <> 0").groupBy("doc", "text_hash").agg(F.collect_set("w").alias("windows")), "hits")
    discard(met, classes, wanted, masks)
    return hits


def _covered(n_words: int, windows, length: int) -> np.ndarray:
    start = np.fromiter((w["start"] for w in windows), np.int64, len(windows))
    n = np.fromiter((w["n"] for w in windows), np.int64, len(windows))
    mask = np.fromiter((w["mask"] for w in windows), np.int64, len(windows))
    index = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (start[index] + offset)[(mask[index] >> offset) & 1 == 1]
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = 35, gram: int = 12, texts: bool = True) -> DataFrame:
    """Drop every word covered by a window of `length` words that also starts elsewhere, in any document.

    Returns per row: doc_id, n_words, n_removed, kept_sha256, repeats array<struct<start, end>> (maximal repeats, in words,
    end exclusive) and, with `texts`, kept_text (words joined by one space). Words are `[^\\x20\\x09-\\x0D]+`. Null and
    empty texts have no words; a text is taken whole, however long. Rows repeated whole, or with a null or repeated doc_id,
    count as occurrences of their own; equal seeds of a window are no matter of order, since the leftmost is taken. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    hits = repeated_windows(docs, length, gram)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    joined = rows.join(hits, ["doc", "text_hash"], "left").select("doc_id", "text", "windows")

    def cut(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for text, windows in zip(batch.column("text"), batch.column("windows")):
                words = text.as_py().encode().split()  # at the six ASCII white-space characters
                kept, n, repeats = words, len(words), []
                if windows.is_valid:
                    gone = _covered(n, windows.as_py(), length)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    repeats = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
                    kept = list(compress(words, ~gone))
                line = b" ".join(kept)
                out.append((n, n - len(kept), hashlib.sha256(line).hexdigest(), repeats, line.decode() if texts else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], span), pa.array([x[4] for x in out], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "kept_text"],
            )

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,end:int>>, kept_text string")
