"""How far the sources of a language lie apart, by their terms, in exact integer arithmetic.

Each term of a language becomes one row: an array with a count for every source of the language. Higher-order functions
turn it into an array of smoothed shares, and into the contributions of all pairs of sources, which are summed with
map-side combining. Nothing is collected but by Spark's own aggregates, and no group is held by one task: a term has as many
numbers as its language has sources.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, slices, small_batches, split_words, stored

#: Shares are in billionths.
SCALE = 1_000_000_000
#: Rows of the tables of groups and of languages that are broadcast at most.
BROADCAST_ROWS = 50_000
#: Text bytes of a task's partial counts.
COUNTED_BYTES = 8 << 20

# Bytes of a text in UTF-8: letters, A-Z in lower case, stay, and all bytes of characters beyond ASCII; others part terms.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Terms `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of each text, A-Z in lower case: offsets by text and all terms. Null: none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    body = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.empty(0, np.uint8)
    parted = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(bounds - bounds[0])), pa.py_buffer(_LETTERS[body]))
    return split_words(parted)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df), stored: occurrences and rows that have the term. A row with a null term for each group."""

    def scan(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text"), COUNTED_BYTES):
                lang, source = (batch.column(c)[lo:hi].dictionary_encode() for c in ("lang", "source"))
                pair = np.asarray(lang.indices, np.int64) * len(source.dictionary) + np.asarray(source.indices)
                groups, first, group = np.unique(pair, return_index=True, return_inverse=True)
                ends, words = terms_of(batch.column("text")[lo:hi])
                code, many = np.asarray(words.indices, np.int64), max(len(words.dictionary), 1)
                doc = np.repeat(np.arange(hi - lo), np.diff(ends))
                own, n = np.unique(doc * many + code, return_counts=True)
                key, back = np.unique(group[own // many] * many + own % many, return_inverse=True)
                totals = np.bincount(back, n, len(key)).astype(np.int64), np.bincount(back, minlength=len(key)).astype(np.int64)
                at = np.concatenate([groups * 0 + np.arange(len(groups)), key // many])
                names = pa.array(first[at])
                zero = np.zeros(len(groups), np.int64)
                term = pa.concat_arrays([pa.nulls(len(groups), pa.string()), words.dictionary.cast(pa.string()).take(pa.array(key % many))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang")[lo:hi].take(names), batch.column("source")[lo:hi].take(names), term, *(pa.array(np.concatenate([zero, x])) for x in totals)],
                    ["lang", "source", "term", "n", "df"],
                )

    small_batches(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    found = docs.select(*named).mapInArrow(scan, "lang string, source string, term string, n long, df long")
    return stored(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "terms")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact: the product may need more than 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2), wide(total + 2 * terms)) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); both are at most SCALE + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def wide_terms(counts: DataFrame, index: DataFrame, langs: DataFrame, least: int) -> DataFrame:
    """(lang, term, counts), stored: for each term in at least so many rows of its language, a count for every source."""
    met = counts.where("term is not null").join(index, ["lang", "source"])
    by = met.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("own")).where(F.col("df") >= least)
    dense = F.transform(F.sequence(F.lit(0), F.col("sources") - 1), lambda i: F.coalesce(F.col("own")[i], F.lit(0).cast("long")))
    return stored(by.join(langs, "lang").select("lang", "term", dense.alias("counts")), "wide")


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of every group of a language and a source.

    Terms in at least `least` rows of a language are kept there. Part `pair` has every other source of the language with the
    summed gaps between the shares of all kept terms (0 if none is kept), all ranks. Part `term` has the kept terms that the
    group has and that weigh more in it than in the language, the `top` largest gaps. Ranks go by value, then by the item's
    bytes. Null lang, source and text are ''; a text is counted whole, however long; repeated rows count as often as they
    come; nulls in other columns and other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = term_counts(docs)
    groups = counts.where("term is null")
    named = stored(groups.groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("names")), "langs")
    index = stored(named.select("lang", F.posexplode("names").alias("at", "source")), "index")
    small = broadcast_if_small(index, BROADCAST_ROWS)
    langs = broadcast_if_small(named, BROADCAST_ROWS)
    wide = wide_terms(counts, small, langs.select("lang", F.size("names").alias("sources")), least)
    discard(counts)
    sums = wide.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    totals = stored(sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("by"), F.sum("n").alias("total"), F.first("terms").alias("terms")), "totals")
    met = wide.join(broadcast_if_small(totals, BROADCAST_ROWS), "lang")
    own = F.zip_with("counts", F.col("by.n"), lambda n, all_: share(n, all_, F.col("terms")))
    every = share(F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n), F.col("total"), F.col("terms"))
    shares = stored(met.select("lang", "term", "counts", own.alias("shares"), every.alias("every")), "shares")
    discard(wide)

    # Each pair once: the gap is the same both ways.
    later = lambda i: F.slice("shares", i + 2, F.size("shares"))
    pairs = F.flatten(F.transform("shares", lambda p, i: F.transform(later(i), lambda q, j: F.struct(i.alias("x"), (i + 1 + j).alias("y"), gap(p, q).alias("f")))))
    apart = stored(shares.select("lang", F.inline(pairs)).groupBy("lang", "x", "y").agg(F.sum("f").alias("f")), "apart")
    both = apart.select("lang", F.col("x").alias("at"), F.col("y").alias("other"), "f").union(apart.select("lang", "y", "x", "f"))
    names = small.select("lang", F.col("at").alias("other"), F.col("source").alias("item"))
    every_pair = index.join(names, "lang").where("at <> other")  # one row a pair of sources: the result itself
    value = F.coalesce("f", F.lit(0)).cast("long").alias("value")
    pair = every_pair.join(both, ["lang", "at", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value)
    parts = shares.select("lang", "term", "every", F.posexplode(F.arrays_zip("counts", "shares")).alias("at", "own"))
    more = parts.where((F.col("own.counts") > 0) & (F.col("own.shares") > F.col("every")))
    term = more.join(small, ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("own.shares"), F.col("every")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pair, term)]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
