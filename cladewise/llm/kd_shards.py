"""Sharding by a k-d tree over metadata, with DataFrame functions only.

Equal texts are one group with the bytes of all its copies. A node of the tree stands for a run of shards. It is split along
the dimension in which its groups spread widest, at the weighted median (of an odd number of shards: at the quantile that
its left shards are due), until a leaf holds one shard and so the target bytes. Where the median falls inside one value,
which a hot source has, groups of that value are parted by a hash, so that both sides come out as asked.

Strings become their weighted ranks: the share of all bytes under smaller values. Quantiles come from weighted histograms:
each pass counts bytes in BINS bins of every node's range and narrows it to the bin where the goal is passed. Cuts are a
table with a row for each node, and groups meet it by a join.

A few groups may weigh so much that no cut could come near its goal. They are laid out first, each on the emptiest shard,
and the tree gives each shard what room is left.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, bytes_of, discard, stored

BINS = 1024
#: A group of more than a shard's bytes by this is laid out before the tree grows: at most shards * BOULDER groups.
BOULDER = 64
#: A group larger than a shard is dealt over so many pieces, row by row.
PIECES = 1024
#: Rows that one task numbers, about.
NUMBERED = 1_000
#: Distinct values of a metadata column whose ranks may be sent to all executors; beyond it the join is shuffled.
BROADCAST_VALUES = 100_000


def weighted_ranks(groups: DataFrame, column: str) -> DataFrame:
    """column, rank (stored): the share of all bytes that smaller values have. Values are sorted in ranges, not in one task."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = groups.groupBy(column).agg(F.sum("bytes").alias("b")).repartitionByRange(parts, column)
    values = stored(values.withColumn("part", F.spark_partition_id()), "values")
    # A row for each partition.
    totals = values.groupBy("part").agg(F.sum("b").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    inside = Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("own", F.coalesce(F.sum("b").over(inside), F.lit(0))).join(F.broadcast(totals), "part")
    out = stored(ranked.select(column, ((F.col("base") + F.col("own")) / F.col("all")).alias("rank")), "ranks")
    discard(values)
    return out


def _find(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Of each node in goals (node, goal): the x at which the running sum of bytes reaches the goal, and the bytes below it
    and at it. rows: node, x (double), bytes."""
    ends = rows.groupBy("node").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    state = stored(goals.join(ends, "node").select("node", "goal", "low", "high", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("at")), "search")
    while True:
        met = rows.join(F.broadcast(state.drop("at")), "node").where("x between low and high")
        bin_ = F.when(F.col("low") < F.col("high"), F.least(F.floor((F.col("x") - F.col("low")) * BINS / (F.col("high") - F.col("low"))), F.lit(BINS - 1))).otherwise(0)
        bins = met.groupBy("node", "goal", "below", bin_.alias("bin")).agg(F.sum("bytes").alias("b"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("through", F.col("below") + F.sum("b").over(upto)).where(F.col("through") >= F.col("goal"))
        first = bins.groupBy("node", "goal").agg(F.min(F.struct("bin", "lo", "hi", "through", "b")).alias("f"))
        last, state = state, stored(first.select("node", "goal", F.col("f.lo").alias("low"), F.col("f.hi").alias("high"), (F.col("f.through") - F.col("f.b")).alias("below"), F.col("f.b").alias("at")), "search")
        discard(last)
        if state.where("low < high").isEmpty():
            return state.select("node", "goal", F.col("low").alias("x"), "below", "at")


def _widest(groups: DataFrame, dims: list[str]) -> DataFrame:
    """node, dim (its place in dims), bytes. The first of equally wide dimensions counts."""
    bounds = groups.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in dims])
    top = F.greatest(*[F.struct(F.col(d).alias("width"), F.lit(-i).alias("place")) for i, d in enumerate(dims)])
    return bounds.select("node", (-top["place"]).alias("dim"), "bytes")


def grow_tree(groups: DataFrame, dims: list[str], rooms: list[int]) -> tuple[DataFrame, list[DataFrame]]:
    """groups (bytes, tie and dimensions from 0 to 1) with their shard, and the cuts of each level.

    rooms: how much each shard is due; a node's goal is its bytes times the share of its left shards. Cuts: node, dim, goal,
    x, tie: left go the groups with a smaller value than x, or with x itself and at most tie. The driver knows the runs of
    shards that nodes stand for, a few numbers for each shard; nothing else depends on the data.
    """
    spark = groups.sparkSession
    runs, levels = {1: (0, len(rooms))}, []
    groups = groups.withColumn("node", F.lit(1))
    while any(hi - lo > 1 for lo, hi in runs.values()):
        split = {n: (lo, (lo + hi) // 2, hi) for n, (lo, hi) in runs.items() if hi - lo > 1}
        shares = [(n, sum(rooms[lo:mid]) / sum(rooms[lo:hi]) if sum(rooms[lo:hi]) else (mid - lo) / (hi - lo)) for n, (lo, mid, hi) in split.items()]
        now = stored(groups, "level")
        nodes = _widest(now, dims).join(F.broadcast(spark.createDataFrame(shares, "node int, share double")), "node")
        goal = F.greatest(F.least(F.round(F.col("bytes") * F.col("share")).cast("long"), F.col("bytes")), F.lit(1).cast("long"))
        nodes = stored(nodes.select("node", "dim", goal.alias("goal")), "nodes")
        value = F.coalesce(*[F.when(F.col("dim") == i, F.col(d)) for i, d in enumerate(dims)])
        placed = now.join(F.broadcast(nodes), "node").withColumn("value", value)
        at = _find(placed.select("node", F.col("value").alias("x"), "bytes"), nodes)
        tied = placed.drop("goal").join(F.broadcast(at), "node").where("value = x")
        ties = _find(tied.select("node", F.col("tie").alias("x"), "bytes"), at.select("node", (F.col("goal") - F.col("below")).alias("goal")))
        # The group at the goal goes to the side that then comes nearer to it.
        over = F.col("below") + F.col("at") - F.col("goal") <= F.col("goal") - F.col("below")
        ties = ties.select("node", F.when(over, F.col("x")).otherwise(F.col("x") - 0.5).alias("tie"))
        cuts = stored(nodes.join(at.select("node", "x"), "node").join(ties, "node"), "cuts")
        levels.append(cuts)
        left = (F.col("value") < F.col("x")) | ((F.col("value") == F.col("x")) & (F.col("tie") <= F.col("cut_tie")))
        moved = now.join(F.broadcast(cuts.withColumnRenamed("tie", "cut_tie")), "node", "left").withColumn("value", value)
        groups = moved.withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1)).cast("int")).select(*groups.columns)
        groups = stored(groups, "level")
        discard(now, nodes)
        for n, (lo, mid, hi) in split.items():
            runs[2 * n], runs[2 * n + 1] = (lo, mid), (mid, hi)
            del runs[n]
    shard = spark.createDataFrame([(n, lo) for n, (lo, _) in runs.items()], "node int, shard int")
    return groups.join(F.broadcast(shard), "node").drop("node"), levels


def lay_out(sizes: list[tuple[str, int]], shards: int) -> tuple[list[tuple[str, int]], list[int]]:
    """Groups to shards, the largest first, each to the emptiest; and the bytes so laid on each shard."""
    heap, out, load = [(0, s) for s in range(shards)], [], [0] * shards
    for grp, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        _, s = heapq.heappop(heap)
        out.append((grp, s))
        load[s] += size
        heapq.heappush(heap, (load[s], s))
    return out, load


def _named(col: Column) -> Column:
    """Nulls are a value of their own, before all others."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def shard_documents(docs: DataFrame, shards: int = 8, metadata: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard (0..shards-1), slot (gapless from 0).

    Dimensions: the string columns `metadata` (source and lang) by weighted rank, and the logarithm of the text's size. Equal
    texts stay together unless all copies of one outweigh a whole shard; such a group alone is dealt row by row. Ties within
    a value are parted by a hash of the text. Nulls are ordinary values (a null text has no bytes), doc_ids may be null or
    repeat; repeated rows get slots of their own; long texts count by their bytes; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    metadata = ["source", "lang"] if metadata is None else metadata
    names = [f"m{i}" for i in range(len(metadata))]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (bytes_of("text") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.sha1(text).alias("grp"), *[_named(F.col(c)).alias(m) for c, m in zip(metadata, names)]
    )
    # Written once, so that rid stays the same wherever the rows are read.
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("piece", F.pmod(F.xxhash64("rid"), F.lit(PIECES)).cast("int")), "rows")
    facts = [F.sum("size").alias("bytes"), F.max("size").alias("width"), *[F.min(m).alias(m) for m in names]]
    sums = stored(rows.groupBy("grp").agg(*facts), "groups")
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    # Groups that outweigh a shard are fewer than shards; boulders fewer than shards * BOULDER.
    heavy = stored(sums.where(F.col("bytes") * shards > total).select("grp"), "heavy")
    large = sums.where((F.col("bytes") * shards * BOULDER > total) & (F.col("bytes") * shards <= total)).select("grp", "bytes").collect()
    laid, load = lay_out([tuple(r) for r in large], shards)
    laid = docs.sparkSession.createDataFrame(laid, "grp string, shard int")
    rest = sums.join(F.broadcast(laid), "grp", "left_anti").join(F.broadcast(heavy), "grp", "left_anti").withColumn("part", F.lit(-1))
    pieces = rows.join(F.broadcast(heavy), "grp").groupBy("grp", F.col("piece").alias("part")).agg(*facts)
    groups = stored(rest.unionByName(pieces), "pieces")
    for m in names:
        ranks = weighted_ranks(groups, m)
        last, groups = groups, stored(groups.join(broadcast_if_small(ranks, BROADCAST_VALUES), m).drop(m).withColumnRenamed("rank", m), "pieces")
        discard(last, ranks)
    size = F.log2("width") / math.log2(max(groups.agg(F.max("width")).first()[0] or 2, 2))
    tie = F.pmod(F.xxhash64("grp", "part"), F.lit(1 << 50)).cast("double")
    placed, _ = grow_tree(groups.select("grp", "part", "bytes", *names, size.alias("width"), tie.alias("tie")), [*names, "width"], [max(-(-total // shards) - x, 0) for x in load])
    placed = stored(placed.select("grp", "part", "shard").unionByName(laid.select("grp", F.lit(-1).alias("part"), "shard")), "shards")
    rows = rows.join(F.broadcast(heavy.withColumn("dealt", F.lit(True))), "grp", "left").withColumn("part", F.when(F.col("dealt"), F.col("piece")).otherwise(-1))
    met = stored(rows.join(placed, ["grp", "part"]).select("doc_id", "size", "text_crc32", "rid", "shard"), "placed")
    discard(sums, groups, placed)
    return _numbered(met)


def _numbered(rows: DataFrame) -> DataFrame:
    """Slots within shards, from bins of about NUMBERED rows."""
    many = rows.groupBy("shard").agg(F.ceil(F.count("*") / NUMBERED).alias("many"))  # a row for each shard
    dealt = rows.join(F.broadcast(many), "shard").withColumn("bin", F.pmod(F.xxhash64("rid"), F.col("many")))
    bins = dealt.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "rid")
    numbered = dealt.withColumn("at", F.row_number().over(inside) - 1).join(bins, ["shard", "bin"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"))
