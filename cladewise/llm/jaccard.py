"""Similarity join on word shingles: grouped prefix join.

A document is the set of its distinct k-word shingles. Equal sets are one node. Sets with Jaccard similarity of at least t
share a shingle among their first p = n - ceil(t n) + 1 in any order of all shingles. Here the rarest come first.

* A first count covers a fixed quarter of all shingles (by hash). A set with p shingles that no other set has can link
  with nothing and is done.
* The sets still open are read again whole, and all their shingles are counted among them. Those shared give the prefixes.
* Open nodes are collapsed: nodes with the same prefix and the same size form a group.
* Groups that share a prefix shingle are candidates. They are not listed: groups that share much of their prefixes are put
  into buckets, and a bucket of more than one block is first compared with its head alone, one comparison a member. Blocks
  of bounded size that share a shingle are then paired, but not blocks whose members all link with the same head. In a pair
  of blocks, groups are filtered by size and by the shingles that nothing else has; what is left is expanded and verified
  by a product of incidence matrices. A pair of blocks hands on a spanning forest of its links, so a large group of near
  copies sends on about as many rows as it has members, and no link that could change a component is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, apart, broadcast_if_small, discard, forest, key_runs, row_hash, rows_within, signed, slices, small_batches, stored, word_codes
from .components import connected_components

#: One shingle in so many (a power of two) is in the first count.
COUNTED = 4
#: Rows (two long integers) that may be sent to all executors; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Nodes in a block, about, and shingles of them all, about.
BLOCK, BLOCK_SHINGLES = 256, 500_000


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends by text and sorted distinct shingle hashes. A shorter text is one shingle; without words there is none."""
    ends, codes = word_codes(pc.ascii_lower(pc.fill_null(texts, "")))
    words = np.diff(ends)
    n = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    text = np.repeat(np.arange(len(words)), n)
    start = ends[text] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hashes = Rolling(codes).of(start, np.minimum(start + k, ends[text + 1]))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(words)))]), hashes


def prefix_size(n, percent: int):
    return n - (n * percent + 99) // 100 + 1


def _signatures(ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    roll, n = Rolling(hashes), len(hashes)
    other = Rolling(hashes ^ np.uint64(0xD6E8FEB86659FD93))
    return roll.of(ends[:-1], ends[1:]), other.of(ends[:-1], ends[1:])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), text)


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, row, n, two signatures of the set and its counted shingles."""

    def scan(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                ends, hashes = shingle_sets(batch.column("text")[lo:hi], k)
                one, two = _signatures(ends, hashes)
                first = (hashes & np.uint64(COUNTED - 1)) == 0
                counted = np.concatenate([[0], np.cumsum(first)])[ends].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(counted), pa.array(signed(hashes[first])))
                columns = [batch.column("doc_id")[lo:hi], batch.column("row")[lo:hi], pa.array(np.diff(ends)), pa.array(signed(one)), pa.array(signed(two)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "one", "two", "counted"])

    return _rows(docs).mapInArrow(scan, "doc_id long, row long, n long, one long, two long, counted array<long>")


def _prefix(percent: int):
    return F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("long") + 1


def _open_sets(docs: DataFrame, scanned: DataFrame, k: int, percent: int) -> DataFrame:
    """node, n, shingles: the whole sets of the nodes that the first count leaves open."""
    # A shingle is alone if all rows that have it have the same set, so copies need not be collapsed before the count.
    tokens = scanned.select("one", F.explode("counted").alias("token")).groupBy("token").agg(F.min("one").alias("one"), F.max("one").alias("other"))
    alone = tokens.where("one = other").groupBy("one").agg(F.count("*").alias("alone"))
    nodes = scanned.where("n > 0").groupBy("one", "two").agg(F.min("n").alias("n"), F.min("row").alias("row"))
    left = _prefix(percent) - F.coalesce("alone", F.lit(0))
    open_ = stored(nodes.join(alone, "one", "left").where(left > 0).select(F.monotonically_increasing_id().alias("node"), "one", "two", "row"), "open")

    def scan(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                ends, hashes = shingle_sets(batch.column("text")[lo:hi], k)
                one, two = _signatures(ends, hashes)
                parts = [x.tobytes() for x in np.split(hashes, ends[1:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends)), pa.array(signed(one)), pa.array(signed(two)), pa.array(parts, pa.binary())], ["n", "one", "two", "shingles"])

    wanted = broadcast_if_small(open_.select("row"), BROADCAST_ROWS)
    sets = _rows(docs).join(wanted, "row", "left_semi").select("text").mapInArrow(scan, "n long, one long, two long, shingles binary")
    # Rows that are the same in all columns are read more than once.
    out = stored(sets.join(open_, ["one", "two"]).groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "one", "two", "shingles")]), "sets")
    discard(open_)
    return out


def _tokens(sets: DataFrame) -> DataFrame:
    def explode(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(s.as_buffer() for s in batch.column("shingles")), np.int64)
            node = np.repeat(np.asarray(batch.column("node")), np.asarray(batch.column("n")))
            for lo in range(0, len(flat), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + 100_000]), pa.array(flat[lo : lo + 100_000])], ["node", "token"])

    return sets.select("node", "n", "shingles").mapInArrow(explode, "node long, token long")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, alone, token: of the nodes that can link with another, the prefix shingles that another has. alone: how
    many of the node's shingles no other has."""
    seen = stored(_tokens(sets).groupBy("token").agg(F.count("*").alias("times"), F.min("node").alias("node")), "seen")
    alone = seen.where("times = 1").groupBy("node").agg(F.count("*").alias("alone"))
    near = sets.select("node", "n").join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    near = stored(near.withColumn("left", _prefix(percent) - F.col("alone")).where("left > 0"), "near")
    mine = sets.join(broadcast_if_small(near.select("node"), BROADCAST_ROWS), "node", "left_semi")
    met = _tokens(mine).join(seen.where("times > 1").select("token", "times"), "token").join(near, "node")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("times", "token"))
    prefix = stored(met.withColumn("rank", rank).where(F.col("rank") <= F.col("left")).select("node", "n", "alone", "token"), "prefix")
    discard(seen, near)
    return prefix


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the shingles that more than one set has."""
    sets = x + y
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    times = np.bincount(column)
    often = times[column] > 1
    owner, column = owner[often], (np.cumsum(times > 1) - 1)[column[often]]
    out = np.zeros((len(x), len(y)), np.int64)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += (m[: len(x)] @ m[len(x) :].T).astype(np.int64)  # exact: at most `width` each
    return out


def _kept_pairs(n: np.ndarray, alone: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can link, by their sizes and by the shingles that nothing else has. Members of a group agree in both."""
    most = np.minimum((n - alone)[left][:, None], (n - alone)[right][None, :])
    return most * (100 + percent) >= percent * (n[left][:, None] + n[right][None, :])


def verify_blocks(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) with 100 * intersection >= percent * union between the members of paired blocks, thinned to a spanning
    forest of each pair of blocks.

    pairs: x, y (blocks, may be equal); members: blk, node, n, alone, shingles. A task holds two blocks at a time.
    """
    sides = pairs.select("x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("blk"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.join(members, "blk").repartition(parts, "x", "y").sortWithinPartitions("x", "y", "blk")

    def check(batches):
        for rows in key_runs(batches, ["x", "y"]):
            blk, node, n, alone = (np.asarray(rows.column(c)) for c in ("blk", "node", "n", "alone"))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles")]
            same = bool(rows.column("x")[0].as_py() == rows.column("y")[0].as_py())
            left = np.flatnonzero(blk == blk[0])
            right = left if same else np.flatnonzero(blk != blk[0])
            if not len(right) or same and len(left) < 2:
                continue
            can = _kept_pairs(n, alone, left, right, percent)
            if same:
                np.fill_diagonal(can, False)
            left, right = left[can.any(1)], right[can.any(0)]
            if not len(left):
                continue
            common = _common([sets[i] for i in left], [sets[i] for i in right])
            union = n[left][:, None] + n[right][None, :] - common
            i, j = np.nonzero(100 * common >= percent * union)
            i, j = left[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            a, b = forest(i, j)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return dealt.select("x", "y", "blk", "node", "n", "alone", "shingles").mapInArrow(check, "a long, b long")


def _with_heads(members: DataFrame, percent: int) -> DataFrame:
    """node, head of the members that link with the head of their bucket."""
    heads = members.where("node = bucket").select("bucket", F.col("shingles").alias("head"))

    def check(batches):
        for batch in batches:
            keep = []
            for own, head in zip(batch.column("shingles"), batch.column("head")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (own, head))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)  # both are sorted
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("bucket")], ["node", "head"]).filter(pa.array(keep, pa.bool_()))

    return members.join(heads, "bucket").select("node", "bucket", "shingles", "head").mapInArrow(check, "node long, head long")


def _buckets(grouped: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """met (grp, n, alone, token: shingles that several groups have) and placed (grp, node, bucket)."""
    # A group belongs with the head that it shares most of its prefix with: of all that have a shingle, the one with the
    # fewest shingles of its own, which is what copies were made from.
    heads = grouped.groupBy("token").agg(F.count("*").alias("times"), F.min(F.struct("alone", "n", "grp")).alias("head")).where("times > 1")
    heads = stored(heads.select("token", F.col("head.grp").alias("head")), "heads")
    met = stored(grouped.join(heads, "token"), "met")
    bucket = met.groupBy("grp", "head").agg(F.count("*").alias("votes")).groupBy("grp").agg(F.max(F.struct("votes", (-F.col("head")).alias("h"))).alias("best"))
    bucket = stored(bucket.select("grp", (-F.col("best.h")).alias("bucket")), "bucket")
    for _ in range(2):  # a head may itself belong with another: chains of copies come together
        onward = bucket.select(F.col("grp").alias("bucket"), F.col("bucket").alias("next"))
        last, bucket = bucket, stored(bucket.join(onward, "bucket", "left").select("grp", F.coalesce("next", "bucket").alias("bucket")), "bucket")
        discard(last)
    grps = met.select("grp").union(member.select("grp")).distinct()
    placed = grps.join(bucket, "grp", "left").join(member, "grp", "left").select("grp", F.coalesce("node", "grp").alias("node"), F.coalesce("bucket", "grp").alias("bucket"))
    placed = stored(placed, "placed")
    size = stored(placed.groupBy("bucket").agg(F.count("*").alias("n_bucket")), "sizes")
    # A bucket joins the largest one that has any of its shingles, if that fills several blocks: it would be paired with
    # all of them anyway.
    has = stored(met.select("token", "grp").join(placed, "grp").select("token", "bucket").distinct().join(size, "bucket"), "has")
    largest = stored(has.groupBy("token").agg(F.max(F.struct("n_bucket", "bucket")).alias("top")).where(F.col("top.n_bucket") > BLOCK), "largest")
    joins = stored(has.join(largest, "token").groupBy("bucket").agg(F.max("top").alias("top")).select("bucket", F.col("top.bucket").alias("into")), "joins")
    final = stored(placed.join(joins, "bucket", "left").select("grp", "node", F.coalesce("into", "bucket").alias("bucket")), "placed")
    discard(heads, bucket, placed, size, has, largest, joins)
    return met, final


def _blocks(members: DataFrame, linked: DataFrame) -> DataFrame:
    """grp, node, bucket, linked and blk of all members."""
    flagged = members.select("grp", "node", "bucket", "n").join(linked.select("node", F.lit(True).alias("linked")), "node", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    flagged = stored(flagged, "flagged")
    many = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    size = stored(flagged.groupBy("bucket", "linked").agg(many.alias("blocks")), "sizes")
    blk = F.xxhash64("bucket", "linked", F.pmod(F.xxhash64("node"), F.col("blocks")))
    out = stored(flagged.join(size, ["bucket", "linked"]).select("grp", "node", "bucket", "linked", "n", blk.alias("blk")), "blocks")
    discard(flagged, size)
    return out


def _block_pairs(met: DataFrame, member: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """x, y: blocks that share a prefix shingle, or members of a group, and fit in size."""
    bounds = [F.min("n").alias("low"), F.max("n").alias("high")]
    of = blocks.groupBy("grp", "blk", "bucket", "linked").agg(F.min("n").alias("n"))
    # Where all link with one head nothing more can be gained from comparing them.
    home = F.when(F.col("linked"), F.col("bucket")).alias("home")
    per_token = met.select("token", "grp").join(of, "grp").groupBy("token", "blk", home).agg(*bounds)
    in_group = of.join(member.select("grp").distinct(), "grp", "left_semi").groupBy(F.col("grp").alias("token"), "blk", home).agg(*bounds)
    tokens = stored(per_token.union(in_group), "tokens")
    x, y = (tokens.select("token", F.col("blk").alias(b), F.col("low").alias("l" + b), F.col("high").alias("h" + b), F.col("home").alias("at" + b)) for b in "xy")
    fit = (F.col("hx") * 100 >= F.col("ly") * percent) & (F.col("hy") * 100 >= F.col("lx") * percent)
    apart = F.col("atx").isNull() | F.col("aty").isNull() | (F.col("atx") != F.col("aty"))
    pairs = x.join(y, "token").where((F.col("x") <= F.col("y")) & fit & apart).select("x", "y").distinct()
    alone = blocks.groupBy(F.col("blk").alias("x")).agg(F.count("*").alias("k")).where("k = 1").select("x", F.col("x").alias("y"))
    out = stored(pairs.join(alone, ["x", "y"], "left_anti"), "pairs")
    discard(tokens)
    return out


def _links(sets: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """a, b: nodes that link, thinned but with the same components."""
    # Groups: the same prefix and size. Only prefixes without a shingle of their own can be equal.
    same = prefix.where("alone = 0").groupBy("node", "n").agg(F.xxhash64(F.array_sort(F.collect_list("token"))).alias("prefix"))
    same = stored(same, "same")
    groups = stored(same.groupBy("prefix", "n").agg(F.min("node").alias("grp"), F.count("*").alias("members")).where("members > 1"), "groups")
    member = stored(same.join(groups, ["prefix", "n"]).select("node", "grp"), "members")
    grouped = stored(prefix.join(member, "node", "left").select(F.coalesce("grp", "node").alias("grp"), "n", "alone", "token").distinct(), "grouped")
    discard(same, groups)
    met, placed = _buckets(grouped, member)
    facts = prefix.groupBy("node").agg(F.first("alone").alias("alone"))
    members = stored(sets.select("node", "n", "shingles").join(placed, "node").join(facts, "node"), "members")
    large = stored(members.groupBy("bucket").agg(F.count("*").alias("n_bucket")).where(F.col("n_bucket") > BLOCK), "large")
    stars = stored(_with_heads(members.join(large, "bucket", "left_semi"), percent), "stars")
    blocks = _blocks(members, stars)
    pairs = _block_pairs(met, member, blocks, percent)
    found = verify_blocks(pairs, members.select("node", "n", "alone", "shingles").join(blocks.select("node", "blk"), "node"), percent)
    links = stored(found.union(stars.select(F.col("node").alias("a"), F.col("head").alias("b"))), "links")
    discard(member, grouped, met, placed, members, large, stars, blocks, pairs)
    return links


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row (stored): doc_id, row, n, class. Rows of a class reach each other by links; class is null without words."""
    small_batches(docs.sparkSession)
    scanned = stored(_scan(docs, k), "shingles")
    sets = _open_sets(docs, scanned, k, percent)
    light = stored(scanned.select("doc_id", "row", "n", "one", "two"), "rows")
    discard(scanned)
    prefix = _prefixes(sets, percent)
    links = _links(sets, prefix, percent)
    roots = connected_components(links)
    # A class is named by the signatures of its root, or of the only set in it.
    names = sets.select(F.col("node").alias("root"), F.struct("one", "two").alias("class"))
    moved = stored(sets.select("node", "one", "two").join(roots, "node").join(names, "root").select("one", "two", "class"), "moved")
    discard(sets, prefix, links, roots)
    own = F.when(F.col("n") > 0, F.coalesce("class", F.struct("one", "two")))
    out = stored(light.join(moved, ["one", "two"], "left").select("doc_id", "row", "n", own.alias("class")), "classes")
    discard(light, moved)
    return out


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach, through sets with Jaccard similarity of at least percent / 100.
    Documents without words or text have an empty set and link with nothing. A null doc_id takes part like any other, but
    never is a component's id unless all its members lack one. Rows that share a doc_id are compared as rows, and ties need
    no order. A text is taken whole, alone in a slice if it is long. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    rows = _classes(docs, k, percent)
    least = stored(rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id")), "least")
    named = rows.join(least, "class", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each class, whatever their doc_ids; all rows without words.

    The row that stays has the smallest doc_id of its class (null: after all others); of rows with equal ids, that with the
    smallest hash of all its columns. Rows that are the same in all columns count as copies.
    """
    rows = _classes(docs, k, percent)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    copies = rows.where("n > 0").groupBy("class").agg(F.min(order).alias("best"), F.count("*").alias("members")).where("members > 1")
    best = stored(copies.select("class", F.col("best").alias("kept")), "best")
    stays = (F.col("row") == F.col("kept.row")) & F.col("doc_id").eqNullSafe(F.col("kept.doc_id"))
    met = stored(rows.where("n > 0").join(best, "class").select("doc_id", "row", stays.alias("stays")), "copies")
    gone = stored(met.where("not stays").select("doc_id", "row").distinct(), "gone")
    same = stored(met.where("stays").groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row"), "same")
    discard(rows, best, met)
    kept = rows_within(docs, gone, "left_anti", BROADCAST_ROWS)
    if not same.isEmpty():
        kept = rows_within(kept, same, "left_anti", BROADCAST_ROWS).union(_once(rows_within(docs, same, "left_semi", BROADCAST_ROWS)))
    return kept


def _once(docs: DataFrame) -> DataFrame:
    """One of each set of rows that are the same in all columns that can be hashed."""
    row = apart(docs) + "row"
    return docs.withColumn(row, row_hash(docs)).dropDuplicates([row, "doc_id"]).drop(row)
