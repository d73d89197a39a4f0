"""Documents packed into as few training sequences as possible.

Texts are encoded and cut into pieces of at most a sequence. Pieces are dealt into groups of bounded size; a task packs a
group best fit, longest first, and then improves it by local search: pieces are moved, exchanged one for one, two for one
and one for two between underfull bins, always so that the sum of squared fills rises, until bins empty. Underfull bins of all
groups are then dealt anew, as they are, and searched again beside others, round after round, until the number of bins
meets a lower bound or a round empties none. A round moves only what lies in underfull bins: row numbers and lengths.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_runs, slices, small_batches, stored
from .token_index import ENCODED_BYTES, encoder

#: Tokens of a sequence, and pieces that a task packs together.
CAPACITY, GROUP = 2048, 8192
#: The search in a group ends when so many of its least full bins in a row can give nothing away; rounds over groups end
#: when one saves less than this share of the bins that are left.
PATIENCE, LEAST_SAVED = 64, 0.001
_LOCAL = 1 << 20


# --- one group --------------------------------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[l] pieces have length l. For each k, pieces over capacity - k share with none of
    at least k, and those over half with none of each other; the rest fills what they leave."""
    n = np.zeros(capacity + 1, np.int64)
    n[: len(counts)] = counts
    total = n * np.arange(capacity + 1)
    best = -(-int(total.sum()) // capacity)
    count, size = np.cumsum(n), np.cumsum(total)
    half = capacity // 2
    for k in range(0, half + 1):
        alone = int(count[capacity] - count[capacity - k])
        large = int(count[capacity - k] - count[half])
        room = large * capacity - int(size[capacity - k] - size[half])
        rest = int(size[half] - (size[k - 1] if k else 0)) - room
        best = max(best, alone + large + max(0, -(-rest // capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in `lengths`, taken in order; each goes where it leaves least room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # a bit for each room that a bin has
    for i, size in enumerate(lengths):
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        by_room[room - size].append(at)
        rooms |= 1 << (room - size)
    return bins


class Search:
    """Local search between bins (lists of places in `lengths`) of one group."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.sizes: dict[int, tuple] = {}

    def _choices(self, at: int) -> tuple:
        """What a bin can give: sorted sums of one and of two of its pieces, with the pieces, and all these sums after a 0."""
        if at not in self.sizes:
            first: dict[int, list[int]] = {}
            for i in self.bins[at]:
                first.setdefault(self.lengths[i], []).append(i)
            known = {size: (i[0],) for size, i in first.items()}
            ones = sorted(known.items())
            twos: dict[int, tuple] = {}
            keys = sorted(first)
            for x, a in enumerate(keys):
                for b in keys[x:]:
                    if a != b:
                        twos.setdefault(a + b, (first[a][0], first[b][0]))
                    elif len(first[a]) > 1:
                        twos.setdefault(a + b, tuple(first[a][:2]))
            one, two = (([n for n, _ in x], [p for _, p in x]) for x in (ones, sorted(twos.items())))
            self.sizes[at] = (one, two, np.array([0, *one[0], *two[0]], np.int64))
        return self.sizes[at]

    def _best(self, low: int, high: int) -> tuple[int, tuple, tuple] | None:
        """The largest gain that the fuller bin `high` can take from `low`, with what it gets and what it gives."""
        room = self.capacity - self.fill[high]
        got, best = None, 0
        (ones, own), (twos, pairs), _ = self._choices(low)
        (back, theirs), (back2, theirs2), _ = self._choices(high)
        takes = [(ones, own, [0], [()]), (ones, own, back, theirs), (twos, pairs, back, theirs), (ones, own, back2, theirs2)]  # move, 1:1, 2:1, 1:2
        for sums, pieces, gives, given in takes:
            for g, what in zip(gives, given):
                x = bisect_right(sums, g + room) - 1
                if x >= 0 and sums[x] - g > best:
                    best, got = sums[x] - g, (sums[x] - g, pieces[x], what)
                    if best == room:
                        return got
        return got

    def _takers(self, low: int, highs: list[int]) -> list[int]:
        """Those of the fuller bins that can take something from `low`, in their order: all looked at together."""
        (ones, _), (twos, _), _ = self._choices(low)
        gives = [self._choices(i)[2] for i in highs]
        sizes = np.array([len(g) for g in gives])
        single = np.array([len(self._choices(i)[0][0]) for i in highs])
        give, bin_ = np.concatenate(gives), np.repeat(np.arange(len(highs)), sizes)
        place = np.arange(len(give)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        upto = give + np.array([self.capacity - self.fill[i] for i in highs])[bin_]
        found = np.zeros(len(highs), bool)
        for sums, use in ((ones, np.ones(len(give), bool)), (twos, (place > 0) & (place <= single[bin_]))):
            if sums:
                x = np.searchsorted(sums, upto[use], "right") - 1
                found[bin_[use][(x >= 0) & (np.asarray(sums)[x] > give[use])]] = True
        return [highs[i] for i in np.flatnonzero(found).tolist()]

    def _apply(self, low: int, high: int, gain: int, take: tuple, give: tuple) -> None:
        for i in take:
            self.bins[low].remove(i)
            self.bins[high].append(i)
        for i in give:
            self.bins[high].remove(i)
            self.bins[low].append(i)
        self.fill[low] -= gain
        self.fill[high] += gain
        self.sizes.pop(low, None)
        self.sizes.pop(high, None)

    def run(self, bound: int) -> None:
        """Drain the least full bin into fuller ones, then the next, until PATIENCE of them cannot be or `bound` bins are left."""
        alive = [i for i, f in enumerate(self.fill) if f]
        settled: set[int] = set()
        while len(alive) > bound:
            alive.sort(key=self.fill.__getitem__)
            open_ = [i for i in alive if self.fill[i] < self.capacity]
            low = next((i for i in open_ if i not in settled), None)
            if low is None or len(settled) >= PATIENCE:
                break
            changed: set[int] = set()
            for high in self._takers(low, [i for i in reversed(open_) if i != low]) if len(open_) > 1 else []:
                while self.fill[low] and self.fill[high] < self.capacity and self.fill[high] >= self.fill[low] and (step := self._best(low, high)):
                    self._apply(low, high, *step)
                    changed |= {low, high}
                if not self.fill[low]:
                    alive.remove(low)
                    break
            settled = settled - changed if changed else settled | {low}
        self.bins[:] = [self.bins[i] for i in range(len(self.bins)) if self.bins[i]]


# --- over tables ------------------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(rid, doc_id, piece, start, length, ids, ids_crc32), stored: the ids of each row's whole text and end_id, cut every
    `capacity` ids. ids are little-endian, 2 bytes each if the vocabulary allows, else 4; ids_crc32 is of 4 bytes each."""
    from zlib import crc32

    small_batches(docs.sparkSession)

    def encode(batches):
        coder = encoder(tokenizer, end_id)
        base, seen = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts, ENCODED_BYTES):
                ids, counts = coder.encode(texts[lo:hi])
                many = -(-counts // capacity)
                row = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                at = (np.cumsum(counts) - counts)[row] + start
                cut = [ids[a:b] for a, b in zip(at.tolist(), (at + length).tolist())]
                columns = [
                    pa.array(base + seen + np.arange(len(row))), batch.column("doc_id")[lo:hi].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array([x.astype(coder.kind).tobytes() for x in cut], pa.binary()), pa.array([crc32(x.tobytes()) for x in cut], pa.int64()),
                ]
                seen += len(row)
                yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(encode, "rid long, doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"), "pieces")


def _packed(rows: DataFrame, turn: int, capacity: int) -> DataFrame:
    """(rid, length, sequence_id, offset, full) of rows (grp, bin, rid, length), stored. In the first turn `bin` is unknown
    (-1) and bins are made; later ones start from the bins that are there."""

    def pack(batches):
        for run in key_runs(batches, ["grp"]):
            lengths = np.asarray(run.column("length"), np.int64)
            rid, own, group = np.asarray(run.column("rid"), np.int64), np.asarray(run.column("bin"), np.int64), run.column("grp")[0].as_py()
            sizes = lengths.tolist()
            if own[0] < 0:
                bins = best_fit(sizes, capacity)
            else:
                _, place = np.unique(own, return_inverse=True)
                order = np.argsort(place, kind="stable")
                bins = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(place[order])) + 1)]
            bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            if len(bins) > bound:
                Search(sizes, bins, capacity).run(bound)
            order = np.array([i for b in bins for i in b], np.int64)
            number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            ends = np.cumsum(lengths[order])
            starts = ends - lengths[order]
            first = np.concatenate([[True], number[1:] != number[:-1]])
            base = starts[first]
            fill = np.add.reduceat(lengths[order], np.flatnonzero(first))
            sequence = (turn << 56) + group * _LOCAL + number
            yield pa.RecordBatch.from_arrays([pa.array(rid[order]), pa.array(lengths[order]), pa.array(sequence), pa.array(starts - base[number]), pa.array((fill == capacity)[number])], ["rid", "length", "sequence_id", "offset", "full"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "grp").sortWithinPartitions("grp", F.desc("length"), "rid").select("grp", "bin", "rid", "length")
    return stored(dealt.mapInArrow(pack, "rid long, length long, sequence_id long, offset long, full boolean"), "packed")


def pack(lengths: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(rid, sequence_id, offset) for lengths (rid: unique; length: 1 to capacity), for any number of rows."""
    counts = {r["length"]: r["count"] for r in lengths.groupBy("length").count().collect()}  # at most `capacity` rows
    every = sum(counts.values())
    by_length = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        by_length[size] = n
    bound = lower_bound(by_length, capacity)
    groups = max(1, -(-every // group))
    deal = lambda c, turn, groups: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(groups)).cast("long").alias("grp")
    rows = lengths.select(deal("rid", 0, groups), F.lit(-1).cast("long").alias("bin"), "rid", "length")
    turn, done, before = 0, [], None
    while True:
        now = _packed(rows, turn, capacity)
        first = F.col("offset") == 0
        bins, full, loose = now.agg(F.count_if(first), F.count_if(first & F.col("full")), F.count_if(~F.col("full"))).first()
        done.append(now)
        settled = before is not None and before - bins < max(1, before * LEAST_SAVED)
        if groups == 1 or bins <= bound or settled:
            break
        before, bound = bins - full, bound - full
        turn, groups = turn + 1, max(1, -(-loose // group))
        rows = now.where(~F.col("full")).select(deal("sequence_id", turn, groups), F.col("sequence_id").alias("bin"), "rid", "length")
    placed = done[-1]
    for df in done[:-1]:
        placed = placed.union(df.where("full"))
    return placed.select("rid", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    Every row's text (null: empty) gives its ids and end_id; only what is longer than a sequence is cut. Sequences are filled
    from offset 0 on without gaps, by as few of them as the search finds. Rows are told apart by where they were read, so null
    and repeated doc_ids and repeated rows are ordinary; pieces of equal lengths may stand in each other's place. A text is
    encoded whole, alone if it is long; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    cut = pieces(docs, tokenizer, capacity, end_id)
    placed = pack(cut.select("rid", "length"), capacity)
    return cut.join(placed, "rid").select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids) of pack_documents(): the ids of whole sequences, as binary, for writing out."""
    by = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    joined = F.aggregate(F.slice("p.ids", 2, F.size("p")), F.col("p")[0]["ids"], lambda a, b: F.concat(a, b))
    return by.select("sequence_id", "length", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"))
