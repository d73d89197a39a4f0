"""Packing against brute force: every id is placed once, bins hold, and the search reaches what is known to be reachable."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cladewise.llm import packing


def fewest(lengths, capacity):
    """The fewest bins, by trying all ways."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= lengths[i]}):
            more = list(rooms)
            more.remove(r)
            put(i + 1, more + [r - lengths[i]])
        put(i + 1, rooms + [capacity - lengths[i]])

    put(0, [])
    return best[0]


def searched(lengths, bins, capacity, bound=0):
    s = packing.Search(lengths, [list(b) for b in bins], capacity)
    squares = [sum(f * f for f in s.fill)]
    apply = s._apply

    def watched(*step):
        apply(*step)
        squares.append(sum(f * f for f in s.fill))

    s._apply = watched
    s.run(bound)
    assert sorted(i for b in s.bins for i in b) == sorted(i for b in bins for i in b)
    assert all(sum(lengths[i] for i in b) <= capacity for b in s.bins) and all(a < b for a, b in zip(squares, squares[1:]))
    return s.bins


def test_each_exchange():
    """A move, one for one, two for one and one for two each empty a bin that the others cannot."""
    cases = [([6, 4], [[0], [1]]), ([7, 6, 4, 3], [[0], [1, 3], [2]]), ([5, 5, 4, 3, 3], [[0, 2], [1], [3, 4]])]
    for lengths, bins in cases:
        assert len(searched(lengths, bins, 10)) == fewest(lengths, 10)
    # each kind by itself: what the fuller bin gets and gives
    for lengths, bins, taken, given in [([6, 4], [[0], [1]], 1, 0), ([6, 3, 4, 2], [[0, 1], [2, 3]], 1, 1), ([5, 4, 3, 3], [[0, 1], [2, 3]], 2, 1), ([4, 3, 2, 8], [[0, 1, 2], [3]], 1, 2)]:
        s = packing.Search(lengths, bins, 10)
        high, low = (0, 1) if s.fill[0] >= s.fill[1] else (1, 0)
        gain, take, give = s._best(low, high)
        assert s.fill[high] + gain == 10 and (len(take), len(give)) == (taken, given), (lengths, bins)


def test_against_all_ways():
    """Never worse than best fit, within one bin of the fewest, and the bound holds."""
    rng = np.random.default_rng(5)
    better = 0
    for _ in range(150):
        capacity = int(rng.integers(8, 60))
        lengths = sorted(rng.integers(1, capacity + 1, int(rng.integers(1, 11))).tolist(), reverse=True)
        start = packing.best_fit(lengths, capacity)
        bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        got, best = searched(lengths, start, capacity, bound), fewest(lengths, capacity)
        assert bound <= best <= len(got) <= len(start) and len(got) <= best + 1
        # from one bin for each piece too
        alone = searched(lengths, [[i] for i in range(len(lengths))], capacity, bound)
        assert best <= len(alone) <= best + 1
        better += len(got) < len(start)
    assert packing.lower_bound(np.zeros(11, np.int64), 10) == 0 and packing.lower_bound(np.bincount([6, 6, 6], minlength=11), 10) == 3


def test_search_saves_bins():
    """Pieces of a quarter to a half of a bin, where best fit leaves room that exchanges fill."""
    lengths = sorted(np.random.default_rng(2).integers(500, 1100, 1500).tolist(), reverse=True)
    start = packing.best_fit(lengths, 2048)
    got = searched(lengths, start, 2048, packing.lower_bound(np.bincount(lengths, minlength=2049), 2048))
    assert len(got) <= 0.98 * len(start)


def test_over_tables(spark):
    """Several rounds over groups: all rows placed, gapless, near the bound; one length for a third of all rows."""
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 2049, 3000), np.full(1500, 700), np.full(20, 2048)]).tolist()
    df = spark.createDataFrame([*enumerate(lengths)], "rid long, length long").repartition(5)
    got = packing.pack(df, 2048, group=300).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], lengths[r["rid"]]))
    assert sorted(r["rid"] for r in got) == list(range(len(lengths)))
    for b in by.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist() and sum(n for _, n in b) <= 2048
    bound = packing.lower_bound(np.bincount(lengths, minlength=2049), 2048)
    whole = packing.best_fit(sorted(lengths, reverse=True), 2048)
    assert bound <= len(by) <= 1.01 * len(whole), (bound, len(by), len(whole))
    assert packing.pack(df.limit(0), 2048).count() == 0


def test_documents(spark, awkward):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    coder, capacity = Tokenizer.from_file(P.path("word_bpe_49k.json")), 512
    out = packing.pack_documents(awkward, P.path("word_bpe_49k.json"), capacity)
    got = out.collect()
    want = Counter()
    for r in awkward.collect():
        ids = np.array([*coder.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for i, a in enumerate(range(0, len(ids), capacity)):
            cut = ids[a : a + capacity]
            want[(r["doc_id"], i, a, len(cut), zlib.crc32(cut.tobytes()), cut.astype("<u2").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for s in packing.sequences(out).collect():
        own = sorted(spans.pop(s["sequence_id"]))
        assert s["length"] <= capacity and bytes(s["ids"]) == b"".join(x[2] for x in own) and len(s["doc_ids"]) == len(own)
    assert not spans
    total = sum(k[3] * n for k, n in want.items())
    assert len({r["sequence_id"] for r in got}) <= -(-total // capacity) + 1
    assert packing.pack_documents(awkward.limit(0), P.path("word_bpe_49k.json")).count() == 0
