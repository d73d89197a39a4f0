"""The divergence audit against brute force, with all that awkward tables hold."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from cladewise.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in docs]
    langs, rows = defaultdict(lambda: defaultdict(Counter)), []
    seen = defaultdict(Counter)
    for lang, source, terms in docs:
        langs[lang][source].update(terms)
        seen[lang].update(set(terms))
    for lang, sources in langs.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        every = share(sum(sources.values(), Counter()))
        own = {s: share(c) for s, c in sources.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pair = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(own[s][t], every[t]), t) for t in kept if sources[s][t] and own[s][t] > every[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                rows += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return sorted(rows)


def test_terms():
    texts = ["A bC-d_e 9f Ünï ÄÖ\x00x\x7fy {z}", None, "", "  ", "漢字 Kanji"]
    ends, words = divergence.terms_of(pa.array(["skipped", *texts])[1:])
    flat = words.to_pylist()
    assert [flat[a:b] for a, b in zip(ends[:-1], ends[1:])] == [TERM.findall((t or "").translate(LOWER)) for t in texts]


def test_against_brute_force(spark, awkward):
    words = "the of Quick brown fox Jumps over lazy dog ÜBER straße naïve".split()
    docs = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        docs.append((["en", "de", None][i % 9 // 4], source if i % 50 else None, " ".join(words[(i * j * j + j) % (3 + i % 10)] for j in range(i % 23)) if i % 17 else None))
    docs += [("lone", "only", "the fox"), ("bare", "x", ""), ("bare", "y", None)] + [("tie", s, "a b a b") for s in ("p", "q", "r")] * 5
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    for least, top in ((10, 10), (1, 3), (1000, 10)):
        got = sorted(tuple(r) for r in divergence.divergence(df, least, top).collect())
        assert got == brute(docs, least, top)
    rows = [(r["lang"], r["source"], r["text"]) for r in awkward.collect()]
    assert sorted(tuple(r) for r in divergence.divergence(awkward, 2).collect()) == brute(rows, 2, 10)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_large_counts(spark):
    """Shares and gaps stay exact where the product needs more than 64 bits."""
    n = [(0, 0, 1), (2 * 10**13, 3 * 10**13 + 1, 7), (10**15, 10**15, 1), (5, 10**15, 10**7)]
    df = spark.createDataFrame(n, "a long, b long, v long").select("a", "b", "v", divergence.share(F.col("a"), F.col("b"), F.col("v")).alias("p"))
    for r in df.select("*", divergence.gap(F.col("p"), F.lit(12345)).alias("f")).collect():
        p = 1 + 10**9 * (r["a"] + 2) // (r["b"] + 2 * r["v"])
        assert (r["p"], r["f"]) == (p, (p - 12345) ** 2 // (p + 12345))
