"""Leaks whose slots clash, and texts that are mostly slots."""

from collections import defaultdict

import numpy as np

from cladewise.llm import decontaminate


def found(spark, docs, items):
    d = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(d, b).collect()}


def test_clashing_slots(spark):
    """One slot against the others drops its windows only; values may coincide or part."""
    item = "a train leaves town with 120 passengers and travels 45 km to meet old friends near the old stone bridge before 9 minutes pass by"
    hours = "then she carries 3 apples and also keeps 5 pears for the long way back home while it rains"
    parts = "then she carries 2 apples and she walks for 2 hours on the long way back home while it rains"
    many = "we saw 7 birds by the lake and then 7 ducks by the lake and later 7 geese near the old stone bridge over there"
    docs = [
        item.replace("120", "45"), hours.replace("3 apples", "4 apples").replace("5 pears", "4 pears"),
        parts.replace("2 apples", "3 apples").replace("2 hours", "4 hours"), many.replace("7 geese", "8 geese"), "nothing of this is in here at all, not even with 45 km or so",
    ]
    got = found(spark, docs, [item, hours, parts, many])
    assert set(got) == {(i, i) for i in range(4)}
    assert [got[(i, i)]["coverage"] for i in range(3)] == [1.0, 1.0, 1.0] and not any(r["verbatim"] for r in got.values())
    # only the windows with the third value go
    assert 0.5 <= got[(3, 3)]["coverage"] < 1


def test_items_of_slots(spark):
    """Items dense in slots leak when copied, whatever stands around them; names may open sentences."""
    sums, names = "Compute 3 + 4 * 5 - 6", "Anna Bruno Carla Dieter Emil Frida Gustav Hanna Igor Jana Karl Lena"
    table = "12 kg 14 kg 16 kg 18 kg 20 kg 22 kg 24 kg 26 kg of flour"
    opener = "Alice buys some bread for the whole class. Alice then walks slowly to the old stone bridge"
    docs = [
        f"some text before and {sums} and after", f"people: {names.upper()} were there", f"weights are {table.lower()} in all", opener.replace("Alice", "Robert"), f"she said {opener.lower()} and left",
        "Compute 3 + 4 * 5 - 7", "Anna met Bruno and Dieter",
    ]
    got = found(spark, docs, [sums, names, table, opener])
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)}
    assert all(got[k]["coverage"] == 1 and got[k]["verbatim"] == (k != (3, 3)) for k in got)


def test_other_languages(spark):
    """Units, number words and names of other languages are slots as well."""
    pairs = [
        ("der alte Zug fährt sieben Stunden bis zum Dorf und kommt dann nach zwanzig Minuten wieder an", "der alte Zug fährt fünf Tage bis zum Dorf und kommt dann nach dreißig Sekunden wieder an"),
        ("le vieux train roule pendant sept heures vers la mer et revient après vingt-deux minutes sans arrêt", "le vieux train roule pendant trois jours vers la mer et revient après trente secondes sans arrêt"),
        ("el viejo tren viaja durante siete horas hacia el mar y vuelve después de veinte minutos sin parar", "el viejo tren viaja durante cinco días hacia el mar y vuelve después de treinta segundos sin parar"),
        ("in the old town Jean-Pierre walks up to the bridge and then Mary-Ann walks back to the square", "in the old town McDonald walks up to the bridge and then NASA walks back to the square"),
    ]
    got = found(spark, [b for _, b in pairs], [a for a, _ in pairs])
    assert set(got) == {(i, i) for i in range(4)}
    assert all(r["coverage"] == 1 and not r["verbatim"] for r in got.values())


def brute_leaks(doc, item, window=8, literals=4, least=0.5, long_run=20):
    """Coverage of an item (words and numbers) in a document, None if it does not leak."""
    d, t = doc.split(), item.split()
    size = min(window, len(t))
    if len(t) < 2:
        return None
    places = len(t) - size + 1
    rich = [sum(not w.isdigit() for w in t[i : i + size]) >= min(literals, size) for i in range(places)]
    matched, runs = set(), False
    for delta in range(-len(t), len(d)):
        found = []
        for i in range(places):
            cut = d[i + delta : i + delta + size] if i + delta >= 0 else []
            own = t[i : i + size]
            if len(cut) == size and (cut == own or rich[i] and all(a == b or a.isdigit() and b.isdigit() for a, b in zip(own, cut))):
                found.append(i)
        votes = defaultdict(set)
        for i in found:
            for j in range(i, i + size):
                if t[j].isdigit():
                    votes[t[j], d[j + delta]].add(j)
        most = defaultdict(int)
        for (a, _), at in votes.items():
            most[a] = max(most[a], len(at))
        counts = []
        for i in found:
            pairs = [(t[j], d[j + delta]) for j in range(i, i + size) if t[j].isdigit()]
            if all(a == b for a, b in pairs) or all(len(votes[p]) == most[p[0]] for p in pairs):
                counts.append(i)
        matched |= set(counts)
        here = set(counts)
        need = max(long_run - size + 1, 1)
        runs |= any(all(i + k in here for k in range(need)) for i in here)
    share = max(len(matched) / places, len([i for i in matched if rich[i]]) / sum(rich) if sum(rich) else 0)
    return round(share, 6) if matched and (share >= least or runs) else None


def test_against_brute_force(spark):
    """Random questions with other numbers: values that coincide, swap, part, or repeat; long, short and one-word items."""
    rng = np.random.default_rng(6)
    words = [a + b for a in ("bar", "lom", "tek", "sun", "pod") for b in ("ol", "ix", "an", "ur")]
    text = lambda n, numbers: " ".join(str(rng.integers(1, 5) * 11) if rng.random() < numbers else words[rng.integers(0, 20)] for _ in range(n))
    items = [text(int(n), p) for n, p in zip(rng.integers(1, 34, 24), rng.choice([0.0, 0.2, 0.4, 0.8], 24))]
    docs = [text(40, 0.3) for _ in range(10)]
    for k, item in enumerate(items * 4):
        values, kind = [str(11 * v) for v in range(1, 5)], k % 6
        new = {0: values, 1: values[1:] + values[:1], 2: ["7"] * 4, 3: ["5", "6", "5", "9"], 4: values, 5: ["90", "91", "92", "93"]}[kind]
        moved = [dict(zip(values, new)).get(w, w) for w in item.split()]
        if kind == 4:  # one place against the others
            moved = [("77" if w.isdigit() and rng.random() < 0.3 else w) for w in moved]
        if kind == 5 and len(moved) > 10:  # cut in the middle
            moved[len(moved) // 2] = "broken"
        docs.append(" ".join([text(int(rng.integers(1, 12)), 0.1), *moved, text(int(rng.integers(0, 12)), 0.1)]).strip())
    got = {k: r["coverage"] for k, r in found(spark, docs, items).items()}
    want = {(i, j): c for i, d in enumerate(docs) for j, t in enumerate(items) if (c := brute_leaks(d, t)) is not None}
    assert got == want and len(want) > 60
