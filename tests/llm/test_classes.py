"""The labelled sample and the pseudo-labels of the classifier when classes are rare or texts repeated."""

import numpy as np

from cladewise.llm import cotrain


def corpus(spark, n, toxic_every):
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(n):
        good, toxic = i % 3 != 0, bool(toxic_every) and i % toxic_every == 0
        words = [f"w{j}" for j in rng.integers(0, 40, 30)]
        text = " ".join([w if good else w + "%%%" for w in words] + ["badword rotten"] * toxic)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_rare_class(spark, monkeypatch):
    """A sample of 240 rows of 3,000 holds the rare class, which 240 rows by hash hardly do."""
    monkeypatch.setattr(cotrain, "SAMPLE", 240)
    docs, labels, rows = corpus(spark, 3000, 70)
    sample = cotrain.draw_sample(labels).collect()
    assert len(sample) <= 240 and sum(r["toxic"] for r in sample) == sum(r[2] for r in rows)
    assert abs(sum(r["weight"] for r in sample if r["toxic"]) / sum(r["weight"] for r in sample) - 43 / 3000) < 1e-6
    got = {r["doc_id"]: r for r in cotrain.score_documents(docs, *cotrain.train(docs, labels)).collect()}
    assert np.mean([(got[i]["quality"] >= 0.5) == q for i, q, _ in rows]) > 0.95
    assert np.mean([got[i]["toxic"] >= 0.5 for i, _, t in rows if t]) > 0.9 and np.mean([got[i]["toxic"] < 0.5 for i, _, t in rows if not t]) > 0.98


def test_one_target(spark):
    """Without toxic labels quality is fitted all the same."""
    docs, labels, rows = corpus(spark, 400, 0)
    got = {r["doc_id"]: r for r in cotrain.score_documents(docs, *cotrain.train(docs, labels)).collect()}
    assert np.mean([got[i]["keep"] == bool(q) for i, q, _ in rows]) > 0.95 and {r["toxic"] for r in got.values()} == {0.0}


def test_repeated_text(spark):
    """Copies of one text take one place of a quota."""
    n = cotrain.PSEUDO
    rows = [(i, 1, 9.0) for i in range(2 * n)] + [(1000 + i, 1000 + i, 8.0) for i in range(2 * n)]
    scored = spark.createDataFrame([(i, i, h, z, z, -z, -z) for i, h, z in rows], "doc_id long, row long, text_hash long, z_quality_text double, z_quality_meta double, z_toxic_text double, z_toxic_meta double")
    got = cotrain.pseudo_labels(scored).collect()
    for t, label in ((0, 1), (1, 0)):
        for view in (0, 1):
            ids = sorted(r["doc_id"] for r in got if (r["target"], r["view"]) == (t, view))
            assert ids == [0, *range(1000, 1000 + n - 1)]
            assert {r["label"] for r in got if r["target"] == t} == {label}
