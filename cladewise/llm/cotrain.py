"""Quality classifier by co-training.

Two views of a document: its words, and its metadata (language, source, length and layout counts). A logistic model for
each view and target (quality, toxicity) is fitted on labelled documents. In each round all unlabelled documents are scored
under both views; what one view is surest about becomes pseudo-labels for the other, and the models are fitted again. Each
view's scores are calibrated on labelled documents held out of the fits, and a last small model combines them to score
every document.

Bounds, all parameters of the fit: labelled rows (SAMPLE), pseudo-labels for each class, view and round (PSEUDO), features
(FEATURES). Labelled rows are drawn by class, rare classes first, and weigh as much as the rows they stand for; pseudo-labels are
drawn from distinct texts. Scoring covers all rows.

The features are fixed before the first round, so texts are read once: a table keeps, for each row, the places of its
features and its metadata, and the rounds and the final scores work on that table.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, row_hash, rows_within, slices, small_batches, split_words, stored

SAMPLE, PSEUDO, ROUNDS, FEATURES = 6_000, 150, 2, 1_500
LANG_SLOTS, SOURCE_SLOTS = 8, 32
TARGETS = ("quality", "toxic")
#: Logits of a target that cannot be fitted: one half for quality, zero for toxic.
UNFITTED = (0.0, -30.0)
_EDGES = string.punctuation + "«»“”„…"


# --- views ------------------------------------------------------------------------------------------------------------


def word_features(word: str) -> tuple[str, ...]:
    """Of a word: itself without outer punctuation, its beginnings, its ending as written, its shape."""
    core = word.strip(_EDGES).lower()
    out = [f"w {core or word}", *[f"p {core[:n]}" for n in (3, 5, 7) if len(core) > n]]
    if not word[-1].isalnum():
        out.append(f"e {word[-3:] if len(word) > 3 else word}")
    if len(word) > 2 and word.isupper():
        out.append("s UPPER")
    return tuple(out)


def metadata(batch: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
    """Metadata and layout of rows lo..hi: numbers, and last the slots of language and source."""
    texts = pc.fill_null(batch.column("text")[lo:hi], "")
    size = np.asarray(pc.binary_length(texts), np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(x.as_buffer() for x in texts if x.as_buffer()), np.uint8) if size.sum() else np.empty(0, np.uint8)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[ends])
    upper, lines, spaces = total((raw >= 65) & (raw <= 90)), total(raw == 10), total(raw == 32)
    digits = total((raw >= 48) & (raw <= 57))
    symbols = total(((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126)))
    n = np.maximum(size, 1)
    claimed = np.asarray(pc.fill_null(batch.column("n_chars")[lo:hi], 0), np.float64)
    x = [np.log1p(np.maximum(claimed, 0)), np.log1p(size), upper / n, symbols / n, spaces / n, np.log1p(lines), digits / n, np.log1p(size / (lines + 1))]
    x += [np.minimum(symbols / n * 10, 1), np.minimum(upper / n * 10, 1), (size == 0).astype(float)]
    for name, slots in (("lang", LANG_SLOTS), ("source", SOURCE_SLOTS)):
        hashed = [xxhash.xxh3_64_intdigest(v or "") % slots for v in batch.column(name)[lo:hi].to_pylist()]
        x.append(np.array(hashed, np.float64))
    return np.stack(x, 1).astype(np.float32)


def one_hot(meta: np.ndarray) -> np.ndarray:
    """Rows of metadata() with a column for each slot."""
    n = meta.shape[1] - 2
    rows = np.zeros((len(meta), n + LANG_SLOTS + SOURCE_SLOTS), np.float32)
    rows[:, :n] = meta[:, :n]
    for i, at in ((n, n), (n + 1, n + LANG_SLOTS)):
        rows[np.arange(len(meta)), at + meta[:, i].astype(np.int64)] = 1
    return rows


class Vocabulary:
    """Selected word features and, for each word met, which of them it has."""

    def __init__(self, names: list[str]):
        self.index, self.cache = {f: i for i, f in enumerate(names)}, {}

    def of(self, word: str) -> tuple[int, ...]:
        return tuple(i for f in word_features(word) if (i := self.index.get(f)) is not None)

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs of the texts."""
        ends, words = split_words(texts)
        if len(self.cache) > 500_000:
            self.cache = {}
        own, cache = words.dictionary.to_pylist(), self.cache
        got = [*map(cache.get, own)]
        for i, g in enumerate(got):
            if g is None:
                got[i] = cache[own[i]] = self.of(own[i])
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.array([f for g in got for f in g], np.int64)
        start = np.concatenate([[0], np.cumsum(n)])
        index = np.asarray(words.indices, np.int64)
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        hit = n[index] > 0
        index, row = index[hit], row[hit]
        # A word counts once in a row.
        once = np.unique(row * len(own) + index)
        row, index = once // max(len(own), 1), once % max(len(own), 1)
        times = n[index]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[index], times)
        both = np.unique(np.repeat(row, times) * len(self.index) + flat[at])
        return both // max(len(self.index), 1), both % max(len(self.index), 1)


# --- models -----------------------------------------------------------------------------------------------------------


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 150) -> np.ndarray:
    """Weights and, last, the intercept: accelerated gradient descent on the penalised mean loss."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    total = weight.sum()
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        probe = x.T @ (weight[:, None] * (x @ probe)[:, None])[:, 0]
        top = np.linalg.norm(probe)
        probe /= max(top, 1e-12)
    rate = 1 / (0.25 * top / total + penalty)
    ahead, before = w, w
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        g = x.T @ (weight * (p - y)) / total
        g[:-1] += penalty * ahead[:-1]
        w = (ahead - rate * g).astype(np.float32)
        ahead = w + (i / (i + 3)) * (w - before)
        before = w
    return w


class Model:
    """Both views for both targets, their calibration and the combination. Plain arrays, small enough to send along."""

    def __init__(self, names: list[str], mean: np.ndarray, scale: np.ndarray):
        self.names, self.mean, self.scale = names, mean, scale
        self.text = np.zeros((len(TARGETS), len(names) + 1), np.float32)
        self.meta = np.zeros((len(TARGETS), len(mean) + 1), np.float32)
        self.calibration = np.tile(np.array([1.0, 0.0]), (len(TARGETS), 2, 1))
        self.combined = np.tile(np.array([1.0, 0.0, 0.0]), (len(TARGETS), 1))

    def views(self, row: np.ndarray, feature: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Logits: row x target x view."""
        n = len(meta)
        scaled = (meta - self.mean) / self.scale
        out = np.empty((n, len(TARGETS), 2))
        for t in range(len(TARGETS)):
            out[:, t, 0] = np.bincount(row, self.text[t, feature], n) + self.text[t, -1]
            out[:, t, 1] = scaled @ self.meta[t, :-1] + self.meta[t, -1]
        return out

    def calibrated(self, views: np.ndarray) -> np.ndarray:
        return views * self.calibration[None, :, :, 0] + self.calibration[None, :, :, 1]

    def score(self, views: np.ndarray) -> np.ndarray:
        z = (self.calibrated(views) * self.combined[None, :, :2]).sum(2) + self.combined[None, :, 2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Fitter:
    """Holds the bounded labelled sample and the pseudo-labels, and fits a Model to them. Texts are lists of the places of
    their features among the selected ones."""

    def __init__(self, names: list[str], texts: list[np.ndarray], meta: np.ndarray, labels: np.ndarray, held: np.ndarray, weight: np.ndarray, fitted: list[int]):
        self.names, self.meta, self.labels, self.held = names, meta, labels.astype(np.float32), held
        self.weight, self.fitted = weight.astype(np.float32), fitted
        self.x = self._matrix(texts)
        scale = meta.std(0) if len(meta) else np.ones(meta.shape[1])
        self.model = Model(names, meta.mean(0), np.where(scale > 1e-6, scale, 1))
        for t in {*range(len(TARGETS))} - {*fitted}:
            self.model.combined[t] = (0, 0, UNFITTED[t])
        #: (target, view) -> rows that the other view is sure of: text matrix or metadata, and labels.
        self.extra: dict[tuple[int, int], list] = {}

    def _matrix(self, texts: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.names)), np.float32)
        for i, at in enumerate(texts):
            x[i, at] = 1
        return x

    def add(self, target: int, view: int, texts: list[np.ndarray], meta: np.ndarray, label: np.ndarray) -> None:
        rows = self._matrix(texts) if view == 0 else (meta - self.model.mean) / self.model.scale
        self.extra.setdefault((target, view), []).append((rows, label))

    def fit(self) -> Model:
        m, use = self.model, ~self.held
        views = [self.x, ((self.meta - m.mean) / m.scale).astype(np.float32)]
        for t in self.fitted:
            for view, out, penalty in ((0, m.text, 2e-3), (1, m.meta, 1e-3)):
                x, y, w = [views[view][use]], [self.labels[use, t]], [self.weight[use]]
                for rows, label in self.extra.get((t, view), []):
                    x.append(rows.astype(np.float32))
                    y.append(label.astype(np.float32))
                    w.append(np.full(len(label), 0.3, np.float32))
                out[t] = fit_logistic(np.vstack(x), np.concatenate(y), np.concatenate(w), penalty)
        rows, features = np.nonzero(self.x)
        raw = m.views(rows, features, self.meta)
        held = self.held
        weight = self.weight[held]
        for t in self.fitted:
            y = self.labels[held, t]
            if y.min() == y.max():  # nothing to calibrate with
                m.combined[t] = (0.5, 0.5, 0)
                continue
            for view in (0, 1):
                z = raw[held, t, view]
                m.calibration[t, view] = fit_logistic(z[:, None] / 4, y, weight, 1e-3) / np.array([4.0, 1.0])
            z = m.calibrated(raw)[held, t]
            m.combined[t] = fit_logistic(z / 4, y, weight, 1e-3) / np.array([4.0, 4.0, 1.0])
        return m


# --- over tables ------------------------------------------------------------------------------------------------------

_VIEWS = (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))
#: Rows (two long integers) that may be sent to all executors; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
_META = 13  # numbers of metadata()


def _rows(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    return docs.select(*[(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in _VIEWS], row_hash(docs).alias("row"))


def _sample_features(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """features (names), meta and the columns of `sample`, a bounded set of doc_ids. Of rows that share a doc_id, that with
    the smallest hash counts."""
    columns = [c for c in sample.columns if c != "doc_id"]

    def scan(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                own = [sorted({f for w in set((t or "").split()) for f in word_features(w)}) for t in batch.column("text")[lo:hi].to_pylist()]
                meta = pa.array([m.tobytes() for m in metadata(batch, lo, hi)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(own, pa.list_(pa.string())), meta, *[batch.column(c)[lo:hi] for c in columns]], ["doc_id", "features", "meta", *columns])

    kinds = dict(sample.dtypes)
    schema = ", ".join(["doc_id long, features array<string>, meta binary", *[f"{c} {kinds[c]}" for c in columns]])
    rows = _rows(docs)
    first = rows.join(F.broadcast(sample.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("row").alias("row"))
    first = stored(first.join(sample, "doc_id"), "drawn")
    met = rows.join(F.broadcast(first), ["doc_id", "row"]).dropDuplicates(["doc_id"])
    return stored(met.mapInArrow(scan, schema), "features")


def select_features(sample: DataFrame, labels: np.ndarray, most: int = FEATURES) -> list[str]:
    """Features met in three documents or more that tell the classes of either target apart best, by chi-square."""
    n, shares = len(labels), labels.mean(0).tolist()
    by = sample.select(F.explode("features").alias("feature"), *TARGETS).groupBy("feature").agg(F.count("*").alias("c"), *[F.sum(t).alias(t) for t in TARGETS])
    scores = [(F.col(t) - F.col("c") * p) ** 2 / (F.col("c") * p * (1 - p) * (1 - F.col("c") / n) + 1e-9) for t, p in zip(TARGETS, shares)]
    top = by.where("c >= 3").select("feature", F.round(F.greatest(*scores), 6).alias("score")).orderBy(F.desc("score"), "feature").limit(most)
    return [r["feature"] for r in top.collect()]


def _unpacked(at, meta) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of features and one-hot metadata of bounded rows on the driver."""
    numbers = np.array([np.frombuffer(bytes(m), np.float32) for m in meta], np.float32).reshape(len(meta), _META)
    return [np.frombuffer(bytes(x), "<u2") for x in at], one_hot(numbers)


def _collect_sample(rows: DataFrame, names: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The bounded sample on the driver: the places of its selected features, metadata, and quality, toxic, held, weight."""
    index = {f: i for i, f in enumerate(names)}
    columns = [*TARGETS, "held", "weight"]

    def pack(batches):
        for batch in batches:
            at = [np.array([index[f] for f in own if f in index], "<u2").tobytes() for own in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), *[batch.column(c) for c in ("meta", *columns)]], ["at", "meta", *columns])

    kinds = dict(rows.dtypes)
    got = rows.mapInArrow(pack, ", ".join(["at binary, meta binary", *[f"{c} {kinds[c]}" for c in columns]])).collect()
    return *_unpacked([r["at"] for r in got], [r["meta"] for r in got]), np.array([[float(r[c]) for c in columns] for r in got]).reshape(len(got), 4)


def featurise(docs: DataFrame, names: list[str]) -> DataFrame:
    """Per row (stored): doc_id, row, text_hash, at (places of its features, two bytes each), meta."""

    def scan(batches):
        vocabulary = Vocabulary(names)
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                row, feature = vocabulary.pairs(batch.column("text")[lo:hi])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))])
                at = _binary(feature.astype("<u2"), ends * 2)
                meta = _binary(metadata(batch, lo, hi), np.arange(hi - lo + 1) * 4 * _META)
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi] for c in ("doc_id", "row", "text_hash")], at, meta], ["doc_id", "row", "text_hash", "at", "meta"])

    rows = _rows(docs).withColumn("text_hash", F.xxhash64("text"))
    return stored(rows.mapInArrow(scan, "doc_id long, row long, text_hash long, at binary, meta binary"), "featurised")


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def _scored(featurised: DataFrame, model: Model, schema: str, result) -> DataFrame:
    """Scores of all rows by `result` (from the views' logits to columns), after doc_id, row and text_hash."""

    def scan(batches):
        for batch in batches:
            at, meta = batch.column("at"), batch.column("meta")
            n = batch.num_rows
            sizes = np.asarray(pc.binary_length(at), np.int64) // 2
            feature = np.frombuffer(b"".join(x.as_buffer() for x in at), "<u2").astype(np.int64)
            numbers = np.frombuffer(b"".join(x.as_buffer() for x in meta), np.float32).reshape(n, _META)
            z = model.views(np.repeat(np.arange(n), sizes), feature, one_hot(numbers))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "row", "text_hash")] + [pa.array(x) for x in result(z)], names)

    schema = "doc_id long, row long, text_hash long, " + schema
    names = [c.split()[0] for c in schema.split(", ")]
    return featurised.mapInArrow(scan, schema)


def _all_views(featurised: DataFrame, model: Model) -> DataFrame:
    """Calibrated logits of every row: doc_id, row, text_hash, z_<target>_<view>."""
    names = [f"z_{t}_{v}" for t in TARGETS for v in ("text", "meta")]
    return _scored(featurised, model, ", ".join(f"{n} double" for n in names), lambda z: np.ascontiguousarray(model.calibrated(z).reshape(len(z), -1).T))


def quotas(counts: dict, most: int) -> dict:
    """Rows to draw of each class: an eighth of `most` if it has them, and the rest in proportion."""
    least = {k: min(n, most // 8) for k, n in counts.items()}
    rest, left = most - sum(least.values()), sum(counts.values()) - sum(least.values())
    return {k: n if left <= rest else least[k] + (n - least[k]) * rest // left for k, n in counts.items()}


def draw_sample(usable: DataFrame) -> DataFrame:
    """At most SAMPLE labelled rows, by class (quality x toxic), and how many rows each stands for, with mean 1: weight."""
    counts = {(r["quality"], r["toxic"]): r["count"] for r in usable.groupBy(*TARGETS).count().collect()}  # at most four
    take = quotas(counts, SAMPLE)
    mean = sum(counts.values()) / max(sum(take.values()), 1)
    out = usable.limit(0).withColumn("weight", F.lit(1.0))
    for (quality, toxic), n in sorted(counts.items()):
        rows = usable.where((F.col("quality") == quality) & (F.col("toxic") == toxic))
        out = out.union(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(take[quality, toxic]).withColumn("weight", F.lit(n / max(take[quality, toxic], 1) / mean)))
    return out


def pseudo_labels(scored: DataFrame) -> DataFrame:
    """doc_id, row, target, view, label: what each view is surest about, for the other view. A text counts once, by its surest row."""
    kinds = [(t, v, label, F.col(f"z_{target}_{name}")) for t, target in enumerate(TARGETS) for v, name in enumerate(("text", "meta")) for label in (1, 0)]
    # The larger logit first, or the smaller one; then the smaller doc_id.
    surest = [F.min(F.struct((-z if label else z).alias("z"), "doc_id", "row")).alias(f"k{i}") for i, (_, _, label, z) in enumerate(kinds)]
    texts = stored(scored.groupBy("text_hash").agg(*surest), "surest")
    picks = None
    for i, (t, view, label, _) in enumerate(kinds):
        best = texts.where(F.col(f"k{i}.z") < -math.log(9)).orderBy(f"k{i}.z", f"k{i}.doc_id", f"k{i}.row").limit(PSEUDO)
        best = best.select(F.col(f"k{i}.doc_id").alias("doc_id"), F.col(f"k{i}.row").alias("row"), F.lit(t).alias("target"), F.lit(1 - view).alias("view"), F.lit(label).alias("label"))
        picks = best if picks is None else picks.union(best)
    return picks


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> tuple[Model | None, DataFrame | None]:
    """Co-train on labels (doc_id, quality, toxic): the model and the features of all docs, for score_documents().

    A target with fewer than ten rows of a class in the fitted part of the sample gets a constant score. No model
    if that holds for both, or fewer than ten rows are held out. Labels that are null or not 0 or 1 are left out; of labels that
    contradict each other, the worse holds. Ties for a place in the sample or among pseudo-labels go to the smaller doc_id.
    """
    small_batches(docs.sparkSession)
    usable = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    usable = stored(usable, "labels")
    sample = stored(draw_sample(usable).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0), "sample")
    rows = _sample_features(docs, sample)
    known = np.array([tuple(r) for r in rows.select(*TARGETS, "held").collect()], np.int8).reshape(-1, 3)
    fits = known[known[:, 2] == 0][:, :2]
    ones = fits.sum(0, dtype=int)
    fitted = [t for t in range(len(TARGETS)) if min(ones[t], len(fits) - ones[t]) >= 10]
    if not fitted or known[:, 2].sum() < 10:
        return None, None
    names = select_features(rows.where("not held"), fits)
    texts, meta, known = _collect_sample(rows, names)
    fitter = Fitter(names, texts, meta, known[:, :2], known[:, 2].astype(bool), known[:, 3], fitted)
    model = fitter.fit()
    discard(sample, rows)
    featurised = featurise(docs, names)
    labelled = broadcast_if_small(usable.select("doc_id"), BROADCAST_ROWS)
    for _ in range(rounds):
        picks = pseudo_labels(_all_views(featurised, model).where("doc_id is not null").join(labelled, "doc_id", "left_anti"))
        chosen = stored(picks.groupBy("row").agg(F.collect_set(F.struct("target", "view", "label")).alias("uses")), "chosen")
        # At most eight times PSEUDO rows; rows that are the same in all columns count once.
        got = featurised.join(F.broadcast(chosen), "row").dropDuplicates(["row"]).select("at", "meta", "uses").collect()
        texts, meta = _unpacked([r["at"] for r in got], [r["meta"] for r in got])
        for t in range(len(TARGETS)):
            for view in (0, 1):
                use = [(i, u["label"]) for i, r in enumerate(got) for u in r["uses"] if (u["target"], u["view"]) == (t, view)]
                if use:
                    i = [a for a, _ in use]
                    fitter.add(t, view, [texts[j] for j in i], meta[i], np.array([b for _, b in use]))
        model = fitter.fit()
        discard(chosen)
    discard(usable)
    return model, featurised


def _decisions(docs: DataFrame, model: Model, featurised: DataFrame | None) -> DataFrame:
    """doc_id, row, text_hash, quality, toxic, keep of all rows."""

    def result(z):
        p = np.round(model.score(z), 6)
        return p[:, 0], p[:, 1], (p[:, 0] >= 0.5) & (p[:, 1] < 0.5)

    small_batches(docs.sparkSession)
    return _scored(featurised or featurise(docs, model.names), model, "quality double, toxic double, keep boolean", result)


def score_documents(docs: DataFrame, model: Model | None, featurised: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, quality, toxic (probabilities) and keep: quality at least a half, toxic below it.

    `featurised` is what train() or featurise() gave for these docs. Nulls in any column count as empty text, unknown
    language or source, or length 0; a text is scored whole, however long. Without a model everything scores one half for
    quality and zero for toxic, and is kept. Repeated rows score alike; an empty table gives no rows; other columns are
    ignored.
    """
    if model is None:
        return _rows(docs).select("doc_id", F.lit(0.5).alias("quality"), F.lit(0.0).alias("toxic"), F.lit(True).alias("keep"))
    return _decisions(docs, model, featurised).select("doc_id", "quality", "toxic", "keep")


def keep_documents(docs: DataFrame, model: Model | None, featurised: DataFrame | None = None) -> DataFrame:
    """The rows of docs that score_documents() keeps, all columns as they are; rows that are the same go or stay together."""
    if model is None:
        return docs
    featurised = featurised or featurise(docs, model.names)
    gone = stored(_decisions(docs, model, featurised).where("not keep").select("doc_id", "row").distinct(), "rejected")
    discard(featurised)
    return rows_within(docs, gone, "left_anti", BROADCAST_ROWS)
