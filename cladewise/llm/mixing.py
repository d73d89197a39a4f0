"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The tree is domain - language - source. A node's budget is shared among its children by weight. A child can use at most
its tokens times the allowed epochs; what one cannot use goes to its siblings by their weights, and only when a whole
family is full does the rest pass to the siblings of its parent, since a node's own limit is the sum of its children's.
Each leaf then takes whole epochs and the longest prefix of one more, in an order seeded by the epoch, that fits what is
left. Tokens are words here: runs of anything but ASCII white space, since a tokenizer would need Python workers.

What a row is taken for follows from its own key and a few numbers of its leaf, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, broadcast_if_small, discard, row_hash, stored

LEVELS = ["domain", "lang", "source"]
NONE = "(none)"
#: Rows of a leaf in one bin of its seeded order, about: a single bin of each leaf is ordered row by row.
BIN_ROWS = 1_000

#: Leaves whose cuts may be sent to all executors; beyond it the join is shuffled.
BROADCAST_LEAVES = 100_000
#: Parts of a doubling of limit / weight in which children are ordered by their bin alone.
RATIO_BINS = 64

# The production mix. Names that are not listed weigh 1.
WEIGHTS = {
    "domain": {"d0": 3.0, "d1": 3.0, "d2": 2.0, "d3": 2.0},
    "lang": {"en": 3.0, "de": 1.0, "fr": 1.0, "es": 1.0},
    "source": {"src0": 4.0, "src1": 2.0, "src2": 2.0},
}


def source_domain(source: Column) -> Column:
    """Documents name no domain: sources are dealt to four by hash."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(4)))


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    known = weights.get(level) or {}
    if not known:
        return F.lit(1.0)
    pairs = F.create_map(*[F.lit(x) for name, w in known.items() for x in (name, float(w))])
    return F.coalesce(F.try_element_at(pairs, F.col(level)), F.lit(1.0))


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split `budget` among the children of each parent by `weight`, none above its `limit`; adds `given`.

    Ordered by limit / weight, children are full until the first for which an equal rate for all the rest stays below its
    limit; that rate holds from there on. Children are first summed up in bins of limit / weight, and only those of the bin
    in which the rate settles are ordered one by one. Children without weight or limit get nothing.
    """
    ratio = F.when((F.col("weight") > 0) & (F.col("limit") > 0), F.col("limit") / F.col("weight"))
    children = stored(children.withColumn("ratio", ratio).withColumn("bin", F.floor(F.log2("ratio") * RATIO_BINS)), "children")
    live = children.where("ratio is not null")
    bins = live.groupBy(*parent, "bin").agg(F.sum("limit").alias("cap"), F.sum("weight").alias("w"), F.max("ratio").alias("top"), F.first("budget").alias("budget"))
    up = Window.partitionBy(*parent).orderBy("bin")
    bins = bins.withColumn("taken", F.sum("cap").over(up)).withColumn("rest", F.coalesce(F.sum("w").over(up.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    # All of a bin is full if what is left then still gives the rest at least the largest ratio of the bin.
    bins = bins.withColumn("open", F.col("budget") - F.col("taken") < F.col("top") * F.col("rest"))
    bins = bins.withColumn("open", F.when(F.col("rest") == 0, F.col("budget") < F.col("taken")).otherwise(F.col("open")))
    edge = bins.where("open").groupBy(*parent).agg(F.min(F.struct("bin", (F.col("taken") - F.col("cap")).alias("before"), F.col("rest").alias("after"))).alias("edge"))
    edge = stored(edge.select(*parent, F.col("edge.bin").alias("bin"), F.col("edge.before").alias("before"), F.col("edge.after").alias("after")), "edge")
    order = Window.partitionBy(*parent).orderBy("ratio", name)
    at = live.join(edge, [*parent, "bin"])
    at = at.withColumn("taken", F.col("before") + F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit"))
    at = at.withColumn("rest", F.col("after") + F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    at = at.withColumn("rate", (F.col("budget") - F.col("taken")) / F.col("rest")).withColumn("place", F.row_number().over(order))
    rates = at.where(F.col("rate") < F.col("ratio")).groupBy(*parent).agg(F.min_by("rate", "place").alias("rate"))
    rates = stored(rates, "rates")
    given = F.when(F.col("ratio").isNull(), 0.0).otherwise(F.least("limit", F.greatest(F.coalesce(F.col("rate") * F.col("weight"), F.col("limit")), F.lit(0.0))))
    out = stored(children.join(rates, parent, "left").withColumn("given", given).drop("ratio", "bin", "rate"), "shares")
    discard(children, edge, rates)
    return out


def leaf_budgets(leaves: DataFrame, total: float, weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens, rows. Adds limit and budget (long, tokens)."""
    for level in LEVELS:
        leaves = leaves.withColumn(f"w_{level}", _weight(level, weights))
    usable = F.when((F.col("w_source") > 0) & (F.col("w_lang") > 0) & (F.col("w_domain") > 0), F.col("tokens") * float(epochs)).otherwise(0.0)
    leaves = leaves.withColumn("limit", usable)
    langs = leaves.groupBy("domain", "lang", "w_domain", "w_lang").agg(F.sum("limit").alias("limit"))
    domains = langs.groupBy("domain", "w_domain").agg(F.sum("limit").alias("limit"))
    top = share(domains.withColumn("budget", F.lit(float(total))).withColumn("weight", F.col("w_domain")).withColumn("root", F.lit(0)), ["root"], "domain").select("domain", F.col("given").alias("budget"))
    mid = share(langs.join(top, "domain").withColumn("weight", F.col("w_lang")), ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    low = share(leaves.join(mid, ["domain", "lang"]).withColumn("weight", F.col("w_source")), ["domain", "lang"], "source")
    return low.select(*LEVELS, "tokens", "rows", "limit", F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def _levels(docs: DataFrame) -> list[Column]:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    domain = named("domain") if "domain" in docs.columns else source_domain(F.col("source").cast("string"))
    return [domain, named("lang"), named("source")]


def _key(doc: Column, row: Column) -> tuple[Column, Column]:
    """A doc_id and a row's hash, without nulls."""
    return F.coalesce(doc.cast("long"), F.lit(-(1 << 63))), row


def place(seed: int, epoch: Column, doc: Column, row: Column) -> Column:
    """A row's place in the order of an epoch, from 0 to 1, but for ties."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch, *_key(doc, row)), F.lit(1 << 50)) / float(1 << 50)


def _times(epochs: int, seed: int, doc: Column, row: Column, before: str = "") -> Column:
    """How many epochs a row is in, beside the cut of its leaf (columns whole, bins, edge and cut, after `before`)."""
    whole, bins, edge, cut = (F.col(before + c) for c in ("whole", "bins", "edge", "cut"))
    u = place(seed, whole + 1, doc, row)
    at = F.floor(u * bins)
    key = F.struct(u.alias("u"), *(c.alias(n) for c, n in zip(_key(doc, row), ("doc", "row"))))
    more = F.when(edge.isNull(), True).otherwise((at < edge) | ((at == edge) & F.coalesce(key <= cut, F.lit(False))))
    return whole + F.when(whole >= epochs, 0).otherwise(more.cast("int"))


def _cuts(docs: DataFrame, total: int | None, part: float, weights: dict, epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, domain, lang, source, n_words) and, for each leaf, its whole epochs and where the next one is cut."""
    domain, lang, source = _levels(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), domain.alias("domain"), lang.alias("lang"), source.alias("source"), n_words("text").alias("n_words"))
    rows = stored(rows, "mix")
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_words").alias("tokens"), F.count("*").alias("rows")), "leaves")
    if total is None:
        total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * part)
    budgets = leaf_budgets(leaves, total, weights, epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(epochs))).otherwise(0)
    budgets = stored(
        budgets.withColumn("whole", whole.cast("int"))
        .withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens"))
        .withColumn("bins", F.ceil(F.col("rows") / BIN_ROWS))
        .select(*LEVELS, "tokens", "whole", "left", "bins"),
        "budgets",
    )
    # Rows that are the same in all columns are one unit: they have one place, and go in or stay out together.
    partial = budgets.where((F.col("whole") < epochs) & (F.col("left") < F.col("tokens")) & (F.col("left") > 0))
    unit = rows.join(broadcast_if_small(partial, BROADCAST_LEAVES), LEVELS)
    unit = unit.withColumn("u", place(seed, F.col("whole") + 1, F.col("doc_id"), F.col("row"))).withColumn("bin", F.floor(F.col("u") * F.col("bins")))
    sums = stored(unit.groupBy(*LEVELS, "bin", "left").agg(F.sum("n_words").alias("n")), "bins")
    upto = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = sums.withColumn("through", F.sum("n").over(upto)).where(F.col("through") > F.col("left"))
    edge = edge.groupBy(*LEVELS).agg(F.min(F.struct("bin", (F.col("through") - F.col("n")).alias("base"))).alias("edge"))
    edge = stored(edge.select(*LEVELS, F.col("edge.bin").alias("bin"), F.col("edge.base").alias("base")), "edge")
    doc, row = _key(F.col("doc_id"), F.col("row"))
    inside = unit.join(broadcast_if_small(edge, BROADCAST_LEAVES), [*LEVELS, "bin"]).groupBy(*LEVELS, "left", "base", F.struct("u", doc.alias("doc"), row.alias("row")).alias("key"))
    inside = inside.agg(F.sum("n_words").alias("n"))
    order = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cut = inside.withColumn("through", F.col("base") + F.sum("n").over(order)).where(F.col("through") <= F.col("left")).groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    none = F.when((F.col("left") == 0) & (F.col("tokens") > 0), -1)
    cuts = budgets.join(edge.select(*LEVELS, F.col("bin").alias("edge")), LEVELS, "left").join(cut, LEVELS, "left")
    cuts = cuts.select(*LEVELS, "whole", "bins", F.coalesce("edge", none).alias("edge"), "cut")
    cuts = stored(cuts, "cuts")
    discard(leaves, budgets, sums, edge)
    return rows, cuts


def mix_sources(docs: DataFrame, total: int | None = None, part: float = 0.9, weights: dict | None = None, epochs: int = 2, seed: int = 7) -> DataFrame:
    """One row for each time a row of docs is taken: doc_id, row, domain, lang, source, n_words, epoch (from 1).

    The budget is `total` words, or `part` of all words. A null language or source goes by the name (none); a null or
    empty text has no words and comes with any prefix that reaches it; a text is counted whole, however long. Rows that are
    the same in all columns are taken together; other ties in the seeded order are broken by doc_id and the row's hash. An
    empty table gives no rows. Other columns are ignored, whatever their names; a column `domain` in docs is used if it is
    there.
    """
    rows, cuts = _cuts(docs, total, part, WEIGHTS if weights is None else weights, epochs, seed)
    met = rows.join(broadcast_if_small(cuts, BROADCAST_LEAVES), LEVELS).withColumn("times", _times(epochs, seed, F.col("doc_id"), F.col("row")))
    return met.where("times > 0").select("doc_id", "row", *LEVELS, "n_words", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"))


def take_rows(docs: DataFrame, total: int | None = None, part: float = 0.9, weights: dict | None = None, epochs: int = 2, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as mix_sources() takes it, with the columns of docs."""
    rows, cuts = _cuts(docs, total, part, WEIGHTS if weights is None else weights, epochs, seed)
    discard(rows)
    p = apart(docs)
    own = dict(zip((f"{p}{level}" for level in LEVELS), _levels(docs)))
    cuts = broadcast_if_small(cuts, BROADCAST_LEAVES).select(*[F.col(level).alias(f"{p}of_{level}") for level in LEVELS], *[F.col(c).alias(f"{p}{c}") for c in ("whole", "bins", "edge", "cut")])
    keyed = docs.withColumn(f"{p}row", row_hash(docs)).withColumns(own)
    met = keyed.join(cuts, [F.col(f"{p}{level}") == F.col(f"{p}of_{level}") for level in LEVELS])
    met = met.withColumn(f"{p}times", _times(epochs, seed, F.col("doc_id"), F.col(f"{p}row"), p)).where(F.col(f"{p}times") > 0)
    met = met.withColumn(f"{p}epoch", F.explode(F.sequence(F.lit(1), F.col(f"{p}times"))))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns])
