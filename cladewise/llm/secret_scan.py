"""Secret scan by corpus-wide ownership frequency, with DataFrame functions only.

Candidates are found in whole texts, hashed, and counted over distinct repositories and owners. A value seen under many
owners is a widely copied example; one that a single owner has and that looks random is reported as live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Kinds in the order of their names in the output, their patterns, the group that holds the value and
# the least length of that value.
BASE_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # a longest run of 16 or more is what [0-9a-f]+ finds there
]
#: Added by the method: bare runs that could be a key. They count only if one owner has them and they look random.
OPAQUE = ("opaque", r"[A-Za-z0-9_-]{24,}", 0, 24)
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|your[_-]|dummy|x{6,}|(.)\1{5,}"


def _found(text: Column, pattern: str, group: int) -> Column:
    """Matches, leftmost and non-overlapping: what lies before each (characters), its length, its value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    return F.when(
        text.rlike(pattern),
        F.arrays_zip(
            F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.length).alias("gap"),
            F.transform(whole, F.length).alias("len"),
            value.alias("value"),
        ),
    )


def looks_live(value: Column, distinct: int = 10) -> Column:
    """Many different characters, a digit and a letter, and no mark of an example."""
    return (
        (F.size(F.array_distinct(F.split(value, ""))) >= distinct)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & ~value.rlike(PLACEHOLDER)
    )


def scan_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: list[str] | None = None,
    repository: list[str] | None = None,
    most_owners: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Returns (rows, spans).

    rows: one per input row: rid, key. spans: one per kept span: rid, kind, ord, start, end (code points, end exclusive),
    value_sha256, n_owners, n_repositories, live, base. Base spans are always kept; opaque ones only when live: at most
    `most_owners` owners have the value, it looks random, and it overlaps no base span.

    Owners default to `source`, repositories to (`source`, `lang`). A null or empty text has no spans; a null key, owner
    or repository is an ordinary value; repeated rows are reported each; other columns are ignored. Long texts make long
    match lists, which are exploded to rows before positions are summed, so the work stays linear.
    """
    owner, repository = owner or ["source"], repository or ["source", "lang"]
    kinds = [*BASE_KINDS, OPAQUE]
    t = F.coalesce(F.col(text), F.lit(""))
    hits = stored(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(key).alias("key"),
            F.xxhash64(*[F.col(c) for c in owner]).alias("owner"),
            F.xxhash64(*[F.col(c) for c in repository]).alias("repository"),
            *[_found(t, pattern, group).alias(kind) for kind, pattern, group, _ in kinds],
        ),
        "secrets",
    )
    per_kind = [
        hits.where(F.col(kind).isNotNull())
        .select("rid", "owner", "repository", F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("at", "m"))
        .select("rid", "owner", "repository", "ord", "kind", "at", "m.gap", "m.len", "m.value")
        for i, (kind, *_) in enumerate(kinds)
    ]
    every = per_kind[0]
    for x in per_kind[1:]:
        every = every.unionByName(x)
    least = F.element_at(F.array(*[F.lit(n) for *_, n in kinds]), F.col("ord") + 1)
    before = Window.partitionBy("rid", "ord").orderBy("at")
    placed = (
        every.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
        .withColumn("start", F.col("end") - F.col("len"))
        .where(F.length("value") >= least)
        .withColumn("base", F.col("ord") < len(BASE_KINDS))
        .withColumn("likely", looks_live(F.col("value")))
        .withColumn("value_sha256", F.sha2("value", 256))
    )
    row = Window.partitionBy("rid").orderBy("start", "ord")
    clear = placed.withColumn(
        "clear",
        F.col("base")
        | (
            F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
            & F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(row.rowsBetween(1, Window.unboundedFollowing)) >= F.col("end"), F.lit(True))
        ),
    ).where("clear and (base or likely)")
    spans = stored(clear.select("rid", "owner", "repository", "ord", "kind", "start", "end", "value_sha256", "base", "likely"), "spans")
    owners = spans.groupBy("value_sha256", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = owners.groupBy("value_sha256", "owner").agg(F.count("*").alias("n"))
    # Stored, so that a value which very many rows have is a large key of `spans` alone and its join can be split.
    counts = stored(owners.groupBy("value_sha256").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories")), "owners")
    judged = (
        spans.join(counts, "value_sha256")
        .withColumn("live", F.col("likely") & (F.col("n_owners") <= most_owners))
        .where("base or live")
        .select("rid", "kind", "ord", "start", "end", "value_sha256", "n_owners", "n_repositories", "live", "base")
    )
    return hits.select("rid", "key"), judged


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, digests, the span list, and how many values are live or widely copied."""
    rows, spans = scan_secrets(docs)
    span = F.struct("start", "ord", "end", "kind")
    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>")
    per_row = spans.groupBy("rid").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind, *_ in BASE_KINDS],
        F.collect_list(F.when(F.col("base"), span)).alias("base_spans"),
        F.collect_list(span).alias("all_spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    return (
        rows.join(per_row, "rid", "left")
        .select(
            F.col("key").alias("doc_id"),
            *[F.coalesce(F.col(f"n_{kind}"), F.lit(0)).cast("long").alias(f"n_{kind}") for kind, *_ in BASE_KINDS],
            F.sha2(_line(F.coalesce("base_spans", none)), 256).alias("base_sha256"),
            _line(F.coalesce("all_spans", none)).alias("spans"),
            F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
            F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        )
    )
