"""A table with all that operators should bear."""

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 50, n)))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with names that operators use."""
    base = prose(120, 1)
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, base + " more words here", "en", "b", 5), (4, None, "en", "b", 0), (5, "", None, None, None),
        (None, base, "en", "a", 5), (None, None, None, None, None), (6, "one", "de", "a", 3), (6, "one", "de", "a", 3), (6, "two words", "de", "a", 3),
        (7, prose(40_000, 2), "fr", "c", 9), (8, "  \t\n ", "fr", "c", 4), (9, prose(60, 3) + " " + base, "en", "a", 7), (-5, "ünï çödé 漢字 \x00 end", "xx", "ç", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = "rid piece start length ids bin grp sequence_id offset term n df at names own counts shares every total x y v label code error _row _doc _hash _times _lang _domain _source _epoch _r _d".split()
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names}).cache()
