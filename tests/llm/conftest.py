"""Fixtures of the training-data tests: messy documents, and brute-force helpers."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS, **extra):
    """Documents from (doc_id, text) pairs or whole rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", f"s{(r[0] or 0) % 3}", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema)


def words(rng, n, size=6):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, size))) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """NULL and empty texts, NULL ids, repeated rows, ties, a very long text, and columns with clashing names."""
    rng = random.Random(5)
    base = words(rng, 60)
    rows = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "one two three"), (6, base), (7, base), (7, base),
            (None, base), (8, base.replace(base.split()[30], "zzzz")), (9, words(rng, 30_000)), (10, "\n\n"),
            (11, words(rng, 40)), (12, "\n".join([words(rng, 12)] * 5)), (None, None)]
    df = frame(spark, rows)
    clashing = ("id", "fp", "rep", "cell", "h", "line", "pos", "doc", "shard", "slot", "key", "__t", "tokens", "size", "rank",
                "epoch2", "a", "b", "u", "v", "score", "lines", "word", "label", "node", "component")
    for c in clashing:
        from pyspark.sql import functions as F
        df = df.withColumn(c, F.lit(7))
    return df
