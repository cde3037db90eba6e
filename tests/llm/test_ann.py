"""Nearest neighbours: recall and scores against brute force, and odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from tabulant.llm import ann


def brute(ids, vectors, queries, k):
    norms = np.sqrt((vectors * vectors).sum(1))
    out = {}
    for q in queries:
        v = vectors[list(ids).index(q)]
        cos = (vectors * v).sum(1) / (norms * np.sqrt((v * v).sum()))
        rest = [i for i in range(len(ids)) if ids[i] != q]
        out[q] = sorted(((-cos[i], ids[i]) for i in rest))[:k]
    return out


def recall(spark, sf):
    from tabulant.llm.queries import QUERIES
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    vectors = np.array(table.embedding.tolist(), np.float64)
    got = {}
    for r in QUERIES["op4_nearest"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(table.vec_id.tolist(), vectors, [i for i in table.vec_id if i % 50 == 0], 5)
    hits = 0
    for q, best in want.items():
        assert sorted(got[q]) == list(range(1, 6))
        found = [got[q][r] for r in range(1, 6)]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in found} & {i for _, i in best})
        exact = {i: -c for c, i in best}
        assert all(abs(s - exact[i]) < 1e-12 for i, s in found if i in exact)
    return hits / (5 * len(want))


def test_recall(spark):
    assert recall(spark, "/root/testdata/sf0.01") >= 0.95
    assert recall(spark, "/root/testdata/sf0.1") >= 0.95


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]),
            (6, [2.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]),
            (10, [0.0, 1.0]), (0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(
        df.filter("embedding is null or not (vec_id = 0 and embedding[1] = 1)"), F.col("id") == 0).collect()]
    assert sorted(got) == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 7, 1.0), (0, 4, 10, 0.0)]
    assert ann.nearest(df.limit(0), F.col("id") == 0).count() == 0


def test_hot_vector(spark):
    """A third of all rows are one vector: its copies are each other's neighbours, smaller ids first."""
    rng = np.random.default_rng(1)
    hot = rng.standard_normal(16).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.standard_normal(16).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("id") == 300, block_rows=100).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 3, 6, 9, 12]


def test_repeated_query_rows(spark):
    """A query row that repeats is one query; an id with two vectors is two, with five neighbours each."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((30, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(0, vectors[0].tolist())] * 3 + [(1, rng.standard_normal(8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, F.col("id").isin(0, 1)).collect()]
    assert len({(v, s) for q, _, v, s in got if q == 0}) == 5
    assert sorted(r for q, r, _, _ in got if q == 0) == [1, 2, 3, 4, 5]
    assert sorted(r for q, r, _, _ in got if q == 1) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert not any(q == v for q, _, v, _ in got)


def test_rows_of_one_id_are_spread_over_blocks(spark):
    """A third of all rows share an id: they are dealt over the blocks like others, and all are found."""
    rng = np.random.default_rng(4)
    rows = [(7 if i % 3 == 0 else i, rng.standard_normal(4).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = ann.nearest(df, F.col("id") == 8, k=2000, block_rows=100).collect()
    assert len(got) == 1199 and sum(r.vec_id == 7 for r in got) == 401
    assert [r.rank for r in sorted(got, key=lambda r: (-r.score, r.vec_id))] == list(range(1, 1200))
