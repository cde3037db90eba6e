"""Approximate nearest neighbours by collision counting.

Vectors are brought to length one and projected on ``projections`` random
lines; on each line the projections form one sorted array.  Around a query's
own projection a window is opened on every line and widened step by step
(virtual rehashing: the radius grows, the arrays stay).  A vector that lies in
the windows of at least ``threshold`` lines is verified by its exact cosine;
the search ends at the radius within which ``k`` verified neighbours lie.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WIDTH = 2.72       # window width at radius 1, in units of the projection's deviation: best for a ratio of 2
START, GROWTH = 0.05, 1.25
ABREAST = 512      # queries whose windows are held at once
LEVELS = math.ceil(math.log(2.0 / START, GROWTH)) + 1  # the last radius covers the largest distance, 2


class SortedProjections:
    """The sorted arrays of one block of vectors, and the search in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: np.ndarray, threshold: int):
        self.ids, self.vectors, self.threshold, self.lines = ids, vectors, threshold, lines
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.unit = vectors / self.norms[:, None]
        places = (self.unit @ lines).T
        self.order = np.argsort(places, axis=1, kind="stable").astype(np.int32)
        self.places = np.take_along_axis(places, self.order, 1)

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window borders in every sorted array, [level, query, line]."""
        at = queries / np.sqrt((queries * queries).sum(1))[:, None] @ self.lines
        half = WIDTH / 2 * START * GROWTH ** np.arange(LEVELS)
        low = np.empty((LEVELS, len(queries), self.lines.shape[1]), np.int32)
        high = np.empty_like(low)
        for j, row in enumerate(self.places):
            low[:, :, j] = np.searchsorted(row, at[None, :, j] - half[:, None], "left")
            high[:, :, j] = np.searchsorted(row, at[None, :, j] + half[:, None], "right")
        return low, high

    def cosines(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosine of the original vectors; summed row by row, so equal vectors get equal scores."""
        return (self.vectors[rows] * query).sum(1) / (self.norms[rows] * np.sqrt((query * query).sum()))

    def search(self, query_id: int, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        """Ids and cosines of the ``k`` nearest found in this block, the query's own id left out."""
        n, own = len(self.ids), self.ids == query_id
        # Below this level the windows hold too few entries for k vectors to reach the threshold.
        inside = (high - low).sum(1)
        level = min(int(np.searchsorted(inside, k * self.threshold)), LEVELS - 1)
        a = b = None
        count, seen = np.zeros(n, np.int32), own.copy()
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        for level in range(level, LEVELS):
            lo, hi = low[level].tolist(), high[level].tolist()
            grown = ([o[x:y] for o, x, y in zip(self.order, lo, hi)] if a is None else
                     [o[x:y] for o, x, y in zip(self.order, lo, a)] + [o[x:y] for o, x, y in zip(self.order, b, hi)])
            a, b = lo, hi
            count += np.bincount(np.concatenate(grown), minlength=n).astype(np.int32)
            last = level == LEVELS - 1  # what never reached the threshold is verified too
            fresh = np.flatnonzero(~seen if last else (count >= self.threshold) & ~seen)
            seen[fresh] = True
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, self.cosines(query, fresh)])
            # Unit vectors at distance d have cosine 1 - d * d / 2.
            radius = START * GROWTH ** level
            if len(rows) >= k and np.partition(scores, -k)[-k] >= 1 - radius * radius / 2:
                break
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(``id``, ``v`` as doubles, ``dim``) of the rows that take part: an id, finite components, not all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).withColumn(
        "dim", F.size("v"))


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
            projections: int = 64, threshold: float = 0.66, block_rows: int = 8192, query_rows: int = 32768,
            seed: int = 42) -> DataFrame:
    """The ``k`` nearest by cosine of every row for which ``is_query`` (a condition on ``id``) holds.

    All rows are indexed, in blocks of about ``block_rows`` dealt by a hash of
    their place, so that rows of one id are spread like others; every block
    of ``query_rows`` queries meets every block once, and a window merges the
    blocks' ``k`` best.  No candidate is dropped: a query whose windows reach the
    largest radius is compared with the whole block.
    Vectors that are NULL, zero or hold NULL or non-finite components take no
    part, nor do rows without an id; only vectors of one length are compared;
    rows with a query's own id are not its neighbours; of repeated other rows
    each counts.  Query rows that repeat each other are one query; an id with
    several vectors is as many queries, each with ranks of its own.  Ties go to
    the smaller id.  Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` in
    double precision; queries with fewer candidates return them all.
    """
    rows = stage(usable(vectors, id_col, vec_col).withColumn("at", F.monotonically_increasing_id()), "ann-vectors")
    asked = stage(rows.filter(is_query).select("dim", "id", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "ann-queries")
    n, nq = rows.count(), asked.count()
    blocks, parts = max(1, math.ceil(n / block_rows)), max(1, math.ceil(nq / query_rows))
    deal = lambda count, by: F.pmod(F.xxhash64(by), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    none = F.lit(None).cast("long")
    data = rows.select("dim", deal(blocks, "at").alias("block"), every(parts).alias("part"), none.alias("q"), "id", "v")
    ask = asked.select("dim", every(blocks).alias("block"), deal(parts, "q").alias("part"), "q", "id", "v")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = {"q": [], "query_id": [], "vec_id": [], "score": []}
        dim = key[0].as_py()
        table = table.combine_chunks()
        asks = table["q"].is_valid().to_numpy()
        ids = table["id"].to_numpy()
        values = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        if asks.any() and not asks.all():
            lines = np.random.default_rng(seed).standard_normal((dim, projections))
            block = SortedProjections(ids[~asks], values[~asks], lines, math.ceil(threshold * projections))
            numbers, ids, values = table["q"].drop_null().to_numpy(), ids[asks], values[asks]
            for at in range(0, len(ids), ABREAST):
                low, high = block.windows(values[at:at + ABREAST])
                for i, own in enumerate(ids[at:at + ABREAST].tolist()):
                    found, scores = block.search(own, values[at + i], low[:, i], high[:, i], k)
                    out["q"].append(np.full(len(found), numbers[at + i]))
                    out["query_id"].append(np.full(len(found), own))
                    out["vec_id"].append(found)
                    out["score"].append(scores)
        kinds = {"q": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(x) if x else [], kinds[c]) for c, x in out.items()})

    found = data.unionByName(ask).groupBy("dim", "block", "part").applyInArrow(
        run, "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
