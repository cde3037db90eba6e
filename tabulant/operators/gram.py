"""Correlation of many columns from tiles of their Gram matrix.

Hundreds of columns have tens of thousands of pairs, more than one aggregate
row can hold.  Each task reduces its rows to sums over pairs of columns with
matrix products, and sends them as tiles; tiles are merged in two steps, so no
task holds more than a few hundred of them, nor all tiles of the matrix.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions below travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE = 64     # columns to a side of a tile
SPREAD = 256  # tasks' tiles are first merged in so many groups
STATE = "i int, j int, part int, state array<double>"


class PairSums:
    """Sums over all pairs of columns, of the rows where both are known.

    Values are taken relative to the first batch's means, so that large
    common offsets do not cost digits.
    """

    def __init__(self, p: int):
        self.shift = None
        self.n, self.x, self.xx, self.xy = (np.zeros((p, p)) for _ in range(4))

    def add(self, values: np.ndarray) -> None:
        known = ~np.isnan(values)
        if self.shift is None:
            self.shift = np.where(known.any(0), np.nansum(values, 0) / np.maximum(known.sum(0), 1), 0.0)
        z, m = np.where(known, values - self.shift, 0.0), known.astype(float)
        self.n += m.T @ m
        self.x += z.T @ m
        self.xx += (z * z).T @ m
        self.xy += z.T @ z

    def tile(self, rows: slice, cols: slice) -> np.ndarray:
        """(n, mean of x, mean of y, centred sums xx, yy, xy) of the pairs (x in ``rows``, y in ``cols``)."""
        n, x, y = self.n[rows, cols], self.x[rows, cols], self.x[cols, rows].T
        d = np.maximum(n, 1)
        return np.stack([n, x / d + self.shift[rows][:, None], y / d + self.shift[cols][None, :],
                         self.xx[rows, cols] - x * x / d, self.xx[cols, rows].T - y * y / d, self.xy[rows, cols] - x * y / d])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of both sets of rows together (parallel update of centred sums)."""
    n = a[0] + b[0]
    d = np.maximum(n, 1)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / d
    share = b[0] / d
    return np.stack([n, np.where(a[0] > 0, a[1] + dx * share, b[1]), np.where(a[0] > 0, a[2] + dy * share, b[2]),
                     a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def correlate(state: np.ndarray) -> np.ndarray:
    """Pearson's r of each pair; NaN for fewer than two rows or a constant column."""
    n, _, _, xx, yy, xy = state
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((n > 1) & (xx > 0) & (yy > 0), xy / np.sqrt(xx * yy), np.nan)


def corr_tiles(df: DataFrame, cols: list[str], scale: int = 6, tile: int = TILE) -> DataFrame:
    """Long-form correlation matrix ``(x, y, r)`` of every ordered pair, from one scan.

    Each pair counts the rows in which both of its columns are known (NULL
    and NaN are not); ``r`` is NULL for fewer than two of them or a constant
    column.  A task holds four square matrices of the columns, the shuffles carry
    tiles: their number depends on columns and tasks, not on rows.
    """
    p, names = len(cols), list(cols)
    cuts = [slice(s, min(s + tile, p)) for s in range(0, p, tile)]

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId() % SPREAD, PairSums(p)
        for batch in batches:
            if batch.num_rows:
                sums.add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
        if sums.shift is not None:
            for i, rows in enumerate(cuts):
                for j in range(i, len(cuts)):
                    state = sums.tile(rows, cuts[j]).ravel()
                    yield pa.record_batch([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int32()),
                                           pa.ListArray.from_arrays([0, len(state)], pa.array(state))], ["i", "j", "part", "state"])

    def merged(states: pa.Table) -> tuple[int, int, np.ndarray]:
        i, j = states["i"][0].as_py(), states["j"][0].as_py()
        shape = (6, cuts[i].stop - cuts[i].start, cuts[j].stop - cuts[j].start)
        total = None
        for s in states["state"]:
            state = s.values.to_numpy().reshape(shape)
            total = state if total is None else merge(total, state)
        return i, j, total

    def merge_some(states: pa.Table) -> pa.Table:
        i, j, total = merged(states)
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "part": pa.array([0], pa.int32()),
                         "state": pa.ListArray.from_arrays([0, total.size], pa.array(total.ravel()))})

    def finish(states: pa.Table) -> pa.Table:
        i, j, total = merged(states)
        r = correlate(total)
        if i == j:  # a column with itself, where rounding may miss 1
            r = np.where(np.eye(len(r), dtype=bool) & ~np.isnan(r), 1.0, r)
        left, right = np.array(names[cuts[i]], object), np.array(names[cuts[j]], object)
        x, y, r = np.repeat(left, len(right)), np.tile(right, len(left)), r.ravel()
        if i != j:
            x, y, r = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([r, r])
        return pa.table({"x": pa.array(x, pa.string()), "y": pa.array(y, pa.string()), "r": pa.array(r, mask=np.isnan(r))})

    numbers = df.select(*[F.col(c).cast("double").alias(f"c{n}") for n, c in enumerate(names)])
    some = numbers.mapInArrow(reduce_rows, STATE).groupBy("i", "j", "part").applyInArrow(merge_some, STATE)
    out = some.groupBy("i", "j").applyInArrow(finish, "x string, y string, r double")
    return out.select("x", "y", F.round("r", scale).alias("r"))
