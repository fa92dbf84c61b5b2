"""Sums over all rows, computed in one pass for many models at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null, q
from .filters import finite_rows
from .ordering import first_n, spread


def point_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The coordinates alone, as doubles, of the rows where all are finite.

    One missing coordinate would turn every sum it enters into NaN.
    """
    return spread(finite_rows(df.select(*[q(c) for c in columns]), columns))


def finite_point(columns: Sequence[str]) -> Column:
    """True for the rows that :func:`point_table` keeps."""
    return reduce(lambda a, b: a & b, [finite_or_null(q(c).cast("double")).isNotNull() for c in columns])


def batch_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("f8")


#: Points that are arranged together, and points of one block of them.
ARRANGED, BLOCK = 1 << 20, 64


def near_order(x: np.ndarray) -> np.ndarray:
    """An order in which each BLOCK consecutive points are near each other: medians along
    the widest side, down to single blocks."""
    order = np.arange(len(x))
    todo = [(0, len(x))]
    while todo:
        low, high = todo.pop()
        if high - low <= BLOCK:
            continue
        own = order[low:high]
        values = x[own]
        side = int(np.argmax(values.max(axis=0) - values.min(axis=0)))
        half = -(-(high - low) // BLOCK) // 2 * BLOCK
        order[low:high] = own[np.argpartition(values[:, side], half)]
        todo += [(low, low + half), (low + half, high)]
    return order


def arranged(points: DataFrame) -> DataFrame:
    """The rows of :func:`point_table` in pieces of about ARRANGED points, each in :func:`near_order`."""
    dim = len(points.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def piece() -> pa.RecordBatch:
            x = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([x[near_order(x)].tobytes()], pa.binary())], ["dim", "points"]
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch_matrix(batch))
                size += batch.num_rows
            if size >= ARRANGED:
                yield piece()
                held, size = [], 0
        if held:
            yield piece()

    return points.mapInArrow(run, "dim int, points binary")


class Piece:
    """One arranged piece: its points, and count, mean, spread and box of each block."""

    def __init__(self, x: np.ndarray):
        self.x = x
        starts = np.arange(0, len(x), BLOCK)
        self.sizes = np.diff(np.r_[starts, len(x)]).astype("f8")
        self.block = np.repeat(np.arange(len(starts)), self.sizes.astype("i8"))
        self.low, self.high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        self.mean = np.add.reduceat(x, starts) / self.sizes[:, None]
        self.spread = np.add.reduceat(np.square(x - self.mean[self.block]).sum(axis=1), starts)

    def owners(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centre nearest to all of each block's points, and whether there is one: no
        other centre comes as near the box as that one stays to its far corner."""
        shape = len(self.low), len(centres)
        near, far = np.zeros(shape), np.zeros(shape)
        for i, c in enumerate(centres.T):
            below, above = self.low[:, i, None] - c, c - self.high[:, i, None]
            near += np.square(np.maximum(np.maximum(below, above), 0.0))
            far += np.square(np.maximum(np.abs(below), np.abs(above)))
        reach = far.min(axis=1)
        # A hair wider than rounding could make it narrow.
        return far.argmin(axis=1), (near <= reach[:, None] * (1 + 1e-9)).sum(axis=1) <= 1


def pieces(batch: pa.RecordBatch) -> Iterator[Piece]:
    for dim, points in zip(batch.column("dim").to_pylist(), batch.column("points")):
        yield Piece(np.frombuffer(points.as_buffer()).reshape(-1, dim))


def _matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch_matrix(batch)


def summed(points: DataFrame, width: int, add: Callable, read: Callable[[pa.RecordBatch], Iterator] = _matrices) -> np.ndarray:
    """Total of ``add(rows)``, a vector of ``width`` numbers.

    Each task adds up its own batches and emits ``width`` numbers; as many are
    collected, whatever the number of rows. ``read`` gives what ``add`` takes, from a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                for part in read(batch):
                    total += add(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype="i4")), pa.array(total)], ["i", "v"]
        )

    rows = points.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(width)
    for row in rows.collect():
        out[row["i"]] = row["v"]
    return out


#: Distinct points drawn to place the starting centres, at least.
START_ROWS = 4096


def starting_rows(points: DataFrame, seed: int, k: int) -> np.ndarray:
    """A bounded draw of distinct points for the starting centres of ``k`` clusters.

    At least twice ``k`` and :data:`START_ROWS` rows, drawn by a hash of their
    values: the same for any partitioning. Fewer distinct points than ``k``
    raise; every row takes part in the fit itself.
    """
    order = F.xxhash64(*[q(c) for c in points.columns], F.lit(seed))
    drawn = first_n(points.distinct(), [], order, max(START_ROWS, 2 * k))
    rows = np.array(sorted(tuple(r) for r in drawn.collect()), dtype=float).reshape(-1, len(points.columns))
    if len(rows) < k:
        raise ValueError(f"{k} clusters need as many distinct points; there are {len(rows)}")
    return rows


def spread_centres(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centre is drawn with its squared distance as weight."""
    rng = np.random.default_rng(seed)
    centres = [rows[rng.integers(len(rows))]]
    gap = np.square(rows - centres[0]).sum(axis=1)
    while len(centres) < k:
        total = gap.sum()
        pick = rng.choice(len(rows), p=gap / total) if total > 0 else rng.integers(len(rows))
        centres.append(rows[pick])
        gap = np.minimum(gap, np.square(rows - rows[pick]).sum(axis=1))
    return np.array(centres)
