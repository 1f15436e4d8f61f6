"""Ordered per-pixel recursions that no window function expresses: running pedestals and tracking histograms.

Rows are partitioned by pixel and sorted by their order inside the partition, where a kernel holds
the states of the partition's pixels as arrays (bounded by the detector, whatever the number of
frames). A block of rows is dealt to steps, the k-th of which has the k-th row of each pixel, so a
step is a few array operations over all pixels, as one frame is. Pixels are the unit of parallelism.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 200_000


class Pedestal:
    """State of one pixel: sum, sum of squares, samples and mean, in one floating type."""

    def __init__(self, n_samples: int, kind: type = np.float64):
        self.limit, self.kind = kind(n_samples), kind
        self.clear()

    def clear(self) -> None:
        self.sum = self.sum2 = self.mean = self.kind(0)
        self.n = 0

    def push_no_update(self, v) -> None:
        v = self.kind(v)
        if self.n < self.limit:
            self.n += 1
            self.sum, self.sum2 = self.sum + v, self.sum2 + v * v
        else:
            self.sum, self.sum2 = self.sum + (v - self.sum / self.limit), self.sum2 + (v * v - self.sum2 / self.limit)

    def update_mean(self) -> None:
        self.mean = self.sum / self.kind(self.n) if self.n else self.kind(0)

    def push(self, v) -> None:
        self.push_no_update(v)
        self.update_mean()

    def push_fast(self, v) -> None:
        """The steady state: divides by the full number of samples, whatever has been pushed."""
        v = self.kind(v)
        self.sum, self.sum2 = self.sum + (v - self.sum / self.limit), self.sum2 + (v * v - self.sum2 / self.limit)
        self.mean = self.sum / self.limit

    def push_with_threshold(self, v, threshold) -> None:
        if abs(self.kind(v) - self.mean) < threshold:
            self.push(v)

    def variance(self):
        """Population variance, not below 0; 0 without samples."""
        if not self.n:
            return self.kind(0)
        return max(self.kind(0), self.sum2 / self.kind(self.n) - (self.sum / self.kind(self.n)) ** 2)

    def std(self):
        return np.sqrt(self.variance())


class Pedestals:
    """``Pedestal`` for many pixels: arrays of sums, sums of squares, samples and means."""

    def __init__(self, n_samples: int, kind: type = np.float64):
        self.limit, self.kind = kind(n_samples), kind
        self.sum, self.sum2, self.mean, self.n = np.zeros(0, kind), np.zeros(0, kind), np.zeros(0, kind), np.zeros(0, np.int64)

    def grow(self, n: int) -> None:
        for name in ("sum", "sum2", "mean", "n"):
            held = getattr(self, name)
            setattr(self, name, np.concatenate([held, np.zeros(n - len(held), held.dtype)]))

    def push_no_update(self, at: np.ndarray, v: np.ndarray) -> None:
        """One value for each of the pixels ``at``, which do not repeat."""
        v = v.astype(self.kind)
        young = self.n[at] < self.limit
        for held, x in ((self.sum, v), (self.sum2, v * v)):
            held[at] += np.where(young, x, x - held[at] / self.limit)
        self.n[at] += young

    def update_mean(self, at: np.ndarray) -> None:
        n = self.n[at].astype(self.kind)
        self.mean[at] = np.where(n > 0, self.sum[at] / np.maximum(n, 1), 0)

    def push(self, at: np.ndarray, v: np.ndarray) -> None:
        self.push_no_update(at, v)
        self.update_mean(at)

    def push_with_threshold(self, at: np.ndarray, v: np.ndarray, threshold: np.ndarray) -> None:
        v = v.astype(self.kind)
        near = np.abs(v - self.mean[at]) < threshold
        self.push(at[near], v[near])

    def std(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        n = np.maximum(self.n[at], 1).astype(self.kind)
        spread = np.sqrt(np.maximum(self.sum2[at] / n - (self.sum[at] / n) ** 2, 0))
        return np.where(self.n[at] > 0, spread, self.kind(0)).astype(self.kind)

    def rows(self) -> list[np.ndarray]:
        return [self.n, self.sum, self.sum2, self.mean, self.std()]


def steps(slots: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of the first row of every slot, of the second, and so on."""
    order = np.argsort(slots, kind="stable")
    sorted_slots = slots[order]
    starts = np.flatnonzero(np.r_[True, sorted_slots[1:] != sorted_slots[:-1]])
    rank = np.arange(len(slots)) - np.repeat(starts, np.diff(np.r_[starts, len(slots)]))
    by_rank = np.argsort(rank, kind="stable")
    yield from (order[part] for part in np.split(by_rank, np.cumsum(np.bincount(rank))[:-1]))


def fold(df: DataFrame, order: list[str], columns: list[str], start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Fold each pixel's rows in order.

    ``state = start()`` has ``grow(n)``; ``step(state, pixels, *columns)`` takes one row of each of some
    pixels; ``finish(state, row, col)`` gives the columns of the result. Rows with a null are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    shape = to_arrow_schema(kind)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, places = start(), np.zeros((0, 2), dtype=np.int64)
        for block in blocks(batches):
            pixels, slots = np.unique(np.stack([block["row"].to_numpy(), block["col"].to_numpy()], axis=1), axis=0, return_inverse=True)
            known = {tuple(p): k for k, p in enumerate(places.tolist())}
            fresh = np.array([p for p in pixels.tolist() if tuple(p) not in known], dtype=np.int64).reshape(-1, 2)
            known |= {tuple(p): len(places) + k for k, p in enumerate(fresh.tolist())}
            places = np.concatenate([places, fresh])
            state.grow(len(places))
            slots = np.array([known[tuple(p)] for p in pixels.tolist()], dtype=np.int64)[slots.ravel()]
            values = [block[c].to_numpy() for c in columns]
            for at in steps(slots):
                step(state, slots[at], *(v[at] for v in values))
        if len(places):
            found = finish(state, places[:, 0], places[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(a, type=f.type) for a, f in zip(found, shape)], schema=shape)

    given = [F.col("row").cast("long"), F.col("col").cast("long"), *columns]
    ordered = df.repartition("row", "col").sortWithinPartitions(*order)
    return ordered.select(*given).na.drop().mapInArrow(run, kind)


PEDESTAL = "row long, col long, samples long, total double, total2 double, mean double, std double"


def running_pedestal(df: DataFrame, value: str, order: list[str], n_samples: int = 1000) -> DataFrame:
    """Pedestal of every pixel after all its values in order."""
    return fold(df, order, [value], lambda: Pedestals(n_samples), Pedestals.push, lambda p, row, col: [row, col, *p.rows()], PEDESTAL)


def running_pedestal_with_threshold(df: DataFrame, value: str, threshold: str, order: list[str], n_samples: int = 1000) -> DataFrame:
    """The same, but a value counts only if it is nearer to the pixel's mean than the row's threshold."""
    return fold(df, order, [value, threshold], lambda: Pedestals(n_samples), Pedestals.push_with_threshold, lambda p, row, col: [row, col, *p.rows()], PEDESTAL)


def pedestal_no_update(df: DataFrame, value: str) -> DataFrame:
    """The set form below ``n_samples`` values: samples, sums, mean and population deviation by built-in aggregates."""
    v = F.col(value).cast("double")
    sums = df.groupBy("row", "col").agg(F.count("*").alias("samples"), F.sum(v).alias("total"), F.sum(v * v).alias("total2"))
    mean = F.col("total") / F.col("samples")
    return sums.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("total2") / F.col("samples") - mean * mean, F.lit(0.0))))


class Tracking:
    """A pixel of the pedestal-tracking histogram: float32 pedestal, frozen deviation, 16-bit counts."""

    def __init__(self, bins: int, xmin: float, xmax: float, n_sigma: float, n_samples: int):
        self.pedestal = Pedestal(n_samples, np.float32)
        self.sigma = np.float32(0)
        self.counts: dict[int, int] = {}
        self.bins, self.xmin, self.xmax, self.n_sigma = bins, xmin, xmax, n_sigma
        self.seeding = True

    def step(self, is_pedestal: bool, raw: int) -> None:
        if is_pedestal:
            self.pedestal.push_no_update(raw)
            return
        if self.seeding:
            self.pedestal.update_mean()
            self.sigma, self.seeding = self.pedestal.std(), False
        residual = np.float32(raw) - self.pedestal.mean
        if self.xmin <= residual < self.xmax:
            at = min(int((float(residual) - self.xmin) * (self.bins / (self.xmax - self.xmin))), self.bins - 1)
            self.counts[at] = min(self.counts.get(at, 0) + 1, 65_535)
        if self.n_sigma > 0 and self.sigma > 0 and abs(residual) < self.n_sigma * self.sigma:
            self.pedestal.push(raw)


class Trackings:
    """``Tracking`` for many pixels."""

    def __init__(self, bins: int, xmin: float, xmax: float, n_samples: int):
        self.pedestals = Pedestals(n_samples, np.float32)
        self.bins, self.xmin, self.xmax = bins, xmin, xmax
        self.sigma, self.seeding = np.zeros(0, np.float32), np.zeros(0, bool)
        self.counts = np.zeros((0, bins), np.int32)

    def grow(self, n: int) -> None:
        more = n - len(self.sigma)
        self.pedestals.grow(n)
        self.sigma = np.concatenate([self.sigma, np.zeros(more, np.float32)])
        self.seeding = np.concatenate([self.seeding, np.ones(more, bool)])
        self.counts = np.concatenate([self.counts, np.zeros((more, self.bins), np.int32)])

    def step(self, at: np.ndarray, is_pedestal: np.ndarray, raw: np.ndarray, n_sigma: np.ndarray) -> None:
        is_pedestal = is_pedestal.astype(bool)
        self.pedestals.push_no_update(at[is_pedestal], raw[is_pedestal])
        at, raw, n_sigma = at[~is_pedestal], raw[~is_pedestal], n_sigma[~is_pedestal].astype(np.float32)
        new = at[self.seeding[at]]
        self.pedestals.update_mean(new)
        self.sigma[new], self.seeding[new] = self.pedestals.std(new), False
        residual = raw.astype(np.float32) - self.pedestals.mean[at]
        inside = (self.xmin <= residual) & (residual < self.xmax)
        scaled = (residual[inside].astype(np.float64) - self.xmin) * (self.bins / (self.xmax - self.xmin))
        cell = (at[inside], np.minimum(scaled.astype(np.int64), self.bins - 1))
        self.counts[cell] = np.minimum(self.counts[cell] + 1, 65_535)
        sigma = self.sigma[at]
        quiet = (n_sigma > 0) & (sigma > 0) & (np.abs(residual) < n_sigma * sigma)
        self.pedestals.push(at[quiet], raw[quiet])

    def rows(self, row: np.ndarray, col: np.ndarray) -> list[np.ndarray]:
        at, bins = np.nonzero(self.counts)
        return [row[at], col[at], bins, self.counts[at, bins]]


def tracking_histogram(df: DataFrame, raw: str, is_pedestal: str, order: list[str], bins: int, xmin: float, xmax: float, n_sigma: float | Column = 1.0, n_samples: int = 1000) -> DataFrame:
    """Sparse (row, col, bin, count) of residuals; pedestal rows must come first in the order. ``n_sigma`` may change from row to row."""
    live = df.withColumn("_n_sigma", n_sigma if isinstance(n_sigma, Column) else F.lit(float(n_sigma)))
    return fold(live, order, [is_pedestal, raw, "_n_sigma"], lambda: Trackings(bins, xmin, xmax, n_samples), Trackings.step, Trackings.rows, "row long, col long, bin long, count long")
