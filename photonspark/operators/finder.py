"""Photon cluster finding on packed frames ``(frame, data)``.

``frozen_clusters`` is the set form: the pedestal does not change, so frames are independent and each
is one pass of array operations over shifted windows, without a shuffle. ``Finder`` is the exact
sequential form that updates the pedestal while it scans; ``exact_clusters`` runs one finder for each
shard (frame number modulo shards), as independent finders on a thread pool would.
``variable_clusters`` labels connected pixels above a threshold, frame by frame.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonspark.operators.small import image_of

MAX_HIT_PIXELS = 50
CLUSTERS = "frame long, x int, y int, data array<long>"


def half_up(v: np.ndarray) -> np.ndarray:
    return (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)


def photons(image: np.ndarray, mean: np.ndarray, rms: np.ndarray, n_sigma: float, sx: int, sy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and windows of the pixels that hold their window's maximum in a window that passes."""
    hx, hy = sx // 2, sy // 2
    known = ~np.isnan(mean)
    micro = np.floor((image - np.where(known, mean, 0)) * 1_000_000 + 0.5).astype(np.int64)
    wide = np.pad(np.where(known, micro, 0), ((hy, hy), (hx, hx)))
    rows, cols = image.shape
    shifted = [wide[hy + dy : hy + dy + rows, hx + dx : hx + dx + cols] for dy in range(-hy, hy + sy % 2) for dx in range(-hx, hx + sx % 2)]
    most, total = np.zeros((rows, cols), dtype=np.int64), np.zeros((rows, cols), dtype=np.int64)
    for part in shifted:
        np.maximum(most, part, out=most)
        total += part
    limit = rms * (n_sigma * 1_000_000)
    hit = known & (micro >= -limit) & (micro == most) & ((most > limit) | (total > math.sqrt(sx * sy) * limit))
    r, c = np.nonzero(hit)
    return r, c, half_up(np.stack([part[r, c] for part in shifted], axis=1) / 1_000_000)


def frozen_clusters(frames: DataFrame, pedestal: DataFrame, shape: tuple[int, int], n_sigma: float = 5.0, sx: int = 3, sy: int = 3) -> DataFrame:
    """(frame, x, y, data): pixels that hold their window's maximum in a window that passes.

    ``frames(frame, data)`` packed, ``pedestal(row, col, mean, std)``. Residuals are whole micro-units,
    so sums do not depend on their order. Pixels outside the image, or without a pedestal, count as 0
    in the windows of others.
    """
    sent = frames.sparkSession.sparkContext.broadcast(image_of(pedestal, shape, "mean", "std"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, rms = sent.value
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                image = data.values.to_numpy(zero_copy_only=False).astype(float).reshape(shape)
                r, c, windows = photons(image, mean, rms, n_sigma, sx, sy)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * (sx * sy)), pa.array(windows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), number, dtype=np.int64)), pa.array(c.astype(np.int32)), pa.array(r.astype(np.int32)), lists], names=["frame", "x", "y", "data"])

    return frames.select(F.col("frame").cast("long"), "data").mapInArrow(run, CLUSTERS)


class Finder:
    """Sequential finder of fixed-size clusters in whole images; it owns a pedestal."""

    def __init__(self, shape: tuple[int, int], n_sigma: float = 5.0, n_samples: int = 1000, sx: int = 3, sy: int = 3):
        if sx < 3 or sy < 3:
            raise ValueError(f"a finder's clusters have 3 x 3 pixels at least, not {sx} x {sy}")
        self.n_sigma, self.sx, self.sy, self.limit = n_sigma, sx, sy, n_samples
        self.c3 = math.sqrt(sx * sy)
        self.sum, self.sum2, self.mean = (np.zeros(shape) for _ in range(3))
        self.n = np.zeros(shape, dtype=np.int64)

    def push_pedestal_frame(self, image: np.ndarray) -> None:
        image = image.astype(float)
        young = self.n < self.limit
        self.sum = np.where(young, self.sum + image, self.sum + image - self.sum / self.limit)
        self.sum2 = np.where(young, self.sum2 + image**2, self.sum2 + image**2 - self.sum2 / self.limit)
        self.n = self.n + young
        self.mean = self.sum / self.n

    def _push_fast(self, at: tuple[int, int], v: float) -> None:
        self.sum[at] += v - self.sum[at] / self.limit
        self.sum2[at] += v * v - self.sum2[at] / self.limit
        self.mean[at] = self.sum[at] / self.limit

    def noise(self) -> np.ndarray:
        n = np.maximum(self.n, 1)
        return np.sqrt(np.maximum(self.sum2 / n - (self.sum / n) ** 2, 0)) * (self.n > 0)

    def clear_pedestal(self) -> None:
        for a in (self.sum, self.sum2, self.mean, self.n):
            a[...] = 0

    def find(self, image: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(x, y, data) in scan order; pixels without a photon go into the pedestal."""
        rows, cols = image.shape
        image, hx, hy, out = image.astype(float), self.sx // 2, self.sy // 2, []
        for r in range(rows):
            top, low = max(0, r - hy), min(rows, r + hy + self.sy % 2)
            for c in range(cols):
                n = self.n[r, c]
                rms = math.sqrt(max(0.0, self.sum2[r, c] / n - (self.sum[r, c] / n) ** 2)) if n else 0.0
                v, limit = image[r, c] - self.mean[r, c], self.n_sigma * rms
                if v < -limit:
                    continue
                left, right = max(0, c - hx), min(cols, c + hx + self.sx % 2)
                near = image[top:low, left:right] - self.mean[top:low, left:right]
                most, total = max(near.max(), 0.0), near.sum()
                if most > limit:
                    if v < most:
                        continue
                elif total <= self.c3 * limit:
                    self._push_fast((r, c), image[r, c])
                    continue
                if v == most:
                    data = np.zeros((self.sy, self.sx), dtype=np.int64)
                    data[top - (r - hy) : low - (r - hy), left - (c - hx) : right - (c - hx)] = np.sign(near) * np.floor(np.abs(near) + 0.5)
                    out.append((c, r, data.ravel().tolist()))
        return out


def exact_clusters(frames: DataFrame, shape: tuple[int, int], n_pedestal: int, n_shards: int = 3, n_sigma: float = 5.0, n_samples: int = 1000, sx: int = 3, sy: int = 3) -> DataFrame:
    """Clusters of packed frames ``(frame, data)``; frames below ``n_pedestal`` seed every shard's pedestal.

    Shard = frame % n_shards. Inside a partition the frames are sorted by shard and number, and
    a shard's finder is carried over the batches.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, finder = None, None
        for batch in batches:
            rows = []
            for own, number, data in zip(batch["shard"], batch["frame"], batch["data"]):
                if own != shard:
                    shard, finder = own, Finder(shape, n_sigma, n_samples, sx, sy)
                image = np.asarray(data).reshape(shape)
                if number < n_pedestal:
                    finder.push_pedestal_frame(image)
                else:
                    rows += [(number, x, y, d) for x, y, d in finder.find(image)]
            yield pd.DataFrame(rows, columns=["frame", "x", "y", "data"])

    every = F.explode(F.when(F.col("frame") < n_pedestal, F.sequence(F.lit(0), F.lit(n_shards - 1))).otherwise(F.array((F.col("frame") % n_shards).cast("int"))))
    sharded = frames.select("frame", "data", every.alias("shard")).repartition("shard").sortWithinPartitions("shard", "frame")
    return sharded.mapInPandas(run, "frame long, x int, y int, data array<long>")


NEIGHBOURS = {4: ((-1, 0), (0, -1), (0, 1), (1, 0)), 8: tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)}


def label_components(mask: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of 8-connected pixels in raster order of their first pixel; 0 elsewhere."""
    labels = np.zeros(mask.shape, dtype=np.int32)
    count = 0
    for start in zip(*np.nonzero(mask)):
        if labels[start]:
            continue
        count += 1
        labels[start], stack = count, [start]
        while stack:
            r, c = stack.pop()
            for dr, dc in NEIGHBOURS[8]:
                at = (r + dr, c + dc)
                if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and mask[at] and not labels[at]:
                    labels[at] = count
                    stack.append(at)
    return labels


def labelled(frames: DataFrame, shape: tuple[int, int], threshold: float) -> DataFrame:
    """(frame, data): the label image of each packed frame, 0 where no component is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"frame": batch["frame"], "data": [label_components(np.asarray(d).reshape(shape) > threshold).ravel() for d in batch["data"]]})

    return frames.select("frame", "data").mapInPandas(run, "frame long, data array<int>")


def hits_of(image: np.ndarray, threshold: float) -> list[dict]:
    """Hits of connected pixels above the threshold; size, energy and maximum stop at ``MAX_HIT_PIXELS`` pixels in raster order; ``pixels`` counts all."""
    labels = label_components(image > threshold).ravel()
    hot = np.flatnonzero(labels)
    order = hot[np.argsort(labels[hot], kind="stable")]  # by label, each in raster order
    out = []
    for every in np.split(order, np.cumsum(np.bincount(labels[hot])[1:])[:-1]) if len(hot) else ():
        rows, cols = np.unravel_index(every[:MAX_HIT_PIXELS], image.shape)
        values = image[rows, cols]
        top = int(values.argmax())
        out.append({"pixels": len(every), "size": len(rows), "row": int(rows[top]), "col": int(cols[top]), "energy": float(values.sum()), "max": float(values[top]), "rows": rows.tolist(), "cols": cols.tolist(), "enes": values.astype(float).tolist()})
    return out


def flood_hits(image: np.ndarray, threshold: float | None = None, noise: np.ndarray | None = None, factor: float = 5.0, neighbours: int = 4) -> list[dict]:
    """Flood fill from seeds in raster order; taken pixels become 0. With a noise map seeds exceed 5 and
    neighbours ``factor`` times their noise. Size and energy count every pixel; the lists stop at ``MAX_HIT_PIXELS``."""
    left, out = image.astype(float), []
    above = (lambda at, k: left[at] > k * noise[at]) if noise is not None else (lambda at, k: left[at] > threshold)
    for start in np.ndindex(*left.shape):
        if not above(start, 5.0):
            continue
        hit = {"size": 0, "row": -1, "col": -1, "energy": 0.0, "max": 0.0, "rows": [], "cols": [], "enes": []}
        stack = [start]
        while stack:
            at = stack.pop()
            v = left[at]
            if at != start and not above(at, factor) or v == 0:
                continue
            if hit["size"] < MAX_HIT_PIXELS:
                for name, x in zip(("rows", "cols", "enes"), (int(at[0]), int(at[1]), float(v))):
                    hit[name].append(x)
            hit["size"] += 1
            hit["energy"] += float(v)
            if hit["max"] < v:
                hit |= {"row": int(at[0]), "col": int(at[1]), "max": float(v)}
            left[at] = 0
            for dr, dc in reversed(NEIGHBOURS[neighbours]):
                near = (at[0] + dr, at[1] + dc)
                if 0 <= near[0] < left.shape[0] and 0 <= near[1] < left.shape[1] and above(near, factor):
                    stack.append(near)
        out.append(hit)
    return out


HIT = "frame long, size int, row int, col int, energy double, max double, rows array<int>, cols array<int>, enes array<double>, pixels int"


def variable_clusters(frames: DataFrame, shape: tuple[int, int], threshold: float, flood: bool = False, neighbours: int = 8) -> DataFrame:
    """Hits of packed frames ``(frame, data)``; frames are independent, so there is no shuffle."""
    names = [x.split()[0] for x in HIT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for number, data in zip(batch["frame"], batch["data"]):
                image = np.asarray(data).reshape(shape)
                found = flood_hits(image, threshold, neighbours=neighbours) if flood else hits_of(image, threshold)
                rows += [{"frame": number, "pixels": h["size"]} | h for h in found]
            yield pd.DataFrame(rows, columns=names)

    return frames.select("frame", "data").mapInPandas(run, HIT)


def pack(pixels: DataFrame, rows: int, cols: int, value: str = "value") -> DataFrame:
    """Long pixels to packed frames ``(frame, data)``; a frame has rows * cols values.

    Missing pixels are 0, those outside the image are left out, and of repeated ones the largest stays.
    """
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    kind = "double" if dict(pixels.dtypes)[value] in ("double", "float") else "long"
    place = (F.col("row") * cols + F.col("col")).cast("int")
    cells = pixels.where(inside).groupBy("frame").agg(F.collect_list(F.struct(place.alias("k"), F.col(value).cast(kind).alias("v"))).alias("m"))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at, stops = lists.values, lists.offsets.to_numpy()
            out = np.zeros((batch.num_rows, rows * cols), dtype=np.float64 if kind == "double" else np.int64)
            frame = np.repeat(np.arange(batch.num_rows), np.diff(stops))
            k, v = (at.field(c).to_numpy(zero_copy_only=False)[stops[0] : stops[-1]] for c in ("k", "v"))
            known = ~np.isnan(v.astype(float))
            frame, k, v = frame[known], k[known].astype(np.int64), v[known]
            order = np.lexsort((v, k))  # the largest last
            out[frame[order], k[order]] = v[order]
            data = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (rows * cols)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["frame", "data"])

    number = dict(pixels.dtypes)["frame"]
    return cells.mapInArrow(scatter, f"frame {number}, data array<{kind}>")


def unpack(frames: DataFrame, cols: int, value: str = "value") -> DataFrame:
    at = F.col("pos").cast("long")
    return frames.select("frame", F.posexplode("data").alias("pos", value)).select("frame", F.floor(at / cols).alias("row"), (at % cols).alias("col"), value)
