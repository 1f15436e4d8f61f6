"""Photon clusters: sums, reductions and charge-sharing (eta) values as Column expressions.

``data`` is a row-major array of ``sx * sy`` values; the center is ``sx // 2, sy // 2``. Corners are
0 top-left, 1 top-right, 2 bottom-left, 3 bottom-right. Sums are widened, so they do not wrap.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonspark.functions.decode import safe_divide
from photonspark.operators.small import bounded_broadcast, image_of

TL, TR, BL, BR = range(4)


@dataclass(frozen=True)
class Shape:
    sx: int
    sy: int

    @property
    def center(self) -> int:
        return self.sx // 2 + (self.sy // 2) * self.sx

    def blocks(self) -> dict[int, tuple[int, int, int, int]]:
        """Indices of the 2x2 blocks that touch the center and lie inside, by corner."""
        cx, cy, c, s = self.sx // 2, self.sy // 2, self.center, self.sx
        across = {0: (-1, cx >= 1), 1: (0, cx + 1 < self.sx)}
        down = {0: (-s, cy >= 1), 1: (0, cy + 1 < self.sy)}
        return {2 * b + a: (c + dx + dy, c + dx + dy + 1, c + dx + dy + s, c + dx + dy + s + 1) for b, (dy, ok_y) in down.items() for a, (dx, ok_x) in across.items() if ok_x and ok_y}


def total(data: Column) -> Column:
    return F.aggregate(data, F.lit(0).cast("double"), lambda a, x: a + x)


def total_long(data: Column) -> Column:
    return F.aggregate(data, F.lit(0).cast("long"), lambda a, x: a + x)


def block_sums(data: Column, shape: Shape) -> dict[int, Column]:
    return {corner: data[i] + data[j] + data[k] + data[m] for corner, (i, j, k, m) in shape.blocks().items()}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: without this, every use would copy its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def max_sum_2x2(data: Column, shape: Shape) -> Column:
    """struct(sum, index): the largest block, the first in corner order on ties."""
    sums = block_sums(data, shape)
    codes = F.array(*map(F.lit, sums))
    return let(F.array(*sums.values()), lambda s: F.struct(F.array_max(s).alias("sum"), F.element_at(codes, F.array_position(s, F.array_max(s)).cast("int")).alias("index")))


def _by_corner(corner: Column, values: dict[int, Column]) -> Column:
    return F.coalesce(*(F.when(corner == c, v) for c, v in values.items()))


def reduce_to_2x2(data: Column, shape: Shape) -> Column:
    corner = max_sum_2x2(data, shape)["index"]
    return _by_corner(corner, {c: F.array(*(data[i] for i in at)) for c, at in shape.blocks().items()})


def reduce_to_3x3(data: Column, shape: Shape) -> Column:
    """The central 3x3."""
    c, s = shape.center, shape.sx
    return F.array(*(data[c + dy * s + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)))


def _eta(x: Column, y: Column, corner: Column, energy: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), corner.cast("int").alias("c"), energy.alias("sum"))


def _first_max(data: Column) -> Column:
    return F.array_position(data, F.array_max(data)).cast("int") - 1


def eta2(data: Column, shape: Shape) -> Column:
    """Ratios along the winning block's row and column through the center."""
    c, s, here, have = shape.center, shape.sx, data[shape.center], shape.blocks()
    left, right = (lambda: safe_divide(here, data[c - 1] + here)), (lambda: safe_divide(data[c + 1], here + data[c + 1]))
    up, low = (lambda: safe_divide(here, data[c - s] + here)), (lambda: safe_divide(data[c + s], here + data[c + s]))

    def body(best: Column) -> Column:
        corner = best["index"]
        x = _by_corner(corner, {k: (left() if k in (TL, BL) else right()) for k in have})
        y = _by_corner(corner, {k: (up() if k in (TL, TR) else low()) for k in have})
        return _eta(x, y, corner, best["sum"])

    return let(max_sum_2x2(data, shape), body)


def eta2_2x2(data: Column) -> Column:
    """The 2x2 form: the corner is opposite to the largest pixel."""
    corner = F.lit(3) - _first_max(data)
    d = [data[i] for i in range(4)]
    upper, lower = safe_divide(d[1], d[0] + d[1]), safe_divide(d[3], d[2] + d[3])
    left, right = safe_divide(d[2], d[0] + d[2]), safe_divide(d[3], d[1] + d[3])
    x = _by_corner(corner, {TL: lower, TR: lower, BL: upper, BR: upper})
    y = _by_corner(corner, {TL: right, TR: left, BL: right, BR: left})
    return _eta(x, y, corner, d[0] + d[1] + d[2] + d[3])


def full_eta2(data: Column, shape: Shape) -> Column:
    """Right column and lower row of the winning block over its sum."""
    have = shape.blocks()

    def body(best: Column) -> Column:
        corner = best["index"]
        x = _by_corner(corner, {k: safe_divide(data[at[1]] + data[at[3]], best["sum"]) for k, at in have.items()})
        y = _by_corner(corner, {k: safe_divide(data[at[2]] + data[at[3]], best["sum"]) for k, at in have.items()})
        return _eta(x, y, corner, best["sum"])

    return let(max_sum_2x2(data, shape), body)


def full_eta2_2x2(data: Column) -> Column:
    s = data[0] + data[1] + data[2] + data[3]
    return _eta(safe_divide(data[1] + data[3], s), safe_divide(data[2] + data[3], s), F.lit(3) - _first_max(data), s)


def eta3(data: Column, shape: Shape = Shape(3, 3)) -> Column:
    """Right minus left column and bottom minus top row over the total; larger clusters by their central 3x3."""
    d = data if shape == Shape(3, 3) else reduce_to_3x3(data, shape)
    s = sum((d[i] for i in range(1, 9)), d[0])
    x, y = d[2] + d[5] + d[8] - d[0] - d[3] - d[6], d[6] + d[7] + d[8] - d[0] - d[1] - d[2]
    return _eta(safe_divide(x, s), safe_divide(y, s), F.lit(TL), s)


def cross_eta3(data: Column, shape: Shape = Shape(3, 3)) -> Column:
    d = data if shape == Shape(3, 3) else reduce_to_3x3(data, shape)
    s = sum((d[i] for i in range(1, 9)), d[0])
    return _eta(safe_divide(d[5] - d[3], d[3] + d[4] + d[5]), safe_divide(d[7] - d[1], d[1] + d[4] + d[7]), F.lit(TL), s)


def eta_line(data: Column, horizontal: bool) -> Column:
    """1x2 and 2x1 clusters: the ratio of the second to the first value along the axis."""
    ratio = safe_divide(data[1], data[0])
    zero = F.lit(0.0)
    return _eta(ratio if horizontal else zero, zero if horizontal else ratio, F.lit(TL), data[0] + data[1])


#: Name -> eta function of (data, shape): the registry that interpolation looks up.
ETA = {"eta2": eta2, "full_eta2": full_eta2, "eta3": eta3, "cross_eta3": cross_eta3}


def in_roi(x: Column, y: Column, roi: tuple[int, int, int, int]) -> Column:
    xmin, xmax, ymin, ymax = roi
    return (x >= xmin) & (x < xmax) & (y >= ymin) & (y < ymax)


def noise_cut(clusters: DataFrame, noise: DataFrame, shape: Shape, n_pixels: int | None = None) -> DataFrame:
    """Clusters whose center, best 2x2 block and total exceed one, two and three times the noise at (y, x).

    A cluster where the map has no value has no limit to exceed and is left out. ``n_pixels``: the most rows the map can have.
    """
    data = F.col("data")
    lookup = noise.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("noise").alias("_n"))
    joined = clusters.join(bounded_broadcast(lookup, n_pixels), (F.col("y") == F.col("_row")) & (F.col("x") == F.col("_col")))
    n = F.col("_n")
    return joined.where((data[shape.center] > n) & (max_sum_2x2(data, shape)["sum"] > 2 * n) & (total(data) > 3 * n)).select(*clusters.columns)


def gain_map(clusters: DataFrame, gains: DataFrame, shape: Shape, rows: int, cols: int, kind: str = "bigint") -> DataFrame:
    """Multiply each pixel by the inverse gain at its place and cast (integers truncate); clusters that touch the border become zeros.

    The map, at most rows * cols values, becomes one array, so a cluster is one projection and no row is shuffled;
    all columns of ``clusters`` stay. A pixel without a gain becomes 0.
    """
    hx, hy = shape.sx // 2, shape.sy // 2
    (inverse,) = image_of(gains.select("row", "col", (F.lit(1.0) / F.col("gain")).alias("inverse")), (rows, cols), "inverse")
    held = pa.table({"inverse": pa.array([pa.array(inverse.ravel(), from_pandas=True)], pa.list_(pa.float64()))})
    inverse = gains.sparkSession.createDataFrame(held).scalar()
    border = (F.col("x") < hx) | (F.col("y") < hy) | (F.col("x") >= cols - hx) | (F.col("y") >= rows - hy)
    at = lambda i: ((F.col("y") + (i // shape.sx - hy)) * cols + F.col("x") + (i % shape.sx - hx)).cast("int")
    scaled = [F.coalesce((F.col("data")[i] * F.get(inverse, at(i))).cast(kind), F.lit(0).cast(kind)) for i in range(shape.sx * shape.sy)]
    zeros = [F.lit(0).cast(kind)] * (shape.sx * shape.sy)
    return clusters.withColumn("data", F.when(border, F.array(*zeros)).otherwise(F.array(*scaled)))
