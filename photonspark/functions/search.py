"""Index searches in sorted arrays and small array helpers, as Column expressions with 0-based results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_smaller(edges: Column, v: Column) -> Column:
    """Index of the last element before the first (from index 1 on) that is >= v; the last index if none is."""
    return F.greatest(F.size(F.filter(edges, lambda e: e < v)) - 1, F.lit(0))


def first_larger(edges: Column, v: Column) -> Column:
    """Index of the first element > v, else the last index."""
    return F.least(F.size(F.filter(edges, lambda e: e <= v)), F.size(edges) - 1)


def nearest_index(values: Column, v: Column) -> Column:
    """First index of the least distance to v."""
    apart = F.transform(values, lambda e: F.abs(e - v))
    return (F.array_position(apart, F.array_min(apart)) - 1).cast("int")


def linear_interpolation(x0: Column, y0: Column, x1: Column, y1: Column, x: Column) -> Column:
    return y0 + (x - x0) * (y1 - y0) / (x1 - x0)


def all_equal(values: Column) -> Column:
    """False for an empty array."""
    return F.coalesce(F.array_min(values) == F.array_max(values), F.lit(False)) & (F.size(values) > 0)


def cumsum(df: DataFrame, value: str, order: list[str], by: list[str], name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def flat_list(nested: Column) -> Column:
    return F.flatten(nested)


def split_task(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """n contiguous ranges of [first, last); the last takes the remainder, and n >= items gives single items."""
    items = last - first
    if n >= items:
        return [(i, i + 1) for i in range(first, last)]
    step = items // n
    cuts = [first + i * step for i in range(n)] + [last]
    return list(zip(cuts, cuts[1:]))
