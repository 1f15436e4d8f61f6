"""Element-wise arithmetic of array columns with a size check, shapes, and joins by position."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonspark.functions.decode import safe_divide


def elementwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of the elements at each place; arrays of different sizes raise an error, a null array gives null."""
    differ = F.raise_error(F.concat(F.lit("arrays of different sizes: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(differ)


def add(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return elementwise(a, b, safe_divide)


def bit_and(a: Column, mask: int) -> Column:
    return F.transform(a, lambda x: x.bitwiseAND(F.lit(mask)))


def num_elements(shape: tuple[int, ...]) -> int:
    return math.prod(shape)


def drop_first_dim(shape: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(shape[1:])


def sub_view(data: Column, shape: tuple[int, ...], at: int) -> Column:
    """The part of a row-major array at index ``at`` of its first dimension."""
    if not 0 <= at < shape[0]:
        raise IndexError(f"{at} is outside a first dimension of {shape[0]}")
    n = num_elements(drop_first_dim(shape))
    return F.slice(data, at * n + 1, n)


def by_position(rows: DataFrame, others: DataFrame, position: str = "position") -> DataFrame:
    """Rows with the columns of ``others`` at the same position; both sides must have the same positions."""
    left, right = rows.agg(F.count("*"), F.count_distinct(position)).first(), others.agg(F.count("*"), F.count_distinct(position)).first()
    joined = rows.join(others, position)
    if len({*left, *right}) > 1 or joined.count() != left[0]:
        raise ValueError(f"the positions differ: {left[0]} and {right[0]} rows")
    return joined


def where_mask(rows: DataFrame, mask: list[bool], position: str = "position") -> DataFrame:
    """Rows at positions 0, 1, ... at which the mask is true; the mask must be as long as the table."""
    flags = rows.sparkSession.createDataFrame([(i, bool(m)) for i, m in enumerate(mask)], f"{position} long, _keep boolean")
    return by_position(rows, flags, position).where("_keep").drop("_keep")
