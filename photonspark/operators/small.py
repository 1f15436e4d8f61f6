"""Broadcast a side only behind a check of its size; beyond the bound the join shuffles both sides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a lookup table (a few numbers each) that every executor can hold.
LOOKUP_ROWS = 4_000_000


def bounded_broadcast(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast a table that is known to have at most ``rows`` rows, if these are few enough.

    Nothing is run to find out. Without a bound the join is left to adaptive execution, which
    knows the real sizes.
    """
    return F.broadcast(df) if rows is not None and rows <= LOOKUP_ROWS else df


def checked_broadcast(df: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """For tables that are cheap to read, such as files: counts up to the bound first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def image_of(pixels: DataFrame, shape: tuple[int, int], *columns: str) -> list[np.ndarray]:
    """Columns of ``pixels(row, col, ...)`` as images on the driver; NaN where there is none. Bounded by the detector."""
    if shape[0] * shape[1] > LOOKUP_ROWS:
        raise ValueError(f"a detector has at most {LOOKUP_ROWS} pixels")
    inside = F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1)
    # one row a pixel, whatever is given
    once = pixels.where(inside).groupBy("row", "col").agg(*(F.max(c).cast("double").alias(c) for c in columns))
    found = once.toArrow()
    at = found.column("row").to_numpy().astype(int), found.column("col").to_numpy().astype(int)
    images = [np.full(shape, np.nan) for _ in columns]
    for image, name in zip(images, columns):
        image[at] = found.column(name).to_numpy()
    return images
