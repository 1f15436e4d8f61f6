"""Per-pixel histograms, hit maps and eta cubes: sparse counts, densified on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest count of each integer storage; floating storages do not saturate.
STORAGE = {"u8": 255, "u16": 65_535, "u32": 4_294_967_295, "u64": None, "f": None, "d": None}


def check(bins: int, xmin: float, xmax: float, rows: int = 1, cols: int = 1) -> None:
    if min(bins, rows, cols) < 1:
        raise ValueError("rows, columns and bins are at least 1")
    if not xmax > xmin:
        raise ValueError("xmax must exceed xmin")


def bin_index(v: Column, bins: int, xmin: float, xmax: float) -> Column:
    """Bin of values in [xmin, xmax), null outside (NaN is outside)."""
    inside = (v >= xmin) & (v < xmax)
    at = F.floor((v - F.lit(float(xmin))) * F.lit(bins / (xmax - xmin)))
    return F.when(inside, F.least(at, F.lit(bins - 1)).cast("long"))


def bin_edges(bins: int, xmin: float, xmax: float) -> list[float]:
    return [xmin + i * (xmax - xmin) / bins for i in range(bins + 1)]


def bin_centers(bins: int, xmin: float, xmax: float) -> list[float]:
    edges = bin_edges(bins, xmin, xmax)
    return [(a + b) / 2 for a, b in zip(edges, edges[1:])]


def pixel_histogram(df: DataFrame, v: Column, bins: int, xmin: float, xmax: float, storage: str = "d") -> DataFrame:
    """(row, col, bin, count); integer storage saturates at its largest value."""
    check(bins, xmin, xmax)
    counts = df.select("row", "col", bin_index(v, bins, xmin, xmax).alias("bin")).where("bin IS NOT NULL").groupBy("row", "col", "bin").agg(F.count("*").alias("count"))
    top = STORAGE[storage]
    return counts if top is None else counts.withColumn("count", F.least("count", F.lit(top).cast("long")))


def hitmap(clusters: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cluster centers per pixel; those outside are skipped."""
    inside = F.col("x").between(0, cols - 1) & F.col("y").between(0, rows - 1)
    return clusters.where(inside).groupBy(F.col("y").alias("row"), F.col("x").alias("col")).agg(F.count("*").alias("count"))


def eta_cube(df: DataFrame, eta: Column, energy: Column, bins: tuple[int, int, int], energy_range: tuple[float, float], eta_range: tuple[float, float] = (-0.1, 1.1)) -> DataFrame:
    """(ix, iy, ie, count) of eta x, eta y and energy."""
    rows = df.select(eta.alias("_e"), energy.cast("double").alias("_w"))
    cells = rows.select(bin_index(F.col("_e.x"), bins[0], *eta_range).alias("ix"), bin_index(F.col("_e.y"), bins[1], *eta_range).alias("iy"), bin_index(F.col("_w"), bins[2], *energy_range).alias("ie"))
    return cells.where("ix IS NOT NULL AND iy IS NOT NULL AND ie IS NOT NULL").groupBy("ix", "iy", "ie").agg(F.count("*").alias("count"))


def dense_cube(spark: SparkSession, cube: DataFrame, bins: tuple[int, int, int]) -> DataFrame:
    nx, ny, ne = bins
    cells = spark.range(nx * ny * ne).select(F.expr(f"id div {ny * ne}").alias("ix"), F.expr(f"id div {ne} % {ny}").alias("iy"), F.expr(f"id % {ne}").alias("ie"))
    return cells.join(cube, ["ix", "iy", "ie"], "left").na.fill(0, ["count"])
