"""Sub-pixel interpolation: cumulative distributions of eta and their lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonspark.functions.clusters import ETA, Shape
from photonspark.functions.search import last_smaller
from photonspark.operators.small import bounded_broadcast

#: Shift of the photon by corner for the 2x2 eta kinds.
SHIFT_X = {0: -1.0, 1: 0.0, 2: -1.0, 3: 0.0}
SHIFT_Y = {0: -1.0, 1: -1.0, 2: 0.0, 3: 0.0}


def _conditional(cube: DataFrame, axis: str, others: list[str], value: str) -> Column:
    """Cumulative share along an axis, the first cell left out of sum and norm."""
    line = Window.partitionBy(*others)
    upto = line.orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    first = F.sum(F.when(F.col(axis) == 0, F.col(value)).otherwise(0)).over(line)
    norm = F.sum(value).over(line) - first
    return (F.sum(value).over(upto) - first).cast("double") / F.when(norm == 0, 1).otherwise(norm)


def cdf(cube: DataFrame) -> DataFrame:
    """(ix, iy, ie, ietax, ietay) of a dense cube: conditional distributions along both axes."""
    return cube.select("ix", "iy", "ie", _conditional(cube, "ix", ["iy", "ie"], "count").alias("ietax"), _conditional(cube, "iy", ["ix", "ie"], "count").alias("ietay"))


def rosenblatt(cube: DataFrame) -> DataFrame:
    """Marginal distribution of eta x, conditional distribution of eta y."""
    line = Window.partitionBy("ie").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    marginal = cube.groupBy("ix", "ie").agg(F.sum(F.when(F.col("ix") == 0, 0).otherwise(F.col("count"))).alias("m"))
    whole = F.sum("m").over(Window.partitionBy("ie"))
    ietax = marginal.select("ix", "ie", (F.sum("m").over(line).cast("double") / F.when(whole == 0, 1).otherwise(whole)).alias("ietax"))
    ietay = cube.select("ix", "iy", "ie", _conditional(cube, "iy", ["ix", "ie"], "count").alias("ietay"))
    return ietay.join(ietax, ["ix", "ie"]).select("ix", "iy", "ie", "ietax", "ietay")


def transform_eta(df: DataFrame, eta: Column, table: DataFrame, xbins: list[float], ybins: list[float], ebins: list[float]) -> DataFrame:
    """Add ``u`` = (ietax, ietay) of the nearest cell; an eta outside the edges is an error."""
    def cell(edges: list[float], v: Column) -> Column:
        at = last_smaller(F.array(*map(F.lit, edges)), v)
        return F.when(at < len(edges) - 1, at.cast("long")).otherwise(F.raise_error(F.lit("eta outside the bins")).cast("long"))

    placed = df.withColumn("_eta", eta).withColumn("ix", cell(xbins, F.col("_eta.x"))).withColumn("iy", cell(ybins, F.col("_eta.y"))).withColumn("ie", cell(ebins, F.col("_eta.sum").cast("double")))
    cells = (len(xbins) - 1) * (len(ybins) - 1) * (len(ebins) - 1)
    return placed.join(bounded_broadcast(table, cells), ["ix", "iy", "ie"]).drop("ix", "iy", "ie")


def interpolate(clusters: DataFrame, shape: Shape, kind: str, table: DataFrame, xbins: list[float], ybins: list[float], ebins: list[float], clamp: bool = False) -> DataFrame:
    """Clusters with photon position and energy: px, py, energy.

    2x2 clusters use the general eta (corner top-left), as the interpolator does.
    """
    found = transform_eta(clusters, ETA[kind](F.col("data"), shape), table, xbins, ybins, ebins)
    if kind in ("eta2", "full_eta2"):
        shift = lambda by: F.coalesce(*(F.when(F.col("_eta.c") == c, F.lit(v)) for c, v in by.items()))
        px, py = F.col("x") + 0.5 + F.col("ietax") + shift(SHIFT_X), F.col("y") + 0.5 + F.col("ietay") + shift(SHIFT_Y)
    else:
        px, py = F.col("x") + F.col("ietax"), F.col("y") + F.col("ietay")
    return found.withColumn("px", px).withColumn("py", py).withColumn("energy", F.col("_eta.sum")).drop("_eta", "ietax", "ietay")


def interpolate_with(clusters: DataFrame, eta: str, table: DataFrame, xbins: list[float], ybins: list[float], ebins: list[float]) -> DataFrame:
    """With eta values that the rows already carry: the position is x + u, without shift."""
    found = transform_eta(clusters, F.col(eta), table, xbins, ybins, ebins)
    return found.withColumn("px", F.col("x") + F.col("ietax")).withColumn("py", F.col("y") + F.col("ietay")).withColumn("energy", F.col("_eta.sum")).drop("_eta", "ietax", "ietay")


def bilinear(u00: Column, u10: Column, u01: Column, u11: Column, fx: Column, fy: Column) -> Column:
    """Weighted mean of four neighbouring cells; an option that the default does not use."""
    low, high = u00 + (u10 - u00) * fx, u01 + (u11 - u01) * fx
    return low + (high - low) * fy
