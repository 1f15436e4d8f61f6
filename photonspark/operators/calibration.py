"""Pedestals by gain and calibration.

Frames are long rows ``(frame, row, col, raw)``. A pedestal or calibration table has one row for each
gain and pixel of the detector, so its size depends on the detector and not on the data; it is
broadcast after its size has been checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonspark.functions.decode import gain, value
from photonspark.operators.small import LOOKUP_ROWS, bounded_broadcast

PIXEL = ["row", "col"]


def grid(spark: SparkSession, rows: int, cols: int, gains: int | None = None) -> DataFrame:
    """All (gain,) row, col of a detector."""
    n = rows * cols * (gains or 1)
    out = spark.range(n).select(F.expr(f"id div {rows * cols}").alias("gain"), F.expr(f"id div {cols} % {rows}").alias("row"), F.expr(f"id % {cols}").alias("col"))
    return out if gains else out.drop("gain")


def pedestal(frames: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean value per (gain, row, col); with a shape all three gains of every pixel, 0 without samples."""
    found = frames.select(gain("raw").cast("long").alias("gain"), "row", "col", value("raw").cast("long").alias("v")).groupBy("gain", *PIXEL).agg(F.sum("v").alias("total"), F.count("*").alias("samples"))
    if shape is not None:
        found = grid(frames.sparkSession, *shape, gains=3).join(found, ["gain", *PIXEL], "left").na.fill(0)
    mean = F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("samples")), F.lit(0.0))
    return found.select("gain", *PIXEL, mean.alias("mean"), "samples")


def pedestal_g0(frames: DataFrame) -> DataFrame:
    return pedestal(frames.where(gain("raw") == 0)).drop("gain")


def switching_pixels(frames: DataFrame) -> DataFrame:
    """How often a pixel had a gain other than 0."""
    return frames.groupBy(*PIXEL).agg(F.count_if(gain("raw") != 0).alias("switches"))


def _lookup(pedestals: DataFrame, calibration: DataFrame, keys: list[str]) -> DataFrame:
    """Pedestal and calibration by key. The calibration has one row a key, so the join has no more rows
    than it; only the calibration, a file of the detector's size, is counted for the broadcast."""
    few = calibration.limit(LOOKUP_ROWS + 1).count()
    both = pedestals.select(*keys, F.col("mean").alias("_p")).join(calibration.select(*keys, F.col("cal").alias("_c")), keys)
    return bounded_broadcast(both, few)


def apply_calibration(frames: DataFrame, pedestals: DataFrame, calibration: DataFrame) -> DataFrame:
    """(value - pedestal[gain, row, col]) / calibration[gain, row, col]."""
    table = _lookup(pedestals, calibration, ["gain", *PIXEL])
    rows = frames.withColumn("gain", gain("raw").cast("long"))
    return rows.join(table, ["gain", *PIXEL]).withColumn("energy", (value("raw") - F.col("_p")) / F.col("_c")).drop("_p", "_c")


def apply_calibration_g0(frames: DataFrame, pedestals: DataFrame, calibration: DataFrame) -> DataFrame:
    """Gain 0 only; other gains become 0."""
    table = _lookup(pedestals, calibration, PIXEL)
    energy = F.when(gain("raw") != 0, F.lit(0.0)).otherwise((value("raw") - F.col("_p")) / F.col("_c"))
    return frames.join(table, PIXEL).withColumn("energy", energy).drop("_p", "_c")
