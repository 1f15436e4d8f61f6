"""Pixel maps and detector geometry as small dimension tables computed by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonspark.operators.small import checked_broadcast

#: Fixed values of chips: first column of each ADC's strip, ADC wiring of two chip generations.
MOENCH03_COLUMNS = (300, 325, 350, 375, 300, 325, 350, 375, 200, 225, 250, 275, 200, 225, 250, 275, 100, 125, 150, 175, 100, 125, 150, 175, 0, 25, 50, 75, 0, 25, 50, 75)
MOENCH04_ADC = (9, 8, 11, 10, 13, 12, 15, 14, 1, 0, 3, 2, 5, 4, 7, 6, 23, 22, 21, 20, 19, 18, 17, 16, 31, 30, 29, 28, 27, 26, 25, 24)
#: variant -> (channels, ADC of each third of the columns)
MOENCH05 = {"default": (12, (5, 9, 1)), "1g": (3, (1, 2, 0)), "old": (32, (9, 13, 1))}


def _grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("row"), F.expr(f"id % {cols}").alias("col"))


def _pick(values: tuple[int, ...], at: Column) -> Column:
    return F.array(*map(F.lit, values))[at.cast("int")]


def moench05(spark: SparkSession, variant: str = "default") -> DataFrame:
    channels, adc = MOENCH05[variant]
    sample = F.col("row") * 50 + F.col("col") % 50
    return _grid(spark, 160, 150).withColumn("src_index", sample * channels + _pick(adc, F.floor(F.col("col") / 50)))


def _strips(spark: SparkSession, columns: tuple[int, ...], lower: tuple[bool, ...]) -> DataFrame:
    """400x400 read through 32 ADCs with strips of 25 columns; upper halves run towards row 0."""
    adc, sample = F.col("id") % 32, F.expr("id div 32")
    line = F.expr("id div 32 div 25")
    row = F.when(F.array(*map(F.lit, lower))[adc.cast("int")], 200 + line).otherwise(199 - line)
    return spark.range(400 * 400).select(row.alias("row"), (_pick(columns, adc) + sample % 25).alias("col"), F.col("id").alias("src_index"))


def moench03(spark: SparkSession) -> DataFrame:
    return _strips(spark, MOENCH03_COLUMNS, tuple(i // 4 % 2 == 1 for i in range(32)))


def moench04(spark: SparkSession) -> DataFrame:
    return _strips(spark, tuple(a % 16 * 25 for a in MOENCH04_ADC), tuple(i >= 16 for i in range(32)))


def eiger_flip(spark: SparkSession) -> DataFrame:
    return _grid(spark, 256, 512).withColumn("src_index", (255 - F.col("row")) * 512 + F.col("col"))


def matterhorn02(spark: SparkSession, counters: int = 1) -> DataFrame:
    """48x48 pixels read by two transceivers in turns of four samples."""
    half, c = F.expr("col div 24"), F.col("col") % 24
    n = F.col("row") * 24 + c
    base = _grid(spark, 48, 48).withColumn("src_index", n + F.floor(n / 4) * 4 + half * 4)
    planes = base.withColumn("counter", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(counters - 1).cast("long"))))
    return planes.select("counter", "row", "col", (F.col("src_index") + F.col("counter") * 48 * 48).alias("src_index"))


def matterhorn10(spark: SparkSession, dynamic_range: int, counters: int) -> DataFrame:
    """256x256 for each counter; a packet of 64 bits holds neighbours of one group, four packets interleave."""
    if dynamic_range not in (4, 8, 16):
        raise ValueError("the dynamic range is 4, 8 or 16")
    run = 64 // dynamic_range
    row, counter, col = F.col("row") % 256, F.expr("row div 256"), F.col("col")
    read = F.when(row < 128, counter).otherwise(counters - 1 - counter)
    package, group, pixel = F.floor(col / 64), F.floor(col % 64 / run), col % run
    index = package * run + group * 4 * run + pixel + row * 256 * counters + 256 * read
    return _grid(spark, 256 * counters, 256).withColumn("src_index", index)


def gather(pixels: DataFrame, pixel_map: DataFrame, position: str = "pos") -> DataFrame:
    """``out[row, col] = in[src_index]``: the map is broadcast if it has no more rows than a detector has pixels."""
    return pixels.join(checked_broadcast(pixel_map), F.col(position) == F.col("src_index")).drop("src_index")


def module_places(geometry: tuple[int, int], udp: tuple[int, int] = (1, 1), quad: bool = False) -> list[tuple[int, int]]:
    """(row index, column index) of every module in read-out order; geometry and udp are (rows, cols)."""
    order = [(r + pr, c + pc) for c in range(0, geometry[1], udp[1]) for r in range(0, geometry[0], udp[0]) for pr in range(udp[0]) for pc in range(udp[1])]
    return [((r + 1) % 2 if quad else r, c) for r, c in order]


def modules(spark: SparkSession, geometry: tuple[int, int], px: int, py: int, udp: tuple[int, int] = (1, 1), quad: bool = False) -> DataFrame:
    """One row a module in read-out order; geometry and udp are (rows, cols)."""
    places = [(i, r, c) for i, (r, c) in enumerate(module_places(geometry, udp, quad))]
    df = spark.createDataFrame(places, "module long, row_index long, col_index long")
    return df.select("module", (F.col("col_index") * px).alias("origin_x"), (F.col("row_index") * py).alias("origin_y"), F.lit(py).cast("long").alias("height"), F.lit(px).cast("long").alias("width"), "row_index", "col_index")


def clip_to_roi(geometry: DataFrame, xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> DataFrame:
    """Modules that overlap the region, their size clipped and their origin relative to it."""
    c = F.col
    right, low = c("origin_x") + c("width"), c("origin_y") + c("height")
    hit = geometry.where((c("origin_x") < xmax) & (right > xmin) & (c("origin_y") < ymax) & (low > ymin))
    return hit.select(
        *[x for x in geometry.columns if x not in ("origin_x", "origin_y", "width", "height")],
        F.greatest(c("origin_x") - xmin, F.lit(0)).cast("long").alias("origin_x"),
        F.greatest(c("origin_y") - ymin, F.lit(0)).cast("long").alias("origin_y"),
        (F.least(right, xmax) - F.greatest(c("origin_x"), xmin)).cast("long").alias("width"),
        (F.least(low, ymax) - F.greatest(c("origin_y"), ymin)).cast("long").alias("height"),
    )
