"""Detector-shaped views of the driver's tables; ``photonspark.plans.oracle`` has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonspark.functions.decode import value
from photonspark.operators.calibration import grid

ROWS = COLS = 16
FRAMES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pixels of 64 frames of 16x16."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((c("l_orderkey") % FRAMES).alias("frame"), (c("l_suppkey") % ROWS).alias("row"), (c("l_partkey") % COLS).alias("col"), (F.floor("l_extendedprice").cast("long") % 65536).alias("raw"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def img(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense frames: the largest value of each pixel, 0 where there is none."""
    most = px(spark, sf_dir).groupBy("frame", "row", "col").agg(F.max(value("raw")).alias("value"))
    cells = grid(spark, ROWS, COLS, gains=FRAMES).withColumnRenamed("gain", "frame")
    return cells.join(most, ["frame", "row", "col"], "left").na.fill(0, ["value"])


def cl(spark: SparkSession, sf_dir: str, n: int = 9) -> DataFrame:
    """Clusters of the first n values of each vector, in thousandths."""
    data = F.transform(F.slice("embedding", 1, n), lambda e: F.floor(e.cast("double") * 1000 + 0.5).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 400).alias("x"), (F.floor(F.col("vec_id") / 400) % 400).alias("y"), data.alias("data"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered stream of pixel values."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("row"), (F.col("event_id") % 8).alias("col"), "value", "ts", "event_id")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One x, y series for each pixel."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("pixel"), F.round(F.col("l_discount") * 100).cast("long").alias("x")).agg(F.sum(F.floor("l_quantity").cast("long")).alias("y"))
