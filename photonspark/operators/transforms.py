"""Decoders of chip-test-board bytes: pixel maps over the 16-bit words of a frame, and own transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonspark.operators import geometry

#: Name -> pixel map of chips whose frames are 16-bit words.
WORD_MAPS: dict[str, Callable[[SparkSession], DataFrame]] = {
    "moench03": geometry.moench03,
    "moench04_analog": geometry.moench04,
    "moench05": geometry.moench05,
    "moench05_1g": lambda spark: geometry.moench05(spark, "1g"),
    "moench05_old": lambda spark: geometry.moench05(spark, "old"),
    "matterhorn02": lambda spark: geometry.matterhorn02(spark, 4),
}


def map_array(pixel_map: DataFrame) -> np.ndarray:
    """Source index of every pixel in row-major order; a map has the detector's pixels, so it fits the driver."""
    order = [c for c in ("counter", "row", "col") if c in pixel_map.columns]
    return pixel_map.orderBy(*order).toPandas()["src_index"].to_numpy()


def transform(frames: DataFrame, f: Callable[[bytes], np.ndarray]) -> DataFrame:
    """``frame_index, data`` with ``data = f(bytes)``: the hook for own decoders, batch by batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"frame_index": batch["frame_index"], "data": [np.asarray(f(b)).ravel().astype(np.int64) for b in batch["bytes"]]})

    return frames.select("frame_index", "bytes").mapInPandas(run, "frame_index long, data array<long>")


def words(frames: DataFrame, chip: str, mask: int = 0xFFFF) -> DataFrame:
    at = map_array(WORD_MAPS[chip](frames.sparkSession))
    return transform(frames, lambda b: np.frombuffer(b, "<u2")[at] & mask)


def adc_sar(frames: DataFrame, bits: tuple[int, ...]) -> DataFrame:
    """ADC values of frames of 64-bit words: bit i of a value is bit ``bits[i]`` of its word (``functions.decode`` has the orders)."""

    def decode(raw: bytes) -> np.ndarray:
        if len(raw) % 8:
            raise ValueError(f"a frame of {len(raw)} bytes has no whole 64-bit words")
        word = np.frombuffer(raw, "<u8")
        return sum(((word >> np.uint64(b)) & np.uint64(1)) << np.uint64(i) for i, b in enumerate(bits))

    return transform(frames, decode)


def matterhorn10(frames: DataFrame, dynamic_range: int = 16, counters: int = 1) -> DataFrame:
    """(counters, 256, 256) values of 16, 8 or 4 bits."""
    at = map_array(geometry.matterhorn10(frames.sparkSession, dynamic_range, counters))
    size = 256 * 256 * counters * dynamic_range // 8

    def decode(b: bytes) -> np.ndarray:
        if len(b) != size:
            raise ValueError(f"a frame has {len(b)} bytes, not {size}")
        raw = np.frombuffer(b, "<u2" if dynamic_range == 16 else "u1")
        if dynamic_range == 4:
            raw = np.stack([raw & 15, raw >> 4], axis=1).ravel()
        return raw[at]

    return transform(frames, decode)


def mythen302(frames: DataFrame, offset: int = 4) -> DataFrame:
    """(frame_index, half, channel, counter, value) on SQL functions only."""
    from photonspark.functions.decode import decode_my302

    flat = frames.select("frame_index", F.posexplode(decode_my302("bytes", offset)).alias("pos", "value"))
    pos = F.col("pos")
    return flat.select("frame_index", F.floor(pos / 192).cast("int").alias("half"), (F.floor(pos / 3) % 64).cast("int").alias("channel"), (pos % 3).alias("counter"), "value")


def random_pixels(spark: SparkSession, n: int, xmin: int, xmax: int, ymin: int, ymax: int, seed: int | None = None) -> DataFrame:
    """n random (row, col) inside [ymin, ymax) x [xmin, xmax)."""
    pick = lambda low, high, s: (F.floor(F.rand(s) * (high - low)) + low).cast("long")
    return spark.range(n).select(pick(ymin, ymax, seed).alias("row"), pick(xmin, xmax, None if seed is None else seed + 1).alias("col"))
