"""Readers with a position, for interactive use: frames of a series and clusters of a file.

What is read comes as a DataFrame. Frames are chosen by a predicate on their index that the source
pushes down, so a read of some frames touches no others. Clusters of a chunk are read from the
position in the file, and a chunk has the size that the caller asks for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonspark.sources import clust, detector
from photonspark.sources.files import packed, resolve, size_of

FRAME = "frame_index"


class FrameFile:
    """Frames of any detector file in order: ``read_frame``, ``read_n``, ``read``, ``seek`` and chunks by iteration."""

    def __init__(self, spark: SparkSession, path: str, chunk_size: int = 1):
        self.frames, self.chunk_size, self.position = detector.detector(spark, path), chunk_size, 0
        held = self.frames.agg((F.max(FRAME) + 1).alias("n")).first()["n"]
        self.total_frames = held or 0

    def __len__(self) -> int:
        return self.total_frames

    def __enter__(self) -> FrameFile:
        return self

    def __exit__(self, *error) -> None:
        self.position = self.total_frames

    def seek(self, index: int) -> None:
        if not 0 <= index < self.total_frames:
            raise IndexError(f"frame {index} of {self.total_frames}")
        self.position = index

    def tell(self) -> int:
        return self.position

    def read_n(self, n: int) -> DataFrame:
        """The next frames, at most ``n``; an error if none is left."""
        if self.position >= self.total_frames:
            raise EOFError("no frame is left")
        first, self.position = self.position, min(self.total_frames, self.position + n)
        return self.frames.where((F.col(FRAME) >= first) & (F.col(FRAME) < self.position))

    def read_frame(self, index: int | None = None) -> DataFrame:
        if index is not None:
            self.seek(index)
        return self.read_n(1)

    def read(self) -> DataFrame:
        """All frames from the first on."""
        self.position = 0
        return self.read_n(self.total_frames)

    def frame_number(self, index: int) -> int:
        return self.frames.where(F.col(FRAME) == index).select("frame_number").first()[0]

    def images(self, index: int) -> dict[int, np.ndarray]:
        """Module -> image of one frame, on the driver."""
        rows = self.frames.where(F.col(FRAME) == index).collect()
        return {r["module"] if "module" in r else 0: np.array(r["data"]).reshape(r["rows"], r["cols"]) for r in rows}

    def __iter__(self) -> Iterator[DataFrame]:
        while self.position < self.total_frames:
            yield self.read_n(self.chunk_size)


class ClusterFile:
    """Clusters of one file in order: ``read_clusters(n)`` goes on inside a frame, ``read_frame`` takes a whole one."""

    def __init__(self, spark: SparkSession, path: str, chunk_size: int = 1000, sx: int = 3, sy: int = 3, dtype: str = "i4"):
        self.spark, self.path, self.chunk_size = spark, path, chunk_size
        self.dtype = clust.cluster_dtype(sx, sy, dtype)
        self.at = self.left = self.frame = 0
        if (size := size_of(path)) is None:
            raise FileNotFoundError(path)
        self.end = size

    def _header(self, source) -> None:
        """Step into the next frame."""
        source.seek(self.at)
        head = source.read(8)
        if len(head) < 8:
            raise OSError(f"{self.path} ends inside a header")
        self.frame, self.left = struct.unpack("<iI", head)
        self.at += 8
        if self.at + self.left * self.dtype.itemsize > self.end:
            raise OSError(f"{self.path} ends inside a frame")

    def _take(self, source, n: int) -> pa.RecordBatch:
        source.seek(self.at)
        rows = np.frombuffer(source.read(n * self.dtype.itemsize), dtype=self.dtype)
        self.at, self.left = self.at + rows.nbytes, self.left - n
        columns = [pa.array(np.full(n, self.frame, np.int32)), pa.array(rows["x"].astype(np.int32)), pa.array(rows["y"].astype(np.int32)), packed(rows["data"].astype(np.float64))]
        return pa.RecordBatch.from_arrays(columns, names=["frame_number", "x", "y", "data"])

    def _frame_of(self, parts: list[pa.RecordBatch]) -> DataFrame:
        schema = pa.schema([("frame_number", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("data", pa.list_(pa.float64()))])
        return self.spark.createDataFrame(pa.Table.from_batches(parts) if parts else schema.empty_table())

    def _read(self, n: int) -> list[pa.RecordBatch]:
        parts, got = [], 0
        with resolve(self.path)[0].open_input_file(resolve(self.path)[1]) as source:
            while got < n and (self.left or self.at < self.end):
                if not self.left:
                    self._header(source)
                some = min(n - got, self.left)
                parts.append(self._take(source, some))
                got += some
        return parts

    def read_clusters(self, n: int) -> DataFrame:
        """The next clusters, at most ``n``, of as many frames as it takes."""
        return self._frame_of(self._read(n))

    def read_frame(self) -> DataFrame:
        """The next frame; an error inside a frame or at the end of the file."""
        if self.left:
            raise ValueError("the position is inside a frame")
        if self.at >= self.end:
            raise EOFError("no frame is left")
        with resolve(self.path)[0].open_input_file(resolve(self.path)[1]) as source:
            self._header(source)
            return self._frame_of([self._take(source, self.left)])

    def __iter__(self) -> Iterator[DataFrame]:
        while parts := [p for p in self._read(self.chunk_size) if p.num_rows]:
            yield self._frame_of(parts)


def clusters(spark: SparkSession, rows: list[tuple[int, int, list]], sx: int = 3, sy: int = 3, kind: str = "int") -> DataFrame:
    """(x, y, data) of given clusters; sizes and types that no cluster has raise an error."""
    if kind not in ("smallint", "int", "float", "double"):
        raise ValueError(f"clusters have no values of type {kind}")
    if sx < 1 or sy < 1 or any(len(data) != sx * sy for _, _, data in rows):
        raise ValueError(f"a cluster has {sx} x {sy} values")
    if any(not (0 <= v < 1 << 16) for x, y, _ in rows for v in (x, y)):
        raise ValueError("coordinates have 16 bits")
    df = spark.createDataFrame([(int(x), int(y), [float(v) for v in data]) for x, y, data in rows], "x int, y int, data array<double>")
    return df.withColumn("data", F.col("data").cast(f"array<{kind}>"))
