"""Cluster files as a data source: repeat {int32 frame, uint32 n, n aligned cluster structs}.

Options: ``sx``, ``sy`` (default 3), ``dtype`` (default ``i4``), ``paths`` as the load path. A file is a
partition, and its task walks the headers; only files of over ``SPLIT_BYTES`` are walked at planning,
to be cut between frames. Frames that predicates on ``frame_number`` rule out are skipped by their
length; regions on x and y are applied by Spark.
The writer makes one file a partition in frame order; frames of one file are whole.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from photonspark.sources.files import Bounds, packed, resolve

SPLIT_BYTES = 256 << 20


def cluster_dtype(sx: int, sy: int, kind: str) -> np.dtype:
    """Two uint16 coordinates and the values, with the padding of a C struct."""
    return np.dtype([("x", "<u2"), ("y", "<u2"), ("data", np.dtype(kind).newbyteorder("<"), (sx * sy,))], align=True)


@dataclass
class Part(InputPartition):
    """Whole frames between two bytes of a file."""

    path: str
    start: int
    end: int


class ClusterReader(DataSourceReader):
    def __init__(self, path: str, dtype: np.dtype):
        self.path, self.dtype, self.bounds = path, dtype, Bounds("frame_number")

    def pushFilters(self, filters):
        return self.bounds.push(filters)

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, root = resolve(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.Directory:
            return sorted((x.path, x.size) for x in system.get_file_info(fs.FileSelector(root)) if x.is_file and x.path.endswith(".clust"))
        return [(root, info.size)]

    def headers(self, source, name: str, at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(byte after the header, frame number, clusters) of every frame; leaves the source after the header."""
        while at < end:
            source.seek(at)
            head = source.read(8)
            if len(head) < 8:
                raise OSError(f"{name} ends inside a header")
            frame, n = struct.unpack("<iI", head)
            if (after := at + 8 + n * self.dtype.itemsize) > end:
                raise OSError(f"{name} ends inside a frame")
            yield at + 8, frame, n
            at = after

    def partitions(self) -> list[Part]:
        out = []
        for name, size in self._files():
            cuts = [0]
            if size > SPLIT_BYTES:
                with resolve(self.path)[0].open_input_file(name) as source:
                    for at, _, _ in self.headers(source, name, 0, size):
                        if at - 8 - cuts[-1] >= SPLIT_BYTES:
                            cuts.append(at - 8)
            out += [Part(name, a, b) for a, b in zip(cuts, [*cuts[1:], size]) if a < b]
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with resolve(self.path)[0].open_input_file(part.path) as source:
            for _, frame, n in self.headers(source, part.path, part.start, part.end):
                for at in range(0, n if self.bounds.holds(frame) else 0, 65_536):
                    rows = np.frombuffer(source.read(min(65_536, n - at) * self.dtype.itemsize), dtype=self.dtype)
                    columns = [pa.array(np.full(len(rows), frame, np.int32)), pa.array(rows["x"].astype(np.int32)), pa.array(rows["y"].astype(np.int32)), packed(rows["data"].astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["frame_number", "x", "y", "data"])


@dataclass
class Written(WriterCommitMessage):
    staged: str | None


class ClusterWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: np.dtype):
        self.path, self.dtype = path, dtype

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = resolve(self.path)
        system.create_dir(f"{root}/_staged", recursive=True)
        name, sink, frame, held = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.clust", None, None, []

        def flush() -> None:
            if frame is not None:
                rows = np.zeros(len(held), dtype=self.dtype)
                rows["x"], rows["y"], rows["data"] = [h[0] for h in held], [h[1] for h in held], [h[2] for h in held]
                sink.write(struct.pack("<iI", frame, len(rows)) + rows.tobytes())

        for batch in iterator:
            for number, x, y, data in zip(*(batch.column(c).to_pylist() for c in ("frame_number", "x", "y", "data"))):
                if sink is None:
                    sink = system.open_output_stream(f"{root}/_staged/{name}", compression=None)
                if number != frame:
                    flush()
                    frame, held = number, []
                held.append((x, y, data))
        if sink is None:
            return Written(None)
        flush()
        sink.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = resolve(self.path)
        for message in messages:
            if message and message.staged:
                system.move(f"{root}/_staged/{message.staged}", f"{root}/{message.staged}")
        system.delete_dir(f"{root}/_staged")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = resolve(self.path)
        if system.get_file_info(f"{root}/_staged").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_staged")


class ClusterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clusters"

    def schema(self) -> str:
        return "frame_number int, x int, y int, data array<double>"

    def _dtype(self) -> np.dtype:
        return cluster_dtype(int(self.options.get("sx", 3)), int(self.options.get("sy", 3)), self.options.get("dtype", "i4"))

    def reader(self, schema) -> ClusterReader:
        return ClusterReader(self.options["path"], self._dtype())

    def writer(self, schema, overwrite: bool) -> ClusterWriter:
        return ClusterWriter(self.options["path"], self._dtype())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClusterSource)


def write_clusters(clusters: DataFrame, path: str, sx: int = 3, sy: int = 3, dtype: str = "i4") -> None:
    """Append ``clusters(frame_number, x, y, data)`` as files in frame order; a frame stays in one file."""
    register(clusters.sparkSession)
    ordered = clusters.select(F.col("frame_number").cast("int"), F.col("x").cast("int"), F.col("y").cast("int"), F.col("data").cast("array<double>")).repartitionByRange("frame_number").sortWithinPartitions("frame_number")
    ordered.write.format("clusters").mode("append").option("path", path).options(sx=sx, sy=sy, dtype=dtype).save()


def write_npy(frames: DataFrame, path: str, shape: tuple[int, int], dtype: str = "<f8") -> None:
    """Packed frames ``(frame, data)`` as one .npy file, streamed to the driver in order."""
    system, name = resolve(path)
    n = frames.count()
    with system.open_output_stream(name, compression=None) as sink:
        about = repr({"descr": np.dtype(dtype).str, "fortran_order": False, "shape": (n, *shape)}).encode()
        about += b" " * (-(len(about) + 11) % 64) + b"\n"
        sink.write(b"\x93NUMPY\x01\x00" + struct.pack("<H", len(about)) + about)
        for row in frames.select("frame", "data").orderBy("frame").toLocalIterator():
            sink.write(np.array(row["data"], dtype=dtype).tobytes())
