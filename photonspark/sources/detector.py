"""Binary detector series as PySpark data sources.

``raw_frames`` (several modules, 112-byte headers), ``ctb_frames`` (chip test board), ``jungfrau_frames``
(.dat series) and ``npy_frames``. The driver plans one partition for a run of frames of a file;
predicates on ``frame_index`` skip files and frames. Rows are packed frames; ``detector`` picks the
format by the file name.
"""

from __future__ import annotations

import ast
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from photonspark.operators.geometry import clip_to_roi, module_places, modules
from photonspark.operators.small import checked_broadcast
from photonspark.sources.files import Bounds, blocks, packed, read_bytes, size_of
from photonspark.sources.metadata import CTB, FileName, Master, _version, read_master

FRAMES_PER_TASK = 2000

#: The header of a module's frame.
HEADER = np.dtype([("frame_number", "<u8"), ("exp_length", "<u4"), ("packet_number", "<u4"), ("bunch_id", "<u8"), ("timestamp", "<u8"), ("mod_id", "<u2"), ("mod_row", "<u2"), ("mod_col", "<u2"), ("reserved", "<u2"), ("debug", "<u4"), ("round_robin", "<u2"), ("det_type", "u1"), ("header_version", "u1"), ("packet_mask", "V64")])
HEADER_COLUMNS = ["frame_number", "exp_length", "packet_number", "bunch_id", "timestamp", "mod_id", "mod_row", "mod_col", "reserved", "debug", "round_robin", "det_type", "header_version"]
HEADER_SCHEMA = ", ".join(f"{c} long" for c in HEADER_COLUMNS) + ", packet_mask binary"
DTYPES = {8: "u1", 16: "<u2", 32: "<u4", 64: "<u8"}


@dataclass
class Run(InputPartition):
    """``count`` frames of one file, the first being ``first`` of the series and ``at`` of the file."""

    path: str
    module: int
    first: int
    at: int
    count: int


def runs(path: str, module: int, first: int, count: int, bounds: Bounds) -> Iterator[Run]:
    low, n = bounds.cut(first, count)
    for k in range(0, n, FRAMES_PER_TASK):
        yield Run(path, module, low + k, low + k - first, min(FRAMES_PER_TASK, n - k))


class FrameReader(DataSourceReader):
    """Shared planning: subclasses list files and decode records."""

    record: int

    def __init__(self):
        self.bounds = Bounds("frame_index")

    def pushFilters(self, filters):
        return self.bounds.push(filters)

    def files(self) -> Iterator[tuple[str, int, int, int]]:
        """(path, module, first frame, frames)"""
        raise NotImplementedError

    def start(self, run: Run) -> int:
        return run.at * self.record

    def partitions(self) -> list[Run]:
        return [r for path, module, first, n in self.files() for r in runs(path, module, first, n, self.bounds)] or [Run("", 0, 0, 0, 0)]

    def decode(self, raw: bytes, run: Run, index: np.ndarray) -> pa.RecordBatch:
        raise NotImplementedError

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        done = 0
        for raw in blocks(run.path, self.start(run), run.count, self.record) if run.count else ():
            n = len(raw) // self.record
            if n * self.record != len(raw):
                raise OSError(f"{run.path} ends inside a frame")
            yield self.decode(raw, run, np.arange(run.first + done, run.first + done + n))
            done += n


def header_columns(head: np.ndarray) -> list[pa.Array]:
    return [pa.array(head[c].astype(np.int64)) for c in HEADER_COLUMNS] + [pa.array([m.tobytes() for m in head["packet_mask"]], pa.binary())]


class RawReader(FrameReader):
    def __init__(self, path: str):
        super().__init__()
        self.name, self.master = FileName.parse(path), read_master(path)
        if self.master.bitdepth not in DTYPES:
            raise ValueError(f"{self.master.bitdepth}-bit raw files are not supported")
        if _version(self.master.version) < (4, 0):
            self.name = FileName(self.name.folder, self.name.base, self.name.index, self.name.ext, True)
        m = self.master
        self.pixels = np.dtype(DTYPES[m.bitdepth])
        self.record = HEADER.itemsize + m.pixels_x * m.pixels_y * self.pixels.itemsize
        self.places = module_places((m.geometry_row, m.geometry_col), (m.udp_row, m.udp_col), bool(m.quad))

    def files(self) -> Iterator[tuple[str, int, int, int]]:
        for module in range(self.master.geometry_row * self.master.geometry_col):
            file, first = 0, 0
            while (size := size_of(path := self.name.data(module, file))) is not None:
                yield path, module, first, size // self.record
                file, first = file + 1, first + size // self.record

    def flipped(self, module: int) -> bool:
        """Half modules of an Eiger in even rows of the detector are read upside down."""
        return self.master.detector_type == "Eiger" and self.places[module][0] % 2 == 0

    def decode(self, raw: bytes, run: Run, index: np.ndarray) -> pa.RecordBatch:
        m = self.master
        rows = np.frombuffer(raw, dtype=np.dtype([("head", HEADER), ("image", self.pixels, (m.pixels_y, m.pixels_x))]))
        images = rows["image"][:, ::-1] if self.flipped(run.module) else rows["image"]
        n = len(rows)
        columns = [pa.array(index), pa.array(np.full(n, run.module, np.int32)), pa.array(np.full(n, m.pixels_y, np.int32)), pa.array(np.full(n, m.pixels_x, np.int32)), packed(images.reshape(n, -1)), *header_columns(rows["head"])]
        return pa.RecordBatch.from_arrays(columns, names=["frame_index", "module", "rows", "cols", "data", *HEADER_COLUMNS, "packet_mask"])


class CtbReader(FrameReader):
    """Headers and the undecoded bytes of a chip test board's frames."""

    def __init__(self, path: str):
        super().__init__()
        self.name, self.master = FileName.parse(path), read_master(path)
        if self.master.detector_type not in CTB:
            raise ValueError(f"not a chip test board: {self.master.detector_type}")
        self.record = HEADER.itemsize + self.master.image_size_bytes

    def files(self) -> Iterator[tuple[str, int, int, int]]:
        file, first = 0, 0
        while (size := size_of(path := self.name.data(0, file))) is not None:
            yield path, 0, first, size // self.record
            file, first = file + 1, first + self.master.max_frames_per_file

    def decode(self, raw: bytes, run: Run, index: np.ndarray) -> pa.RecordBatch:
        n = len(raw) // self.record
        head = np.frombuffer(raw, dtype=np.dtype([("head", HEADER), ("rest", f"V{self.record - HEADER.itemsize}")]))["head"]
        body = [raw[i * self.record + HEADER.itemsize : (i + 1) * self.record] for i in range(n)]
        return pa.RecordBatch.from_arrays([pa.array(index), pa.array(body, pa.binary()), *header_columns(head)], names=["frame_index", "bytes", *HEADER_COLUMNS, "packet_mask"])


#: Shapes that the size of a .dat file may stand for, in this order.
DAT_SHAPES = ((512, 1024), (256, 1024), (256, 256))


class DatReader(FrameReader):
    def __init__(self, path: str):
        super().__init__()
        m = re.fullmatch(r"(.*_)(\d{6})(\.dat)", path)
        if not m:
            raise ValueError(f"not the name of a .dat series: {path}")
        self.stem, self.index = m[1], int(m[2])
        size = size_of(path) or 0
        fits = [s for s in DAT_SHAPES if size and size % (16 + 2 * s[0] * s[1]) == 0]
        if not fits:
            raise ValueError(f"{size} bytes hold no whole frames of a known shape")
        self.shape = fits[0]
        self.record = 16 + 2 * self.shape[0] * self.shape[1]

    def files(self) -> Iterator[tuple[str, int, int, int]]:
        index, first = self.index, 0
        while (size := size_of(path := f"{self.stem}{index:06d}.dat")) is not None:
            yield path, 0, first, size // self.record
            index, first = index + 1, first + size // self.record

    def decode(self, raw: bytes, run: Run, index: np.ndarray) -> pa.RecordBatch:
        rows = np.frombuffer(raw, dtype=np.dtype([("framenum", "<u8"), ("bunchid", "<u8"), ("image", "<u2", self.shape)]))
        n, (h, w) = len(rows), self.shape
        columns = [pa.array(index), pa.array(rows["framenum"].astype(np.int64)), pa.array(rows["bunchid"].astype(np.int64)), pa.array(np.full(n, h, np.int32)), pa.array(np.full(n, w, np.int32)), packed(rows["image"].reshape(n, -1))]
        return pa.RecordBatch.from_arrays(columns, names=["frame_index", "frame_number", "bunch_id", "rows", "cols", "data"])


def npy_header(path: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type, shape and first data byte of a .npy file of version 1 or 2 in C order."""
    head = read_bytes(path, 0, 12)
    if head[:6] != b"\x93NUMPY" or head[6] not in (1, 2):
        raise ValueError(f"not a .npy file of version 1 or 2: {path}")
    length, start = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
    about = ast.literal_eval(read_bytes(path, start, length).decode("latin-1"))
    if about["fortran_order"] or about["descr"][0] == ">":
        raise ValueError("only little-endian C order is read")
    return np.dtype(about["descr"]), about["shape"], start + length


class NpyReader(FrameReader):
    """The first axis counts frames."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self.dtype, self.shape, self.offset = npy_header(path)
        self.inner = self.shape[1:] or (1,)
        self.record = int(np.prod(self.inner)) * self.dtype.itemsize

    def files(self) -> Iterator[tuple[str, int, int, int]]:
        yield self.path, 0, 0, self.shape[0] if self.shape else 1

    def start(self, run: Run) -> int:
        return self.offset + run.at * self.record

    def decode(self, raw: bytes, run: Run, index: np.ndarray) -> pa.RecordBatch:
        n = len(index)
        frames = np.frombuffer(raw, dtype=self.dtype).reshape(n, -1).astype(np.float64)
        h, w = (1, *self.inner)[-2:]
        return pa.RecordBatch.from_arrays([pa.array(index), pa.array(np.full(n, h, np.int32)), pa.array(np.full(n, w, np.int32)), packed(frames)], names=["frame_index", "rows", "cols", "data"])


def _source(label: str, made: type[FrameReader], columns: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return made(self.options["path"])

    return Source


RAW = _source("raw_frames", RawReader, f"frame_index long, module int, rows int, cols int, data array<long>, {HEADER_SCHEMA}")
CTB_FRAMES = _source("ctb_frames", CtbReader, f"frame_index long, bytes binary, {HEADER_SCHEMA}")
DAT = _source("jungfrau_frames", DatReader, "frame_index long, frame_number long, bunch_id long, rows int, cols int, data array<long>")
NPY = _source("npy_frames", NpyReader, "frame_index long, rows int, cols int, data array<double>")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (RAW, CTB_FRAMES, DAT, NPY):
        spark.dataSource.register(source)


def detector(spark: SparkSession, path: str) -> DataFrame:
    """Frames of any known file, by its name; a chip test board's series keeps its bytes undecoded."""
    register(spark)
    if path.endswith((".json", ".raw")):
        kind = "ctb_frames" if read_master(path).detector_type in CTB else "raw_frames"
    elif path.endswith(".npy"):
        kind = "npy_frames"
    elif path.endswith(".dat"):
        kind = "jungfrau_frames"
    else:
        raise ValueError(f"no reader for {path}")
    return spark.read.format(kind).load(path)


def read_header(path: str) -> dict[str, int]:
    """The first frame header of a data file."""
    head = np.frombuffer(read_bytes(path, 0, HEADER.itemsize), dtype=HEADER)[0]
    return {c: int(head[c]) for c in HEADER_COLUMNS}


def module_table(spark: SparkSession, master: Master) -> DataFrame:
    return modules(spark, (master.geometry_row, master.geometry_col), master.pixels_x, master.pixels_y, (master.udp_row, master.udp_col), bool(master.quad))


def stitched(spark: SparkSession, path: str, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels ``(frame_number, row, col, value)`` of frames that all modules have, in detector coordinates.

    With a region (xmin, xmax, ymin, ymax) only overlapping modules are joined, and rows and
    columns count from its corner. A series whose numbers do not ascend is a data error.
    """
    register(spark)
    master = read_master(path)
    table = module_table(spark, master)
    x0, x1, y0, y1 = roi or (0, master.geometry_col * master.pixels_x, 0, master.geometry_row * master.pixels_y)
    hit = clip_to_roi(table, F.lit(x0), F.lit(x1), F.lit(y0), F.lit(y1)).select("module") if roi else table.select("module")
    places = table.join(hit, "module", "left_semi").select(F.col("module").alias("_m"), "origin_x", "origin_y")
    frames = spark.read.format("raw_frames").load(path).select("module", "frame_number", "cols", "data")
    n = places.count()
    frames = frames.join(checked_broadcast(places), F.col("module") == F.col("_m"))
    complete = frames.groupBy("frame_number").agg(F.count_distinct("module").alias("n")).where(F.col("n") == n).select("frame_number")
    px = frames.join(complete, "frame_number", "left_semi").select("frame_number", "origin_x", "origin_y", "cols", F.posexplode("data").alias("pos", "value"))
    row, col = F.col("origin_y") + F.floor(F.col("pos") / F.col("cols")) - y0, F.col("origin_x") + F.col("pos") % F.col("cols") - x0
    return px.select("frame_number", row.cast("long").alias("row"), col.cast("long").alias("col"), "value").where(F.col("row").between(0, y1 - y0 - 1) & F.col("col").between(0, x1 - x0 - 1))


def stitched_rois(spark: SparkSession, path: str, rois: list[tuple[int, int, int, int]]) -> DataFrame:
    """``(roi, frame_number, row, col, value)`` of several regions; a pixel in two regions is in both."""
    if not rois:
        raise ValueError("no region is given")
    parts = [stitched(spark, path, roi).select(F.lit(k).alias("roi"), "*") for k, roi in enumerate(rois)]
    return reduce(DataFrame.unionByName, parts)


def load_calibration(spark: SparkSession, path: str, hg0: bool = False, shape: tuple[int, int] = (512, 1024)) -> DataFrame:
    """(gain, row, col, cal) of float64 planes; ``hg0`` takes gain 0 from the fourth plane."""
    register_size = shape[0] * shape[1]
    raw = np.frombuffer(read_bytes(path), dtype="<f8").reshape(-1, *shape)
    planes = [raw[3] if hg0 and g == 0 else raw[g] for g in range(3)]
    gain, row, col = np.unravel_index(np.arange(3 * register_size), (3, *shape))
    return spark.createDataFrame(pa.table({"gain": gain.astype(np.int64), "row": row.astype(np.int64), "col": col.astype(np.int64), "cal": np.concatenate([p.ravel() for p in planes])}))
