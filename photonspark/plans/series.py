"""Binary series made of the test tables, written to the shared folder and read back by the sources.

The views are a fixed number of small frames, so a series has a bounded size and is written from the driver.
"""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonspark.operators import finder, transforms
from photonspark.plans.views import COLS, FRAMES, ROWS, cl, img
from photonspark.sources import clust, detector, metadata
from photonspark.sources.files import resolve, write_bytes

FRAMES_PER_FILE = 25


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{root.rstrip('/')}/photonspark/series-{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix="photonspark-")
    system, name = resolve(folder)
    system.create_dir(name, recursive=True)
    return folder


def master(kind: str, rows: int, cols: int, modules: int, **more) -> bytes:
    about = {"Version": "7.2", "Detector Type": kind, "Timing Mode": "auto", "Geometry": {"x": 1, "y": modules}, "Image Size": 2 * rows * cols, "Pixels": {"x": cols, "y": rows}, "Max Frames Per File": FRAMES_PER_FILE, "Frame Discard Policy": "nodiscard", "Frame Padding": 1, "Scan Parameters": "[disabled]", "Total Frames": FRAMES, "Frames in File": FRAMES, "Exptime": "5s", "Period": "1ms", "Dynamic Range": 16}
    return json.dumps(about | more).encode()


def images(spark: SparkSession, sf_dir: str) -> list[np.ndarray]:
    packed = finder.pack(img(spark, sf_dir), ROWS, COLS).orderBy("frame")
    return [np.array(r["data"], dtype="<u2").reshape(ROWS, COLS) for r in packed.toLocalIterator()]


def write_raw(spark: SparkSession, sf_dir: str, kind: str = "Jungfrau", modules: int = 2, **more) -> str:
    """A raw series of the image view, cut into modules one above the other; returns the master's path."""
    folder, height = shared_folder(spark), ROWS // modules
    held = images(spark, sf_dir)
    for module in range(modules):
        for file in range(-(-len(held) // FRAMES_PER_FILE)):
            part = held[file * FRAMES_PER_FILE : (file + 1) * FRAMES_PER_FILE]
            head = np.zeros(len(part), dtype=detector.HEADER)
            head["frame_number"] = np.arange(len(part)) + file * FRAMES_PER_FILE
            data = b"".join(h.tobytes() + np.ascontiguousarray(image[module * height : (module + 1) * height]).tobytes() for h, image in zip(head, part))
            write_bytes(f"{folder}/run_d{module}_f{file}_0.raw", data)
    write_bytes(f"{folder}/run_master_0.json", master(kind, height, COLS, modules, **more))
    return f"{folder}/run_master_0.json"


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each module as they were read."""
    frames = detector.detector(spark, write_raw(spark, sf_dir))
    px = frames.select("frame_index", "module", "frame_number", "cols", F.posexplode("data").alias("pos", "value"))
    return px.select("frame_index", "module", "frame_number", F.floor(F.col("pos") / F.col("cols")).alias("row"), (F.col("pos") % F.col("cols")).alias("col"), "value")


def some_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seek: only the frames that the predicate names are read."""
    frames = detector.detector(spark, write_raw(spark, sf_dir))
    return frames.where("frame_index >= 20 AND frame_index < 30").select("frame_index", "module", F.aggregate("data", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.stitched(spark, write_raw(spark, sf_dir))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.stitched_rois(spark, write_raw(spark, sf_dir), [(2, 9, 5, 13), (0, 16, 0, 3)])


def board_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a chip test board, decoded to 16-bit samples."""
    path = write_raw(spark, sf_dir, "ChipTestBoard", 1, **{"Version": "8.0", "Analog Flag": 1, "Analog Samples": 8})
    found = transforms.transform(detector.detector(spark, path), lambda raw: np.frombuffer(raw, "<u2"))
    px = found.select("frame_index", F.posexplode("data").alias("pos", "value"))
    return px.select("frame_index", F.col("pos").cast("long").alias("sample"), F.col("value").cast("long").alias("value"))


def npy_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/frames.npy"
    clust.write_npy(finder.pack(img(spark, sf_dir), ROWS, COLS), path, (ROWS, COLS))
    px = detector.detector(spark, path).select("frame_index", F.posexplode("data").alias("pos", "value"))
    return px.select("frame_index", F.floor(F.col("pos") / COLS).alias("row"), (F.col("pos") % COLS).alias("col"), "value")


def cluster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/clusters"
    given = cl(spark, sf_dir).select((F.floor(F.col("vec_id") / 7) - 5).alias("frame_number"), "x", "y", "data")
    clust.write_clusters(given, folder)
    back = spark.read.format("clusters").load(folder)
    return back.select("frame_number", "x", "y", *(F.col("data")[i].cast("long").alias(f"d{i}") for i in range(9)))


def cluster_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region and a range of frames of cluster files; the frames are skipped by the reader."""
    return cluster_files(spark, sf_dir).where("frame_number BETWEEN -3 AND 20 AND x >= 10 AND x < 100 AND y >= 0 AND y < 2").select("frame_number", "x", "y")


def master_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/run_master_0.json"
    write_bytes(path, master("Jungfrau", 8, 16, 2))
    kept = ["version", "detector_type", "timing_mode", "geometry_row", "geometry_col", "image_size_bytes", "pixels_x", "pixels_y", "bitdepth", "max_frames_per_file", "frame_padding", "exptime_ns", "period_ns", "reading_mode"]
    return metadata.metadata(spark, path).select(*(F.col(c).cast("string").alias(c) for c in kept))


QUERIES = {
    "s1_raw_frames": raw_frames,
    "s2_seek_frames": some_frames,
    "s7_regions": regions,
    "s9_stitched": stitched,
    "s13_master_file": master_file,
    "s17_board_frames": board_frames,
    "s21_npy_frames": npy_frames,
    "s23_cluster_files": cluster_files,
    "s25_cluster_region": cluster_region,
}
