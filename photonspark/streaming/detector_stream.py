"""Streaming forms: a sharded cluster finder, a pedestal-tracking histogram and sinks.

State is keyed by shard or pixel, order is arrival order inside a micro-batch (frame number
within a batch), and the source's rate limit is the back-pressure.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from photonspark.operators.finder import Finder
from photonspark.operators.folds import Tracking
from photonspark.sources.clust import write_clusters


def find_clusters(frames: DataFrame, shape: tuple[int, int], n_shards: int = 3, n_sigma: float = 5.0, n_samples: int = 1000, sx: int = 3, sy: int = 3) -> DataFrame:
    """Clusters of a stream of packed frames ``(frame, frame_type, data)``.

    PEDESTAL frames go to every shard, DATA frames to shard ``frame % n_shards``.
    """
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        finder = pickle.loads(state.get[0]) if state.exists else Finder(shape, n_sigma, n_samples, sx, sy)
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for number, kind, data in zip(rows["frame"], rows["frame_type"], rows["data"]):
            image = np.asarray(data).reshape(shape)
            if kind == "PEDESTAL":
                finder.push_pedestal_frame(image)
            else:
                out += [(number, x, y, d) for x, y, d in finder.find(image)]
        state.update((pickle.dumps(finder),))
        yield pd.DataFrame(out, columns=["frame_number", "x", "y", "data"])

    every = F.when(F.col("frame_type") == "PEDESTAL", F.sequence(F.lit(0), F.lit(n_shards - 1))).otherwise(F.array((F.col("frame") % n_shards).cast("int")))
    sharded = frames.select("frame", "frame_type", "data", F.explode(every).alias("shard"))
    return sharded.groupBy("shard").applyInPandasWithState(step, "frame_number long, x int, y int, data array<long>", "finder binary", "append", "NoTimeout")


def track_histogram(pixels: DataFrame, bins: int, xmin: float, xmax: float, n_sigma: float = 1.0, n_samples: int = 1000) -> DataFrame:
    """Running (row, col, bin, count) of a stream ``(row, col, seq, is_pedestal, raw)``; the last row of a cell holds."""
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pixel = pickle.loads(state.get[0]) if state.exists else Tracking(bins, xmin, xmax, n_sigma, n_samples)
        rows = pd.concat(list(batches)).sort_values("seq")
        for is_pedestal, raw in zip(rows["is_pedestal"], rows["raw"]):
            pixel.step(bool(is_pedestal), int(raw))
        state.update((pickle.dumps(pixel),))
        yield pd.DataFrame([(*key, b, n) for b, n in sorted(pixel.counts.items())], columns=["row", "col", "bin", "count"])

    return pixels.groupBy("row", "col").applyInPandasWithState(step, "row long, col long, bin long, count long", "pixel binary", "update", "NoTimeout")


def pixel_histogram(values: DataFrame, v, bins: int, xmin: float, xmax: float) -> DataFrame:
    """The plain histogram needs no own state: a streaming aggregation."""
    from photonspark.operators.histogram import pixel_histogram as counts

    return counts(values, v, bins, xmin, xmax)


def sink_to_clusters(stream: DataFrame, path: str, checkpoint: str, sx: int = 3, sy: int = 3, dtype: str = "i4") -> StreamingQuery:
    """Write each micro-batch to a folder of cluster files of its own; a repeated batch rewrites its folder."""
    def write(batch: DataFrame, number: int) -> None:
        from photonspark.sources.files import resolve
        from pyarrow import fs

        system, root = resolve(f"{path}/batch-{number:09d}")
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)
        write_clusters(batch, f"{path}/batch-{number:09d}", sx, sy, dtype)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ClusterCollector:
    """Clusters of a stream, kept as Parquet under ``path`` (a shared folder) until they are taken."""

    def __init__(self, stream: DataFrame, path: str, checkpoint: str):
        self.spark, self.path, self.schema = stream.sparkSession, path, stream.schema
        self.taken, self.kept = -1, False
        self.query = stream.writeStream.foreachBatch(self._keep).option("checkpointLocation", checkpoint).start()

    def _keep(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        self.kept = True

    def steal_clusters(self) -> DataFrame:
        """All clusters since the last call; what is on its way is waited for."""
        self.query.processAllAvailable()
        done = self.query.lastProgress
        first, last = self.taken, done["batchId"] if done else -1
        self.taken = max(first, last)
        if last <= first or not self.kept:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(self.path)  # the folders' names give the column batch
        return found.where((F.col("batch") > first) & (F.col("batch") <= last)).select(*self.schema.names)

    def stop(self) -> None:
        self.query.stop()
