"""Readers with a position, array arithmetic, positional masks and the cluster collector."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonspark.functions import arrays
from photonspark.operators import finder, folds
from photonspark.sources import clust, detector, reader
from photonspark.streaming import detector_stream


@pytest.fixture
def series(tmp_path):
    about = {"Version": "7.2", "Detector Type": "Jungfrau", "Timing Mode": "auto", "Geometry": {"x": 1, "y": 2}, "Image Size": 64, "Pixels": {"x": 8, "y": 4}, "Max Frames Per File": 4, "Total Frames": 10, "Frames in File": 10, "Dynamic Range": 16}
    (tmp_path / "run_master_0.json").write_text(json.dumps(about))
    for module in range(2):
        for k in range(10):
            head = np.zeros(1, dtype=detector.HEADER)
            head["frame_number"] = 100 + k
            with open(tmp_path / f"run_d{module}_f{k // 4}_0.raw", "ab") as f:
                f.write(head.tobytes() + np.full((4, 8), 10 * k + module, "<u2").tobytes())
    return str(tmp_path / "run_master_0.json")


def test_frame_file(spark, series):
    with reader.FrameFile(spark, series, chunk_size=4) as held:
        numbers = lambda df: sorted({r["frame_number"] for r in df.collect()})
        assert len(held) == 10 and [numbers(c) for c in held] == [[100, 101, 102, 103], [104, 105, 106, 107], [108, 109]]
        with pytest.raises(EOFError):
            held.read_n(1)
        held.seek(8)
        assert numbers(held.read_n(50)) == [108, 109] and held.tell() == 10
        assert numbers(held.read_frame(3)) == [103] and held.tell() == 4 and held.frame_number(7) == 107
        assert held.read().count() == 20
        assert held.images(5)[1].shape == (4, 8) and held.images(5)[1][3, 7] == 51
        with pytest.raises(IndexError):
            held.seek(10)


def test_regions(spark, series):
    got = detector.stitched_rois(spark, series, [(0, 3, 2, 6), (6, 8, 0, 1)])
    assert {(r["roi"], r["n"]) for r in got.groupBy("roi").agg(F.count("*").alias("n")).collect()} == {(0, 120), (1, 20)}
    with pytest.raises(ValueError):
        detector.stitched_rois(spark, series, [])


def test_cluster_file_positions(spark, tmp_path):
    rows = [(f, k, abs(f), [float(f + k)] * 9) for f, n in ((-2, 5), (0, 0), (3, 7), (4, 1)) for k in range(n)]
    clust.write_clusters(spark.createDataFrame(rows, "frame_number int, x int, y int, data array<double>").coalesce(1), str(tmp_path / "c"))
    path = tmp_path / "one.clust"
    path.write_bytes(b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("*.clust"))))
    got = lambda df: [(r["frame_number"], r["x"], r["y"], r["data"]) for r in df.collect()]
    held = reader.ClusterFile(spark, str(path), chunk_size=6)
    first = got(held.read_clusters(3))
    assert len(first) == 3
    with pytest.raises(ValueError, match="inside a frame"):
        held.read_frame()
    assert sorted(first + got(held.read_clusters(100))) == sorted(rows) and held.read_clusters(5).count() == 0
    with pytest.raises(EOFError):
        held.read_frame()
    assert [c.count() for c in reader.ClusterFile(spark, str(path), chunk_size=6)] == [6, 6, 1]
    whole = reader.ClusterFile(spark, str(path))
    assert {r[0] for r in got(whole.read_frame())} <= {-2, 3, 4}


def test_constructed_clusters(spark):
    assert reader.clusters(spark, [(1, 2, [1, 2, 3, 4])], 2, 2, "smallint").first() == (1, 2, [1, 2, 3, 4])
    for bad in (dict(sx=3, sy=3), dict(sx=2, sy=2, kind="string")):
        with pytest.raises(ValueError):
            reader.clusters(spark, [(1, 2, [1, 2, 3, 4])], **bad)
    with pytest.raises(ValueError):
        reader.clusters(spark, [(-1, 2, [1] * 9)])


def test_array_arithmetic(spark):
    df = spark.createDataFrame([([6.0, 1.0], [2.0, 0.0], [1.0]), (None, [1.0, 1.0], None)], "a array<double>, b array<double>, c array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(arrays.add(a, b).alias("s"), arrays.subtract(a, b).alias("d"), arrays.multiply(a, b).alias("p"), arrays.divide(a, b).alias("q")).collect()
    assert tuple(got[0]) == ([8.0, 1.0], [4.0, 1.0], [12.0, 0.0], [3.0, 0.0]) and got[1]["s"] is None
    with pytest.raises(Exception, match="different sizes"):
        df.select(arrays.add(a, F.col("c"))).collect()
    view = spark.range(1).select(arrays.sub_view(F.array(*map(F.lit, range(12))), (3, 2, 2), 1).alias("v"), arrays.bit_and(F.array(F.lit(7), F.lit(8)), 3).alias("m")).first()
    assert (view["v"], view["m"]) == ([4, 5, 6, 7], [3, 0]) and arrays.drop_first_dim((3, 2, 2)) == (2, 2) and arrays.num_elements(()) == 1
    with pytest.raises(IndexError):
        arrays.sub_view(F.array(F.lit(1)), (1,), 1)


def test_positions(spark):
    rows = spark.createDataFrame([(i, 10 * i) for i in range(4)], "position long, v long")
    assert sorted(r["v"] for r in arrays.where_mask(rows, [True, False, False, True]).collect()) == [0, 30]
    for mask in ([True] * 3, [True] * 5):
        with pytest.raises(ValueError, match="positions differ"):
            arrays.where_mask(rows, mask)
    etas = spark.createDataFrame([(i, i / 2) for i in range(4)], "position long, eta double")
    assert {(r["v"], r["eta"]) for r in arrays.by_position(rows, etas).collect()} == {(0, 0.0), (10, 0.5), (20, 1.0), (30, 1.5)}


def test_live_n_sigma(spark):
    """A row's own n_sigma decides whether it moves the pedestal."""
    rows = [(0, 0, k, k < 20, 100 + k % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "row long, col long, k long, p boolean, v long")
    state = folds.Tracking(32, -16.0, 16.0, 0.0, 1000)
    for _, _, k, p, v in rows:
        state.n_sigma = 0.0 if k < 40 else 3.0
        state.step(p, v)
    got = folds.tracking_histogram(df, "v", "p", ["k"], 32, -16.0, 16.0, F.when(F.col("k") < 40, 0.0).otherwise(3.0))
    assert {r["bin"]: r["count"] for r in got.collect()} == state.counts


def test_label_images_and_finder_sizes(spark):
    image = np.zeros((4, 5), dtype=int)
    image[0, 0] = image[1, 1] = image[3, 4] = 9
    df = spark.createDataFrame([(7, image.ravel().tolist())], "frame long, data array<long>")
    got = np.array(finder.labelled(df, (4, 5), 5).first()["data"]).reshape(4, 5)
    assert (got == [[1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 2]]).all()
    with pytest.raises(ValueError):
        finder.Finder((4, 5), sx=2, sy=2)


def test_collector_gives_clusters_once(spark, tmp_path):
    rows = spark.createDataFrame([(f, 1, 2, [1.0] * 9) for f in range(6)], "frame_number int, x int, y int, data array<double>")
    (tmp_path / "in").mkdir()
    collector = detector_stream.ClusterCollector(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    try:
        assert collector.steal_clusters().count() == 0
        rows.where("frame_number < 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert sorted(r["frame_number"] for r in collector.steal_clusters().collect()) == [0, 1]
        rows.where("frame_number >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert sorted(r["frame_number"] for r in collector.steal_clusters().collect()) == [2, 3, 4, 5]
        assert collector.steal_clusters().count() == 0
    finally:
        collector.stop()
