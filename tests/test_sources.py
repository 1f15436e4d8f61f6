"""Round trips of the binary formats, predicates at planning, and streams."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonspark.sources import clust, detector, metadata
from photonspark.streaming import detector_stream


def master(tmp_path, kind="Jungfrau", version="7.2", **more):
    j = {"Version": version, "Detector Type": kind, "Timing Mode": "auto", "Geometry": {"x": 1, "y": 2}, "Image Size in bytes": 64, "Pixels": {"x": 8, "y": 4}, "Max Frames Per File": 3, "Frame Discard Policy": "nodiscard", "Frame Padding": 1, "Scan Parameters": "[disabled]", "Total Frames": 5, "Frames in File": 5, "Exptime": "5s", "Period": "1ms", "Dynamic Range": 16} | more
    path = tmp_path / "run_master_0.json"
    path.write_text(json.dumps(j))
    return str(path)


def header(frame):
    head = np.zeros(1, dtype=detector.HEADER)
    head["frame_number"] = frame
    return head.tobytes()


def raw_series(tmp_path):
    path = master(tmp_path)
    images = {}
    for module in range(2):
        for k, frame in enumerate([1, 2, 3, 4, 6] if module else [1, 2, 4, 5, 6]):
            image = np.arange(32, dtype="<u2").reshape(4, 8) + 100 * frame + 1000 * module
            images[module, frame] = image
            with open(tmp_path / f"run_d{module}_f{k // 3}_0.raw", "ab") as f:
                f.write(header(frame) + image.tobytes())
    return path, images


def test_header_is_112_bytes():
    assert detector.HEADER.itemsize == 112
    assert [clust.cluster_dtype(*s).itemsize for s in ((3, 3, "i4"), (3, 3, "i2"), (2, 2, "f8"), (3, 3, "f8"))] == [40, 22, 40, 80]


def test_raw_frames_and_stitching(spark, tmp_path):
    path, images = raw_series(tmp_path)
    df = detector.detector(spark, path)
    assert df.count() == 10
    got = {(r["module"], r["frame_number"]): r["data"] for r in df.collect()}
    assert all(got[k] == v.ravel().tolist() for k, v in images.items())
    one = df.where("frame_index >= 3 AND frame_index < 4")
    assert sorted((r["module"], r["frame_number"]) for r in one.collect()) == [(0, 5), (1, 4)]
    px = detector.stitched(spark, path)
    assert sorted(r[0] for r in px.select("frame_number").distinct().collect()) == [1, 2, 4, 6]
    cell = px.where("frame_number = 4 AND row = 5 AND col = 2").first()["value"]
    assert cell == images[1, 4][1, 2]
    roi = detector.stitched(spark, path, (2, 5, 4, 6))
    assert roi.where("frame_number = 3").count() == 6 and roi.where("frame_number = 3 AND row = 0 AND col = 0").first()["value"] == images[1, 3][0, 2]
    assert detector.read_header(str(tmp_path / "run_d1_f1_0.raw"))["frame_number"] == 4


def test_planning_skips_frames(tmp_path):
    path, _ = raw_series(tmp_path)
    reader = detector.RawReader(path)
    list(reader.pushFilters([detector_filter("frame_index", 4)]))
    assert [(r.module, r.first, r.count) for r in reader.partitions()] == [(0, 4, 1), (1, 4, 1)]


def detector_filter(name, value):
    from pyspark.sql.datasource import EqualTo

    return EqualTo((name,), value)


def test_ctb_and_transforms(spark, tmp_path):
    from photonspark.operators import transforms

    path = master(tmp_path, "ChipTestBoard", "8.0", **{"Geometry": {"x": 1, "y": 1}, "Image Size": 48, "Analog Flag": 1, "Analog Samples": 12, "Digital Flag": 1, "Digital Samples": 4})
    j = json.loads(open(path).read())
    del j["Image Size in bytes"]
    open(path, "w").write(json.dumps(j))
    for k in range(4):
        with open(tmp_path / f"run_d0_f{k // 3}_0.raw", "ab") as f:
            f.write(header(k) + bytes(range(48)))
    df = detector.detector(spark, path)
    assert [r["frame_number"] for r in df.orderBy("frame_index").collect()] == [0, 1, 2, 3]
    got = transforms.transform(df, lambda b: np.frombuffer(b, "u1")[::-1]).where("frame_index = 3").first()["data"]
    assert got == list(range(47, -1, -1))
    assert metadata.read_master(path).reading_mode == "ANALOG_AND_DIGITAL"


def test_jungfrau_series(spark, tmp_path):
    n = 0
    for file, count in enumerate((7, 7, 7, 3)):
        with open(tmp_path / f"x_{file:06d}.dat", "wb") as f:
            for _ in range(count):
                n += 1
                f.write(struct.pack("<QQ", n, n * n) + np.full(65536, n, "<u2").tobytes())
    df = detector.detector(spark, str(tmp_path / "x_000000.dat"))
    rows = df.select("frame_index", "frame_number", "bunch_id", "rows", "cols", F.element_at("data", 1).alias("v")).orderBy("frame_index").collect()
    assert [tuple(r) for r in rows] == [(i, i + 1, (i + 1) ** 2, 256, 256, i + 1) for i in range(24)]
    assert detector.detector(spark, str(tmp_path / "x_000002.dat")).count() == 10


def test_npy_round_trip(spark, tmp_path):
    a = np.arange(24, dtype="<f8").reshape(4, 2, 3)
    np.save(tmp_path / "a.npy", a)
    df = detector.detector(spark, str(tmp_path / "a.npy"))
    assert [r["data"] for r in df.orderBy("frame_index").collect()] == a.reshape(4, -1).tolist()
    clust.write_npy(df.withColumnRenamed("frame_index", "frame"), str(tmp_path / "b.npy"), (2, 3))
    assert (np.load(tmp_path / "b.npy") == a).all()
    np.save(tmp_path / "f.npy", np.asfortranarray(a))
    with pytest.raises(ValueError):
        detector.npy_header(str(tmp_path / "f.npy"))
    with pytest.raises(ValueError):
        detector.detector(spark, "x.tiff")


def test_cluster_files(spark, tmp_path):
    rows = [(135, 1 + k, 200 + k, [float(9 * k + i) for i in range(9)]) for k in range(97)] + [(7, 5, 5, [1.0] * 9), (8, 6, 6, [2.0] * 9)]
    df = spark.createDataFrame(rows, "frame_number int, x int, y int, data array<double>")
    clust.write_clusters(df, str(tmp_path / "c"))
    read = spark.read.format("clusters").load(str(tmp_path / "c"))
    assert sorted((r["frame_number"], r["x"], r["y"], r["data"]) for r in read.collect()) == sorted(rows)
    assert read.where("frame_number = 135 AND x >= 0 AND x < 50 AND y >= 200 AND y < 249").count() == 49
    reader = clust.ClusterReader(str(tmp_path / "c"), clust.cluster_dtype(3, 3, "i4"))
    list(reader.pushFilters([detector_filter("frame_number", 8)]))
    assert [f for p in reader.partitions() for b in reader.read(p) for f in b.column("frame_number").to_pylist()] == [8]
    doubles = spark.createDataFrame([(f, 10 + k, 20, [float(i) for i in range(4)]) for f in (0, 1) for k in range(4)], "frame_number int, x int, y int, data array<double>")
    clust.write_clusters(doubles, str(tmp_path / "d"), 2, 2, "f8")
    assert sum(p.stat().st_size for p in (tmp_path / "d").glob("*.clust")) == 2 * (8 + 4 * 40)


def test_metadata(spark, tmp_path):
    path = master(tmp_path, "Eiger", **{"Dynamic Range": 32, "Scan Parameters": "[enabled\ndac dac 4\nstart 500\nstop 2200\nstep 5\nsettleTime 100us\n]", "Receiver Roi": {"xmin": 4294967295, "xmax": 4294967295, "ymin": 4294967295, "ymax": 4294967295}})
    row = metadata.metadata(spark, path).first()
    assert (row["bitdepth"], row["exptime_ns"], row["period_ns"], row["rois"], row["udp_col"]) == (32, 5 * 10**9, 10**6, [], 2)
    assert (row["scan"]["dac"], row["scan"]["start"], row["scan"]["stop"], row["scan"]["settle_ns"]) == ("dac 4", 500, 2201, 100_000)
    assert list(metadata.Scan.parse("[enabled\ndac x\nstart 0\nstop 10\nstep 5\n]")) == [0, 5]
    assert metadata.FileName.parse("some/path/test_master_73.json").data(1, 2) == "some/path/test_d1_f2_73.raw"
    for bad in ("somefile.json", "another_test_d0_f0_1.raw", "test_master_1.txt"):
        with pytest.raises(ValueError):
            metadata.FileName.parse(bad)
    text = "Version : 6.2\nDetector Type : Moench\nTiming Mode : auto\nPixels : [400, 400]\nImage Size : 320000 bytes\nFrames in File : 7\nTotal Frames : 7\nExptime : 1ms\nPeriod : 2ms\nMax. Frames Per File : 100\n#Frame Header\nPixels : [1, 1]\n"
    m = metadata.parse_text(text)
    assert (m.pixels_x, m.frames_in_file, m.exptime_ns, m.max_frames_per_file) == (400, 7, 10**6, 100)


def test_calibration_file(spark, tmp_path):
    planes = np.arange(4 * 6, dtype="<f8").reshape(4, 2, 3)
    planes.tofile(tmp_path / "cal.bin")
    get = lambda hg0: {(r["gain"], r["row"], r["col"]): r["cal"] for r in detector.load_calibration(spark, str(tmp_path / "cal.bin"), hg0, (2, 3)).collect()}
    assert get(False)[0, 1, 2] == planes[0, 1, 2] and get(True)[0, 1, 2] == planes[3, 1, 2] and get(True)[2, 0, 1] == planes[2, 0, 1]


def test_streams_match_batch(spark, tmp_path):
    from photonspark.operators import finder, folds

    draw = np.random.default_rng(4)
    images = [np.round(draw.normal(100, 5, (5, 5))).astype(int) for _ in range(12)]
    for image in images[6:]:
        image[2, 2] += 300
    schema = "frame long, frame_type string, data array<long>"
    packed = spark.createDataFrame([(f, "PEDESTAL" if f < 6 else "DATA", im.ravel().tolist()) for f, im in enumerate(images)], schema)
    packed.coalesce(1).write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "frames"))
    detector_stream.sink_to_clusters(detector_stream.find_clusters(stream, (5, 5), 2, 3.0), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    clust.register(spark)
    got = spark.read.format("clusters").load(str(tmp_path / "out" / "batch-000000000"))
    want = finder.exact_clusters(packed.select("frame", "data"), (5, 5), 6, 2, 3.0)
    assert sorted((r["frame_number"], r["x"], r["y"], [int(v) for v in r["data"]]) for r in got.collect()) == sorted((r["frame"], r["x"], r["y"], r["data"]) for r in want.collect())

    pixels = spark.createDataFrame([(0, k % 2, k, k < 20, int(v)) for k, v in enumerate(draw.normal(100, 4, 80))], "row long, col long, seq long, is_pedestal boolean, raw long")
    pixels.coalesce(1).write.parquet(str(tmp_path / "px"))
    live = spark.readStream.schema(pixels.schema).parquet(str(tmp_path / "px"))
    query = detector_stream.track_histogram(live, 32, -16.0, 16.0).writeStream.format("memory").queryName("tracked").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = folds.tracking_histogram(pixels, "raw", "is_pedestal", ["seq"], 32, -16.0, 16.0)
    assert sorted(map(tuple, spark.table("tracked").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize(("kind", "more", "upside_down"), [("Eiger", {"Quad": 1, "Geometry": {"x": 2, "y": 2}}, [False, False, True, True]), ("Eiger", {"Geometry": {"x": 2, "y": 2}}, [True, True, False, False]), ("Eiger", {"Geometry": {"x": 4, "y": 1}}, [True] * 4), ("Jungfrau", {}, [False, False])])
def test_eiger_modules_in_even_rows_are_flipped(spark, tmp_path, kind, more, upside_down):
    """The row of a module comes from the geometry: a quad swaps rows, two UDP columns stand side by side."""
    path = master(tmp_path, kind, **more)
    image = np.arange(32, dtype="<u2").reshape(4, 8)
    for module in range(len(upside_down)):
        (tmp_path / f"run_d{module}_f0_0.raw").write_bytes(header(1) + image.tobytes())
    got = {r["module"]: r["data"] for r in detector.detector(spark, path).collect()}
    assert [got[m] == image[::-1].ravel().tolist() for m in range(len(upside_down))] == upside_down
    assert all(got[m] in (image.ravel().tolist(), image[::-1].ravel().tolist()) for m in got)


def test_negative_frame_numbers_and_split_files(spark, tmp_path, monkeypatch):
    rows = [(f, 1, 2, [float(f)] * 9) for f in range(-6, 6) for _ in range(3)]
    clust.write_clusters(spark.createDataFrame(rows, "frame_number int, x int, y int, data array<double>").coalesce(1), str(tmp_path / "c"))
    clust.register(spark)
    read = spark.read.format("clusters").load(str(tmp_path / "c"))
    assert sorted(r["frame_number"] for r in read.collect()) == sorted(r[0] for r in rows)
    assert read.where("frame_number < -3").count() == 9 and read.where("frame_number IN (-6, 5)").count() == 6
    monkeypatch.setattr(clust, "SPLIT_BYTES", 300)
    reader = clust.ClusterReader(str(tmp_path / "c"), clust.cluster_dtype(3, 3, "i4"))
    parts = reader.partitions()
    assert len(parts) > 3 and sum(b.num_rows for p in parts for b in reader.read(p)) == len(rows)
    broken = next((tmp_path / "c").glob("*.clust"))
    broken.write_bytes(broken.read_bytes()[:-1])
    with pytest.raises(OSError, match="ends inside"):
        [b for p in reader.partitions() for b in reader.read(p)]


def test_adc_sar_of_board_frames(spark):
    from photonspark.functions import decode
    from photonspark.operators import transforms

    word = sum(1 << b for b in decode.SAR_04[:3])
    frames = spark.createDataFrame([(0, struct.pack("<2Q", word, 1 << decode.SAR_04[11]))], "frame_index long, bytes binary")
    assert transforms.adc_sar(frames, decode.SAR_04).first()["data"] == [7, 1 << 11]
