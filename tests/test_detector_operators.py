"""Table operators against literal values and numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from photonspark.functions.clusters import Shape
from photonspark.operators import calibration, finder, fit, folds, geometry, histogram, interpolation, sync, transforms

G1, G2 = 1 << 14, 3 << 14


def frames(spark, images):
    rows = [(f, int(r), int(c), int(image[r, c])) for f, image in enumerate(images) for r, c in np.ndindex(*image.shape)]
    return spark.createDataFrame(rows, "frame long, row long, col long, raw long")


def test_pedestal_by_gain(spark):
    pixels = {(0, 0): [100, 200, 300], (0, 1): [G1 + 100, G1 + 200, G1 + 300], (1, 0): [G1 + 37, 38, G2 + 39], (1, 1): [G2 + 100, G2 + 200, G2 + 300]}
    images = [np.array([[pixels[r, c][f] for c in range(2)] for r in range(2)]) for f in range(3)]
    df = frames(spark, images)
    got = {(r["gain"], r["row"], r["col"]): r["mean"] for r in calibration.pedestal(df, (2, 2)).collect()}
    want = {0: [[200, 0], [38, 0]], 1: [[0, 200], [37, 0]], 2: [[0, 0], [39, 200]]}
    assert got == {(g, r, c): want[g][r][c] for g in want for r in range(2) for c in range(2)}
    assert {(r["row"], r["col"]): r["switches"] for r in calibration.switching_pixels(df).collect()} == {(0, 0): 0, (0, 1): 3, (1, 0): 2, (1, 1): 3}


def test_apply_calibration(spark):
    df = spark.createDataFrame([(0, 0, 0, 100), (2, 3, 3, G1 + 1000), (1, 1, 4, G2 + 857), (2, 2, 2, 0)], "frame long, row long, col long, raw long")
    grid = calibration.grid(spark, 4, 5, gains=3)
    at = lambda g, r, c: (F.col("gain") == g) & (F.col("row") == r) & (F.col("col") == c)
    ped = grid.withColumn("mean", F.when(at(0, 0, 0), 10.0).when(at(1, 3, 3), 500.0).when(at(2, 1, 4), 100.0).otherwise(0.0))
    cal = grid.withColumn("cal", F.when(at(0, 0, 0), 43.7).when(at(1, 3, 3), 2.0).when(at(2, 1, 4), 3.0).otherwise(1.0))
    got = {(r["row"], r["col"]): r["energy"] for r in calibration.apply_calibration(df, ped, cal).collect()}
    assert got == pytest.approx({(0, 0): 90 / 43.7, (3, 3): 250.0, (1, 4): 757 / 3, (2, 2): 0.0})
    g0 = calibration.apply_calibration_g0(df, ped.where("gain = 0").drop("gain"), cal.where("gain = 0").drop("gain"))
    assert {(r["row"], r["col"]): r["energy"] for r in g0.collect()} == pytest.approx({(0, 0): 90 / 43.7, (3, 3): 0.0, (1, 4): 0.0, (2, 2): 0.0})


def test_running_pedestal(spark):
    rows = [(r, c, k, float(r + c)) for r in range(3) for c in range(3) for k in range(50)]
    df = spark.createDataFrame(rows, "row long, col long, k long, v double")
    for r in folds.running_pedestal(df, "v", ["k"], 5).collect():
        s = r["row"] + r["col"]
        assert (r["samples"], r["total"], r["total2"], r["mean"], r["std"]) == (5, 5 * s, 5 * s * s, s, 0)
    noisy = spark.createDataFrame([(0, 0, k, float(v)) for k, v in enumerate(np.random.default_rng(1).normal(5, 2, 2000))], "row long, col long, k long, v double")
    got = folds.running_pedestal(noisy, "v", ["k"], 1000).first()
    assert got["mean"] == pytest.approx(5, rel=0.1) and got["std"] == pytest.approx(2, rel=0.1)
    plain = folds.pedestal_no_update(noisy.where("k < 1000"), "v").first()
    assert plain["mean"] == pytest.approx(folds.running_pedestal(noisy.where("k < 1000"), "v", ["k"], 1000).first()["mean"])


def test_pedestal_threshold_and_fast():
    p = folds.Pedestal(4)
    for v in (10, 10, 10, 10):
        p.push(v)
    p.push_with_threshold(100, 5)
    assert p.mean == 10
    p.push_with_threshold(12, 5)
    assert p.mean == pytest.approx(10.5)
    young = folds.Pedestal(10)
    young.push_fast(10)
    assert young.mean == pytest.approx(1.0) and young.n == 0


def test_histogram_bins(spark):
    df = spark.createDataFrame([(0, 0, v) for v in (0.05, 0.0999, 0.1, -0.1, 1.0, 1.1, float("nan"))], "row long, col long, v double")
    assert {(r["bin"], r["count"]) for r in histogram.pixel_histogram(df, F.col("v"), 10, 0.0, 1.0).collect()} == {(0, 2), (1, 1)}
    many = spark.range(350).select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0.5).alias("v"))
    assert histogram.pixel_histogram(many, F.col("v"), 10, 0.0, 1.0, "u8").first()["count"] == 255
    for bad in ((0, 0.0, 1.0), (5, 1.0, 1.0)):
        with pytest.raises(ValueError):
            histogram.check(*bad)
    assert histogram.bin_centers(2, 0.0, 1.0) == [0.25, 0.75]


def test_hitmap(spark):
    cv = spark.createDataFrame([(0, 0), (1, 1), (1, 1), (2, 2), (9, 1)], "x long, y long")
    assert {(r["row"], r["col"]): r["count"] for r in histogram.hitmap(cv, 5, 5).collect()} == {(0, 0): 1, (1, 1): 2, (2, 2): 1}


def cube(spark, values):
    return spark.createDataFrame([(i, j, 0, int(values[i][j])) for i in range(len(values)) for j in range(len(values[0]))], "ix long, iy long, ie long, count long")


def test_interpolation_cubes(spark):
    first = cube(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    got = {(r["ix"], r["iy"]): (r["ietax"], r["ietay"]) for r in interpolation.cdf(first).collect()}
    x, y = [0, 0, 0, 4 / 11, 5 / 13, 6 / 15, 1, 1, 1], [0, 2 / 5, 1, 0, 5 / 11, 1, 0, 8 / 17, 1]
    assert [got[i, j] for i in range(3) for j in range(3)] == [pytest.approx(v) for v in zip(x, y)]
    rosen = {(r["ix"], r["iy"]): r["ietax"] for r in interpolation.rosenblatt(first).collect()}
    assert [rosen[i, 0] for i in range(3)] == pytest.approx([0, 15 / 39, 1])


def test_interpolate_zero_cube(spark):
    table = spark.range(29 * 29 * 19).select(F.expr("id div 551").alias("ix"), F.expr("id div 19 % 29").alias("iy"), F.expr("id % 19").alias("ie"), F.lit(0.0).alias("ietax"), F.lit(0.0).alias("ietay"))
    edges = [i * 5 / 29 for i in range(30)]
    cv = spark.createDataFrame([(1, 1, [1] * 9)], "x long, y long, data array<int>")
    got = interpolation.interpolate(cv, Shape(3, 3), "eta2", table, edges, edges, [i * 10 / 19 for i in range(20)]).first()
    assert (got["px"], got["py"], got["energy"]) == (0.5, 0.5, 4)
    small = spark.createDataFrame([(1, 1, [1] * 4)], "x long, y long, data array<int>")
    got = interpolation.interpolate(small, Shape(2, 2), "eta2", table, edges, edges, [i * 10 / 19 for i in range(20)]).first()
    assert (got["px"], got["py"], got["energy"]) == (0.5, 0.5, 4)


GEOMETRY = [
    ((1, 2), 1024, 512, (1, 1), False, [(0, 0), (1024, 0)]),
    ((2, 2), 512, 256, (1, 2), False, [(0, 0), (512, 0), (0, 256), (512, 256)]),
    ((4, 1), 1024, 256, (2, 1), False, [(0, 0), (0, 256), (0, 512), (0, 768)]),
    ((2, 1), 512, 256, (2, 1), True, [(0, 256), (0, 0)]),
]


@pytest.mark.parametrize(("shape", "px", "py", "udp", "quad", "origins"), GEOMETRY)
def test_geometry(spark, shape, px, py, udp, quad, origins):
    got = geometry.modules(spark, shape, px, py, udp, quad).orderBy("module").collect()
    assert [(r["origin_x"], r["origin_y"]) for r in got] == origins


def test_pixel_maps_are_permutations(spark):
    for df, n in ((geometry.moench03(spark), 160000), (geometry.moench04(spark), 160000), (geometry.matterhorn02(spark, 4), 9216), (geometry.matterhorn10(spark, 8, 2), 131072), (geometry.eiger_flip(spark), 131072)):
        got = df.agg(F.count_distinct("src_index"), F.min("src_index"), F.max("src_index"), F.count_distinct(*[c for c in df.columns if c != "src_index"])).first()
        assert tuple(got) == (n, 0, n - 1, n)
    with pytest.raises(ValueError):
        geometry.matterhorn10(spark, 12, 1)


def test_matterhorn10_rows_run_backwards(spark):
    """Each row of the chip holds 255..0 after the read-out order is undone."""
    at = transforms.map_array(geometry.matterhorn10(spark, 16, 1))
    wire = np.empty(65536, dtype="<u2")
    wire[at] = np.tile(np.arange(255, -1, -1), 256)
    df = spark.createDataFrame([(0, wire.tobytes())], "frame_index long, bytes binary")
    assert np.array(transforms.matterhorn10(df).first()["data"]).reshape(256, 256)[7].tolist() == list(range(255, -1, -1))


def test_frame_sync(spark):
    rows = [(0, f) for f in (1, 2, 3, 5, 6, 9000)] + [(1, f) for f in (1, 3, 4, 5, 6, 9000)]
    got = {r["idx"]: r["frame_number"] for r in sync.frame_sync(spark.createDataFrame(rows, "module long, frame_number long"), 2).collect()}
    assert got == {0: 1, 1: 3, 2: 5, 3: 5, 4: 6, 5: 9000}


def brute_find(images, n_pedestal, n_shards, shape, n_sigma, n_samples):
    """A literal scan with one pedestal a shard."""
    out, shards = [], [{"s": np.zeros(shape), "s2": np.zeros(shape), "n": np.zeros(shape), "m": np.zeros(shape)} for _ in range(n_shards)]
    for f, image in enumerate(images):
        image = image.astype(float)
        if f < n_pedestal:
            for p in shards:
                p["s"] += image
                p["s2"] += image**2
                p["n"] += 1
                p["m"] = p["s"] / p["n"]
            continue
        p = shards[f % n_shards]
        for r, c in np.ndindex(*shape):
            rms = np.sqrt(max(0, p["s2"][r, c] / p["n"][r, c] - (p["s"][r, c] / p["n"][r, c]) ** 2))
            v = image[r, c] - p["m"][r, c]
            if v < -n_sigma * rms:
                continue
            window = {(a, b): image[a, b] - p["m"][a, b] for a in range(r - 1, r + 2) for b in range(c - 1, c + 2) if 0 <= a < shape[0] and 0 <= b < shape[1]}
            top, total = max(0, *window.values()), sum(window.values())
            if top > n_sigma * rms:
                if v < top:
                    continue
            elif not total > 3 * n_sigma * rms:
                p["s"][r, c] += image[r, c] - p["s"][r, c] / n_samples
                p["s2"][r, c] += image[r, c] ** 2 - p["s2"][r, c] / n_samples
                p["m"][r, c] = p["s"][r, c] / n_samples
                continue
            if v == top:
                rounded = lambda x: int(np.floor(abs(x) + 0.5) * np.sign(x))
                out.append((f, c, r, [rounded(window.get((a, b), 0)) for a in range(r - 1, r + 2) for b in range(c - 1, c + 2)]))
    return sorted(out)


def test_exact_finder_matches_brute_force(spark):
    draw, shape = np.random.default_rng(2), (6, 7)
    images = [np.round(draw.normal(100, 5, shape)).astype(int) for _ in range(24)]
    for image in images[10:]:
        image[draw.integers(6), draw.integers(7)] += 200
    df = spark.createDataFrame([(f, image.ravel().tolist()) for f, image in enumerate(images)], "frame long, data array<long>")
    got = finder.exact_clusters(df, shape, n_pedestal=10, n_shards=2, n_sigma=3.0, n_samples=10)
    assert sorted((r["frame"], r["x"], r["y"], r["data"]) for r in got.collect()) == brute_find(images, 10, 2, shape, 3.0, 10)


def test_frozen_clusters_keep_ties(spark):
    image = np.zeros((4, 5), dtype=int)
    image[1, 1] = image[1, 2] = 50
    px = frames(spark, [image]).withColumnRenamed("raw", "value")
    pedestal = calibration.grid(spark, 4, 5).withColumn("mean", F.lit(0.0)).withColumn("std", F.lit(1.0))
    got = finder.frozen_clusters(finder.pack(px, 4, 5), pedestal, (4, 5)).collect()
    assert sorted((r["x"], r["y"]) for r in got) == [(1, 1), (2, 1)]
    assert {tuple(r["data"]) for r in got} == {(0, 0, 0, 0, 50, 50, 0, 0, 0), (0, 0, 0, 50, 50, 0, 0, 0, 0)}


def test_variable_clusters(spark):
    image = np.zeros((6, 6), dtype=int)
    image[0, 0], image[1, 1], image[4, 4] = 10, 30, 20
    df = spark.createDataFrame([(3, image.ravel().tolist())], "frame long, data array<long>")
    found = sorted(finder.variable_clusters(df, (6, 6), 5).collect(), key=lambda r: -r["size"])
    assert [(r["size"], r["row"], r["col"], r["energy"], r["max"]) for r in found] == [(2, 1, 1, 40.0, 30.0), (1, 4, 4, 20.0, 20.0)]
    four = finder.variable_clusters(df, (6, 6), 5, flood=True, neighbours=4)
    assert four.count() == 3
    big = finder.hits_of(np.full((8, 8), 9.0), 1)
    assert (big[0]["size"], big[0]["energy"]) == (50, 450.0) and finder.flood_hits(np.full((8, 8), 9.0), 1)[0]["size"] == 64


def test_tracking_histogram(spark):
    draw = np.random.default_rng(3)
    seq = [(k < 20, int(v)) for k, v in enumerate(draw.normal(100, 4, 120))]
    df = spark.createDataFrame([(0, 0, k, p, v) for k, (p, v) in enumerate(seq)], "row long, col long, k long, p boolean, v long")
    state = folds.Tracking(32, -16.0, 16.0, 1.0, 1000)
    for p, v in seq:
        state.step(p, v)
    got = {r["bin"]: r["count"] for r in folds.tracking_histogram(df, "v", "p", ["k"], 32, -16.0, 16.0).collect()}
    assert got == state.counts and sum(got.values()) > 90
    assert state.pedestal.n > 20


CURVES = [("gaussian", [1000, 50, 5]), ("gaussian", [500, 25, 1]), ("rising_scurve", [5, 0.02, 50, 6, 100, 0.1]), ("falling_scurve", [5, 0.02, 50, 6, 100, 0.1]), ("gaussian_erfc_plateau", [800, 200, 50, 4]), ("gaussian_charge_sharing", [20, 0.05, 60, 4, 900, 0.2])]


@pytest.mark.parametrize(("name", "p"), CURVES)
def test_fits_recover_parameters(spark, name, p):
    x = np.linspace(0, 100, 200)
    y = fit.MODELS[name].f(x, np.array([p], float))[0]
    df = spark.createDataFrame([(0, 0, y.tolist()), (0, 1, [0.0] * 200)], "row long, col long, y array<double>")
    model = fit.FitModel(name, compute_errors=True)
    got = {r["col"]: r for r in fit.fit_pixels(df, model, x.tolist()).collect()}
    fitted = model(x, got[0]["par"])
    assert np.abs(fitted - y).max() < 1e-3 * np.abs(y).max()
    assert got[0]["ndf"] == 200 - model.n_par and np.isfinite(got[1]["par"]).all()


def test_fit_model_settings():
    m = fit.FitModel("gaussian")
    m.fix_parameter("mu", 3.0)
    m.set_parameter(0, 5.0)
    m.set_par_limits("sigma", 0.5, 9.0)
    x = np.linspace(0, 10, 50)
    y = fit.MODELS["gaussian"].f(x, np.array([[7.0, 3.0, 1.2]]))
    found = fit.minimise(m, x, y)
    assert found["par"][0] == pytest.approx([7.0, 3.0, 1.2], rel=1e-4)
    m.release_parameter("mu")
    assert m.fixed == {} and m.par_names == ("A", "mu", "sigma")


def test_closed_forms(spark):
    rows = [(k, x, 2 + 3 * x + k * x * x) for k in range(3) for x in range(6)]
    df = spark.createDataFrame(rows, "k long, x long, y long")
    for r in fit.fit_pol2(df, ["k"], F.col("x"), F.col("y")).collect():
        assert (r["p0"], r["p1"], r["p2"]) == pytest.approx((2, 3, r["k"]), abs=1e-9)
    line = fit.fit_pol1(df.where("k = 0"), ["k"], F.col("x"), F.col("y"), 1 + F.col("x")).first()
    assert (line["p0"], line["p1"]) == pytest.approx((2, 3))


def test_legacy_fits(spark):
    x = np.linspace(0, 10, 40)
    df = spark.createDataFrame([(0, 0, (3 + 2 * x).tolist(), [0.5] * 40)], "row long, col long, y array<double>, y_err array<double>")
    line = fit.fit_legacy(df, "pol1", x.tolist()).first()
    assert line["par"] == pytest.approx([2, 3], rel=1e-6) and line["Ndf"] == 38
    assert fit.fit_legacy(df.drop("y_err"), "gaus", x.tolist()).columns == ["row", "col", "par"]


def test_frozen_clusters_match_brute_force(spark):
    draw, shape, sx, sy = np.random.default_rng(6), (7, 9), 5, 3
    images = [np.round(draw.normal(50, 9, shape)).astype(int) for _ in range(6)]
    mean, std = draw.normal(50, 1, shape), draw.uniform(3, 6, shape)
    pedestal = spark.createDataFrame([(r, c, float(mean[r, c]), float(std[r, c])) for r in range(7) for c in range(9)], "row long, col long, mean double, std double")
    packed = spark.createDataFrame([(f, i.ravel().tolist()) for f, i in enumerate(images)], "frame long, data array<long>")
    want = []
    for f, image in enumerate(images):
        v = np.floor((image - mean) * 1e6 + 0.5)
        for r, c in np.ndindex(*shape):
            near = {(dy, dx): v[r + dy, c + dx] if 0 <= r + dy < 7 and 0 <= c + dx < 9 else 0.0 for dy in (-1, 0, 1) for dx in range(-2, 3)}
            limit, most = 1.5e6 * std[r, c], max(0.0, *near.values())
            if v[r, c] >= -limit and v[r, c] == most and (most > limit or sum(near.values()) > np.sqrt(15) * limit):
                want.append((f, c, r, [int(np.sign(x) * np.floor(abs(x) / 1e6 + 0.5)) for x in near.values()]))
    got = finder.frozen_clusters(packed, pedestal, shape, 1.5, sx, sy).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def test_pack_fills_and_keeps_the_largest(spark):
    px = spark.createDataFrame([(0, 0, 1, 5), (0, 1, 2, 7), (0, 1, 2, 6), (0, 9, 0, 1), (3, 0, 0, None), (3, 1, 0, -2)], "frame long, row long, col long, value long")
    assert {r["frame"]: r["data"] for r in finder.pack(px, 2, 3).collect()} == {0: [0, 5, 0, 0, 0, 7], 3: [0, 0, 0, -2, 0, 0]}
    halves = px.withColumn("value", F.col("value") / 2)
    assert {r["frame"]: r["data"] for r in finder.pack(halves, 2, 3).collect()}[0] == [0, 2.5, 0, 0, 0, 3.5]
    large = finder.pack(spark.range(512 * 1024).select(F.lit(1).alias("frame"), F.floor(F.col("id") / 1024).alias("row"), (F.col("id") % 1024).alias("col"), F.col("id").alias("value")), 512, 1024)
    assert large.select(F.col("data")[524_287], F.size("data")).first() == (524_287, 524_288)


@pytest.mark.parametrize("block", [7, 200_000])
def test_folds_of_many_pixels_match_one_at_a_time(spark, monkeypatch, block):
    monkeypatch.setattr(folds, "BLOCK_ROWS", block)
    draw = np.random.default_rng(block)
    rows = [(int(draw.integers(3)), int(draw.integers(4)), k, bool(k < 90), int(v), 6.0) for k, v in enumerate(draw.normal(100, 4, 600))]
    df = spark.createDataFrame([*rows, (0, 0, 999, True, None, 6.0)], "row long, col long, k long, p boolean, v long, t double")
    pedestals, near, tracked = {}, {}, {}
    for row, col, _, p, v, t in rows:
        pedestals.setdefault((row, col), folds.Pedestal(20)).push(v)
        near.setdefault((row, col), folds.Pedestal(20)).push_with_threshold(v, 300 if not near[row, col].n else t)
        tracked.setdefault((row, col), folds.Tracking(32, -16.0, 16.0, 1.0, 40)).step(p, v)
    flat = lambda held: {k: pytest.approx((p.n, p.sum, p.sum2, p.mean, p.std()), rel=1e-9) for k, p in held.items()}
    got = lambda found: {(r["row"], r["col"]): tuple(r[c] for c in ("samples", "total", "total2", "mean", "std")) for r in found.collect()}
    assert got(folds.running_pedestal(df, "v", ["k"], 20)) == flat(pedestals)
    first = df.withColumn("t", F.when(F.row_number().over(Window.partitionBy("row", "col").orderBy("k")) == 1, 300.0).otherwise(F.col("t")))
    assert got(folds.running_pedestal_with_threshold(first, "v", "t", ["k"], 20)) == flat(near)
    hist = folds.tracking_histogram(df, "v", "p", ["k"], 32, -16.0, 16.0, 1.0, 40)
    assert {(r["row"], r["col"], r["bin"]): r["count"] for r in hist.collect()} == {(*k, b): n for k, s in tracked.items() for b, n in s.counts.items()}
    assert folds.running_pedestal(df.where("false"), "v", ["k"]).count() == 0


def test_frame_sync_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(sync, "RANGE", 16)
    draw = np.random.default_rng(1)
    series = [sorted(draw.choice(400, 300, replace=False).tolist()) for _ in range(3)]
    common = sorted(set(series[0]) & set(series[1]) & set(series[2]))
    want = [(k, next(c for c in common if c >= low)) for k in range(300) if (low := max(s[k] for s in series)) <= common[-1]]
    rows = [(m, f) for m, s in enumerate(series) for f in s]
    df = spark.createDataFrame([*rows, rows[0], (0, None), (None, 3)], "module long, frame_number long")
    assert sorted(map(tuple, sync.frame_sync(df, 3).collect())) == want
    assert sync.frame_sync(df.where("false"), 3).count() == 0
