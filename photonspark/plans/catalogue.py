"""Every query of the detector operators, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonspark.functions import clusters, decode, models, search
from photonspark.functions.clusters import Shape
from photonspark.operators import calibration, finder, fit, folds, geometry, histogram, interpolation, sync
from photonspark.plans import oracle, series
from photonspark.plans.views import COLS, ROWS, cl, hits, img, px, scan, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = oracle.SQL

LINE = ["l_orderkey", "l_linenumber", "l_partkey"]
S3, S5, S2 = Shape(3, 3), Shape(5, 5), Shape(2, 2)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h1_pixel_hist(spark, sf_dir)


def spread(df: DataFrame, n: int) -> DataFrame:
    """One column for each element of the array ``data``."""
    return df.select(*[c for c in df.columns if c != "data"], *(F.col("data")[i].alias(f"d{i}") for i in range(n)))


# -- decoding --------------------------------------------------------------------------------------


@query
def d1_gain_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).select(*LINE, decode.value("raw").alias("value"), decode.gain("raw").alias("gain"))


def _word() -> Column:
    return (F.col("l_orderkey") * 2654435761 + F.col("l_partkey") * 40503) % 4294967296


def _picked(bits: tuple[int, ...]) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select(*LINE, decode.pick_bits(_word(), bits).alias("decoded"))


QUERIES |= {"d4_sar05678": _picked(decode.SAR_05_06_07_08), "d5_sar05": _picked(decode.SAR_05), "d6_sar04": _picked(decode.SAR_04)}


@query
def d8_custom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = [1.5 + i / 10 for i in range(12)]
    return px(spark, sf_dir).select(*LINE, F.round(decode.custom_weights("raw", weights), 6).alias("weighted"))


@query
def d9_mask24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE, decode.mask24(_word(), 4).alias("masked"))


def _bytes(n: int) -> Column:
    """The first n bytes of a digest of the id."""
    return F.unhex(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 2 * n))


@query
def d10_expand24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", decode.expand24to32(_bytes(15)).alias("data")), 5)


@query
def d11_expand4to8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", decode.expand4to8(_bytes(4)).cast("array<bigint>").alias("data")), 8)


@query
def d17_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.array(*map(F.lit, ("ns", "us", "ms", "s", "")))[(F.col("event_id") % 5).cast("int")]
    return table(spark, sf_dir, "events").select("event_id", decode.duration_ns(F.concat((F.col("event_id") % 1000).cast("string"), unit)).alias("ns"))


@query
def d19_safe_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE, decode.safe_divide(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio"))


# -- searches --------------------------------------------------------------------------------------

EDGES = (0.0, 5000.0, 10000.0, 20000.0, 40000.0, 60000.0)


def _searched(f: Callable[[Column, Column], Column]) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", f(F.array(*map(F.lit, EDGES)), F.col("o_totalprice") / 5).cast("long").alias("idx"))


QUERIES |= {"a1_last_smaller": _searched(search.last_smaller), "a2_first_larger": _searched(search.first_larger), "a3_nearest": _searched(search.nearest_index)}


@query
def a4_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("v", F.floor(F.col("value") * 100).cast("long"))
    return search.cumsum(rows, "v", ["ts", "event_id"], ["user_id"], "running").select("event_id", "running")


# -- clusters --------------------------------------------------------------------------------------


@query
def c1_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl(spark, sf_dir).select("vec_id", clusters.total_long(F.col("data")).alias("total"))


def _max2x2(shape: Shape) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = clusters.max_sum_2x2(F.col("data"), shape)
        return cl(spark, sf_dir, shape.sx * shape.sy).select("vec_id", best["sum"].alias("sum"), best["index"].alias("corner"))

    return run


QUERIES |= {"c2_max2x2": _max2x2(S3), "c2_max2x2_5x5": _max2x2(S5)}


@query
def c3_reduce2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(cl(spark, sf_dir).select("vec_id", clusters.reduce_to_2x2(F.col("data"), S3).alias("data")), 4)


@query
def c4_reduce3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(cl(spark, sf_dir, 25).select("vec_id", clusters.reduce_to_3x3(F.col("data"), S5).alias("data")), 9)


def _eta(n: int, eta: Column) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = cl(spark, sf_dir, n).select("vec_id", "x", "y", eta.alias("e"))
        return found.select("vec_id", "x", "y", F.col("e.x").alias("eta_x"), F.col("e.y").alias("eta_y"), F.col("e.c").alias("corner"), F.col("e.sum").alias("energy"))

    return run


def _etas() -> dict[str, Query]:
    d = F.col("data")
    return {
        "c5_eta2": _eta(9, clusters.eta2(d, S3)),
        "c5_eta2_5x5": _eta(25, clusters.eta2(d, S5)),
        "c6_eta2_2x2": _eta(4, clusters.eta2_2x2(d)),
        "c7_full_eta2": _eta(9, clusters.full_eta2(d, S3)),
        "c8_full_eta2_2x2": _eta(4, clusters.full_eta2_2x2(d)),
        "c9_eta3": _eta(9, clusters.eta3(d)),
        "c10_cross_eta3": _eta(9, clusters.cross_eta3(d)),
    }


# Column expressions need a running session, so those queries are built when they are called
QUERIES |= {name: (lambda spark, sf_dir, name=name: _etas()[name](spark, sf_dir)) for name in ("c5_eta2", "c5_eta2_5x5", "c6_eta2_2x2", "c7_full_eta2", "c8_full_eta2_2x2", "c9_eta3", "c10_cross_eta3")}


@query
def c14_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cl(spark, sf_dir)
    both = rows.where("vec_id % 2 = 0").unionByName(rows.where("vec_id % 2 = 1")).unionByName(rows.where("vec_id % 5 = 0"))
    return both.select("vec_id", "x", "y", clusters.total_long(F.col("data")).alias("total"))


def _gains(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return calibration.grid(spark, rows, cols).withColumn("gain", (1 + (F.col("row") * 7 + F.col("col")) % 5).cast("double"))


@query
def c16_gain_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(clusters.gain_map(cl(spark, sf_dir), _gains(spark, 400, 400), S3, 400, 400), 9)


@query
def f1_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl(spark, sf_dir).where(clusters.in_roi(F.col("x"), F.col("y"), (20, 200, 0, 1))).select("vec_id", "x", "y")


@query
def f2_noise_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = calibration.grid(spark, 400, 400).withColumn("noise", (F.col("col") * 7 + F.col("row")) % 40)
    return clusters.noise_cut(cl(spark, sf_dir), noise, S3, 400 * 400).select("vec_id", "x", "y")


@query
def f5_hitmap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl(spark, sf_dir).where("x < 100 AND y < 100").select("vec_id", "x", "y")


# -- pedestals and calibration ---------------------------------------------------------------------


@query
def p2_pedestal_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = decode.value("raw")
    s = px(spark, sf_dir).groupBy("row", "col").agg(F.count("*").alias("samples"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"))
    n = F.col("samples")
    spread = F.greatest((F.col("s2") * n - F.col("s") * F.col("s")).cast("double"), F.lit(0.0))
    return s.select("row", "col", "samples", F.round(F.col("s") / n, 6).alias("mean"), F.round(F.sqrt(spread) / n, 6).alias("std"))


@query
def p6_pedestal3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.pedestal(px(spark, sf_dir), (ROWS, COLS))


@query
def p7_pedestal_g0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.pedestal_g0(px(spark, sf_dir))


@query
def p8_switching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.switching_pixels(px(spark, sf_dir))


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = px(spark, sf_dir)
    cal = calibration.grid(spark, ROWS, COLS, gains=3).withColumn("cal", F.col("gain") + 1.0)
    return calibration.apply_calibration(frames, calibration.pedestal(frames, (ROWS, COLS)), cal)


@query
def p9_calibrate3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir).select(*LINE, "l_suppkey", F.round("energy", 6).alias("energy"))


@query
def p10_calibrate_g0(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = px(spark, sf_dir)
    cal = calibration.grid(spark, ROWS, COLS).withColumn("cal", F.lit(2.0))
    found = calibration.apply_calibration_g0(frames, calibration.pedestal_g0(frames), cal)
    return found.select(*LINE, "l_suppkey", F.round("energy", 6).alias("energy"))


@query
def p1_pedestal_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).withColumn("v", F.floor(F.col("value") * 100).cast("double"))
    found = folds.running_pedestal(rows, "v", ["ts", "event_id"], n_samples=20)
    return found.select("row", "col", "samples", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


@query
def p4_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).withColumn("threshold", F.lit(60.0))
    found = folds.running_pedestal_with_threshold(rows, "value", "threshold", ["ts", "event_id"], n_samples=50)
    return found.select("row", "col", "samples", *(F.round(c, 6).alias(c) for c in ("total", "total2", "mean", "std")))


# -- histograms ------------------------------------------------------------------------------------


@query
def h1_pixel_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.pixel_histogram(_calibrated(spark, sf_dir), F.col("energy"), 64, -8000.0, 8000.0)


@query
def h2_hist_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.pixel_histogram(px(spark, sf_dir), decode.value("raw"), 2, 0.0, 16384.0, "u8")


@query
def h5_tracking_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = px(spark, sf_dir).withColumn("v", decode.value("raw")).withColumn("seed", F.col("l_orderkey") % 64 < 16).withColumn("later", ~F.col("seed"))
    return folds.tracking_histogram(rows, "v", "seed", ["later", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 64, -8000.0, 8000.0, n_sigma=1.0)


@query
def h7_hitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("x"), (F.floor(F.col("event_id") / 7) % 50).alias("y"))
    return histogram.hitmap(found, 50, 40)


CUBE = (8, 8, 4)
ENERGY = (-1000.0, 4000.0)


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    eta = clusters.eta2(F.col("data"), S3)
    return histogram.eta_cube(cl(spark, sf_dir), eta, eta["sum"], CUBE, ENERGY)


@query
def h8_eta_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir)


# -- interpolation ---------------------------------------------------------------------------------


@query
def i1_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.cdf(histogram.dense_cube(spark, _cube(spark, sf_dir), CUBE))


@query
def i2_rosenblatt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.rosenblatt(histogram.dense_cube(spark, _cube(spark, sf_dir), CUBE))


def _inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cl(spark, sf_dir).withColumn("e", clusters.eta2(F.col("data"), S3))
    return rows.where("e.x >= -0.1 AND e.x < 1.1 AND e.y >= -0.1 AND e.y < 1.1 AND e.sum >= -1000 AND e.sum < 4000")


def _bins() -> tuple[list[float], list[float], list[float]]:
    return histogram.bin_edges(8, -0.1, 1.1), histogram.bin_edges(8, -0.1, 1.1), histogram.bin_edges(4, *ENERGY)


@query
def i4_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interpolation.interpolate(_inside(spark, sf_dir), S3, "eta2", i1_cdf(spark, sf_dir), *_bins())
    return found.select("vec_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "energy")


@query
def i5_interpolate_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interpolation.interpolate_with(_inside(spark, sf_dir), "e", i1_cdf(spark, sf_dir), *_bins())
    return found.select("vec_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "energy")


# -- pixel maps and geometry -----------------------------------------------------------------------

QUERIES |= {
    "m1_moench03": lambda spark, sf_dir: geometry.moench03(spark),
    "m2_moench04": lambda spark, sf_dir: geometry.moench04(spark),
    "m3_moench05": lambda spark, sf_dir: geometry.moench05(spark),
    "m3_moench05_1g": lambda spark, sf_dir: geometry.moench05(spark, "1g"),
    "m3_moench05_old": lambda spark, sf_dir: geometry.moench05(spark, "old"),
    "m4_eiger_flip": lambda spark, sf_dir: geometry.eiger_flip(spark),
    "m5_matterhorn02": lambda spark, sf_dir: geometry.matterhorn02(spark, 4),
    "m6_matterhorn10": lambda spark, sf_dir: geometry.matterhorn10(spark, 8, 2),
    "m7_geometry": lambda spark, sf_dir: geometry.modules(spark, (2, 2), 512, 256),
}


@query
def m8_roi_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.clip_to_roi(geometry.modules(spark, (2, 2), 512, 256), F.lit(300), F.lit(900), F.lit(100), F.lit(400))


@query
def m9_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = calibration.grid(spark, ROWS, COLS).withColumn("src_index", (ROWS - 1 - F.col("row")) * COLS + F.col("col"))
    pixels = img(spark, sf_dir).select("frame", (F.col("row") * COLS + F.col("col")).alias("pos"), "value")
    return geometry.gather(pixels, flipped).select("frame", "row", "col", "value")


# -- frames and clusters ---------------------------------------------------------------------------


@query
def j1_frame_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("module"), (F.col("l_orderkey") % 997).alias("frame_number")).distinct()
    return sync.frame_sync(rows, 4)


@query
def g1_clusters_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = img(spark, sf_dir)
    v = F.col("value")
    s = frames.groupBy("row", "col").agg(F.sum(v).alias("s"), F.sum(v * v).alias("s2"))
    variance = F.greatest((F.col("s2") * 64 - F.col("s") * F.col("s")).cast("double"), F.lit(0.0))
    pedestal = s.select("row", "col", (F.col("s").cast("double") / 64).alias("mean"), (F.sqrt(variance) / 64).alias("std"))
    return spread(finder.frozen_clusters(finder.pack(frames, ROWS, COLS), pedestal, (ROWS, COLS), n_sigma=1.0), 9)


@query
def g1_clusters_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = finder.pack(img(spark, sf_dir), ROWS, COLS)
    return finder.exact_clusters(frames, (ROWS, COLS), n_pedestal=16, n_sigma=2.0)


@query
def g4_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = finder.pack(img(spark, sf_dir), ROWS, COLS)
    found = finder.variable_clusters(frames, (ROWS, COLS), 15000)
    first = F.array_min(F.zip_with("rows", "cols", lambda r, c: r * COLS + c)).cast("long")
    return found.select("frame", first.alias("label"), F.col("pixels").cast("long").alias("size"))


@query
def g5_floodfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finder.variable_clusters(finder.pack(img(spark, sf_dir), ROWS, COLS), (ROWS, COLS), 15000, flood=True, neighbours=4).drop("pixels")


# -- fits ------------------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("pixel", *(F.round(c, 6).alias(c) for c in df.columns if c != "pixel"))


@query
def r1_pol1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fit.fit_pol1(scan(spark, sf_dir), ["pixel"], F.col("x"), F.col("y")))


@query
def r1w_pol1_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fit.fit_pol1(scan(spark, sf_dir), ["pixel"], F.col("x"), F.col("y"), 1 + F.col("x") % 3))


@query
def r2_pol2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fit.fit_pol2(scan(spark, sf_dir), ["pixel"], F.col("x"), F.col("y")))


@query
def r9_gauss_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir).withColumn("height", F.max("y").over(Window.partitionBy("pixel")))
    high = 2 * F.col("y") > F.col("height")
    width = (F.max(F.when(high, F.col("x"))) - F.min(F.when(high, F.col("x")))) / 2.35
    return rows.groupBy("pixel", "height").agg(F.min(F.when(F.col("y") == F.col("height"), F.col("x"))).alias("mu"), width.alias("sigma"))


@query
def r10_erf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE, F.round(models.erf((F.col("l_quantity") - 25) / 10), 9).alias("erf"))


@query
def d20_scurve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = [F.lit(v) for v in (5.0, 0.1, 25.0, 6.0, 100.0, 0.5)]
    return table(spark, sf_dir, "lineitem").select(*LINE, F.round(models.rising_scurve(F.col("l_quantity"), p), 6).alias("y"))


@query
def r12_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit.chi2_of(scan(spark, sf_dir), ["pixel"], F.col("y").cast("double"), (3 * F.col("x")).cast("double"))
    return found.select("pixel", F.round("chi2", 6).alias("chi2"))


def _fitted(model: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = px(spark, sf_dir).select("row", "col", (F.floor(decode.value("raw") / 512)).alias("x")).groupBy("row", "col", "x").agg(F.count("*").alias("y"))
        steps = calibration.grid(spark, ROWS, COLS, gains=32).withColumnRenamed("gain", "x")
        points = fit.pack_points(steps.join(counts, ["row", "col", "x"], "left").na.fill(0, ["y"]))
        return fit.fit_pixels(points, fit.FitModel(model), [float(i) for i in range(32)])

    return run


QUERIES |= {f"{n}_{m}_fit": _fitted(m) for n, m in (("r3", "gaussian"), ("r4", "gaussian_erfc_plateau"), ("r5", "gaussian_charge_sharing"), ("r6", "gaussian_charge_sharing_kb"), ("r7", "rising_scurve"), ("r8", "falling_scurve"))}

# -- files -----------------------------------------------------------------------------------------

QUERIES |= series.QUERIES
