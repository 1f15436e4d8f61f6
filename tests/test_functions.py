"""Scalar functions against literal values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonspark.functions import clusters, decode, models, search
from photonspark.functions.clusters import Shape
from photonspark.operators import calibration


def one(spark, column, **values):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "gain", "value"), [(100, 0, 100), ((1 << 14) + 1000, 1, 1000), ((3 << 14) + 857, 2, 857), ((2 << 14) + 5, 0, 5)])
def test_gain_and_value(spark, raw, gain, value):
    got = one(spark, decode.value_and_gain(F.lit(raw)))
    assert (got["value"], got["gain"]) == (value, gain)


def test_sar_bits(spark):
    for bits in (decode.SAR_05, decode.SAR_04, decode.SAR_05_06_07_08):
        words = [1 << b for b in bits]
        df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w long")
        assert [r[0] for r in df.orderBy("i").select(decode.pick_bits("w", bits)).collect()] == [1 << i for i in range(12)]
    pack = lambda *b: F.lit(sum(1 << x for x in b)).cast("long")
    assert [one(spark, decode.pick_bits(pack(*b), decode.SAR_05)) for b in ((29, 19, 28), (18, 27, 25), (25, 22))] == [7, 1096, 3072]


@pytest.mark.parametrize(("word", "want"), [(1, 1.0), (2, 2.1), (4, 3.24), (7, 6.34)])
def test_custom_weights(spark, word, want):
    assert one(spark, decode.custom_weights(F.lit(word), [1.7, 2.1, 1.8])) == pytest.approx(want, abs=1e-3)


def test_custom_weights_at_most_16():
    with pytest.raises(ValueError):
        decode.custom_weights("x", [1.0] * 17)


@pytest.mark.parametrize(("word", "offset", "want"), [(0xFFFFFFFF, 0, 0xFFFFFF), (0xFF0000D9, 0, 0xD9), (16777217, 0, 1), (0xFFFF, 4, 0xFFF), (0xFF000D9F, 4, 0xF000D9), (15, 7, 0), (0x8000000F, 7, 0)])
def test_mask24(spark, word, offset, want):
    assert one(spark, decode.mask24(F.lit(word).cast("long"), offset)) == want


def test_expand_bytes(spark):
    lit = lambda h: F.lit(bytes.fromhex(h))
    assert one(spark, decode.expand24to32(lit("0F0000FF0000FFFFFF"))) == [0xF, 0xFF, 0xFFFFFF]
    assert one(spark, decode.expand24to32(lit("0000FFFFFF0000FF00"))) == [0xFF0000, 0xFFFF, 0xFF00]
    assert one(spark, decode.expand24to32(lit("0000FFFFFF0000FF0000"), 4)) == [0xFFF000, 0xFFF, 0xFF0]
    assert one(spark, decode.expand24to32(lit(""))) == []
    with pytest.raises(Exception, match="byte count"):
        one(spark, decode.expand24to32(lit("0000FFFFFF0000FF00"), 4))
    assert one(spark, decode.expand4to8(lit("00F0FF00F0FF"))) == [0, 0, 0, 15, 15, 15, 0, 0, 0, 15, 15, 15]
    with pytest.raises(ValueError):
        decode.bit_offset(8)


@pytest.mark.parametrize(("text", "want"), [("5s", 5 * 10**9), ("2.62144ms", 2_621_440), ("100us", 100_000), ("7ns", 7), ("1e-3", 1_000_000), (" 2 s ", 2 * 10**9)])
def test_durations(spark, text, want):
    from photonspark.sources.metadata import duration_ns

    assert one(spark, decode.duration_ns(F.lit(text))) == want == duration_ns(text)


def test_unknown_unit_is_an_error(spark):
    with pytest.raises(Exception, match="unknown unit"):
        one(spark, decode.duration_ns(F.lit("3 h")))


def test_searches(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    a = arr(1, 2, 3, 4, 5)
    cases = [(search.last_smaller, 3, 1), (search.last_smaller, 0, 0), (search.last_smaller, 99, 4), (search.first_larger, 3, 3), (search.first_larger, 0, 0), (search.first_larger, 9, 4), (search.nearest_index, 3.4, 2), (search.nearest_index, 2.5, 1), (search.nearest_index, -9, 0)]
    assert [one(spark, f(a, F.lit(v))) for f, v, _ in cases] == [w for *_, w in cases]
    assert one(spark, search.all_equal(arr(2, 2))) is True and one(spark, search.all_equal(F.array().cast("array<int>"))) is False
    assert search.split_task(0, 10, 3) == [(0, 3), (3, 6), (6, 10)] and search.split_task(0, 2, 5) == [(0, 1), (1, 2)]


ETAS = [
    (2, 2, [1, 2, 1, 3], 0, 7, (3 / 4, 3 / 5), (5 / 7, 4 / 7)),
    (3, 3, [1, 2, 3, 4, 7, 6, 1, 2, 5], 3, 20, (6 / 13, 2 / 9), (11 / 20, 7 / 20)),
    (5, 5, [1, 1, 1, 1, 1, 1, 1, 2, 1, 2, 1, 8, 9, 1, 4, 1, 6, 7, 8, 1, 1, 1, 1, 1, 1], 2, 30, (9 / 17, 7 / 16), (16 / 30, 13 / 30)),
    (4, 2, [1, 4, 4, 2, 5, 6, 7, 3], 0, 21, (7 / 13, 7 / 11), (11 / 21, 13 / 21)),
    (2, 3, [1, 3, 2, 4, 3, 2], 2, 11, (4 / 6, 2 / 6), (6 / 11, 5 / 11)),
    (3, 3, [8, 2, 5, 20, 50, 3, 30, 23, 3], 2, 123, (50 / 70, 23 / 73), None),
    (3, 3, [8, 12, 82, 77, 80, 91, 5, 3, 3], 1, 265, (91 / 171, 80 / 92), None),
]


@pytest.mark.parametrize(("sx", "sy", "data", "corner", "total", "eta", "full"), ETAS)
def test_eta_literals(spark, sx, sy, data, corner, total, eta, full):
    shape, values = Shape(sx, sy), F.array(*map(F.lit, data))
    got = one(spark, clusters.eta2(values, shape))
    assert (got["c"], got["sum"]) == (corner, total) and (got["x"], got["y"]) == pytest.approx(eta)
    if full:
        got = one(spark, clusters.full_eta2(values, shape))
        assert (got["x"], got["y"]) == pytest.approx(full)
    assert one(spark, clusters.total_long(clusters.reduce_to_2x2(values, shape))) == total


def test_eta_2x2_and_reductions(spark):
    lit = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, clusters.eta2_2x2(lit(1, 2, 1, 3)))
    assert (got["c"], got["x"], got["y"]) == (0, pytest.approx(3 / 4), pytest.approx(3 / 5))
    assert one(spark, clusters.reduce_to_2x2(lit(1, 1, 1, 2, 3, 1, 2, 2, 1), Shape(3, 3))) == [2, 3, 2, 2]
    assert one(spark, clusters.reduce_to_2x2(lit(2, 2, 1, 2, 3, 1, 1, 1, 1), Shape(3, 3))) == [2, 2, 2, 3]
    five = [1] * 6 + [2, 1, 1, 1, 2, 2, 3, 1, 1, 1, 2] + [1] * 8
    assert one(spark, clusters.reduce_to_3x3(lit(*five), Shape(5, 5))) == [2, 1, 1, 2, 3, 1, 2, 1, 1]
    best = one(spark, clusters.max_sum_2x2(lit(0, 1, 0, 2, 3, 0, 2, 1, 0), Shape(3, 3)))
    assert (best["sum"], best["index"]) == (8, 2)
    ones = one(spark, clusters.eta2(lit(*[1] * 9), Shape(3, 3)))
    assert (ones["x"], ones["y"], ones["c"], ones["sum"]) == (0.5, 0.5, 0, 4)
    assert one(spark, clusters.eta_line(lit(0, 5), True))["x"] == 0.0


def test_clusters_with_maps(spark):
    cv = spark.createDataFrame([(0, 1, 1, [1] * 9), (1, 0, 1, [1] * 9), (2, 3, 3, [10, 10, 10, 10, 30, 10, 10, 10, 10])], "id long, x long, y long, data array<int>")
    gains = spark.createDataFrame([(r, c, 2.0) for r in range(10) for c in range(10)], "row long, col long, gain double")
    got = {r["id"]: r["data"] for r in clusters.gain_map(cv, gains, Shape(3, 3), 10, 10).collect()}
    assert got == {0: [0] * 9, 1: [0] * 9, 2: [5, 5, 5, 5, 15, 5, 5, 5, 5]}
    noise = spark.createDataFrame([(r, c, 25) for r in range(5) for c in range(5)], "row long, col long, noise int")
    assert [r["id"] for r in clusters.noise_cut(cv, noise, Shape(3, 3)).collect()] == [2]


@pytest.mark.parametrize("x", [-3.0, -0.5, 0.0, 0.1, 1.0, 2.5])
def test_erf(spark, x):
    assert one(spark, models.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=1.5e-7)


def test_models_agree_with_numpy(spark):
    from photonspark.operators.fit import MODELS

    p = [1.0, 0.1, 3.0, 1.5, 10.0, 0.2]
    for name, f in (("rising_scurve", models.rising_scurve), ("falling_scurve", models.falling_scurve)):
        want = MODELS[name].f(np.array([2.5]), np.array([p]))[0, 0]
        assert one(spark, f(F.lit(2.5), [F.lit(v) for v in p])) == pytest.approx(want, rel=1e-9)
    assert one(spark, models.gaussian(F.lit(1.0), [F.lit(v) for v in (2.0, 0.0, 1.0)])) == pytest.approx(2 * math.exp(-0.5))


def test_gain_map_keeps_clusters_apart(spark):
    """Clusters that share a key, or are equal, stay rows of their own, with all their columns."""
    rows = [(1, 4, 4, "a"), (1, 4, 4, "b"), (1, 0, 4, "edge"), (2, 9, 9, "out")]
    cv = spark.createDataFrame([(k, x, y, n, list(range(1, 10))) for k, x, y, n in rows], "id long, x long, y long, note string, data array<long>")
    gains = calibration.grid(spark, 10, 10).withColumn("gain", F.when((F.col("row") == 3) & (F.col("col") == 3), F.lit(0.25)).otherwise(F.lit(0.5))).where("NOT (row = 5 AND col = 5)")
    got = {r["note"]: (r["id"], r["x"], r["y"], r["data"]) for r in clusters.gain_map(cv, gains, Shape(3, 3), 10, 10).collect()}
    scaled = [4, 4, 6, 8, 10, 12, 14, 16, 0]
    assert got == {"a": (1, 4, 4, scaled), "b": (1, 4, 4, scaled), "edge": (1, 0, 4, [0] * 9), "out": (2, 9, 9, [0] * 9)}
    assert "Exchange hashpartitioning(id" not in clusters.gain_map(cv, gains, Shape(3, 3), 10, 10)._jdf.queryExecution().toString()
