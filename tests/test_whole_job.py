"""Registered queries do the whole job: no frames, rows or pixels are left out."""

from __future__ import annotations

import duckdb
import pytest

from photonspark.plans import catalogue, oracle

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem",):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def test_components_of_all_frames(spark, duck):
    got = sorted(map(tuple, catalogue.QUERIES["g4_components"](spark, SMALL).collect()))
    assert {frame for frame, _, _ in got} - set(range(8))
    assert got == sorted(duck.sql(oracle.COMPONENTS).fetchall())


def test_frame_sync_of_all_rows(spark, duck):
    got = sorted(map(tuple, catalogue.QUERIES["j1_frame_sync"](spark, SMALL).select("idx", "frame_number").collect()))
    assert got == sorted(duck.sql(oracle.SYNC).fetchall())


def test_component_sizes_count_every_pixel(spark):
    large = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{large}/lineitem.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES["g4_components"](spark, large).collect()))
    assert max(size for _, _, size in got) > 50
    assert got == sorted(con.sql(oracle.COMPONENTS).fetchall())
