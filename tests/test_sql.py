"""Queries whose SQL says the same, side by side on the smallest tables."""

import math
import os

import duckdb
import pytest

from voxlattice.catalog import ORACLES, QUERIES
from voxlattice.plans import batches, cuts, modes, solids, splines, variants

NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ in {m.__name__ for m in (variants, modes, cuts, solids, splines, batches)} and n in ORACLES and n not in ("agg21_auto_mask", "prj12_slice_fill"))  # those two: test_bodies
NAMES += ["top3_box_sweep", "src7_normalised_frame", "snk6_column_major", "prj17_status_and_pack", "agg5_spatial_temporal", "agg9_histogram", "agg24_difference_statistics", "join3_stencil", "win7_plane_fit", "win10_median_test", "trj2_extensometer", "set4_same_settings", "fn11_subset_count"]


def plain(v):
    return (None if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        if t.endswith(".parquet"):
            con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    order = [[d[0] for d in result.description].index(c) for c in names]
    assert len(order) == len(result.description) and got
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
