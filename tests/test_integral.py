"""Integral volumes against NumPy, quantiles with awkward values, and batches that survive a failing sample."""

import numpy as np
import pytest

from voxlattice.operators import integral, stats


def bricks_of(spark, v, edge):
    rows = []
    for b in np.ndindex(*(-(-n // edge) for n in v.shape)):
        part = np.full((edge,) * 3, np.nan)
        src = v[tuple(slice(k * edge, (k + 1) * edge) for k in b)]
        part[tuple(slice(0, n) for n in src.shape)] = src
        if np.isfinite(part).any():
            rows.append((*map(int, b), part.ravel().tolist()))
    return spark.createDataFrame(rows, "bz long, by long, bx long, data array<double>").repartition(3)


def test_boxes_from_eight_lookups(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(5, 1, (9, 8, 7))
    v[8, 7, 6] = np.nan
    lags = 2
    vol = integral.integral_volume(bricks_of(spark, v, 3), 3, lags, 5.0)
    boxes = [(f"b{i}", *(int(x) for lo, n in zip(rng.integers(0, 5, 3), rng.integers(1, 5, 3)) for x in (lo, lo + n))) for i in range(25)]
    boxes = [b for b in boxes if all(b[2 + 2 * k] <= v.shape[k] for k in range(3))]
    boxes += [("all", 0, 9, 0, 8, 0, 7), ("most", 0, 8, 0, 8, 0, 7), ("one", 2, 3, 2, 3, 2, 3), ("beyond", 0, 9, 0, 20, 0, 7)]
    table = spark.createDataFrame(boxes, "box string, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    got = {(r["box"], r["axis"], r["lag"]): (r["pairs"], r["rho"]) for r in integral.box_correlation(vol, 3, lags, table).collect()}
    want = {}
    for name, z0, z1, y0, y1, x0, x1 in boxes:
        w = v[z0:z1, y0:y1, x0:x1]
        if w.size != (z1 - z0) * (y1 - y0) * (x1 - x0) or np.isnan(w).any():
            continue
        d = w - w.mean()
        for k, a in enumerate("zyx"):
            for h in range(lags + 1):
                if h < w.shape[k]:
                    p = np.take(d, range(w.shape[k] - h), k) * np.take(d, range(h, w.shape[k]), k)
                    want[name, a, h] = p.size, p.mean() / w.var() if w.var() > 1e-12 else None
    assert got.keys() == want.keys() and ("most", "x", 2) in got and ("all", "x", 0) not in got
    for k, (pairs, rho) in want.items():
        assert got[k][0] == pairs and (rho is None or got[k][1] == pytest.approx(rho, abs=1e-7))


def test_quantiles_of_awkward_values(spark):
    rows = [(0, float(i)) for i in range(50)] + [(0, float("nan")), (0, float("inf")), (0, None)]
    rows += [(1, -1.7e308), (1, 1.7e308), (1, 0.5), (1, 0.25)] + [(2, 5e-324), (2, 0.0), (2, 5e-324)] + [(3, float("nan")), (3, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}
    few, many = ({r["k"]: tuple(r)[1:] for r in stats.quantiles(df, "v", probs, "k", most=most).collect()} for most in (1000, 2))
    assert few.keys() == many.keys() == {0, 1, 2}
    for k in few:
        assert np.allclose(few[k], many[k], rtol=1e-12, atol=0)
    assert few[0] == (0.0, 24.5, pytest.approx(44.1), 49.0) and few[1][3] == 1.7e308 and few[2][1] == 5e-324
    one = {r["k"]: r for r in stats.summarize(df, "v", "k").collect()}
    assert one[0]["n"] == 50 and one[0]["max"] == 49.0 and one[0]["robust_std"] == pytest.approx(1.4826 * 12.5) and one[3]["n"] == 0 and one[3]["median"] is None


def test_a_batch_survives_failing_samples(spark):
    import pandas as pd

    from voxlattice.operators import batch

    def work(frame, attempt):
        sample = frame["sample_id"].iloc[0]
        if sample == 1:
            raise ValueError("no texture")
        if sample == 2 and attempt < 3:
            return frame["missing"]
        if sample == 4:
            return pd.DataFrame({"sample_id": [], "n": []})
        return pd.DataFrame({"sample_id": [sample], "n": [len(frame)]})

    rows = spark.createDataFrame([(i % 5, "x") for i in range(50)] + [(None, "x")], "sample_id long, v string")
    results, jobs = batch.run_batch(rows, work, "sample_id long, n long", attempts=3)
    assert sorted(map(tuple, results.where("sample_id is not null").collect())) == [(0, 10), (2, 10), (3, 10)]
    got = {r["sample_id"]: (r["state"], r["attempts"], r["reason"]) for r in jobs.collect()}
    assert got[1] == ("failed", 3, "ValueError: no texture") and got[2] == ("done", 3, None) and got[0] == got[3] == got[4] == ("done", 1, None) and len(got) == 6
    assert batch.run_batch(rows.limit(0), work, "sample_id long, n long")[1].count() == 0
