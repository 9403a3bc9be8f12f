import numpy as np
import pandas as pd
import pytest

from pricelens.operators.longtrend import long_lowess, plan_windows
from pricelens.operators.trend import lowess_fit


def _check(spark, series, **kw):
    """Values of one or several series against the plain fit of each."""
    pdf = pd.concat([pd.DataFrame({"s": s, "x": x, "y": y}) for s, (x, y) in series.items()])
    pdf["s"] = pdf["s"].where(pdf["s"] != "none", None)
    out = long_lowess(spark.createDataFrame(pdf), ["s"], "x", "y", **kw).toPandas()
    assert len(out) == len(pdf)
    fit = {k: v for k, v in kw.items() if k in ("frac", "iterations")}
    for s, (x, y) in series.items():
        got = out[out.s.isna() if s == "none" else out.s == s].sort_values("x")
        order = np.argsort(x)
        want = lowess_fit(x[order], y[order], **fit)
        np.testing.assert_allclose(got["trend"].to_numpy(), want, rtol=1e-6, atol=1e-6 * np.abs(y).max())


def _series(rng, n, spread):
    x = np.unique(spread(rng, n)).astype(float)
    y = 3000 + 200 * np.sin(6 * (x - x.min()) / (np.ptp(x) or 1.0)) + rng.normal(0, 30, len(x))
    y[:: 17] += 2500  # outliers, down-weighted between rounds
    return rng.permutation(np.stack([x, y], axis=1)).T


@pytest.mark.parametrize("frac", [(2, 3), (1, 10)])
def test_series_of_all_shapes_match_the_plain_fit(spark, frac):
    rng = np.random.default_rng(3)
    even = _series(rng, 900, lambda r, n: np.arange(n))
    dense = _series(rng, 700, lambda r, n: np.exp(r.uniform(0, 12, n)))  # window ends sweep many blocks
    short, one = _series(rng, 5, lambda r, n: np.arange(n)), (np.array([4.0]), np.array([7.0]))
    _check(spark, {"even": even, "none": dense, "short": short, "one": one}, frac=frac, iterations=2, block_points=32)


@pytest.mark.parametrize("n", [1, 8, 9, 63, 65, 97, 160])
@pytest.mark.parametrize("frac", [(2, 3), (1, 10), (1, 1)])
def test_near_blocks_and_runs_are_apart_and_cover_the_window(n, frac):
    size, k = 8, max(1, n * frac[0] // frac[1])
    x = np.cumsum(np.random.default_rng(n).exponential(1.0, n))
    begins = range(0, n, size)
    rows = plan_windows(x[::size], np.array([x[min(n, b + size) - 1] for b in begins]), n, k, size)
    for row in rows:
        far = [b for f in row["far"] for b in range(f["run"] << f["level"], (f["run"] + 1) << f["level"])]
        met = row["near"] + far
        assert len(met) == len(set(met))
        for f in row["far"]:
            blocks = range(f["run"] << f["level"], (f["run"] + 1) << f["level"])
            assert blocks[0] > row["_b"] if f["side"] > 0 else blocks[-1] < row["_b"]
        for i in range(row["_b"] * size, min(n, (row["_b"] + 1) * size)):
            h = np.partition(np.abs(x - x[i]), k - 1)[k - 1]
            inside = np.abs(x - x[i]) < h
            assert {int(j) // size for j in np.flatnonzero(inside)} <= set(met)
            assert all(inside[j] for b in far for j in range(b * size, (b + 1) * size))


def test_last_block_of_one_point(spark):
    x = np.arange(129.0)
    _check(spark, {"a": (x, 50 + np.random.default_rng(1).normal(0, 5, 129))}, block_points=8, iterations=1)


def test_flat_series_keeps_its_value(spark):
    x = np.arange(100.0)
    _check(spark, {"flat": (x, np.full(100, 5.0))}, block_points=8)


def test_no_rows(spark):
    assert long_lowess(spark.createDataFrame([], "s string, x int, y double"), ["s"], "x", "y").count() == 0


def test_long_series_is_many_tasks_work(spark):
    """100,000 points: no block meets more than a few blocks and runs, and values equal the plain fit at sampled targets."""
    n, size = 100_000, 1024
    rng = np.random.default_rng(9)
    x = np.cumsum(rng.exponential(1.0, n))
    blocks = range(0, n, size)
    rows = plan_windows(np.array([x[b] for b in blocks]), np.array([x[min(n, b + size) - 1] for b in blocks]), n, n * 2 // 3, size)
    assert max(len(r["near"]) for r in rows) <= 12 and max(len(r["far"]) for r in rows) <= 24
    y = 100 + np.sin(x / 9000) * 20 + rng.normal(0, 1, n)
    frame = spark.createDataFrame(pd.DataFrame({"s": "a", "x": x, "y": y}))
    got = long_lowess(frame, ["s"], "x", "y", iterations=0, block_points=size).toPandas().sort_values("x")["trend"].to_numpy()
    k = n * 2 // 3
    for i in [0, 1, 777, 33_333, 50_000, 66_700, 99_998, 99_999]:
        d = np.abs(x - x[i])
        h = np.partition(d, k - 1)[k - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        mx, my = (w @ x) / w.sum(), (w @ y) / w.sum()
        want = my + (w * (x - mx)) @ (y - my) / ((w * (x - mx)) @ (x - mx)) * (x[i] - mx)
        assert abs(got[i] - want) < 1e-7
