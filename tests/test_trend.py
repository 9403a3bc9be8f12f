import numpy as np
import pandas as pd

from pricelens.operators.trend import lowess, lowess_fit


def brute(x, y, frac=(2, 3), iters=3):
    """Point-by-point LOWESS with the same rules, written independently."""
    n = len(x)
    k = max(1, n * frac[0] // frac[1])
    rw = [1.0] * n
    fit = list(y)
    for it in range(iters + 1):
        for i in range(n):
            d = sorted(abs(x[j] - x[i]) for j in range(n))
            h = d[k - 1]
            w = []
            for j in range(n):
                dd = abs(x[j] - x[i])
                w.append(((1 - (dd / h) ** 3) ** 3 if dd < h else 0.0) * rw[j])
            sw = sum(w)
            if sw <= 0:
                fit[i] = y[i]
                continue
            mx = sum(wj * xj for wj, xj in zip(w, x)) / sw
            my = sum(wj * yj for wj, yj in zip(w, y)) / sw
            if sum(1 for wj in w if wj > 0) >= 2:
                sxx = sum(wj * (xj - mx) ** 2 for wj, xj in zip(w, x))
                sxy = sum(wj * (xj - mx) * (yj - my) for wj, xj, yj in zip(w, x, y))
                fit[i] = my + sxy / sxx * (x[i] - mx)
            else:
                fit[i] = my
        if it < iters:
            res = [y[i] - fit[i] for i in range(n)]
            m = float(np.median(np.abs(res)))
            rw = [1.0] * n if m == 0 else [((1 - (r / (6 * m)) ** 2) ** 2 if abs(r / (6 * m)) < 1 else 0.0) for r in res]
    return np.array(fit)


def test_lowess_fit_matches_brute_force():
    rng = np.random.default_rng(5)
    x = np.sort(rng.choice(np.arange(200), 60, replace=False)).astype(float)
    y = 3000 + 2 * x + rng.normal(0, 50, 60)
    y[10] += 2000  # outlier, down-weighted by the robust rounds
    np.testing.assert_allclose(lowess_fit(x, y), brute(list(x), list(y)), rtol=1e-10)


def test_lowess_on_spark_groups(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in ("a", "b"):
        for d in range(40):
            for _ in range(3):
                rows.append((s, d, float(1000 + 5 * d + rng.normal(0, 10))))
    pdf = pd.DataFrame(rows, columns=["s", "day", "price"])
    out = lowess(spark.createDataFrame(pdf), ["s"], "day", "price").toPandas()
    assert len(out) == 80
    for s, grp in out.groupby("s"):
        pts = pdf[pdf.s == s].groupby("day").price.mean()
        exp = lowess_fit(pts.index.to_numpy(float), pts.to_numpy())
        np.testing.assert_allclose(grp.sort_values("day").trend.to_numpy(), exp, atol=1e-7)
