import math

import numpy as np
import pandas as pd

from pricelens.operators import distribution


def _df(spark, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.choice(["p", "q"], 800), "v": np.round(rng.gamma(4, 500, 800), 2)})
    pdf.loc[0, "v"] = 1e6  # an outlier
    return pdf, spark.createDataFrame(pdf)


def test_box_stats_against_numpy(spark):
    pdf, df = _df(spark)
    out = distribution.box_stats(df, ["g"], "v").toPandas()
    for _, r in out.iterrows():
        x = pdf.loc[pdf.g == r.g, "v"].to_numpy()
        q1, med, q3 = np.percentile(x, [25, 50, 75])
        lf, uf = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert r.n == len(x)
        assert math.isclose(r["median"], med)
        assert r.whisker_low == x[x >= lf].min() and r.whisker_high == x[x <= uf].max()
        assert r.n_outliers == int(((x < lf) | (x > uf)).sum())


def test_histogram_density_integrates_to_one(spark):
    _, df = _df(spark)
    out = distribution.histogram(df, ["g"], "v", 75.0).toPandas()
    for _, grp in out.groupby("g"):
        assert math.isclose((grp.density * 75.0).sum(), 1.0, rel_tol=1e-9)
        assert grp.bin_start.min() == grp.bin_start.iloc[grp.bin_index.argmin()]


def test_kde_matches_brute_force(spark):
    pdf, df = _df(spark)
    out = distribution.kde(df, ["g"], "v", points=50).toPandas()
    for g, grp in out.groupby("g"):
        x = pdf.loc[pdf.g == g, "v"].to_numpy()
        h = x.std(ddof=1) * len(x) ** (-0.2)
        grid = x.min() + (np.arange(50) * (x.max() - x.min())) / 50
        dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
        got = grp.sort_values("grid_index").density.to_numpy()
        np.testing.assert_allclose(got, dens, rtol=1e-9, atol=1e-17)
