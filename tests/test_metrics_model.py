import math

import pandas as pd
from pyspark.sql import functions as F

from pricelens.operators import metrics, model


def test_metrics_perfect_fit_and_identities(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (4.0, 3.0)], "y double, p double")
    r = df.agg(*metrics.metric_columns("y", "p")).collect()[0]
    assert math.isclose(r.rmse ** 2, r.mse, rel_tol=1e-12)
    perfect = metrics.regression_metrics(df, "y", "y").collect()[0]
    assert (perfect.mse, perfect.mae, perfect.r2) == (0.0, 0.0, 1.0)


def test_r2_undefined_for_constant_label(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, p double")
    assert metrics.regression_metrics(df, "y", "p").collect()[0].r2 is None


def test_smape_zero_over_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "y double, p double")
    r = metrics.smape(df, "y", "p").collect()[0]
    assert math.isclose(r.smape, (0 + 200 * 2 / 4) / 2)


def test_split_disjoint_complete_and_stable(spark):
    df = spark.range(0, 5000).select(F.col("id").cast("string").alias("url"))
    a = model.add_split(df).toPandas().set_index("url")
    b = model.add_split(df.repartition(13)).toPandas().set_index("url")
    assert len(a) == 5000 and set(a.split) == {"train", "val", "test"}
    assert (a.split == b.loc[a.index].split).all()
    share = a.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.64) < 0.03 and abs(share["test"] - 0.20) < 0.03


def test_scale_roundtrip_uses_population_std(spark):
    pdf = pd.DataFrame({"price": [1.0, 2.0, 3.0, 10.0]})
    df = spark.createDataFrame(pdf)
    sc = model.fit_scaler(df)
    r = sc.collect()[0]
    assert math.isclose(r["std"], pdf.price.std(ddof=0))
    back = model.unscale(model.scale(df, sc), sc, "price_z", "back").toPandas()
    assert (back.back - back.price).abs().max() < 1e-12


def test_unscale_metrics_modes(spark):
    h = spark.createDataFrame([(0, 0.25, 0.4, 0.5, 0.7)], "epoch int, mse double, mae double, rmse double, r2 double")
    c = metrics.unscale_metrics(h, 100.0, 10.0).collect()[0]
    assert (c.mse, c.mae, c.rmse, c.r2) == (25.0, 4.0, 5.0, 0.7)
    a = metrics.unscale_metrics(h, 100.0, 10.0, "affine").collect()[0]
    assert (a.mse, a.rmse) == (102.5, 105.0)


def test_best_epoch_lowest_rmse(spark):
    h = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 2.0), (3, 5.0)], "epoch int, rmse double")
    r = metrics.best_epoch(h).collect()[0]
    assert (r.epoch, r.rmse) == (1, 2.0)


def test_day_grid_is_half_open(spark):
    prompts = spark.createDataFrame([("a",), ("b",)], "p string")
    out = model.day_grid(prompts, (1, 4)).collect()
    assert sorted((r.p, r.day) for r in out) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]
