"""Text regression run: history, best epoch, unit conversion, forecast grid."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from pricelens import schema as S
from pricelens.operators import metrics, tokenmean
from pricelens.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history(spark):
    return {r["epoch"]: r for r in E.queries()["metric_history"](spark, SF).collect()}


def test_history_has_one_eval_entry_per_candidate(history):
    assert sorted(history) == list(range(5))
    for r in history.values():
        assert math.isclose(r["rmse"] ** 2, r["mse"], rel_tol=1e-6)


def test_best_epoch_is_smallest_rmse(spark, history):
    best = E.queries()["best_epoch"](spark, SF).first()
    assert best["rmse"] == min(r["rmse"] for r in history.values())
    assert history[best["epoch"]]["rmse"] == best["rmse"]


def test_affine_mode_reproduces_original_conversion(spark, history):
    path = Q.training_run(spark, SF)
    sc = spark.read.parquet(f"{path}/scaler").first()
    raw = {r["epoch"]: r for r in Q.textmodel.read_history(spark, path).collect()}
    aff = {r["epoch"]: r for r in E.queries()["metric_history_affine"](spark, SF).collect()}
    for e, r in raw.items():
        assert math.isclose(aff[e]["mae"], r["mae"] * sc["std"] + sc["mean"], rel_tol=1e-6)
        assert math.isclose(history[e]["mae"], r["mae"] * sc["std"], rel_tol=1e-6)
        assert history[e]["r2"] == aff[e]["r2"]


def test_forecast_grid_and_csv_round_trip(spark):
    fc = E.queries()["text_forecast"](spark, SF)
    rows = fc.collect()
    tags = {r["prompt"] for r in rows}
    assert len(rows) == 89 * len(tags)
    assert {r["day"] for r in rows} == set(range(1, 90))
    back = E.queries()["forecast_csv"](spark, SF).collect()
    assert sorted((r["prompt"], r["day"], r["price"]) for r in back) == \
        sorted((r["prompt"], r["day"], r["price"]) for r in rows)


def test_eval_per_split(spark):
    ev = {r["split"]: r for r in E.queries()["text_regression_eval"](spark, SF).collect()}
    assert set(ev) == {"train", "val", "test"}
    assert all(r["n"] > 0 and r["rmse"] >= 0 for r in ev.values())


def test_metrics_csv_has_every_run(spark):
    rows = E.queries()["metrics_csv"](spark, SF).collect()
    assert {r["run"] for r in rows} == set(Q.TEXT_RUNS)
    assert all(r["epoch"] is not None and r["RMSE"] is not None for r in rows)


def test_missing_model_is_a_clear_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Q.textmodel.load_model(str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        tokenmean.load_run(spark, str(tmp_path / "none"))
    path = Q.training_run(spark, SF)
    with pytest.raises(FileNotFoundError):
        tokenmean.load_run(spark, path, epoch=99)


def test_one_model_is_kept_per_candidate(spark):
    path = Q.training_run(spark, SF)
    for epoch, strength in enumerate(tokenmean.STRENGTHS):
        tokens, params = tokenmean.load_run(spark, path, epoch)
        assert tokens.count() > 0 and params["strength"] == strength


def planted(spark, rows=2000):
    """Prices that follow a word and the day, with a split."""
    price = F.when(F.col("id") % 3 == 0, 900.0).when(F.col("id") % 3 == 1, 500.0).otherwise(300.0) - 2.0 * F.col(S.DAYS_PASSED) + F.col("id") % 7
    word = F.when(F.col("id") % 3 == 0, "max").when(F.col("id") % 3 == 1, "pro").otherwise("mini")
    return (spark.range(rows).withColumn(S.DAYS_PASSED, (F.col("id") * 7 % 50).cast("int"))
            .withColumn("text", F.concat(F.col(S.DAYS_PASSED).cast("string"), F.lit(" days phone "), word, F.lit(" nice")))
            .withColumn(S.PRICE, price).withColumn("split", F.when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "val").otherwise("test")))


def test_planted_signal_beats_the_mean_and_keeps_its_order(spark, tmp_path):
    df = planted(spark)
    scaler = Q.model.fit_scaler(df.filter("split = 'train'"))
    tokenmean.fit_run(Q.model.scale(df, scaler), str(tmp_path / "run"), "text", "price_z", scaler)
    run = tokenmean.load_run(spark, str(tmp_path / "run"))
    back = Q.model.unscale(tokenmean.predict(run, df, "text"), scaler, "pred_z", "prediction")
    r2 = {r["split"]: r["r2"] for r in metrics.regression_metrics(back, S.PRICE, "prediction", ["split"]).collect()}
    assert min(r2.values()) > 0.8  # 0 is the mean
    asked = {r["prompt"]: r[S.PRICE] for r in tokenmean.predict_text(spark, str(tmp_path / "run"), ["phone max", "Phone PRO", "phone mini"]).collect()}
    assert asked["phone max"] > asked["Phone PRO"] > asked["phone mini"]
    one = tokenmean.predict_text(spark, str(tmp_path / "run"), "phone max", (1, 50)).orderBy("day").collect()
    assert [r["day"] for r in one] == list(range(1, 50)) and one[0][S.PRICE] > one[-1][S.PRICE] + 50
    odd = tokenmean.predict_text(spark, str(tmp_path / "run"), ["", "?!", "unseen words"]).collect()
    assert len(odd) == 3 and all(r[S.PRICE] is not None and not math.isnan(r[S.PRICE]) for r in odd)
    no_day = tokenmean.predict(run, df.withColumn(S.DAYS_PASSED, F.lit(None).cast("int")).limit(3), "text").collect()
    assert all(not math.isnan(r["pred_z"]) for r in no_day)


def test_empty_splits_raise(spark, tmp_path):
    df = Q.model.scale(planted(spark, 100), Q.model.fit_scaler(planted(spark, 100)))
    scaler = Q.model.fit_scaler(df)
    with pytest.raises(ValueError, match="validation"):
        tokenmean.fit_run(df.filter("split <> 'val'"), str(tmp_path / "a"), "text", "price_z", scaler)
    with pytest.raises(ValueError, match="training"):
        tokenmean.fit_run(df.filter("split <> 'train'"), str(tmp_path / "b"), "text", "price_z", scaler)
    with pytest.raises(ValueError, match="validation"):
        Q.textmodel.fit_candidates(df.filter("split = 'train'"), df.filter("split = 'none'"), "text", "price_z", num_features=64)


def test_batch_scorer_matches_spark_model(spark):
    df = Q.model.scale(planted(spark, 400), Q.model.fit_scaler(planted(spark, 400)))
    fitted, history = Q.textmodel.fit_candidates(df.filter("split = 'train'"), df.filter("split = 'val'"), "text", "price_z", num_features=256)
    assert len(history) == 2 * len(Q.textmodel.REG_PARAMS)
    want = sorted((r["id"], r["pred_z"]) for r in Q.textmodel.predict(fitted, df).collect())
    batch = Q.textmodel.score_in_batches(fitted, df, Q.textmodel.linear_predict_fn(fitted), batch_size=64)
    got = sorted((r["id"], r["pred_z"]) for r in batch.collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(math.isclose(g[1], w[1], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))
