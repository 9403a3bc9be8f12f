"""Text -> price regression with Spark ML: the plug-in next to ``tokenmean``.

The original fine-tunes a language model for a few epochs, evaluating on a
validation split after each one, keeps checkpoints, pickles its label
scaler and writes a training-state JSON.  The default estimator is
``tokenmean``; this one takes any Spark ML stages.  Here:

* features: ``RegexTokenizer`` (letters/digits in any script) ->
  ``HashingTF`` -> ``IDF``, plus the day offset as a number; fitted on the
  training split only (as the scaler is);
* candidates play the role of epochs: one ``LinearRegression`` fit per
  regularisation strength with the normal-equation solver -- one pass over
  the cached training features builds the (features x features) Gram
  matrix by tree aggregation, whose size does not grow with the rows; the
  driver solves it in O(d^3), so d stays small: 1023 hashed text features +
  the day offset (d = 1024; 4095 + 1 costs 20x more per fit for no gain
  on the test tables).  Each candidate is scored on the validation split
  by one aggregate;
* artifacts: ``model/`` (``PipelineModel``), ``scaler/`` (1-row parquet),
  ``trainer_state/`` (JSON with a ``log_history`` array of per-epoch
  entries: a training-loss entry then an evaluation entry, as the original
  trainer writes).
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens import schema as S
from pricelens.functions.text import TOKEN_SPLIT
from pricelens.operators import metrics

FEATURES = "features"
PREDICTION_Z = "pred_z"
NUM_FEATURES = 1023
# Candidate L2 strengths, tried in order; their index is the "epoch".
REG_PARAMS = (30.0, 10.0, 3.0, 1.0, 0.3)
MAX_ITER = 100

HISTORY_SCHEMA = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
    T.StructField("eval_mse", T.DoubleType()),
    T.StructField("eval_rmse", T.DoubleType()),
    T.StructField("eval_mae", T.DoubleType()),
    T.StructField("eval_r2", T.DoubleType()),
])


def feature_pipeline(text: str, days: str = S.DAYS_PASSED, num_features: int = NUM_FEATURES) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=TOKEN_SPLIT, gaps=True, toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        VectorAssembler(inputCols=["_tfidf", days], outputCol=FEATURES, handleInvalid="keep"),
    ])


def _eval_row(pred: DataFrame, label: str) -> dict:
    m = pred.agg(*metrics.metric_columns(label, PREDICTION_Z)).first()
    return {"mse": m["mse"], "rmse": m["rmse"], "mae": m["mae"], "r2": m["r2"]}


def fit_candidates(train: DataFrame, val: DataFrame, text: str, label: str,
                   reg_params: Sequence[float] = REG_PARAMS, max_iter: int = MAX_ITER,
                   num_features: int = NUM_FEATURES) -> tuple[PipelineModel, list[dict]]:
    """Fit one model per candidate, score each on ``val``; return the best
    (smallest validation rmse; ties: earliest) and the history entries."""
    feats = feature_pipeline(text, num_features=num_features).fit(train)
    tr = feats.transform(train).select(FEATURES, label).persist(StorageLevel.MEMORY_AND_DISK)
    va = feats.transform(val).select(FEATURES, label).persist(StorageLevel.MEMORY_AND_DISK)
    history, best, best_rmse = [], None, None
    try:
        for epoch, reg in enumerate(reg_params):
            lr = LinearRegression(featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION_Z,
                                  regParam=float(reg), elasticNetParam=0.0, maxIter=max_iter,
                                  solver="normal")
            fitted = lr.fit(tr)
            train_mse = fitted.summary.meanSquaredError
            ev = _eval_row(fitted.transform(va), label)
            history.append({"epoch": epoch, "step": 2 * epoch, "loss": float(train_mse)})
            history.append({"epoch": epoch, "step": 2 * epoch + 1, "eval_loss": ev["mse"],
                            "eval_mse": ev["mse"], "eval_rmse": ev["rmse"], "eval_mae": ev["mae"],
                            "eval_r2": ev["r2"]})
            if ev["rmse"] is not None and (best_rmse is None or ev["rmse"] < best_rmse):
                best, best_rmse = fitted, ev["rmse"]
    finally:
        tr.unpersist()
        va.unpersist()
    if best is None:
        raise ValueError("the validation split is empty: no candidate can be chosen")
    return PipelineModel(stages=[*feats.stages, best]), history


def save_run(spark: SparkSession, path: str, model: PipelineModel, scaler: DataFrame, history: list[dict]) -> None:
    """Write ``model/``, ``scaler/`` and ``trainer_state/`` under ``path``."""
    model.write().overwrite().save(f"{path}/model")
    scaler.coalesce(1).write.mode("errorifexists").parquet(f"{path}/scaler")
    hist = spark.createDataFrame([tuple(h.get(f.name) for f in HISTORY_SCHEMA.fields) for h in history],
                                 HISTORY_SCHEMA)
    state = hist.agg(F.sort_array(F.collect_list(F.struct("step", *[c for c in hist.columns if c != "step"])))
                     .alias("log_history"))
    state.coalesce(1).write.mode("errorifexists").json(f"{path}/trainer_state")


def load_model(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(f"{path}/model")
    except (Py4JJavaError, PySparkException) as missing:  # any store: the reader itself says that nothing is there
        raise FileNotFoundError(f"no trained model under {path}; run the training job first") from missing


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/scaler")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation entries of the training state: ``epoch, mse, rmse, mae, r2`` (scaled units).

    Training-loss entries carry no ``eval_*`` fields and are skipped.
    """
    state = spark.read.option("multiLine", "true").json(f"{path}/trainer_state")
    entries = state.select(F.posexplode("log_history").alias("pos", "e"))
    return (entries.filter(F.col("e.eval_mse").isNotNull())
                   .select(F.col("e.epoch").cast("int").alias("epoch"),
                           F.col("e.eval_mse").alias("mse"), F.col("e.eval_rmse").alias("rmse"),
                           F.col("e.eval_mae").alias("mae"), F.col("e.eval_r2").alias("r2")))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Score rows; keeps the input columns plus ``pred_z``."""
    keep = df.columns
    return model.transform(df).select(*keep, PREDICTION_Z)


def score_in_batches(model: PipelineModel, df: DataFrame, make_predict_fn, batch_size: int = 4096,
                     target: str = PREDICTION_Z) -> DataFrame:
    """Score with an external model: Spark computes the features with the
    fitted feature stages, ``make_predict_fn()`` returns a function from a
    ``(batch, features)`` float array to predictions, applied per Arrow batch
    on the executors (``predict_batch_udf``; the model is built once per
    Python worker)."""
    from pyspark.ml.functions import predict_batch_udf, vector_to_array

    feats = PipelineModel(stages=model.stages[:-1]).transform(df)
    width = len(model.stages[-1].coefficients) if hasattr(model.stages[-1], "coefficients") else None
    udf = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=[[width]] if width else None)
    keep = df.columns
    return feats.select(*keep, udf(vector_to_array(FEATURES)).alias(target))


def linear_predict_fn(model: PipelineModel):
    """A numpy scorer equivalent to the fitted linear stage (for ``score_in_batches``)."""
    lin = model.stages[-1]
    coef = lin.coefficients.toArray()
    intercept = float(lin.intercept)

    def make():
        import numpy as np

        w = np.asarray(coef)

        def predict(x):
            return x @ w + intercept
        return predict
    return make
