"""Text -> price regression trained by epochs: distributed gradient steps on token features.

A text's prediction is a bias plus the mean of its tokens' weights (``x`` is a
token's share of the text's tokens).  An epoch is one full gradient step of the squared
error over all training rows, scaled token by token by the features' column sums,
which makes every step of up to 2 converge however frequent a token is:

    weight += step * sum(x * (label - prediction)) / (sum(x) + ridge)

It is two group-bys over the (text, token, x) table, one by text (predictions) and one
by token (gradient).  Both combine on the map side; rows of equal texts are folded to their count and
label sum first, so the table grows with the distinct texts.  Weights are a table;
nothing is solved or held on the driver, no vocabulary is capped.  After each epoch all splits
are scored, and the epoch's weights are kept as a checkpoint (``checkpoints.Run``: a limit on how
many, the best always among them).  A run that is started again goes on after the last epoch in its manifest.

Texts are keyed by md5.  A null text is an empty one; texts without tokens, and tokens never
trained on, add nothing to the bias.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions import token_array
from pricelens.operators import model
from pricelens.operators.checkpoints import Run
from pricelens.operators.textmodel import PREDICTION_Z
from pricelens.session import landed

EPOCHS = 5
STEP = 1.0
RIDGE = 1.0
TOKEN, WEIGHT, KEY, SHARE = "token", "weight", "_text_key", "x"


def text_key(text: str) -> F.Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def features(df: DataFrame, text: str) -> DataFrame:
    """``_text_key, token, x`` of every distinct text; the shares of a text add up to 1."""
    texts = df.select(text_key(text).alias(KEY), token_array(text).alias("_tokens")).dropDuplicates([KEY])
    pieces = texts.select(KEY, F.size("_tokens").alias("_n"), F.explode("_tokens").alias(TOKEN))
    return pieces.groupBy(KEY, TOKEN).agg((F.count(F.lit(1)) / F.max("_n")).alias(SHARE))


def text_predictions(shares: DataFrame, weights: DataFrame) -> DataFrame:
    """``_text_key, _score``: the mean weight of each text's tokens; unknown tokens weigh nothing."""
    known = shares.join(weights.select(TOKEN, WEIGHT), TOKEN)
    return known.groupBy(KEY).agg(F.sum(F.col(SHARE) * F.col(WEIGHT)).alias("_score"))


def gradient_step(shares: DataFrame, sums: DataFrame, scores: DataFrame | None, weights: DataFrame | None, bias: float,
                  step: float = STEP, ridge: float = RIDGE) -> DataFrame:
    """``token, weight`` after one epoch; ``sums`` has ``_n`` training rows and label sum ``_y`` a text."""
    at = sums.withColumn("_score", F.lit(0.0)) if scores is None else sums.join(scores, KEY, "left").fillna(0.0, ["_score"])
    left = at.select(KEY, "_n", (F.col("_y") - F.col("_n") * (F.lit(bias) + F.col("_score"))).alias("_r"))
    moved = (shares.join(left, KEY).groupBy(TOKEN)
             .agg((F.lit(float(step)) * F.sum(F.col(SHARE) * F.col("_r")) / (F.sum(F.col(SHARE) * F.col("_n")) + F.lit(float(ridge)))).alias("_move")))
    if weights is None:
        return moved.select(TOKEN, F.col("_move").alias(WEIGHT))
    return moved.join(weights, TOKEN, "left").select(TOKEN, (F.coalesce(WEIGHT, F.lit(0.0)) + F.col("_move")).alias(WEIGHT))


def split_errors(rows: DataFrame, scores: DataFrame, bias: float, label: str, split: str) -> dict[str, dict]:
    """``mse, rmse, mae, r2, n`` of each split (r2 null for a constant label)."""
    error = F.lit(bias) + F.coalesce("_score", F.lit(0.0)) - F.col(label)
    told = rows.join(scores, KEY, "left").groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(label).alias("spread"))
    # one row a split
    return {r[split]: {"n": r["n"], "mse": r["mse"], "rmse": r["mse"] ** 0.5, "mae": r["mae"], "r2": 1 - r["mse"] / r["spread"] if r["spread"] else None}
            for r in told.collect()}


def fit(df: DataFrame, folder: str, text: str, label: str, epochs: int = EPOCHS, step: float = STEP, ridge: float = RIDGE, keep: int = 10,
        split: str = model.SPLIT, after_epoch: Callable[[int], None] | None = None) -> dict:
    """Train ``epochs`` epochs on the training split of ``df``, or what is left of them; the run's manifest.

    ``after_epoch`` is called between an epoch's checkpoint being written and its being committed.
    """
    spark = df.sparkSession
    run = Run(spark, folder, keep)
    told = run.manifest()
    settings = {"text": text, "label": label, "step": step, "ridge": ridge}
    if told is not None and {k: told["settings"].get(k) for k in settings} != settings:
        raise ValueError(f"the run under {folder} has other settings: {told['settings']}")
    done = told["last"] + 1 if told else 0
    if done >= epochs:
        return told
    rows = landed(df.select(split, F.col(label).cast("double").alias(label), text_key(text).alias(KEY)), "epoch-rows")
    shares = landed(features(df, text), "epoch-features")
    train = rows.where(F.col(split) == model.TRAIN)
    sums = landed(train.groupBy(KEY).agg(F.count(label).alias("_n"), F.sum(label).alias("_y")).where("_n > 0"), "epoch-sums")
    if told is None:
        bias = sums.agg(F.sum("_y") / F.sum("_n")).first()[0]
        if bias is None:
            raise ValueError("the training split has no labels")
        settings["bias"] = bias
        weights = scores = None
    else:
        bias = settings["bias"] = told["settings"]["bias"]
        weights = spark.read.parquet(told["epochs"][-1]["path"])
        scores = landed(text_predictions(shares, weights), "epoch-scores")
    for epoch in range(done, epochs):
        path = run.new_path(epoch)
        gradient_step(shares, sums, scores, weights, bias, step, ridge).write.parquet(path)
        weights = spark.read.parquet(path)
        scores = landed(text_predictions(shares, weights), "epoch-scores")
        errors = split_errors(rows, scores, bias, label, split)
        if model.VAL not in errors:
            raise ValueError("the validation split is empty: no epoch can be chosen")
        if after_epoch:
            after_epoch(epoch)
        told = run.commit(epoch, path, {**errors[model.VAL], "loss": errors[model.TRAIN]["mse"]}, settings)
    return told


def history(spark: SparkSession, folder: str) -> DataFrame:
    """``epoch, loss, mse, rmse, mae, r2, kept`` of every epoch in the manifest (scaled units; the errors are of the validation split)."""
    told = Run(spark, folder).manifest()
    if told is None:
        raise FileNotFoundError(f"no trained model under {folder}; run the training job first")
    rows = [(e["epoch"], *(e["metrics"][k] for k in ("loss", "mse", "rmse", "mae", "r2")), e["path"] is not None) for e in told["epochs"]]
    return spark.createDataFrame(rows, "epoch int, loss double, mse double, rmse double, mae double, r2 double, kept boolean")


def load(spark: SparkSession, folder: str, epoch: int | None = None) -> tuple[DataFrame, float]:
    """(``token, weight``, bias) of an epoch that is kept, by way of the manifest; the best one if none is given."""
    run = Run(spark, folder)
    return spark.read.parquet(run.checkpoint(epoch)["path"]), run.manifest()["settings"]["bias"]


def predict(loaded: tuple[DataFrame, float], df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``pred_z``."""
    weights, bias = loaded
    scores = text_predictions(features(df, text), weights)
    return (df.withColumn(KEY, text_key(text)).join(scores, KEY, "left")
              .withColumn(PREDICTION_Z, F.lit(bias) + F.coalesce("_score", F.lit(0.0))).drop(KEY, "_score"))
