"""Text -> price regression by shrunken token means.

The label is explained by the day offset first (one least-squares slope),
then by the words.  A token's score is the mean of what the days leave over
the training rows that hold it, shrunk towards 0 by a strength ``k``:
``total / (n + k)``.  A text's score is the mean of its tokens' scores (unknown
tokens 0), and one more least-squares line turns it into the prediction.
Candidate strengths play the role of epochs: all are fitted and evaluated in
the same passes, one model is kept for each, and the one with the smallest
validation error is used.

Every step is a group-by over all rows and all tokens: no driver-side
solve, no cap on the vocabulary.  Each distinct text is scored once, keyed by
its md5, so long texts are neither shuffle nor join keys.  A token that is in
every text is one row of the token table; the rows that join to it are split
by adaptive execution.

Artifacts under a run's folder: ``model/epoch=<e>`` (token, score),
``params`` (one row an epoch), ``scaler`` (1 row) and ``trainer_state`` (JSON
with a ``log_history`` array: a training-loss entry, then an evaluation entry,
for each epoch).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens import schema as S
from pricelens.functions import token_array
from pricelens.operators import metrics, model
from pricelens.operators.textmodel import PREDICTION_Z

# Shrinkage strengths tried, strongest first; their index is the "epoch".
STRENGTHS = (1000.0, 300.0, 100.0, 30.0, 10.0)

TOKEN = "token"
KEY = "_text_key"
PARAMS = ["epoch", "strength", "days_slope", "days_intercept", "mean_days", "gain", "offset"]


def text_scores(df: DataFrame, text: str, scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``_text_key`` and the mean of each score column over the tokens of every distinct text.

    Texts without tokens score 0; unknown tokens count as 0.
    """
    texts = df.filter(F.col(text).isNotNull()).select(F.md5(text).alias(KEY), token_array(text).alias("_tokens")).dropDuplicates([KEY])
    pieces = texts.select(KEY, F.explode_outer("_tokens").alias(TOKEN))
    joined = pieces.join(scores.select(TOKEN, *columns), TOKEN, "left")
    return joined.groupBy(KEY).agg(*[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in columns])


def fit_tokens(train: DataFrame, text: str, residual: str) -> DataFrame:
    """``token, n, total`` over every token of every training row."""
    return (train.select(F.explode(token_array(text)).alias(TOKEN), F.col(residual).alias("_r"))
                 .groupBy(TOKEN).agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("total")))


def fit_run(df: DataFrame, path: str, text: str, label: str, scaler: DataFrame, days: str = S.DAYS_PASSED,
            split: str = model.SPLIT, strengths: Sequence[float] = STRENGTHS) -> None:
    """Fit every strength on the training split, evaluate on the validation split, write the run.

    ``df`` holds all splits; it is read a fixed number of times, whatever the
    number of strengths.
    """
    spark = df.sparkSession
    names = [f"_s{e}" for e in range(len(strengths))]
    train = df.filter(F.col(split) == model.TRAIN)
    line = train.agg(F.coalesce(F.regr_slope(F.col(label), F.col(days)), F.lit(0.0)).alias("days_slope"),
                     F.coalesce(F.regr_intercept(F.col(label), F.col(days)), F.avg(label), F.lit(0.0)).alias("days_intercept"),
                     F.coalesce(F.avg(days), F.lit(0.0)).alias("mean_days"),
                     F.count(F.lit(1)).alias("rows")).first()
    if not line["rows"]:
        raise ValueError("the training split is empty")
    if df.filter(F.col(split) == model.VAL).isEmpty():
        raise ValueError("the validation split is empty: no strength can be chosen")
    slope, intercept = F.lit(line["days_slope"]), F.lit(line["days_intercept"])
    rows = df.select(split, label, days, text, (F.col(label) - (intercept + slope * F.col(days))).alias("_r"))

    counted = fit_tokens(rows.filter(F.col(split) == model.TRAIN), text, "_r")
    per_epoch = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), (F.col("total") / (F.col("n") + F.lit(float(k)))).alias("score"))
                                    for e, k in enumerate(strengths)])).alias("_m")
    counted.select(TOKEN, per_epoch).select(TOKEN, "_m.*").write.mode("errorifexists").partitionBy("epoch").parquet(f"{path}/model")

    saved = spark.read.parquet(f"{path}/model")
    wide = saved.groupBy(TOKEN).agg(*[F.max(F.when(F.col("epoch") == e, F.col("score"))).alias(n) for e, n in enumerate(names)])
    scored = rows.withColumn(KEY, F.md5(text)).join(text_scores(rows, text, wide, names), KEY).select(split, label, days, "_r", *names)
    scored.write.mode("errorifexists").parquet(f"{path}/scored")  # read twice below, small columns only
    scored = spark.read.parquet(f"{path}/scored")

    fits = scored.filter(F.col(split) == model.TRAIN).agg(*[x for n in names for x in (
        F.coalesce(F.regr_slope(F.col("_r"), F.col(n)), F.lit(0.0)).alias(f"gain{n}"),
        F.coalesce(F.regr_intercept(F.col("_r"), F.col(n)), F.avg("_r"), F.lit(0.0)).alias(f"offset{n}"))]).first()
    params = [(e, float(k), line["days_slope"], line["days_intercept"], line["mean_days"], fits[f"gain{n}"], fits[f"offset{n}"])
              for e, (k, n) in enumerate(zip(strengths, names, strict=True))]
    spark.createDataFrame(params, "epoch int, strength double, days_slope double, days_intercept double, mean_days double, gain double, offset double") \
        .coalesce(1).write.mode("errorifexists").parquet(f"{path}/params")
    scaler.coalesce(1).write.mode("errorifexists").parquet(f"{path}/scaler")

    def squares(n: str) -> F.Column:
        return F.pow(F.lit(fits[f"offset{n}"]) + F.lit(fits[f"gain{n}"]) * F.col(n) - F.col("_r"), 2)

    losses = scored.groupBy(split).agg(
        *[F.avg(squares(n)).alias(f"mse{n}") for n in names],
        *[F.avg(F.sqrt(squares(n))).alias(f"mae{n}") for n in names],
        (F.var_pop(label)).alias("spread"))
    entries = []
    for e, n in enumerate(names):
        mse = F.col(f"mse{n}")
        nothing = F.lit(None).cast("double")
        entries.append((F.col(split) == model.TRAIN, F.struct(
            F.lit(2 * e).alias("step"), F.lit(e).alias("epoch"), mse.alias("loss"), nothing.alias("eval_mse"), nothing.alias("eval_rmse"), nothing.alias("eval_mae"), nothing.alias("eval_r2"))))
        entries.append((F.col(split) == model.VAL, F.struct(
            F.lit(2 * e + 1).alias("step"), F.lit(e).alias("epoch"), nothing.alias("loss"), mse.alias("eval_mse"), F.sqrt(mse).alias("eval_rmse"), F.col(f"mae{n}").alias("eval_mae"),
            F.when(F.col("spread") > 0, F.lit(1.0) - mse / F.col("spread")).alias("eval_r2"))))
    told = losses.select(F.explode(F.filter(F.array(*[F.when(c, s) for c, s in entries]), lambda x: x.isNotNull())).alias("entry"))
    told.agg(F.sort_array(F.collect_list("entry")).alias("log_history")).coalesce(1).write.mode("errorifexists").json(f"{path}/trainer_state")


def load_run(spark: SparkSession, path: str, epoch: int | None = None) -> tuple[DataFrame, dict]:
    """``(token, score)`` and the parameters of one epoch; the one with the best validation rmse if none is given."""
    try:
        params = spark.read.parquet(f"{path}/params")
        tokens = spark.read.parquet(f"{path}/model")
    except AnalysisException as missing:
        raise FileNotFoundError(f"no trained model under {path}; run the training job first") from missing
    if epoch is None:
        from pricelens.operators import textmodel

        epoch = metrics.best_epoch(textmodel.read_history(spark, path), "rmse").first()["epoch"]
    chosen = params.filter(F.col("epoch") == epoch).first()
    if chosen is None:
        raise FileNotFoundError(f"no epoch {epoch} under {path}")
    return tokens.filter(F.col("epoch") == epoch).select(TOKEN, "score"), chosen.asDict()


def predict(run: tuple[DataFrame, dict], df: DataFrame, text: str, days: str | None = S.DAYS_PASSED) -> DataFrame:
    """``df`` with ``pred_z``.  Rows without a day (or ``days=None``) are priced at the mean training day."""
    tokens, p = run
    scores = text_scores(df, text, tokens, ["score"]).withColumnRenamed("score", "_score")
    day = F.lit(p["mean_days"]) if days is None else F.coalesce(F.col(days).cast("double"), F.lit(p["mean_days"]))
    known = F.lit(p["days_intercept"]) + F.lit(p["days_slope"]) * day
    worded = F.lit(p["offset"]) + F.lit(p["gain"]) * F.coalesce(F.col("_score"), F.lit(0.0))
    return (df.withColumn(KEY, F.md5(text)).join(scores, KEY, "left")
              .withColumn(PREDICTION_Z, known + worded).drop(KEY, "_score"))


def predict_text(spark: SparkSession, path: str, texts: str | Sequence[str], days: tuple[int, int] | None = None,
                 epoch: int | None = None) -> DataFrame:
    """Price of one text or a list of texts: ``prompt, price``, or ``prompt, day, price`` over the half-open day range.

    With days the model is asked for ``"<n> days <text>"``, without for the text alone.
    """
    from pricelens.functions import days_prompt
    from pricelens.operators import textmodel

    prompts = [texts] if isinstance(texts, str) else list(texts)
    asked = spark.createDataFrame([(t,) for t in prompts], "prompt string")
    run = load_run(spark, path, epoch)
    if days is None:
        scored, keep = predict(run, asked.withColumn("_asked", F.lower("prompt")), "_asked", None), ["prompt"]
    else:
        grid = model.day_grid(asked, days)
        scored, keep = predict(run, grid.withColumn("_asked", F.lower(days_prompt("day", "prompt"))), "_asked", "day"), ["prompt", "day"]
    return model.unscale(scored, textmodel.read_scaler(spark, path), PREDICTION_Z, S.PRICE).select(*keep, S.PRICE)
