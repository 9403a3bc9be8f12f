"""Named queries over the driver's tables: ``(spark, sf_dir) -> DataFrame``.

Each query reads the whole tables (through the landed ``listings``
relation) and returns a DataFrame with aliased columns that match its SQL oracle in
:mod:`pricelens.plans.sql`.  The last step is planned lazily; building a
query may land shared inputs, fit a model or run a stream first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens import schema as S
from pricelens.functions import days_prompt
from pricelens.operators import cells, clean, distribution, epochs, ladder, longtrend, metrics, model, profile, reshape, subwords, textmodel, tokenmean, tokens, trend
from pricelens.functions import stable_bucket
from pricelens.session import scratch_path
from pricelens.sources import files
from pricelens.streaming import landing
from pricelens.sources.tables import (
    RAW_BAD_DATE_BUCKETS, RAW_BAD_PRICE_BUCKETS, RAW_OVERFLOW_COMMAS, RAW_SEED, RAW_WRAPPED_BUCKETS, land_once,
    TABLE_BIN_WIDTH, TABLE_DATE_VIEWPORT, TABLE_FILTERS, TABLE_LADDER, TABLE_PRICE_CLIP, TABLE_PRICE_VIEWPORT,
    listings, read_table,
)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return register


def _explore(spark, sf_dir) -> DataFrame:
    return clean.explore_frame(listings(spark, sf_dir), TABLE_FILTERS, TABLE_PRICE_CLIP, TABLE_LADDER)


def prepared(spark, sf_dir) -> DataFrame:
    """Cleaned rows with day offset, prompts, tag and split, landed once: the modelling queries read this, not the listings."""
    def write(path):
        model.add_split(clean.prepared(listings(spark, sf_dir), TABLE_FILTERS, TABLE_PRICE_CLIP, TABLE_LADDER)).write.parquet(path)
    return spark.read.parquet(land_once(spark, sf_dir, "prepared", write))


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Digits that both engines agree on; the operators themselves don't round."""
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


# --- step 1: the cleaning pipeline ------------------------------------------

@query("preprocess")
def q_preprocess(spark, sf_dir):
    return clean.preprocess(listings(spark, sf_dir), TABLE_FILTERS, price_clip=TABLE_PRICE_CLIP)


# --- step 2: filters, expressions, exploration frame ------------------------

@query("low_price_audit")
def q_low_price_audit(spark, sf_dir):
    return clean.low_price_audit(listings(spark, sf_dir), TABLE_FILTERS, TABLE_PRICE_CLIP)


@query("explore_frame")
def q_explore_frame(spark, sf_dir):
    return _explore(spark, sf_dir)


@query("date_viewport")
def q_date_viewport(spark, sf_dir):
    lo, hi = (F.to_date(F.lit(d)) for d in TABLE_DATE_VIEWPORT)
    return clean.viewport(_explore(spark, sf_dir), S.DATE, lo, hi)


@query("price_viewport")
def q_price_viewport(spark, sf_dir):
    """Listings inside the price axis viewport (the statistics' own viewports are further down)."""
    lo, hi = TABLE_PRICE_VIEWPORT
    return clean.viewport(_explore(spark, sf_dir), S.PRICE, F.lit(lo), F.lit(hi))


@query("one_model")
def q_one_model(spark, sf_dir):
    return clean.one_group(_explore(spark, sf_dir), TABLE_LADDER[0]).select(S.PRICE, S.DATE)


@query("phrase_count")
def q_phrase_count(spark, sf_dir):
    df = clean.add_concatenated(listings(spark, sf_dir))
    df = clean.clip_price(clean.filter_categories(clean.drop_null(df), TABLE_FILTERS), TABLE_PRICE_CLIP)
    return profile.phrase_counts(df, S.CONCATENATED_DESCRIPTION, TABLE_LADDER)


@query("concat_description")
def q_concat_description(spark, sf_dir):
    return clean.add_concatenated(listings(spark, sf_dir)).select(S.URL, S.CONCATENATED_DESCRIPTION)


@query("model_tag")
def q_model_tag(spark, sf_dir):
    df = clean.add_phone_model(clean.add_concatenated(listings(spark, sf_dir)), TABLE_LADDER)
    return df.select(S.URL, S.PHONE_MODEL)


LONG_LADDER, LONG_LADDER_LETTERS = 5_000, 5


@query("long_ladder_tag")
def q_long_ladder_tag(spark, sf_dir):
    """Documents tagged by a ladder of 5,000 phrases: the most frequent words of five letters or more, the longest first."""
    df = read_table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    words = subwords.distinct_words(df, "text").where(F.length(subwords.WORD) >= LONG_LADDER_LETTERS)
    top = words.orderBy(F.desc("n"), subwords.WORD).limit(LONG_LADDER).collect()  # the ladder is a parameter of this size
    phrases = sorted((r[subwords.WORD] for r in top), key=lambda w: (-len(w), w.encode()))
    return ladder.add_first_phrase(df, "text", phrases).select("doc_id", "phrase")


@query("avg_text_length")
def q_avg_text_length(spark, sf_dir):
    pre = q_preprocess(spark, sf_dir)
    out = profile.avg_text_length(pre, [S.DAYS_PASSED_NAME, S.DAYS_PASSED_NAME_DESC])
    return _rounded(out, dict.fromkeys(out.columns, 6))


@query("preview")
def q_preview(spark, sf_dir):
    # A top-10 preview is the feature: per-partition top-k, one small merge.
    return listings(spark, sf_dir).orderBy(S.URL).limit(10)


# --- step 3: profiles --------------------------------------------------------

@query("null_counts")
def q_null_counts(spark, sf_dir):
    return profile.null_counts(listings(spark, sf_dir))


@query("value_counts")
def q_value_counts(spark, sf_dir):
    return profile.value_counts(clean.drop_null(listings(spark, sf_dir)), S.CONDITION)


@query("added_at_counts")
def q_added_at_counts(spark, sf_dir):
    return profile.value_counts(listings(spark, sf_dir), S.ADDED_AT)


@query("category_share")
def q_category_share(spark, sf_dir):
    return _rounded(profile.category_share(listings(spark, sf_dir), S.VOIVODESHIP), {"pct": 6})


@query("condition_share")
def q_condition_share(spark, sf_dir):
    return _rounded(profile.category_share(listings(spark, sf_dir), S.CONDITION), {"pct": 6})


@query("mean_by_date_model")
def q_mean_by_date_model(spark, sf_dir):
    return _rounded(profile.mean_by(_explore(spark, sf_dir), [S.DATE, S.PHONE_MODEL], S.PRICE), {"mean_price": 6})


@query("stage_counts")
def q_stage_counts(spark, sf_dir):
    return profile.stage_counts(listings(spark, sf_dir), TABLE_FILTERS, TABLE_PRICE_CLIP)


@query("column_profile")
def q_column_profile(spark, sf_dir):
    return profile.column_profile(listings(spark, sf_dir))


@query("model_keys")
def q_model_keys(spark, sf_dir):
    return profile.distinct_keys(_explore(spark, sf_dir), S.PHONE_MODEL)


# --- step 4: distributions ---------------------------------------------------

def _tagged(spark, sf_dir) -> DataFrame:
    return _explore(spark, sf_dir).filter(F.col(S.PHONE_MODEL).isNotNull())


BOX_NUMBERS = ["min", "max", "mean", "q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high"]


@query("box_by_model")
def q_box_by_model(spark, sf_dir):
    box = distribution.box_stats(_tagged(spark, sf_dir), [S.PHONE_MODEL], S.PRICE, max_groups=len(TABLE_LADDER))
    return _rounded(box, dict.fromkeys(BOX_NUMBERS, 6))


@query("box_by_date_model")
def q_box_by_date_model(spark, sf_dir):
    return _rounded(distribution.box_stats(_tagged(spark, sf_dir), [S.PHONE_MODEL, S.DATE], S.PRICE), dict.fromkeys(BOX_NUMBERS, 6))


@query("price_histogram")
def q_price_histogram(spark, sf_dir):
    return distribution.histogram(_tagged(spark, sf_dir), [S.PHONE_MODEL], S.PRICE, TABLE_BIN_WIDTH,
                                  max_groups=len(TABLE_LADDER))


@query("price_kde")
def q_price_kde(spark, sf_dir):
    curve = distribution.kde(_tagged(spark, sf_dir), [S.PHONE_MODEL], S.PRICE, S.ORIGINAL_KDE_POINTS,
                             max_groups=len(TABLE_LADDER))
    return _rounded(curve, {"x": 6, "density": 14})


@query("price_kde_binned")
def q_price_kde_binned(spark, sf_dir):
    """The density curves from bin weights."""
    curve = distribution.binned_kde(_tagged(spark, sf_dir), [S.PHONE_MODEL], S.PRICE, S.ORIGINAL_KDE_POINTS, max_groups=len(TABLE_LADDER))
    return _rounded(curve, {"x": 6, "density": 14})


def price_cells(spark, sf_dir) -> DataFrame:
    """Counts per (tag, day) from which quantiles of any range of days follow, stored once."""
    def write(path):
        cells.count_cells(_tagged(spark, sf_dir), [S.PHONE_MODEL, S.DATE], S.PRICE).write.parquet(path)
    return spark.read.parquet(land_once(spark, sf_dir, "price-cells", write))


CELL_NUMBERS = ["min", "max", "mean", *[f"{q}{end}" for q in ("q1", "median", "q3") for end in ("", "_low", "_high")]]


@query("box_cells_by_model")
def q_box_cells_by_model(spark, sf_dir):
    """Quartiles with bounds from the stored counts, all days merged."""
    return _rounded(cells.box_from_cells(price_cells(spark, sf_dir), [S.PHONE_MODEL]), dict.fromkeys(CELL_NUMBERS, 6))


@query("box_cells_by_date_range")
def q_box_cells_by_date_range(spark, sf_dir):
    """The same for the rows of the date viewport: only its days' counts are merged."""
    lo, hi = (F.to_date(F.lit(d)) for d in TABLE_DATE_VIEWPORT)
    return _rounded(cells.box_from_cells(clean.viewport(price_cells(spark, sf_dir), S.DATE, lo, hi), [S.PHONE_MODEL]), dict.fromkeys(CELL_NUMBERS, 6))


# Chart viewports are applied to the finished statistics: the axis is cut, the numbers stay.

@query("box_date_viewport")
def q_box_date_viewport(spark, sf_dir):
    lo, hi = (F.to_date(F.lit(d)) for d in TABLE_DATE_VIEWPORT)
    return clean.viewport(q_box_by_date_model(spark, sf_dir), S.DATE, lo, hi)


@query("histogram_viewport")
def q_histogram_viewport(spark, sf_dir):
    lo, hi = TABLE_PRICE_VIEWPORT
    return clean.viewport(q_price_histogram(spark, sf_dir), "bin_start", F.lit(lo), F.lit(hi))


@query("kde_viewport")
def q_kde_viewport(spark, sf_dir):
    lo, hi = TABLE_PRICE_VIEWPORT
    return clean.viewport(q_price_kde(spark, sf_dir), "x", F.lit(lo), F.lit(hi))


# --- step 5: scaling, split, error metrics ------------------------------------

def modelling_frame(spark, sf_dir) -> DataFrame:
    """Prepared rows with split and the scaler fitted on the training split."""
    df = prepared(spark, sf_dir)
    scaler = model.fit_scaler(df.filter(F.col(model.SPLIT) == model.TRAIN))
    return model.scale(df, scaler), scaler


def scored(spark, sf_dir) -> DataFrame:
    """Baseline predictions: mean scaled price per name over the training split."""
    df, scaler = modelling_frame(spark, sf_dir)
    name_model = model.fit_group_mean(df.filter(F.col(model.SPLIT) == model.TRAIN), S.NAME, "price_z", "pred_z")
    out = model.predict_group_mean(df, name_model, S.NAME, "pred_z")
    return model.unscale(out, scaler, "pred_z", "prediction"), scaler


@query("split_counts")
def q_split_counts(spark, sf_dir):
    df = prepared(spark, sf_dir)
    return df.groupBy(model.SPLIT).agg(F.count(F.lit(1)).alias("n"))


@query("split_exact")
def q_split_exact(spark, sf_dir):
    """Every prepared row's split, of exactly the original's sizes."""
    return model.add_exact_split(prepared(spark, sf_dir).select(S.URL)).select(S.URL, model.SPLIT)


@query("scale_label")
def q_scale_label(spark, sf_dir):
    _, scaler = modelling_frame(spark, sf_dir)
    return scaler.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("unscale_label")
def q_unscale_label(spark, sf_dir):
    df, scaler = modelling_frame(spark, sf_dir)
    back = model.unscale(df, scaler, "price_z", "price_restored")
    return back.select(S.URL, model.SPLIT, F.round("price_z", 9).alias("price_z"),
                       F.round("price_restored", 6).alias("price_restored"))


@query("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    df, _ = scored(spark, sf_dir)
    return metrics.rounded(metrics.regression_metrics(df, S.PRICE, "prediction", [model.SPLIT]))


@query("smape")
def q_smape(spark, sf_dir):
    df, _ = scored(spark, sf_dir)
    return metrics.rounded(metrics.smape(df.filter(F.col(model.SPLIT) == model.VAL), S.PRICE, "prediction"), ["smape"])


@query("test_rmse")
def q_test_rmse(spark, sf_dir):
    df, _ = scored(spark, sf_dir)
    test = df.filter(F.col(model.SPLIT) == model.TEST)
    return test.agg(F.count(F.lit(1)).alias("n"),
                    F.round(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(S.PRICE), 2))), 6).alias("rmse"))


# --- step 6: forecast grid, reshaping -----------------------------------------

def trend_forecast(spark, sf_dir) -> DataFrame:
    """Per-tag least-squares trend of price on days (training split) over days 1..89."""
    df = prepared(spark, sf_dir).filter(F.col(S.PHONE_MODEL).isNotNull())
    train = df.filter(F.col(model.SPLIT) == model.TRAIN)
    trend = model.fit_trend(train, [S.PHONE_MODEL], S.DAYS_PASSED, S.PRICE)
    grid = model.day_grid(df.select(S.PHONE_MODEL).distinct())
    return model.forecast_trend(grid, trend, [S.PHONE_MODEL], max_groups=len(TABLE_LADDER)), train


@query("forecast_grid")
def q_forecast_grid(spark, sf_dir):
    tags = prepared(spark, sf_dir).filter(F.col(S.PHONE_MODEL).isNotNull()).select(S.PHONE_MODEL).distinct()
    grid = model.day_grid(tags)
    return grid.withColumn("prompt", days_prompt("day", S.PHONE_MODEL))


@query("forecast_wide")
def q_forecast_wide(spark, sf_dir):
    fc, _ = trend_forecast(spark, sf_dir)
    fc = fc.withColumn(S.PRICE, F.round(S.PRICE, 6))
    return reshape.long_to_wide(fc, ["day"], S.PHONE_MODEL, S.PRICE, TABLE_LADDER)


@query("extrapolated_flag")
def q_extrapolated_flag(spark, sf_dir):
    fc, train = trend_forecast(spark, sf_dir)
    horizon = train.select(F.max(S.DAYS_PASSED)).scalar()
    out = clean.flag_extrapolated(fc, horizon)
    return out.select(S.PHONE_MODEL, "day", F.round(S.PRICE, 6).alias(S.PRICE), "extrapolated")


@query("metrics_long")
def q_metrics_long(spark, sf_dir):
    df, _ = scored(spark, sf_dir)
    wide = metrics.rounded(metrics.regression_metrics(df, S.PRICE, "prediction", [model.SPLIT]))
    return reshape.wide_to_long(wide, [model.SPLIT], ["mse", "rmse", "mae", "r2"], "metric", "value")


# --- step 7: LOWESS trend -----------------------------------------------------

@query("lowess_trend")
def q_lowess_trend(spark, sf_dir):
    df = prepared(spark, sf_dir).filter(F.col(S.PHONE_MODEL).isNotNull())
    return _rounded(trend.lowess(df, [S.PHONE_MODEL], S.DAYS_PASSED, S.PRICE), {S.PRICE: 4, "trend": 4})


#: Points a block of the overall trend's one series.
TREND_BLOCK = 128


@query("lowess_overall")
def q_lowess_overall(spark, sf_dir):
    """One series of all prepared listings, smoothed by blocks."""
    return _rounded(longtrend.long_lowess(prepared(spark, sf_dir), [], S.DAYS_PASSED, S.PRICE, block_points=TREND_BLOCK), {S.PRICE: 6, "trend": 4})


# --- step 8: tokens ------------------------------------------------------------

@query("tokens_padded")
def q_tokens_padded(spark, sf_dir):
    df = prepared(spark, sf_dir)
    vocab = tokens.fit_vocabulary(df.filter(F.col(model.SPLIT) == model.TRAIN), S.DAYS_PASSED_NAME_DESC)
    out = tokens.tokenize(df, S.DAYS_PASSED_NAME_DESC, vocab, S.ORIGINAL_MAX_LENGTH_TRAIN)
    return out.select(S.URL, model.SPLIT, tokens.INPUT_IDS, tokens.ATTENTION_MASK, tokens.N_TOKENS)


@query("tokens_documents")
def q_tokens_documents(spark, sf_dir):
    """Long accented texts in four languages: truncation, unknown words, padding to the full length."""
    df = model.add_split(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key="doc_id")
    vocab = tokens.fit_vocabulary(df.filter(F.col(model.SPLIT) == model.TRAIN), "text")
    out = tokens.tokenize(df, "text", vocab, S.ORIGINAL_MAX_LENGTH_TRAIN)
    return out.select("doc_id", model.SPLIT, tokens.INPUT_IDS, tokens.ATTENTION_MASK, tokens.N_TOKENS)


def subword_file() -> str:
    """The public vocabulary that the queries cut words with (the operators take any path)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("tokens_subword")
def q_tokens_subword(spark, sf_dir):
    """Documents as pieces of words, truncated and padded."""
    df = model.add_split(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key="doc_id")
    out = subwords.tokenize(df, "text", subwords.read_pieces(spark, subword_file()), S.ORIGINAL_MAX_LENGTH_TRAIN)
    return out.select("doc_id", model.SPLIT, tokens.INPUT_IDS, tokens.ATTENTION_MASK)


@query("subword_unknown_rate")
def q_subword_unknown_rate(spark, sf_dir):
    """Words, pieces and unknown words over the whole texts of all documents."""
    told = subwords.unknown_rate(read_table(spark, sf_dir, "documents"), "text", subwords.read_pieces(spark, subword_file()))
    return _rounded(told, {"unknown_rate": 9})


# --- step 9: files: raw export repair, quarantine, CSV round trip -----------------

def raw_export_path(spark, sf_dir) -> str:
    """The listings written as a raw export with wrapped, over-long and unreadable records."""
    def write(path):
        df = listings(spark, sf_dir)
        b = stable_bucket(S.URL, RAW_SEED)
        wrapped = b.isin(*RAW_WRAPPED_BUCKETS)
        extra = F.coalesce(*[F.when(b == k, F.concat(F.lit("," * n + "x-"), F.col(S.URL))) for k, n in RAW_OVERFLOW_COMMAS.items()])
        texts = {S.PRICE: F.when(b.isin(*RAW_BAD_PRICE_BUCKETS), F.lit("2 500 zl")), S.ADDED_AT: F.when(b.isin(*RAW_BAD_DATE_BUCKETS), F.lit("wczoraj"))}
        files.write_raw_export(df, path, wrapped, extra, texts)
    return land_once(spark, sf_dir, "raw-export", write)


def _raw(spark, sf_dir) -> DataFrame:
    return files.read_raw_listings(spark, raw_export_path(spark, sf_dir))


@query("repair_csv")
def q_repair_csv(spark, sf_dir):
    return files.accepted(files.repair(_raw(spark, sf_dir)))


@query("scan_quarantine")
def q_scan_quarantine(spark, sf_dir):
    return files.quarantine(files.repair(_raw(spark, sf_dir))).drop(S.RECORD)


@query("raw_preview")
def q_raw_preview(spark, sf_dir):
    """The first raw lines, as they stand in the export."""
    return files.raw_preview(spark, raw_export_path(spark, sf_dir)).select(F.split_part("line", F.lit(","), F.lit(1)).alias("first_field"), files.field_count(F.col("line")).alias("n_fields"))


@query("repair_audit")
def q_repair_audit(spark, sf_dir):
    return files.repair_audit(_raw(spark, sf_dir))


@query("landing_audit")
def q_landing_audit(spark, sf_dir):
    """The audit's counts as they were observed while the repaired rows were written."""
    path = land_once(spark, sf_dir, "repaired", lambda p: files.land_repaired(_raw(spark, sf_dir), p))
    return spark.read.parquet(f"{path}/audit")


def streamed_landing(spark, sf_dir) -> str:
    """The raw export landed incrementally by the streaming job (once per process and input)."""
    raw = raw_export_path(spark, sf_dir)

    def run(path):
        landing.land(spark, raw, f"{path}/out", f"{path}/checkpoints")
    return land_once(spark, sf_dir, "stream-landing", run)


@query("stream_repair")
def q_stream_repair(spark, sf_dir):
    return landing.read_landed(spark, f"{streamed_landing(spark, sf_dir)}/out", landing.ACCEPTED)


@query("stream_quarantine")
def q_stream_quarantine(spark, sf_dir):
    return landing.read_landed(spark, f"{streamed_landing(spark, sf_dir)}/out", landing.QUARANTINE).drop(S.RECORD)


def month_partitioned_path(spark, sf_dir) -> str:
    """Listings landed as parquet partitioned by the month of ``added_at``."""
    def write(path):
        df = listings(spark, sf_dir).withColumn("month", F.date_format(S.ADDED_AT, "yyyy-MM"))
        files.write_listings_parquet(df, path, partition_by="month")
    return land_once(spark, sf_dir, "listings-by-month", write)


@query("month_pruned_viewport")
def q_month_pruned_viewport(spark, sf_dir):
    """Date viewport over the month-partitioned hand-off: the month predicate
    prunes whole directories before any file is opened."""
    lo, hi = TABLE_DATE_VIEWPORT
    df = spark.read.parquet(month_partitioned_path(spark, sf_dir))
    pruned = df.filter(F.col("month").between(lo[:7], hi[:7]))
    return (pruned.withColumn(S.DATE, F.to_date(S.ADDED_AT))
                  .filter(F.col(S.DATE).between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))))
                  .select(S.URL, S.PRICE, S.DATE, "month"))


@query("roundtrip_listings")
def q_roundtrip_listings(spark, sf_dir):
    """Standardized CSV sink, read back through the raw scan: same rows."""
    path = scratch_path(spark, "listings-csv")
    files.write_listings_csv(listings(spark, sf_dir), path, compression="gzip")
    return files.accepted(files.repair(files.read_raw_listings(spark, path)))


# --- step 10: text regression, its artifacts, forecasts -------------------------

# Training runs: prompt variant per run, as the original published both.
TEXT_RUNS = {"days_name": S.DAYS_PASSED_NAME, "days_name_desc": S.DAYS_PASSED_NAME_DESC}
MAIN_RUN = "days_name_desc"
# Forecast prompts hold a name only, so they go to the run trained on names.
FORECAST_RUN = "days_name"


def training_run(spark, sf_dir, run: str = MAIN_RUN) -> str:
    """Fit the candidates once per process and input; returns the artifact folder."""
    def write(path):
        df, scaler = modelling_frame(spark, sf_dir)
        tokenmean.fit_run(df, path, TEXT_RUNS[run], "price_z", scaler)
    return land_once(spark, sf_dir, f"run-{run}", write)


def _history_price_units(spark, sf_dir, run: str = MAIN_RUN, mode: str = "correct") -> DataFrame:
    path = training_run(spark, sf_dir, run)
    sc = model.scaler_value(textmodel.read_scaler(spark, path))
    return metrics.unscale_metrics(textmodel.read_history(spark, path), sc["mean"], sc["std"], mode)


@query("text_regression_eval")
def q_text_regression_eval(spark, sf_dir):
    path = training_run(spark, sf_dir)
    df, _ = modelling_frame(spark, sf_dir)
    scored = tokenmean.predict(tokenmean.load_run(spark, path), df, TEXT_RUNS[MAIN_RUN])
    out = model.unscale(scored, textmodel.read_scaler(spark, path), textmodel.PREDICTION_Z, "prediction")
    return metrics.rounded(metrics.regression_metrics(out, S.PRICE, "prediction", [model.SPLIT]))


@query("metric_history")
def q_metric_history(spark, sf_dir):
    return metrics.rounded(_history_price_units(spark, sf_dir))


@query("metric_history_affine")
def q_metric_history_affine(spark, sf_dir):
    """The original dashboard's conversion (x * std + mean), to compare with its tables."""
    return metrics.rounded(_history_price_units(spark, sf_dir, mode="affine"))


@query("best_epoch")
def q_best_epoch(spark, sf_dir):
    return metrics.rounded(metrics.best_epoch(_history_price_units(spark, sf_dir), "rmse"), ["rmse"])


def text_forecast(spark, sf_dir, prompts, days=S.ORIGINAL_DAYS) -> DataFrame:
    """``prompt, day, price`` (or ``prompt, price`` with ``days=None``) of any texts."""
    out = tokenmean.predict_text(spark, training_run(spark, sf_dir, FORECAST_RUN), prompts, days)
    return out.withColumn(S.PRICE, F.round(S.PRICE, 6))


@query("text_forecast")
def q_text_forecast(spark, sf_dir):
    return text_forecast(spark, sf_dir, TABLE_LADDER)


@query("text_forecast_no_days")
def q_text_forecast_no_days(spark, sf_dir):
    return text_forecast(spark, sf_dir, TABLE_LADDER, days=None)


@query("forecast_prompts")
def q_forecast_prompts(spark, sf_dir):
    """The nine published prompts over days 1..89, days after the last observed one flagged."""
    out = text_forecast(spark, sf_dir, S.ORIGINAL_PROMPTS)
    return clean.flag_extrapolated(out, F.lit(S.ORIGINAL_LAST_DAY))


@query("forecast_lowess")
def q_forecast_lowess(spark, sf_dir):
    """Smoothed forecast curve of each prompt, as the charts draw it."""
    smooth = _rounded(trend.lowess(text_forecast(spark, sf_dir, TABLE_LADDER), ["prompt"], "day", S.PRICE), {S.PRICE: 4, "trend": 4})
    last = prepared(spark, sf_dir).select(F.max(S.DAYS_PASSED)).scalar()
    return clean.flag_extrapolated(smooth, last)


@query("metrics_csv")
def q_metrics_csv(spark, sf_dir):
    """Per-run metric tables published as CSV (leading index column), read back as one table."""
    paths = {}
    for run in TEXT_RUNS:
        hist = metrics.rounded(_history_price_units(spark, sf_dir, run))
        paths[run] = scratch_path(spark, f"metrics-{run}")
        out = hist.select(F.col("epoch").alias("_c0"), F.col("mse").alias("MSE"), F.col("mae").alias("MAE"),
                          F.col("rmse").alias("RMSE"), F.col("r2").alias("R2"))
        out.coalesce(1).write.option("header", "true").csv(paths[run])
    return files.read_metrics_csv(spark, paths)


@query("forecast_csv")
def q_forecast_csv(spark, sf_dir):
    """Forecast published in the wide form (unnamed row index, one column a prompt), read back and made long again."""
    prompts = list(TABLE_LADDER)
    path = scratch_path(spark, "predictions")
    files.write_predictions_csv(text_forecast(spark, sf_dir, prompts), path, prompts)
    return reshape.wide_to_long(files.read_predictions_csv(spark, path, prompts), ["day"], prompts, "prompt", S.PRICE)


# --- step 11: training by epochs ------------------------------------------------

def epoch_run(spark, sf_dir) -> str:
    """The run trained by epochs, once per process and input; returns its folder."""
    def write(path):
        df, _ = modelling_frame(spark, sf_dir)
        epochs.fit(df.select(S.URL, model.SPLIT, "price_z", TEXT_RUNS[MAIN_RUN]), path, TEXT_RUNS[MAIN_RUN], "price_z", keep=EPOCHS_KEPT)
    return land_once(spark, sf_dir, "epoch-run", write)


#: Checkpoints kept of the run: fewer than its epochs, so that the limit shows.
EPOCHS_KEPT = 3


@query("epoch_history")
def q_epoch_history(spark, sf_dir):
    """Training loss and validation errors after every epoch, and whether its checkpoint is still kept."""
    told = epochs.history(spark, epoch_run(spark, sf_dir))
    return _rounded(told, dict.fromkeys(["loss", "mse", "rmse", "mae", "r2"], 8))


@query("best_checkpoint")
def q_best_checkpoint(spark, sf_dir):
    """Token weights of the best epoch, loaded through the run's manifest."""
    weights, _ = epochs.load(spark, epoch_run(spark, sf_dir))
    return weights.select(epochs.TOKEN, (F.round(epochs.WEIGHT, 7) + F.lit(0.0)).alias(epochs.WEIGHT))  # no negative zero


@query("epoch_model_eval")
def q_epoch_model_eval(spark, sf_dir):
    """Errors in price units of the best epoch on all splits."""
    df, scaler = modelling_frame(spark, sf_dir)
    out = epochs.predict(epochs.load(spark, epoch_run(spark, sf_dir)), df, TEXT_RUNS[MAIN_RUN])
    out = model.unscale(out, scaler, textmodel.PREDICTION_Z, "prediction")
    return metrics.rounded(metrics.regression_metrics(out, S.PRICE, "prediction", [model.SPLIT]))
