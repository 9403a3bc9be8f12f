"""Listing schema, column names and the fixed values of the original analysis."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names (snake case of the 13 CSV header fields, in file order).
URL = "url"
VOIVODESHIP = "voivodeship"
SCRAP_TIME = "scrap_time"
NAME = "name"
PRICE = "price"
BRAND = "brand"
CONDITION = "condition"
OFFER_FROM = "offer_from"
TYPE = "type"
DESCRIPTION = "description"
ADDED_AT = "added_at"
VIEWS = "views"
USER_SINCE = "user_since"

# Derived columns.
DATE = "date"
DAYS_PASSED = "days_passed"
DAYS_PASSED_NAME = "days_passed_name"
DAYS_PASSED_NAME_DESC = "days_passed_name_desc"
CONCATENATED_DESCRIPTION = "concatenated_description"
PHONE_MODEL = "phone_model"
CORRUPT = "_corrupt_record"
N_FIELDS = "n_fields"
REASON = "reason"
RECORD = "record"

LISTING = T.StructType([
    T.StructField(URL, T.StringType(), True),
    T.StructField(VOIVODESHIP, T.StringType(), True),
    T.StructField(SCRAP_TIME, T.TimestampNTZType(), True),
    T.StructField(NAME, T.StringType(), True),
    T.StructField(PRICE, T.DoubleType(), True),
    T.StructField(BRAND, T.StringType(), True),
    T.StructField(CONDITION, T.StringType(), True),
    T.StructField(OFFER_FROM, T.StringType(), True),
    T.StructField(TYPE, T.StringType(), True),
    T.StructField(DESCRIPTION, T.StringType(), True),
    T.StructField(ADDED_AT, T.TimestampNTZType(), True),
    T.StructField(VIEWS, T.DoubleType(), True),
    T.StructField(USER_SINCE, T.TimestampNTZType(), True),
])
LISTING_COLUMNS = [f.name for f in LISTING.fields]

# Same fields plus the whole text of records that do not fit them.
LISTING_WITH_RECORD = T.StructType(LISTING.fields + [T.StructField(CORRUPT, T.StringType(), True)])


def ddl(schema: T.StructType) -> str:
    """DDL string of a flat schema, as ``from_csv`` wants it."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


# --- Fixed values of the original analysis (must stay as they are) ---------
# Category filter applied to listings: Condition, Type, Brand.
ORIGINAL_FILTERS = {CONDITION: "Używane", TYPE: "Sprawny", BRAND: "iPhone"}
# Rows priced at or below this are accessories/services, not phones.
ORIGINAL_PRICE_CLIP = 1000.0
# Sub-model phrase ladder, most specific first; first match wins.
ORIGINAL_LADDER = ["iphone 11 pro max", "iphone 11 pro", "iphone 11"]
# Columns dropped by the cleaning step when the caller gives none.
ORIGINAL_DROP = [VOIVODESHIP, SCRAP_TIME, VIEWS, USER_SINCE, ADDED_AT, URL, BRAND,
                 CONDITION, OFFER_FROM, TYPE]
# Histogram bin width of the price distribution chart.
ORIGINAL_BIN_WIDTH = 75.0
# Split seed and fractions: 0.8 of rows for training, then 0.8 of those again.
ORIGINAL_SEED = 2137
ORIGINAL_TRAIN_FRACTION = 0.8
# Forecast day range, half open: days 1..89.
ORIGINAL_DAYS = (1, 90)
# Tokenizer truncation for training and for prediction.
ORIGINAL_MAX_LENGTH_TRAIN = 100
ORIGINAL_MAX_LENGTH_PREDICT = 50
# Last observed day marked on the forecast charts.
ORIGINAL_LAST_DAY = 55
# Forecast prompts of the published predictions table, in column order.
ORIGINAL_PROMPTS = [
    "iphone 11 64gb", "iphone 11 128gb", "iphone 11 256gb",
    "iphone 11 pro 64gb", "iphone 11 pro 256gb", "iphone 11 pro 512gb",
    "iphone 11 pro max 64gb", "iphone 11 pro max 256gb", "iphone 11 pro max 512gb",
]
# Price chart viewports.
ORIGINAL_DATE_VIEWPORT = ("2021-01-01", "2021-02-24")
ORIGINAL_PRICE_VIEWPORT = (1500.0, 4500.0)
# LOWESS trend defaults of the charting library: 2/3 of points, 3 robust rounds.
ORIGINAL_LOWESS_FRAC = (2, 3)
ORIGINAL_LOWESS_ITERATIONS = 3
# KDE curve: points on the grid between a series' min and max.
ORIGINAL_KDE_POINTS = 500
