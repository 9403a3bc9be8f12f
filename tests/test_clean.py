import datetime as dt

from pyspark.sql import functions as F

from pricelens import schema as S
from pricelens.operators import clean

TS = dt.datetime


def listing(url, price, name="iPhone 11", desc="Opis", cond="Używane", typ="Sprawny", brand="iPhone",
            added=TS(2021, 1, 5, 10, 0)):
    return (url, "Mazowieckie", TS(2021, 2, 1), name, price, brand, cond, "Osoba", typ, desc, added, 3.0,
            TS(2019, 1, 1))


def frame(spark, rows):
    return spark.createDataFrame(rows, S.LISTING)


def test_preprocess_filters_clip_and_prompts(spark):
    rows = [
        listing("a", 2000.0, "iPhone 11 PRO", "ŁADNY Stan", added=TS(2021, 1, 3, 12)),
        listing("b", 1000.0),                       # exactly the clip: dropped
        listing("c", 1000.01, added=TS(2021, 1, 10)),
        listing("d", None),                         # null price
        listing("e", 3000.0, cond="Nowe"),          # other condition
        listing("f", 500.0, added=TS(2020, 12, 1)),  # cheap row must not set the first date
        listing("g", 2500.0, name=None),            # null name -> null prompts
    ]
    out = clean.preprocess(frame(spark, rows)).collect()
    got = sorted((r.price, r.days_passed_name, r.days_passed_name_desc) for r in out)
    assert got == [
        (1000.01, "7 days iphone 11", "7 days iphone 11 opis"),
        (2000.0, "0 days iphone 11 pro", "0 days iphone 11 pro ładny stan"),
        (2500.0, None, None),
    ]


def test_low_price_audit_is_strict(spark):
    rows = [listing("a", 999.99), listing("b", 1000.0), listing("c", 1000.01)]
    out = clean.low_price_audit(frame(spark, rows)).collect()
    assert [r.price for r in out] == [999.99]
    assert out[0].asDict().keys() == {"name", "price", "description", "date"}


def test_phone_model_ladder_first_match(spark):
    rows = [
        listing("a", 3000.0, "iPhone 11 Pro Max", "x"),
        listing("b", 3000.0, "iPhone 11 Pro", "x"),
        listing("c", 3000.0, "iPhone 11", "super pro max"),
        listing("d", 3000.0, "iPhone X", "nic"),
        listing("e", 3000.0, "Telefon", "iphone 11 pro max w opisie"),
        listing("f", 3000.0, "Telefon", None),
    ]
    out = {r.price: r for r in clean.explore_frame(frame(spark, rows)).collect()}
    tags = sorted((r.phone_model or "") for r in clean.add_phone_model(
        clean.add_concatenated(frame(spark, rows)), S.ORIGINAL_LADDER).collect())
    assert tags == ["", "", "iphone 11", "iphone 11 pro", "iphone 11 pro max", "iphone 11 pro max"]
    assert len(out) == 1


def test_concat_is_null_propagating(spark):
    df = frame(spark, [listing("a", 2000.0, "A", None)])
    r = clean.add_concatenated(df).collect()[0]
    assert r.concatenated_description is None


def test_days_passed_uses_filtered_minimum(spark):
    rows = [listing("a", 2000.0, added=TS(2021, 1, 10)), listing("b", 2000.0, added=TS(2021, 1, 20)),
            listing("c", 2000.0, cond="Nowe", added=TS(2021, 1, 1))]
    out = clean.prepared(frame(spark, rows)).select("url", "days_passed").collect()
    assert dict((r.url, r.days_passed) for r in out) == {"a": 0, "b": 10}


def test_extrapolated_flag(spark):
    df = spark.range(1, 6).select(F.col("id").cast("int").alias("day"))
    got = [r.extrapolated for r in clean.flag_extrapolated(df, 3).orderBy("day").collect()]
    assert got == [False, False, False, True, True]
