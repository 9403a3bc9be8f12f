import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pricelens.operators.ranking import exact_quantiles, global_rank


def test_global_rank_is_dense_total_order(spark):
    df = spark.range(0, 3000).selectExpr("cast((id * 7919) % 3000 as long) as k").repartition(5)
    out = global_rank(df, ["k"]).toPandas().sort_values("k")
    assert out["rank"].tolist() == list(range(1, 3001))


def test_exact_quantiles_match_numpy_linear(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.normal(100, 20, 3001), 1)  # many duplicates
    grp = np.where(np.arange(3001) % 3 == 0, "x", "y")
    pdf = pd.DataFrame({"g": grp, "v": vals})
    df = spark.createDataFrame(pdf).repartition(6)
    out = exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75, 0.9], ["a", "b", "c", "d"]).toPandas()
    for _, r in out.iterrows():
        x = pdf.loc[pdf.g == r.g, "v"].to_numpy()
        assert r.n == len(x)
        np.testing.assert_allclose([r.a, r.b, r.c, r.d], np.percentile(x, [25, 50, 75, 90]), rtol=1e-12)


def test_exact_quantiles_single_value_group(spark):
    df = spark.createDataFrame([("s", 5.0)], "g string, v double")
    r = exact_quantiles(df, ["g"], "v", [0.25, 0.5], ["a", "b"]).collect()[0]
    assert (r.n, r.a, r.b) == (1, 5.0, 5.0)


def test_results_do_not_depend_on_exchange_reuse(spark):
    rng = np.random.default_rng(4)
    n = 40_000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 5, n)), "v": rng.integers(-2**30, 2**30, n)})
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") == 4, None).otherwise(F.col("g"))).repartition(9)
    want = {}
    for g, part in pdf.groupby("g"):
        want[None if g == 4 else g] = np.percentile(part["v"], [25, 50, 75]).tolist()
    old = spark.conf.get("spark.sql.exchange.reuse")
    try:
        for reuse in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            got = {r.g: [r.a, r.b, r.c] for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75], ["a", "b", "c"]).collect()}
            assert got == want  # the null group and the hot group included
            ranks = global_rank(df.select("v").distinct(), ["v"]).orderBy("v").select("rank").collect()
            assert [r.rank for r in ranks] == list(range(1, len(ranks) + 1))
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_exact_quantiles_of_extremes(spark):
    values = [-1e300, 0.0, 1e-300, 1.0, 1.0, 1.0, 2.0, 1e12, float("nan"), None]
    df = spark.createDataFrame([("s", v) for v in values] + [("t", None)], "g string, v double")
    rows = exact_quantiles(df, ["g"], "v", [0.0, 0.5, 1.0], ["a", "b", "c"]).collect()
    assert [(r.g, r.n, r.a, r.b, r.c) for r in rows] == [("s", 8, -1e300, 1.0, 1e12)]
    assert exact_quantiles(df.filter("false"), ["g"], "v", [0.5], ["a"]).count() == 0


def test_quantiles_without_groups(spark):
    r = exact_quantiles(spark.range(101), [], "id", [0.1, 0.5], ["a", "b"]).first()
    assert (r.n, r.a, r.b) == (101, 10.0, 50.0)
