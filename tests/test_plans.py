"""Physical plans: filters reach the scan, columns are pruned, no Python in the hot path."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_preprocess_pushes_filters_and_prunes_columns(spark):
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # no "..." in the scan metadata
    try:
        plan = _plan(E.queries()["preprocess"](spark, SF))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert "PushedFilters: [IsNotNull(condition), IsNotNull(type), IsNotNull(price)" in plan
    assert "EqualTo(condition,R)" in plan and "GreaterThan(price,1000.0)" in plan
    read = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert read and all("voivodeship" not in r and "views" not in r for r in read)


@pytest.mark.parametrize("name", ["preprocess", "explore_frame", "model_tag", "mean_by_date_model",
                                  "regression_metrics", "price_histogram", "tokens_padded"])
def test_no_row_at_a_time_python(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "BatchEvalPython" not in plan
    assert "ArrowEvalPython" not in plan


def test_listings_scan_once_per_subquery(spark):
    # The earliest date is a scalar subquery (one aggregate), not a window over all rows.
    plan = _plan(E.queries()["preprocess"](spark, SF))
    assert "Window" not in plan
    assert "Subquery" in plan


def test_month_partition_pruning(spark):
    plan = _plan(E.queries()["month_pruned_viewport"](spark, SF))
    assert "PartitionFilters: [isnotnull(month" in plan


def test_quantities_are_not_folded_by_value_or_exploded(spark):
    histogram = _plan(E.queries()["price_histogram"](spark, SF))
    assert "keys=[phone_model" in histogram and ", price#" not in "".join(x for x in histogram.splitlines() if "Exchange" in x)
    assert "Generate" not in _plan(E.queries()["price_kde"](spark, SF))


def test_modelling_queries_read_the_prepared_rows(spark):
    for name in ("extrapolated_flag", "tokens_padded", "regression_metrics"):
        plan = _plan(E.queries()[name](spark, SF))
        assert "/prepared-" in plan and "/listings-" not in plan


def test_caller_keeps_its_partition_count(spark):
    from pricelens.session import get_spark, is_local

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "321")
        assert get_spark().conf.get("spark.sql.shuffle.partitions") == "321"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert is_local("local") and is_local("local[4]") and not is_local("local-cluster[1,1,1024]") and not is_local("yarn")
