import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pricelens.operators import cells


def _rows(rng, n):
    value = np.concatenate([rng.lognormal(8, 1.5, n), -rng.lognormal(3, 1, n // 5), np.zeros(n // 10)])
    day = [dt.date(2021, 1, 1 + int(d)) for d in rng.integers(0, 20, len(value))]
    return pd.DataFrame({"tag": rng.choice(["a", "b"], len(value)), "day": day, "v": value})


@pytest.mark.parametrize("accuracy", [0.005, 0.05])
def test_quantiles_of_any_days_lie_within_the_bounds(spark, accuracy):
    rows = _rows(np.random.default_rng(4), 3000)
    growth = cells.growth_of(accuracy)
    state = cells.count_cells(spark.createDataFrame(rows), ["tag", "day"], "v", accuracy).cache()
    probs, names = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0), ("p0", "p10", "q1", "median", "q3", "p99", "p100")
    for first, last in ((1, 20), (3, 3), (5, 11)):
        span = (dt.date(2021, 1, first), dt.date(2021, 1, last))
        told = cells.box_from_cells(state.where(state.day.between(*span)), ["tag"], probs, names).toPandas().set_index("tag")
        inside = rows[(rows.day >= span[0]) & (rows.day <= span[1])]
        for tag, part in inside.groupby("tag"):
            got, v = told.loc[tag], np.sort(part.v.to_numpy())
            assert (got.n, got["min"], got["max"]) == (len(v), v[0], v[-1])
            assert got["mean"] == pytest.approx(v.mean(), rel=1e-9)
            for p, name in zip(probs, names):
                exact, low, high = np.quantile(v, p), got[f"{name}_low"], got[f"{name}_high"]
                slack = 1e-9 * abs(exact) + 1e-9
                assert low - slack <= exact <= high + slack and low - slack <= got[name] <= high + slack
                if low > 0:
                    assert high / low <= growth * (1 + 1e-9)
                # the rank of the answer is off by less than the rows between its bounds
                among = ((v >= low - slack) & (v <= high + slack)).sum()
                assert abs(np.searchsorted(v, got[name]) - p * (len(v) - 1)) <= among + 1


def test_stores_add_up_in_any_parts(spark):
    rows = _rows(np.random.default_rng(5), 500)
    whole = cells.count_cells(spark.createDataFrame(rows), ["tag"], "v")
    parts = [cells.count_cells(spark.createDataFrame(rows[i::3]), ["tag"], "v") for i in range(3)]
    merged = cells.merge_cells(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["tag"])
    a, b = (d.drop("total").toPandas().sort_values(["tag", "cell"]).reset_index(drop=True) for d in (whole, merged))
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def test_odd_values(spark):
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (0.0,), (5e-324,), (1.7e308,)], "v double")
    told = cells.count_cells(odd, [], "v").orderBy("cell").toPandas()
    assert told["n"].tolist() == [1] * 5 and told["first"].tolist() == [-float("inf"), 0.0, 5e-324, 1.7e308, float("inf")]
    assert cells.box_from_cells(cells.count_cells(odd.where("false"), ["v"], "v"), ["v"]).count() == 0
