"""Exact split sizes, binned densities within their bound, counts observed while landing."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators import distribution, model
from pricelens.sources import files
from tests.test_files import HEADER, _fields, _line, _wrap


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 1003])
def test_sizes_are_exact(spark, n):
    keys = [f"k{i}" for i in range(n)]
    df = spark.createDataFrame([(k,) for k in keys], "url string")
    got = {r["url"]: r["split"] for r in model.add_exact_split(df).collect()}
    test = math.ceil(round(0.2 * n, 9))
    val = math.ceil(round(0.2 * (n - test), 9))
    order = sorted(keys, key=lambda k: (int(hashlib.md5(f"2137|{k}".encode()).hexdigest()[:15], 16), k))
    assert got == {k: "train" if i < n - test - val else "val" if i < n - test else "test" for i, k in enumerate(order)}
    if n == 100:
        again = model.add_exact_split(df.orderBy(F.rand(1)).repartition(7)).collect()
        assert {r["url"]: r["split"] for r in again} == got


def test_repeated_and_null_keys_stay_together(spark):
    df = spark.createDataFrame([(f"k{i % 40}" if i % 41 else None,) for i in range(400)], "url string")
    rows = model.add_exact_split(df).collect()
    assert len(rows) == 400 and len({(r["url"], r["split"]) for r in rows}) == len({r["url"] for r in rows})


def test_kth_smallest(spark):
    draw = random.Random(1)
    values = [draw.randrange(1 << 40) for _ in range(500)] + [7] * 50 + [(1 << 40) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 50, 51, 300, len(values)):
        cut, below = model.kth_smallest(df, "v", k, 40)
        assert cut == sorted(values)[k - 1] and below == sum(v < cut for v in values)


def test_binned_density_is_within_its_bound(spark):
    draw = random.Random(3)
    rows = [("a", draw.gauss(50, 10)) for _ in range(3000)] + [("a", 500.0)] * 3 + [("b", draw.choice([1.0, 2.0])) for _ in range(50)]
    rows += [("one", 5.0), ("flat", 2.0), ("flat", 2.0), (None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    exact = {(r["g"], r["grid_index"]): r for r in distribution.kde(df, ["g"], "v").collect()}
    binned = {(r["g"], r["grid_index"]): r for r in distribution.binned_kde(df, ["g"], "v").collect()}
    assert exact.keys() == binned.keys()
    for g in ("a", "b"):
        own = [v for k, v in rows if k == g and v is not None]
        mean = sum(own) / len(own)
        h = math.sqrt(sum((v - mean) ** 2 for v in own) / (len(own) - 1)) * len(own) ** -0.2
        d = (max(own) - min(own)) / (500 * distribution.KDE_BINS_PER_POINT)
        bound = (d * d / (8 * h * h) + math.exp(-distribution.KDE_REACH**2 / 2)) / (h * math.sqrt(2 * math.pi))
        worst = max(abs(exact[k]["density"] - binned[k]["density"]) for k in exact if k[0] == g)
        assert worst <= bound and bound < 2e-3 * max(r["density"] for k, r in exact.items() if k[0] == g)
        assert all(math.isclose(exact[k]["x"], binned[k]["x"]) for k in exact)


def test_counts_are_observed_while_landing(spark, tmp_path):
    lines = [_line(_fields("a")), _wrap(_line(_fields("b"))), _line(_fields("c") + ["x"]), "d"]
    (tmp_path / "raw.csv").write_text(HEADER + "\n" + "\n".join(lines) + "\n", encoding="utf-8")
    raw = files.read_raw_listings(spark, str(tmp_path / "raw.csv"))
    counts = files.land_repaired(raw, str(tmp_path / "out"))
    assert counts == {r["stage"]: r["n_rows"] for r in files.repair_audit(raw).collect()} == {"raw": 4, "wrapped": 2, "quarantined": 1, "accepted": 3}
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 4
    assert {r["stage"]: r["n_rows"] for r in spark.read.parquet(str(tmp_path / "out/audit")).collect()} == counts
