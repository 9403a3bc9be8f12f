"""Derived datasets: landed once per state of the input, in parallel for different ones, removed on request."""

import os
import shutil
import threading

from pricelens.sources import tables

SF = "/root/testdata/sf0.001"


def test_changed_input_lands_again(spark, tmp_path):
    for name in ("lineitem", "part", "supplier", "nation", "orders"):
        shutil.copyfile(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")  # contents alone: the given tables are read-only
    made = []

    def write(path):
        made.append(path)
        spark.range(3).write.parquet(path)

    first = tables.land_once(spark, str(tmp_path), "probe", write)
    assert tables.land_once(spark, str(tmp_path), "probe", write) == first
    spark.read.parquet(f"{SF}/nation.parquet").limit(5).toPandas().to_parquet(tmp_path / "nation.parquet")
    assert tables.land_once(spark, str(tmp_path), "probe", write) != first and len(made) == 2


def test_forget_deletes_and_lands_anew(spark, monkeypatch):
    monkeypatch.setattr(tables, "_LANDED", {})  # other tests keep theirs
    made = []

    def write(path):
        made.append(path)
        spark.range(3).write.parquet(path)

    first = tables.land_once(spark, SF, "forget-probe", write)
    tables.land_once(spark, SF, "forget-probe-2", write)
    local = first.removeprefix("file:")
    assert os.path.isdir(local)
    assert tables.forget_landed(spark) == 2 and not os.path.exists(local)
    again = tables.land_once(spark, SF, "forget-probe", write)
    assert again != first and len(made) == 3 and spark.read.parquet(again).count() == 3


def test_one_slow_landing_does_not_hold_up_another(spark):
    started, done = threading.Event(), threading.Event()

    def slow(path):
        started.set()
        assert done.wait(30)

    t = threading.Thread(target=tables.land_once, args=(spark, SF, "slow-probe", slow))
    t.start()
    assert started.wait(30)
    tables.land_once(spark, SF, "quick-probe", lambda path: done.set())  # would hang on one lock
    t.join(30)
    assert not t.is_alive()
