"""Training by epochs: planted signal, restart after a failed attempt, checkpoint limit, best one through the manifest."""

import os
import random

import pytest

from pricelens.operators import epochs
from pricelens.operators.checkpoints import Run

WORTH = {"pro": 2.0, "max": 1.0, "mini": -1.5, "case": -3.0, "phone": 0.5, "blue": 0.0, "red": 0.0, "new": 0.75}


@pytest.fixture(scope="module")
def rows(spark):
    draw, out = random.Random(5), []
    for _ in range(1500):
        words = [draw.choice(list(WORTH)) for _ in range(draw.randint(1, 6))]
        label = 0.3 + sum(WORTH[w] for w in words) / len(words)
        out.append((draw.choice(["train", "train", "train", "val", "test"]), " ".join(words), label))
    out += [("train", None, 0.3), ("val", "", 0.3), ("test", "unseen", 0.3)]
    return spark.createDataFrame(out, "split string, text string, z double").repartition(4).persist()


def _weights(spark, folder, epoch=None):
    return {r["token"]: r["weight"] for r in epochs.load(spark, folder, epoch)[0].collect()}


def test_planted_signal_is_learned(spark, rows, tmp_path):
    folder = str(tmp_path / "run")
    told = epochs.fit(rows, folder, "text", "z", epochs=12, step=1.8, ridge=0.0)
    losses = [e["metrics"]["mse"] for e in told["epochs"]]
    assert len(losses) == 12 and losses == sorted(losses, reverse=True) and losses[-1] < 0.1 * losses[0] and losses[-1] < 0.02
    out = {r["text"]: r["pred_z"] for r in epochs.predict(epochs.load(spark, folder), rows, "text").collect()}
    bias = told["settings"]["bias"]
    assert out[None] == out[""] == out["unseen"] == bias
    learned = _weights(spark, folder)
    assert sorted(learned, key=learned.get)[:2] == ["case", "mini"] and max(learned, key=learned.get) == "pro"


def test_a_failed_attempt_between_epochs_changes_nothing(spark, rows, tmp_path):
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    expected = epochs.fit(rows, whole, "text", "z", epochs=4)

    def fail(epoch):
        if epoch == 2:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        epochs.fit(rows, broken, "text", "z", epochs=4, after_epoch=fail)
    told = Run(spark, broken).manifest()
    assert told["last"] == 1 and [r["epoch"] for r in epochs.history(spark, broken).collect()] == [0, 1]
    assert _weights(spark, broken) == pytest.approx(_weights(spark, whole, 1))  # the state before is whole
    again = epochs.fit(rows, broken, "text", "z", epochs=4)
    assert [e["metrics"]["mse"] for e in again["epochs"]] == pytest.approx([e["metrics"]["mse"] for e in expected["epochs"]])
    assert _weights(spark, broken) == pytest.approx(_weights(spark, whole))
    assert epochs.fit(rows, broken, "text", "z", epochs=4) == again  # nothing left to do
    with pytest.raises(ValueError, match="other settings"):
        epochs.fit(rows, broken, "text", "z", epochs=5, step=0.5)


def test_limit_and_best(spark, tmp_path):
    run = Run(spark, str(tmp_path / "run"), keep=3)
    for epoch, rmse in enumerate([0.5, 0.2, 0.4, 0.3, 0.6]):
        path = run.new_path(epoch)
        spark.range(1).write.parquet(path)
        told = run.commit(epoch, path, {"rmse": rmse})
        there = [e["epoch"] for e in told["epochs"] if e["path"]]
        assert len(there) <= 3 and {told["best"], epoch} <= set(there)
        assert all(os.path.isdir(e["path"]) for e in told["epochs"] if e["path"])
    assert told["best"] == 1 and there == [1, 3, 4]
    assert sum(name.startswith("checkpoint-") for name in os.listdir(tmp_path / "run")) == 3
    assert run.checkpoint()["epoch"] == 1 and run.checkpoint(4)["epoch"] == 4
    for epoch, match in ((0, "no longer kept"), (9, "no epoch")):
        with pytest.raises(FileNotFoundError, match=match):
            run.checkpoint(epoch)
    with pytest.raises(FileNotFoundError, match="run the training job first"):
        epochs.load(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        Run(spark, str(tmp_path), keep=1)


def test_empty_splits_are_told(spark, tmp_path):
    one = spark.createDataFrame([("train", "a", 1.0)], "split string, text string, z double")
    with pytest.raises(ValueError, match="validation split"):
        epochs.fit(one, str(tmp_path / "a"), "text", "z", epochs=1)
    with pytest.raises(ValueError, match="no labels"):
        epochs.fit(one.limit(0), str(tmp_path / "b"), "text", "z", epochs=1)
