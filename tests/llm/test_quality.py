"""Quality ranking: held-out accuracy, fitting, odd texts."""

import zlib

import numpy as np

from pricelens.llm import quality
from pricelens.llm.queries import QUERIES
from pricelens.llm.shared import table

MEDIUM = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    good = labels == 1
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_quality"](spark, MEDIUM).collect()}
    assert len(rows) == table(spark, MEDIUM, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    test = [(rows[r.doc_id].score, rows[r.doc_id].predicted, r.quality) for r in table(spark, MEDIUM, "labels").collect() if rows[r.doc_id].held_out]
    score, predicted, label = (np.array(x) for x in zip(*test, strict=True))
    assert auc(score, label) > 0.95
    assert (predicted == label).mean() > 0.95


def test_fit_prefers_the_better():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = (x[:, 1] + 0.1 * rng.standard_normal(400) > 0).astype(int)
    ranking = quality.fit(x, y)
    assert np.argmax(np.abs(ranking.weights)) == 1 and ranking.weights[1] > 0
    assert ((ranking.score(x) >= quality.CUT).astype(int) == y).mean() > 0.9
    assert quality.fit(x, np.ones(400, int)) is None and quality.fit(x[:0], y[:0]) is None


def test_odd_texts_and_labels(spark):
    texts = ["", None, " ", "a", "\n\n", "#", "x" * 100_000, "w " * 60_000, "漢字 é", "A B C" * 50] + [f"plain words number {i} go on" for i in range(20)] + ["A!! B!! C!!"] * 20
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "clash"), (3, "again", "clash")], "doc_id long, text string, score string").repartition(2)
    labels = spark.createDataFrame([(i, 1) for i in range(10, 30)] + [(i, 0) for i in range(30, 50)] + [(12, 0), (13, None), (None, 1), (14, 7), (999, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows if r.doc_id in range(16, 30)} == {1} and {r.predicted for r in rows if r.doc_id in range(30, 50)} == {0}
    nothing = quality.classify(docs, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in nothing} == {(quality.CUT, 1)}
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.learn(docs, labels), quality.learn(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_worst_window_covers_the_end_of_a_text():
    plain = [f"word{i}" for i in range(450)]
    junk = [*plain[:400], *["#BUY!"] * 50]
    worst = {n: i for i, n in enumerate(quality.FEATURES) if n.startswith(("worst", "window"))}
    clean, ended = quality.text_features(" ".join(plain)), quality.text_features(" ".join(junk))
    assert clean[worst["worst_marks"]] == 0 and ended[worst["worst_marks"]] == 50 / 200
    assert ended[worst["worst_upper"]] == 50 / 200 and ended[worst["worst_distinct"]] == 151 / 200 and ended[worst["window_distinct"]] < 1
    short = quality.text_features(" ".join(junk[380:]))
    assert short[worst["worst_marks"]] == 50 / 70
