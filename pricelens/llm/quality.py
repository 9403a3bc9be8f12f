"""Quality classifier by Bradley-Terry ranking.

Every labelled good document is preferred to every labelled bad one.  Scores
are linear in features of the whole text; the weights minimise the logistic
loss of score differences over preference pairs (with a small ridge).  The
threshold is the quantile of the training scores that parts the two labels
best, and the reported score is the logistic of the distance to it, moved
so that the threshold reads ``CUT``.

Edge cases: null and empty texts have defined features (all counts 0) and get
a score; labels that are null, not 0/1, or contradictory for a doc_id are not
learned from; without both labels nothing can be ranked and every document
scores exactly ``CUT`` (kept); rows that repeat a doc_id are scored each; a
text of any length is read whole by one task; an empty table gives no rows;
extra columns of the labels are not read, those of the documents are kept unless
an output column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents the weights are learned from, at most (the smallest hashes of doc_id).
SAMPLE_ROWS = 12_000
#: Preference pairs drawn for each document of the larger class.
PAIRS_PER_ROW = 6
RIDGE = 1e-2
STEPS = 25
CUT = 0.7
HELD_OUT_PART, PARTS = 2, 4
#: Words of a text whose spread is measured together; longer texts are measured in pieces, the last of which ends with the text.
WINDOW = 200

FEATURES = ["log_words", "log_chars", "upper", "lower", "digit", "space", "line_end", "mark", "stop", "other_mark", "high",
            "distinct", "repeats", "mean_word", "long_word", "short_word", "dup_lines", "line_words", "marked_words", "upper_words",
            "window_distinct", "worst_marks", "worst_upper", "worst_distinct"]

_CLASS = np.zeros((256, 9), np.float64)
for _byte in range(256):
    _c = chr(_byte)
    _kind = (0 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z" else 2 if "0" <= _c <= "9" else 3 if _c in " \t" else 4 if _c in "\r\n"
             else 5 if _c in "#$%&*|!@^~<>{}[]\\=_+" else 6 if _c in ".,;:?'\"-()" else 7 if _byte < 128 else 8)
    _CLASS[_byte, _kind] = 1.0
_MARKS = frozenset("#$%&*|!@^~<>{}[]\\=_+")


def text_features(text: str) -> list[float]:
    """Features of a whole text; every share is of at least 1, so no text divides by zero."""
    data = text.encode()
    size = max(1, len(data))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / size
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    marked = np.fromiter((w[-1] in _MARKS or w[0] in _MARKS for w in words), bool, len(words))
    upper = np.fromiter((w.isupper() and len(w) > 1 for w in words), bool, len(words))
    lines = [x for x in text.split("\n") if x]
    full = [slice(a, a + WINDOW) for a in range(0, len(words) - WINDOW + 1, WINDOW)] or [slice(0, WINDOW)]
    if full[-1].stop < len(words):
        full.append(slice(len(words) - WINDOW, len(words)))
    distinct = [len(set(words[w])) / max(1, len(words[w])) for w in full]
    return [
        np.log1p(len(words)), np.log1p(len(text)), *shares[:9].tolist(),
        len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        float(lengths.sum()) / n, float((lengths > 14).sum()) / n, float((lengths < 4).sum()) / n,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), float(marked.sum()) / n, float(upper.sum()) / n,
        float(np.mean(distinct)), max(float(marked[w].sum()) / max(1, len(words[w])) for w in full),
        max(float(upper[w].sum()) / max(1, len(words[w])) for w in full), min(distinct),
    ]


@dataclass(frozen=True)
class Ranking:
    """Scores ``weights . clip((x - mean) / spread)``; ``threshold`` and ``unit`` are in that score's units."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    unit: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (self.raw(features) - self.threshold) / self.unit + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def fit(features: np.ndarray, labels: np.ndarray, seed: int = 11) -> Ranking | None:
    """Newton steps on the Bradley-Terry loss over sampled pairs; None unless both labels occur."""
    good, bad = np.nonzero(labels == 1)[0], np.nonzero(labels == 0)[0]
    if not len(good) or not len(bad):
        return None
    mean, spread = features.mean(axis=0), features.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    x = np.clip((features - mean) / spread, -8, 8)
    draw = np.random.default_rng(seed)
    n = max(len(good), len(bad)) * PAIRS_PER_ROW
    winners = np.resize(draw.permutation(good), n)
    losers = bad[draw.integers(0, len(bad), n)]
    difference = x[winners] - x[losers]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))  # chance that the loser wins
        gradient = difference.T @ p / n - RIDGE * w
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = x @ w
    order = np.argsort(raw, kind="stable")
    # share of bad ones below minus share of good ones below, at every quantile of the scores
    below_bad = np.cumsum(labels[order] == 0) / len(bad)
    below_good = np.cumsum(labels[order] == 1) / len(good)
    k = int(np.argmax(below_bad - below_good))
    ranked = raw[order]
    threshold = float(ranked[k] + ranked[min(k + 1, len(ranked) - 1)]) / 2
    return Ranking(mean, spread, w, threshold, max(float(raw.std()), 1e-9))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from; a null doc_id is not held out (and has no label)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(PARTS)) == HELD_OUT_PART, F.lit(False))


def _features_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([text_features(t or "") for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))


def learn(documents: DataFrame, labels: DataFrame) -> Ranking | None:
    """Fit on a bounded sample of the labels that may be learned from; only those documents' features are computed here."""
    clean = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most"))
    sample = clean.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most SAMPLE_ROWS rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _features_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(found), pa.list_(pa.float64()))], names=["doc_id", "quality", "features"])

    # repeated doc_ids: one row each, so the rows that reach the driver stay within the sample's bound
    measured = (rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "doc_id long, quality int, features array<double>")
                .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features")).orderBy("doc_id").collect())
    if not measured:
        return None
    return fit(np.array([r.features for r in measured]), np.array([r.quality for r in measured]))


def score(documents: DataFrame, ranking: Ranking | None) -> DataFrame:
    """``documents`` with ``score`` and ``predicted`` (1: keep), whole rows in one scan."""
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    documents = documents.select(*kept)
    schema = documents.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            scores = ranking.score(_features_of(batch)) if ranking else np.full(n, CUT)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= CUT).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return documents.mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels, then score every document."""
    return score(documents, learn(documents, labels))
