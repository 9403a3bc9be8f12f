"""The pipeline's stages against brute force, each on its own input."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from pricelens.llm import quality
from pricelens.llm.queries import TOKENIZER
from pricelens.llm.shared import table, written
from tests.llm.test_decontam import holds
from tests.llm.test_simhash import plain_components, plain_fingerprint

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_repeats(rows):
    """Texts by doc_id after the passages of 50 bytes that a smaller doc_id has as well are cut out."""
    first = {}
    for d, t in sorted(rows.items()):
        data = t.encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i:i + 50], d)
    out = {}
    for d, t in rows.items():
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if first[data[i:i + 50]] < d:
                gone[i:i + 50] = True
        out[d] = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "replace")
    return out


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    labels = table(spark, SMALL, "labels")
    library = Tokenizer.from_file(TOKENIZER)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["quality", "near_copies", "repeated_passages", "leaked_items", "tokens"]

    ranking = quality.learn(docs, labels)
    rows = {d: t for d, t in rows.items() if ranking.score(np.array([quality.text_features(t)]))[0] >= quality.CUT}
    stage = {}
    for name, function in P.STAGES:
        before = docs
        docs = written(function(spark, before, SMALL), "test-stage")
        stage[name] = docs
        if name != "tokens":
            assert docs.columns == COLUMNS and docs.dtypes == before.dtypes
    assert {r.doc_id: r.text for r in stage["quality"].collect()} == rows

    parts = plain_components({d: plain_fingerprint(t) for d, t in rows.items()})
    rows = {d: t for d, t in rows.items() if parts[d] == d}
    assert {r.doc_id: r.text for r in stage["near_copies"].collect()} == rows

    rows = without_repeats(rows)
    assert {r.doc_id: (r.text, r.n_chars) for r in stage["repeated_passages"].collect()} == {d: (t, len(t)) for d, t in rows.items()}

    items = [r.text for r in table(spark, SMALL, "benchmark").collect()]
    rows = {d: t for d, t in rows.items() if not any(holds(t, item) for item in items)}
    assert {r.doc_id: r.text for r in stage["leaked_items"].collect()} == rows

    for r in stage["tokens"].collect():
        ids = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted(r.doc_id for r in P.run(spark, SMALL).select("doc_id").collect()) == sorted(rows)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty_and_odd_tables(spark, name):
    function = dict(P.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars int, fp int, component_id string, score string"
    assert function(spark, spark.createDataFrame([], schema), SMALL).count() == 0
    rows = [(1, None, None, None, None, 1, "x", "y"), (2, "", "en", "s", 0, 1, "x", "y"), (None, "text without an id", "en", "s", 1, None, None, None),
            (3, "the same text twice", "en", "s", 1, 1, "x", "y"), (3, "the same text twice", "en", "s", 1, 1, "x", "y"), (4, "w " * 50_000, "en", "s", 1, 1, "x", "y")]
    got = function(spark, spark.createDataFrame(rows, schema), SMALL)
    assert name == "tokens" or got.columns == [c.split()[0] for c in schema.split(", ")]
    assert got.count() <= len(rows)


def test_one_row_of_each_group_of_near_copies(spark):
    same, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in ("same", "other", "third"))
    rows = [(1, same), (1, same), (1, other), (2, same), (3, third), (3, same), (3, third), (4, other), (None, third), (None, "only without an id " * 5), (None, "only without an id " * 5), (5, None), (5, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    got = P.near_copies(spark, docs, SMALL)
    assert got.columns == COLUMNS
    kept = [(r.doc_id, r.text or "") for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, same), (1, other), (3, third), (None, "only without an id " * 5), (5, "")], key=str)
