"""Lexical search against a plain scorer; the shared sums cost less and give the same."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = ["the", "of", "and", "Éa", "éa", "x1", "cat", "dog", "fish", "tree", "rock", "zz", "ÀB", "日本", "K"]


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    known = [(d, Counter(_terms(t))) for d, t in docs if _terms(t)]
    n_docs, words = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(w for _, c in known for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in known:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in _terms(text) if w in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def _text(draw, n):
    return " ".join(draw.choice(WORDS[:draw.randint(2, len(WORDS))]) + draw.choice(["", ".", ",\n", "--", "\x00"]) for _ in range(n))


def _tables(seed):
    draw = random.Random(seed)
    docs = [(i, _text(draw, draw.randint(0, 40))) for i in range(150)]
    docs += [(None, "the cat"), (7, "the cat cat"), (7, "the cat cat"), (300, None), (301, ""), (302, "..."), (303, "cat " * 50_000)]
    items = [(i, _text(draw, draw.randint(1, 15))) for i in range(30)]
    return docs, items + items[:2] + [(1, "the the the cat"), (90, None), (91, "?!"), (92, "unseen"), (None, "dog")]


def _run(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for name in ("n", "term", "tf", "score", "rank", "key", "item", "class", "salt"):
        d, i = d.withColumn(name, F.lit("x")), i.withColumn(name, F.lit("y"))
    return sorted([tuple(r) for r in lexical.search(d, i).select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.mark.parametrize("part", [1 << 17, 100])
def test_matches_a_plain_scorer(spark, monkeypatch, part):
    monkeypatch.setattr(lexical, "PART_TERMS", part)
    docs, items = _tables(4)
    assert _run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = _tables(5)
    assert _run(spark, [], items) == [] and _run(spark, docs, []) == [] and _run(spark, [(1, None)], [(1, "a")]) == []


def test_shared_sums_are_the_same_and_fewer():
    draw = random.Random(6)
    common = [1, 2, 3, 4, 5, 6, 6]
    items = [common + [draw.randint(7, 60) for _ in range(5)] for _ in range(80)]
    graph, rows = lexical.Graph(items, 61), 9
    alone = lexical.Graph(items, 61, shared=10**9)
    assert alone.additions() == sum(len(x) - 1 for x in items) and graph.additions() < 0.6 * alone.additions()
    values = np.random.default_rng(1).integers(0, 1000, (61, rows))
    term, row = (x.reshape(-1) for x in np.meshgrid(np.arange(61), np.arange(rows), indexing="ij"))
    wanted = np.array([values[x].sum(axis=0) for x in items])
    assert (graph.scores(row, term, values.reshape(-1), rows) == wanted).all() and (alone.scores(row, term, values.reshape(-1), rows) == wanted).all()


def test_best_keeps_ties_by_document():
    best = lexical.Best(2)
    for a in (6, 3, 0):
        best.add(np.array([[5, 5, 5], [0, a, 0]]), np.arange(a, a + 3))
    assert best.rows.T.tolist() == [[0, 0, 5], [0, 1, 5], [1, 7, 6], [1, 4, 3]]
