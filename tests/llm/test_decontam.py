"""Decontamination against brute force: retrieval is whole, clean documents stay."""

import random

import numpy as np

from pricelens.llm import decontam as D
from pricelens.llm.queries import QUERIES
from pricelens.llm.shared import table

SMALL = "/root/testdata/sf0.01"


def plain_scores(index, words):
    """Largest share over all half-overlapping passages, for every item."""
    impact = {t: {int(index.items[k]): index.impacts[k] for k in range(index.starts[n], index.starts[n + 1])} for t, n in index.terms.items()}
    best = np.zeros(len(index.item_ids))
    for a in range(0, len(words), index.half):
        scores = np.zeros(len(index.item_ids))
        for t in set(words[a:a + 2 * index.half]):
            for item, x in impact.get(t, {}).items():
                scores[item] += x
        best = np.maximum(best, scores)
    return best


def test_retrieval_against_every_score():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(80)]
    say = lambda n: " ".join(vocabulary[int(rng.paretovariate(0.6)) % 80] for _ in range(n))
    index = D.build_index([(i, say(rng.randint(1, 40))) for i in range(30)] + [(99, None), (98, "..."), (97, "")])
    assert len(index.item_ids) == 30
    documents = [D.words_of(say(rng.randint(0, 600))) for _ in range(40)] + [[]]
    got = D.retrieve(index, documents, 0.55)
    want = {(d, i): s for d, w in enumerate(documents) for i, s in enumerate(plain_scores(index, w)) if s >= 0.55}
    assert got.keys() == want.keys() and len(want) > 10
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_postings_of_closed_blocks_are_not_read():
    rng = random.Random(2)
    common = [f"c{i}" for i in range(6)]
    items = [" ".join([f"own{i}x{k}" for k in range(10)] + rng.sample(common, 4)) for i in range(200)]
    index = D.build_index(list(enumerate(items)))
    documents = [D.words_of(" ".join(common * 5) + " " + items[i]) for i in range(0, 200, 20)]
    read = []
    got = D.retrieve(index, documents, 0.7, read)
    assert {(d, index.item_ids[i]) for d, i in got} == {(d, 20 * d) for d in range(10)}
    assert read and all(0 < a < 0.2 * b for a, b in read)
    want = {(d, i): s for d, w in enumerate(documents) for i, s in enumerate(plain_scores(index, w)) if s >= 0.7}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def holds(document, item):
    """Whether the document has 0.8 of the five-word runs of the item's question and of its answer (a shorter half: all its words in a row)."""
    words = D.words_of(document)
    for half in D.question_answer(item):
        n = min(5, len(half))
        if not n:
            continue
        wanted = {tuple(half[i:i + n]) for i in range(len(half) - n + 1)}
        own = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
        if len(wanted & own) < 0.8 * len(wanted):
            return False
    return bool(D.words_of(item))


def test_query_against_brute_force(spark):
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    want = {(r.doc_id, item) for r in table(spark, SMALL, "documents").collect() for item, text in items if holds(r.text or "", text)}
    got = QUERIES["op5_decontaminate"](spark, SMALL).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 0


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_ITEMS", 2)
    item = "What is the capital of the far northern province? The capital is the old town of Vardo by the sea."
    near = item.replace("capital is", "capital town is")
    docs = [(1, f"intro {item.upper()} outro"), (2, None), (3, ""), (4, "What is the capital of the far northern province?"), (5, " ".join(["noise"] * 5000) + " " + item),
            (6, near), (None, item), (7, item), (7, item), (8, "only word"), (9, "the capital of the old sea " * 50)]
    bench = [(10, item), (10, item), (11, None), (12, ""), (13, "?!"), (None, "A single sentence with no end that is long enough to be split"), (14, "zz")]
    documents = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(2)
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.find_leaks(documents, benchmark).collect()), key=str)
    assert got == sorted([(d, 10) for d in (1, 5, 7, 7, None) for _ in range(2)], key=str)
    kept = D.without_leaks(documents, benchmark)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 8, 9]
    none = benchmark.where("false")
    assert D.find_leaks(documents, none).count() == 0 and D.without_leaks(documents, none).count() == len(docs)
    assert D.find_leaks(documents.where("false"), benchmark).count() == 0


def test_one_word_changed_anywhere(spark):
    """Every one-word change that leaves 0.8 of the whole item's five-word runs is found, those in the answer too."""
    items = [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.1", "benchmark").collect()]
    index = D.build_index(items)
    edits, own, in_answer = [], [], 0
    for i, text in items:
        question, answer = D.question_answer(text)
        words = question + answer
        wanted = D.shingles(words)
        for k in range(len(words)):
            changed = [*words[:k], b"zzqx", *words[k + 1:]]
            if len(wanted & D.shingles(changed)) >= 0.8 * len(wanted):
                edits.append(b" ".join([b"some", b"words", b"before", *changed, b"and", b"after"]).decode())
                own.append(i)
                in_answer += k >= len(question)
    found = {(row, index.item_ids[item]) for row, item, *_ in D.matches(index, edits)}
    assert len(edits) > 5000 and in_answer > 1000
    missed = [e for e in enumerate(own) if e not in found]
    assert not missed, (len(missed), len(edits), in_answer)


def test_scores_do_not_depend_on_parts(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(vocabulary[int(rng.paretovariate(0.7)) % 60] for _ in range(n))
    items = [(i, say(rng.randint(8, 60))) for i in range(40)]
    bench = items + [(100 + i, items[0][1]) for i in range(30)] + [(200, None), (201, "?!")]
    docs = [(i, say(20) + " " + " ".join(["zz", *t.split()[1:]]) + " " + say(20), "x") for i, t in items] + [(50, None, "x"), (51, "", "x")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(2)
    whole = D.build_index(bench)
    want = sorted((docs[r][0], whole.item_ids[i], round(score, 9)) for r, i, score, *_ in D.matches(whole, [t or "" for _, t, _ in docs]))
    leaking = {d for d, *_ in want}
    assert len(want) > 40 and any(score < 0.999 for *_, score in want)
    for size in (1_000, 7):
        monkeypatch.setattr(D, "PART_ITEMS", size)
        tests = D.fold(benchmark)
        assert tests.parts == -(-40 // size)
        assert sum(len(index.item_ids) for index in tests.indexes()) == 40
        got = D.find_leaks(documents, benchmark).collect()
        assert sorted((r.doc_id, r.item_id, round(r.bm25, 9)) for r in got) == want
        kept = D.without_leaks(documents, benchmark)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, *_ in docs if d not in leaking) and kept.columns == documents.columns
