"""Long phrase ladders and subword pieces against plain versions."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators import ladder, subwords

WORDS = ["pro", "pro max", "max", "phone", "phone 11", "", "é", "日本", "aab", "ab", "b"]


@pytest.mark.parametrize("letters", [None, 40])
def test_first_phrase_by_rank(spark, letters):
    draw = random.Random(2)
    phrases = list(dict.fromkeys("".join(draw.choice("abcé ") for _ in range(draw.randint(1, 7))) for _ in range(400)))[:300]
    phrases += phrases[:2]  # of equal phrases the first counts
    texts = ["".join(draw.choice("abcdé ") for _ in range(draw.randint(0, 30))) for _ in range(300)] + [None, "", "d" * 100_000 + phrases[-3]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, phrase string")
    if letters:
        assert len(ladder.ladder_parts(phrases, letters)) > 10
    got = {r["id"]: r["phrase"] for r in ladder.add_first_phrase(df, "text", phrases, letters=letters).collect()}
    assert got == {i: None if t is None else next((p for p in phrases if p in t), None) for i, t in enumerate(texts)}


def test_short_and_long_ladders_agree(spark, monkeypatch):
    texts = [(t,) for t in ["phone 11 pro max", "max phone", "aab", "日本é", None, "zzz"]]
    df, phrases = spark.createDataFrame(texts, "text string"), [w for w in WORDS if w]
    short = ladder.add_first_phrase(df, "text", phrases)
    monkeypatch.setattr(ladder, "SHORT", 0)
    long = ladder.add_first_phrase(df, "text", phrases)
    assert "MapInArrow" not in short._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, short.collect())) == sorted(map(str, long.collect()))


def _vocabulary(spark, tmp_path, pieces):
    path = tmp_path / "pieces.txt"
    path.write_text("".join(f"{base64.b64encode(p if isinstance(p, bytes) else p.encode()).decode()} {i}\n" for i, p in enumerate(pieces)), encoding="ascii")
    return subwords.read_pieces(spark, str(path))


def test_greedy_longest_match(spark, tmp_path):
    pieces = [" a", "a", "ab", " ab", "b", "abc", "bc", " caf", "é", b"\xc3", " x", "x"]
    vocabulary = _vocabulary(spark, tmp_path, pieces)
    assert vocabulary.count() == len(pieces) - 1  # a lone byte of a letter is no piece
    ids = {p: i + 2 for i, p in enumerate(pieces)}

    def cut(word):
        rest, out = " " + word, []
        while rest:
            n = max((k for k in range(1, len(rest) + 1) if rest[:k] in ids), default=0)
            if not n:
                return [1]
            out.append(ids[rest[:n]])
            rest = rest[n:]
        return out if len(word) <= subwords.MAX_WORD else [1]

    words = ["a", "ab", "abc", "aabc", "abab", "café", "cafés", "z", "abz", "b", "x" * 100, "x" * 101, "日"]
    got = {r["word"]: r["ids"] for r in subwords.cut_words(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary).collect()}
    assert got == {w: cut(w) for w in words}

    docs = spark.createDataFrame([(1, "AB, abc"), (2, None), (3, ""), (4, "z " * 50), (1, "AB, abc")], "doc_id long, text string").withColumn("word", F.lit("q"))
    rows = subwords.tokenize(docs, "text", vocabulary, 6).orderBy("doc_id").collect()
    told = [*cut("ab"), *cut("abc")][:6]
    assert [(r["doc_id"], r["input_ids"], r["attention_mask"]) for r in rows] == [
        (1, told + [0] * (6 - len(told)), [1] * len(told) + [0] * (6 - len(told)))] * 2 + [(2, None, None), (3, [0] * 6, [0] * 6), (4, [1] * 6, [1] * 6)]
    rate = subwords.unknown_rate(docs, "text", vocabulary).first()
    assert (rate["n_words"], rate["n_unknown"]) == (54, 50 + 2 * (cut("abc") == [1])) and rate["unknown_rate"] == rate["n_unknown"] / 54
    assert subwords.unknown_rate(docs.limit(0), "text", vocabulary).first()["unknown_rate"] is None
