"""Secret scan against the regular expressions themselves, rule by rule."""

import hashlib
import random
import re

import pytest

from pricelens.llm import secrets

BITS = ["token", "TOKEN", "api_key", "apikey", "Passwd", "secret", " ", "  ", "=", ":", '"', "'", "AKIA", "AKIA", "ABCDEFGH12345678", "deadbeef",
        "0123456789abcdef", "\n", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJ", "abc", "xoxb-", "ghp_", "sk_live_", "é", "€", "Z", "_", "-", "ab12" * 6, "😀", "ſecret", "\x00"]


def brute(text):
    out = []
    for n, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if re.fullmatch(rule.wanted or rule.pattern, m.group(), re.ASCII):
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_random_texts_match_the_expressions():
    scanner, draw = secrets.scanner_of(tuple(secrets.RULES)), random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choice(BITS) for _ in range(draw.randint(0, 40)))
        assert scanner.spans(text) == brute(text), text


def test_a_short_match_uses_up_its_text():
    scanner = secrets.scanner_of(tuple(secrets.RULES))
    assert scanner.spans("token=secret:abcdefgh12") == []
    assert scanner.spans("secret:abcdefgh12") == [(0, 0, 17)]
    assert scanner.spans("a" * 31) == [] and scanner.spans("a" * 32) == [(0, 2, 32)]


def test_very_long_texts():
    scanner = secrets.scanner_of(tuple(secrets.RULES))
    text = "é" * 300_000 + " token = " + "f" * 300_000
    assert scanner.spans(text) == [(300_001, 0, 600_009), (300_009, 2, 600_009)]


def test_the_automaton_is_smallest():
    a = secrets.scanner_of(tuple(secrets.BASE_RULES)).automaton
    assert secrets.minimised(a).moves.shape == a.moves.shape
    wider = secrets.combined([secrets.finder(r) for r in secrets.BASE_RULES])
    assert wider.moves.shape == a.moves.shape


@pytest.mark.parametrize("pattern", ["a*", "ab(cd)?", "a|abc"])
def test_rules_that_one_pass_cannot_follow_are_refused(pattern):
    with pytest.raises(ValueError):
        secrets.finder(secrets.Rule("bad", pattern))


def test_rows(spark):
    text = 'é token = "' + "0f" * 20 + '" AKIA' + "A" * 12
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, None, "y"), (2, "", "z")], "doc_id long, text string, spans string")
    got = secrets.digests(secrets.scan(docs)).collect()
    told = ",".join(f"{secrets.KINDS[n]}:{a}:{b}" for a, n, b in brute(text))
    assert [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in got] == [(1, 1, 1, 1, told)] * 2 + [(None, 0, 0, 0, ""), (2, 0, 0, 0, "")]
    assert got[0]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    kept = secrets.scan(docs.withColumnRenamed("spans", "kind"))  # "spans" is an output column, others stay
    assert kept.columns == ["doc_id", "kind", "spans"] and sorted(r["kind"] for r in kept.collect()) == ["x", "x", "y", "z"]
    assert secrets.scan(docs.limit(0)).count() == 0
