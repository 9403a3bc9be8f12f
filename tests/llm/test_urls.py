"""URL filter: automaton against fnmatch, verdicts against DuckDB and plain Python."""

import fnmatch
import random

import duckdb

from pricelens.llm import urlfilter as U
from pricelens.llm.queries import BLOCK_GLOBS, QUERIES, URL_RULES
from pricelens.llm.sql import ORACLE

SMALL = "/root/testdata/sf0.01"


def test_automaton_against_fnmatch():
    rng = random.Random(1)
    globs = ["*", "", "?", "a*", "*a", "*ab*ba*", "a?b", "**a", "*" + "ab" * 50 + "*"] + ["".join(rng.choice("ab*?") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts = ["", "ab" * 60] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    hits = U.run(U.compile_globs([(g, 0) for g in globs]), [t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert hits[i, j] == fnmatch.fnmatchcase(t, g), (t, g)
    assert U.run(U.compile_globs([("a", 0)]), []).shape == (0, 1)


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = max((r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.text), default=None)
    if best:
        return host, path, best.text, best.verdict
    return host, path, None, "block" if any(g.strip("*") in x for g in BLOCK_GLOBS for x in (host, path)) else "allow"


def test_odd_urls(spark):
    urls = [None, "", "nonsense", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/1", "http://xexample.org/es/", "https://a.example.org/en/12",
            "ftp://x.com/fr/", "ftp://com/de/", "ftp://x.com/de", "http://x.com?/fr/", "http://x.com#/de/", "http://É.org/", "http://İ.com/fr/", "a://b://c.org/x",
            "http://x.com/?u=http://example.org/es/", "http://spam-farm.com/fr/", "http://spam-farm.net/", "http://x.net/cheap-pills", "line\nhttp://x.org/\ny", "http://x.org/" + "a" * 5000,
            "http://x.net/a.example.org/es/", "http://x.net/.com/fr/", "http://org", "http://user@x.org:80/p", "http://*.com/fr/*?"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)]
    got = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string").repartition(2), URL_RULES, BLOCK_GLOBS).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(u) for i, u in enumerate(urls)}


def test_no_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in U.filter_urls(pages, [], [], default="block").collect()] == [(None, "block")]
    assert U.filter_urls(pages.where("false"), URL_RULES, []).count() == 0


def test_query_against_sql(spark):
    got = sorted(tuple(r) for r in QUERIES["op9_url_filter"](spark, SMALL).select("page_id", "host", "path", "rule", "verdict").collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    assert got == sorted(db.sql(ORACLE["op9_url_filter"]).fetchall())
    assert {r[4] for r in got} == {"allow", "block"}
