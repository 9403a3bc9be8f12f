"""SimHash fingerprints, vantage-point routing and components against brute force."""

import random

import numpy as np
import xxhash

from pricelens.llm import simhash
from pricelens.llm.components import connected_components
from pricelens.llm.queries import QUERIES
from pricelens.llm.shared import table

SMALL = "/root/testdata/sf0.01"


def plain_fingerprint(text, width=3):
    words = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text)).encode()
    for b in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([b]), b" ")
    words = [w for w in words.split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=3):
    """Component id (smallest key) of {key: fingerprint}."""
    keys = list(prints)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    values = np.array([prints[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.nonzero(np.bitwise_count(values ^ values[i]) <= distance)[0]:
            a, b = sorted((root(k), root(keys[j])))
            parent[b] = a
    return {k: root(k) for k in keys}


def test_fingerprints():
    texts = ["", " \t\n", "One", "one TWO", "a b c", "a b c d", "É é A", "a b c　d e f", "x\x1fy z w", "w " * 500, "rep rep rep other " * 40, "漢 字 か な"]
    assert simhash.fingerprint_texts(texts).tolist() == [plain_fingerprint(t) for t in texts]


def clustered(rng, n):
    values = {0, (1 << 64) - 1}
    while len(values) < n:
        v = rng.choice(list(values)[-50:]) if rng.random() < 0.5 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    return np.array(sorted(values), np.uint64)


def test_every_pair_meets_once(monkeypatch):
    rng = random.Random(2)
    values = clustered(rng, 1500)
    for leaves in (1, 2, 13, 60):
        tree = simhash.build_tree(values[::3], leaves)
        rows, shard, home = simhash.route(tree, values, 3)
        assert np.array_equal(np.sort(rows[home]), np.arange(len(values)))
        met = {}
        for s in np.unique(shard):
            here = rows[shard == s]
            own = set(rows[(shard == s) & home].tolist())
            close = np.bitwise_count(values[here][:, None] ^ values[here][None, :]) <= 3
            for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True):
                if here[i] in own or here[j] in own:
                    pair = tuple(sorted((int(here[i]), int(here[j]))))
                    met[pair] = met.get(pair, 0) + 1
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
        assert set(met) == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
        assert set(met.values()) <= {1}
    monkeypatch.setattr(simhash, "LEAF_ROWS", 20)
    assert [len(set(x)) for x in (simhash.link_within(values, np.ones(len(values), bool), 3), plain_components(dict(enumerate(values.tolist()))).values())][0] == len(set(plain_components(dict(enumerate(values.tolist()))).values()))


def test_links_over_shards_and_blocks(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("BLOCK_ROWS", 25), ("LEAF_ROWS", 16)):
        monkeypatch.setattr(simhash, name, value)
    values = clustered(random.Random(8), 700)
    signed = values.view(np.int64).tolist()
    edges = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3), 3)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    want = plain_components(dict(zip(signed, values.tolist(), strict=True)))
    groups = {}
    for k, c in want.items():
        groups.setdefault(c, set()).add(k)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(k for k in found if found[k] == c) for c in set(found.values())}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 60)] + [(5, 5), (300, 301), (301, 300)] + [(rng.randint(400, 460), rng.randint(400, 460)) for _ in range(50)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(found) == set(parent)
    assert len({(found[x], root(x)) for x in found}) == len(set(found.values())) == len({root(x) for x in found})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(5, None), (3, ""), (9, " \n"), (1, "one"), (2, "ONE"), (None, "one"), (None, "null id alone here"), (8, base), (7, base.upper()), (6, base + " extra"), (6, base + " extra"), (4, "x " * 30_000)]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int").repartition(2)).collect()
    prints = {i: plain_fingerprint(t or "") for i, (_, t) in enumerate(rows)}
    parts = plain_components(prints)
    ids = {c: min((rows[i][0] for i in parts if parts[i] == c and rows[i][0] is not None), default=None) for c in set(parts.values())}
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=key) == sorted([(d, f"{prints[i]:016x}", ids[parts[i]]) for i, (d, _) in enumerate(rows)], key=key)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    prints = {r.doc_id: plain_fingerprint(r.text or "") for r in table(spark, SMALL, "documents").collect()}
    parts = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, SMALL).collect()}
    assert got == {d: (f"{p:016x}", parts[d]) for d, p in prints.items()}
    assert len(set(parts.values())) < len(parts)


def test_visits_of_a_million_prints():
    """Random fingerprints of a million visit under eight shards each, and no shard holds over four times its share."""
    rng = np.random.default_rng(1)
    shards = -(-1_000_000 // simhash.SHARD_ROWS)
    tree = simhash.build_tree(rng.integers(0, 1 << 64, simhash.SAMPLE * shards, np.uint64), shards)
    rows, shard, home = simhash.route(tree, rng.integers(0, 1 << 64, 100_000, np.uint64), 3)
    assert len(tree) + 1 == shards and home.sum() == 100_000
    assert len(rows) < 8 * 100_000
    assert np.bincount(shard[home], minlength=shards).max() < 4 * 100_000 / shards
