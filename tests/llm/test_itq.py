"""Embedding dedup against brute force cosines."""

import numpy as np

from pricelens.llm import itq
from pricelens.llm.queries import QUERIES
from pricelens.llm.shared import table


def brute(vectors):
    u = itq.unit(vectors)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    label = np.arange(len(u))
    while True:
        low = np.array([min(label[i], label[close[i]].min(initial=label[i])) for i in range(len(u))])
        low = low[low]
        if np.array_equal(low, label):
            return close, label
        label = low


def families(seed, groups=60, dims=64):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.standard_normal(dims)
        for _ in range(rng.integers(1, 9)):
            out.append(centre + rng.uniform(0, 0.45) * rng.standard_normal(dims))
    return np.array(out)[rng.permutation(len(out))]


def test_recall_and_no_false_links(spark, monkeypatch):
    vectors = families(1)
    close, _ = brute(vectors)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    for block in (4096, 3):
        monkeypatch.setattr(itq, "BLOCK_ROWS", block)
        got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        found = sum(r.n_links for r in got.values())
        assert all(got[i].n_links <= close[i].sum() for i in got)
        assert found >= 0.9 * close.sum(), (found, close.sum())


def test_query_recall(spark):
    for sf in ("sf0.001", "sf0.1"):
        rows = table(spark, f"/root/testdata/{sf}", "embeddings").orderBy("vec_id").collect()
        ids = np.array([r.vec_id for r in rows])
        close, label = brute(np.array([r.embedding for r in rows], np.float64))
        got = {r.vec_id: r for r in QUERIES["op10_embedding_dedup"](spark, f"/root/testdata/{sf}").collect()}
        assert len(got) == len(rows)
        assert all(got[d].n_links <= n for d, n in zip(ids.tolist(), close.sum(axis=1).tolist(), strict=True))
        assert sum(r.n_links for r in got.values()) >= 0.9 * close.sum()
        same = np.mean([got[d].component_id == ids[c] for d, c in zip(ids.tolist(), label.tolist(), strict=True)])
        assert same > 0.97
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]),
            (9, [None, 1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (11, [0.0, 1e-30, 0.0]), (12, [0.0, 1e30, 0.0]), (13, [0.0, -1.0, 0.0]), (14, [0.0, 1e-45, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, component_id string").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(df).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False), *[(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 13)],
            (11, 2, 11, True), (12, 2, 11, False), (14, 2, 11, False)]
    assert got == sorted(want, key=str)
    assert itq.near_duplicates(df.where("false")).count() == 0
    assert itq.near_duplicates(df.where("vec_id in (4, 6)")).count() == 2


def at_cosine(vectors, low, high, rng):
    """A partner of every vector at a cosine between low and high."""
    u = itq.unit(vectors)
    side = rng.standard_normal(u.shape)
    side = itq.unit(side - (side * u).sum(axis=1, keepdims=True) * u)
    c = rng.uniform(low, high, (len(u), 1))
    return c * u + np.sqrt(1 - c * c) * side


def test_recall_just_over_the_threshold(spark):
    rng = np.random.default_rng(3)
    tables = [np.array([r.embedding for r in table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").limit(1000).collect()], np.float64),
              rng.standard_normal((300, 64)) + 1.5 * rng.standard_normal(64), rng.standard_normal((1, 64))]
    for base in tables:
        vectors = np.concatenate([itq.unit(base), at_cosine(base, 0.9001, 0.92, rng)])
        close, label = brute(vectors)
        assert close.sum() > 0
        got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()}
        found = sum(r.n_links for r in got.values())
        assert 0.9 * close.sum() <= found <= close.sum(), (found, close.sum())
        assert np.mean([got[i].component_id == c for i, c in enumerate(label.tolist())]) >= 0.9


def test_every_length_is_searched(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0]), (5, [3.0, 0.0]), (6, [1.0, 0.0]), (7, [5.0]), (8, [5.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 2, 4), (5, 2, 4), (6, 2, 4), (7, 1, 7), (8, 1, 7)]


def test_pairs_are_counted_once():
    """Over all buckets, every pair that probes can find within the reach is counted once in each direction."""
    vectors = itq.unit(families(5, groups=25, dims=16))
    tables = itq.code_tables(vectors, 0.9, len(vectors))
    signs, weak = tables.bits(vectors)
    packed, words, masks = tables.read(tables.codes(signs, weak))
    assert np.array_equal(words, tables.words(signs)) and np.array_equal(masks, itq.masks(weak))
    flat = signs.reshape(len(signs), -1)
    apart = (flat[:, None] != flat[None]).sum(axis=2)
    one, other = itq.meet(words[:, None], masks[:, None], words[None], masks[None])
    want = (one | other).any(axis=2) & (apart <= tables.reach) & (vectors @ vectors.T >= 0.9)
    np.fill_diagonal(want, False)
    got = np.zeros(len(vectors), np.int64)
    keys = itq.probes(words, weak)
    for slot in range(tables.number):
        for word in np.unique(words[:, slot]):
            rows = np.nonzero((keys[:, slot] == word).any(axis=1))[0]
            cell = itq.Cell(packed[rows], words[rows], masks[rows], words[rows, slot] == word, np.ones(len(rows), bool), slot, int(word))
            got[rows] += itq.bucket_links(cell, vectors[rows], np.ones(len(rows), np.int64), 0.9, tables.reach)[0]
    assert want.any() and np.array_equal(got, want.sum(axis=1))


def test_buckets_stay_small_as_rows_grow():
    """Rows in buckets that can hold a pair, of random vectors, grow by a power under 1.35 (more bits need more tables), not with the square."""
    rng = np.random.default_rng(8)
    rates = []
    for n in (4_000, 32_000):
        vectors = itq.unit(rng.standard_normal((n, 32)))
        tables = itq.code_tables(vectors[:4_000], 0.9, n)
        signs, weak = tables.bits(vectors)
        words = tables.words(signs)
        placed = 0
        for slot, keys in enumerate(itq.probes(words, weak).transpose(1, 0, 2)):
            bucket, counts = np.unique(keys, return_counts=True)
            placed += counts[(counts > 1) & np.isin(bucket, words[:, slot])].sum()
        rates.append(placed / n)
    assert rates[1] < 8 ** 0.35 * rates[0], rates
