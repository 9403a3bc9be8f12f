"""Connected components: any order of ids, and few steps on long paths."""

import random

import pytest

from pricelens.llm import components


def _plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return {x: root(x) for x in list(parent)}


def _same(rows, edges):
    got, wanted = {r["node"]: r["component"] for r in rows}, _plain([e for e in edges if e[0] != e[1]])
    assert got.keys() == wanted.keys()
    assert len({(got[x], wanted[x]) for x in got}) == len(set(got.values())) == len(set(wanted.values()))


def test_a_path_in_id_order_takes_few_steps(spark, monkeypatch):
    steps, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: steps.append(name) or write(df, name))
    edges = [(i, i + 1) for i in range(10_000)]
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == 10_001 and {r["component"] for r in rows} == {0}
    assert steps.count("jumps") <= 16 and steps.count("hooks") == 1


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    ids = draw.sample(range(10**12), 400)
    edges = [(draw.choice(ids), draw.choice(ids)) for _ in range(260)] + [(5, 5)]
    edges += edges[:20] + [(b, a) for a, b in edges[:20]]
    _same(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect(), edges)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
