"""Merkle manifest against a plain tree, over nulls, ties, repeated rows, lone trees and long texts."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pricelens.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _tree(hashes):
    """(root, for every leaf the runs on its way up as (hashes of the run, own slot))."""
    ways = [[] for _ in hashes]
    level = [(h, [i]) for i, h in enumerate(hashes)]
    while len(level) > 1:
        above = []
        for a in range(0, len(level), 3):
            run = level[a:a + 3]
            for slot, (_, leaves) in enumerate(run):
                for i in leaves:
                    ways[i].append(([h for h, _ in run], slot))
            above.append((_hash(*[h for h, _ in run]), [i for _, leaves in run for i in leaves]))
        level = above
    return level[0][0], ways


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for s in sources:
        own = sorted([r for r in rows if r[1] == s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees.append((own, *_tree([_leaf(r) for r in own])))
    root, tops = _tree([t[1] for t in trees])
    out = []
    for (own, subroot, ways), top in zip(trees, tops, strict=True):
        for row, way in zip(own, ways, strict=True):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            text = row[4].replace("\n", "") if bad and row[4] is not None else row[4]
            folded = _leaf((*row[:4], text))
            for run, slot in way + top:
                folded = _hash(*run[:slot], folded, *run[slot + 1:])
            siblings = _hash(*[h for run, slot in way + top for i, h in enumerate(run) if i != slot])
            out.append((row[0], _leaf(row), subroot, root, siblings, folded, folded == root))
    return sorted(out, key=str)


def _run(df):
    altered = F.when(merkle.tampered(), merkle.leaf_digest(F.replace("text", F.lit("\n"), F.lit(""))))
    return sorted([tuple(r) for r in merkle.verify(merkle.manifest(df, altered)).select(*COLUMNS).collect()], key=str)


def _rows(n, seed=3):
    draw = random.Random(seed)
    rows = [(i if i % 50 else None, draw.choice(["a", "é", "hot", "hot", "hot", None, "Z", ""]), draw.choice([None, "en"]), draw.choice([None, 7]),
             draw.choice([None, "", "a\nb", "plain", "é\n€"])) for i in range(n)]
    return rows + rows[:20] + [(5, "alone", "en", 1, "t"), (5, "hot", "en", 1, "x\n" * 200_000)]


@pytest.mark.parametrize("n", [1, 40, 250])
def test_matches_a_plain_tree(spark, n):
    rows = _rows(n)
    assert _run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_lone_and_empty(spark):
    one = [(1, None, None, None, None)]
    assert _run(spark.createDataFrame(one, SCHEMA)) == brute(one)
    assert _run(spark.createDataFrame([], SCHEMA)) == []


def test_extra_columns_with_clashing_names_are_not_read(spark):
    rows = _rows(30)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("leaf", "found", "tree", "at", "rank", "hash", "root", "steps", "name", "first"):
        df = df.withColumn(name, F.lit("x"))
    assert _run(df) == brute(rows)


def test_a_join_is_as_long_as_its_level(spark):
    rows = [(i, "s", "en", 1, str(i)) for i in range(500)]
    placed = spark.createDataFrame([(0, 6, i, _leaf(r)) for i, r in enumerate(rows)], "tree long, height int, at long, hash string")
    roots, levels = merkle.forest(placed)
    assert roots.count() == 1 and [x.count() for x in levels] == [167, 56, 19, 7, 3, 1]
