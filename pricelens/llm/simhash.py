"""SimHash near-duplicates: fingerprints linked through vantage-point trees.

Fingerprints are partitioned by Hamming distance.  A top tree of vantage
points and radii, built from a sample of ``SAMPLE`` fingerprints for each shard
wanted (one in 1,024 of all), deals every distinct fingerprint to its home shard; it also visits, as a guest, each shard that
its ball of ``distance`` bits reaches into (triangle bounds prune the rest).
Two fingerprints part at one node only, and there the inner one visits the
outer side, so each pair within the distance meets in exactly one shard.
Inside a shard the same split goes on in memory until a leaf is small, and
leaves compare home rows with visitors in blocks of XOR and popcount.

A shard gives a spanning forest of the links it found, never the pairs, so
its output is at most its rows.  A dense ball that no split can part is cut
into blocks of home rows, one task each.  Shards are large, because each level of
the top tree sends a random fingerprint to about half as many shards again.

Edge cases: null or blank text has fingerprint zero and is linked like any
other; equal fingerprints link at distance 0; a null doc_id takes part
but is never a component id unless nothing else is there (then null); the
empty table gives no rows; rows that repeat a doc_id are fingerprinted each; a
text of any length is read whole by one task; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.components import connected_components
from pricelens.llm.shared import written
from pricelens.llm.tokenbin import slices
from pricelens.operators.joins import bounded_broadcast

#: Home rows wanted in a shard, and fingerprints for each shard that the top tree is built from.
SHARD_ROWS = 16_384
SAMPLE = 16
#: Fingerprints routed through the top tree at a time.
ROUTE_ROWS = 1 << 16
#: Home rows of a shard that one task compares with all its visitors.
BLOCK_ROWS = 65_536
#: Rows under which a tree inside a shard is a leaf.
LEAF_ROWS = 512
HASH_SEED = 42


def fingerprint_texts(texts: list[str], shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text as unsigned integers.

    Words are runs of non-blank bytes after lowering A-Z; a bit is set when
    more than half of the shingles' XXH64 values (repeats counted) set it.
    """
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    counts: list[int] = []
    rows: list[int] = []
    for row, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        n = len(words)
        if n <= shingle:
            hashes.append(digest(joined, HASH_SEED))
            counts.append(1)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            begins = [0, *(ends[:n - shingle] + 1).tolist()]
            hashes.extend([digest(joined[a:b], HASH_SEED) for a, b in zip(begins, ends[shingle - 1:].tolist(), strict=True)])
            counts.append(n - shingle + 1)
        rows.append(row)
    if rows:
        sizes = np.array(counts)
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long), one scan and no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [fingerprint_texts(texts[s], shingle) for s in slices(texts, 1 << 20)]
            values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _far(values: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ point).astype(np.int16)


def _split(values: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that part the values most evenly; None if none does.

    Of a few candidate points, spread over the values, the one with the
    widest spread of distances parts with the least overlap.
    """
    picks = values[np.linspace(0, len(values) - 1, min(8, len(values))).astype(np.int64)]
    spreads = [_far(values, p) for p in picks]
    best = max(range(len(picks)), key=lambda i: float(spreads[i].std()))
    radius = int(np.median(spreads[best]))
    inner = int((spreads[best] <= radius).sum())
    if inner == len(values):
        radius -= 1
        inner = int((spreads[best] <= radius).sum())
    return (picks[best], radius) if 0 < inner < len(values) else None


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (point, radius, inner, outer); children >= 0 are nodes, < 0 leaf -1 - child.

    The largest part is split next, until there are ``leaves`` parts.
    """
    nodes: list[list[int]] = []
    # parts by falling size; the running number settles ties
    parts: list[tuple[int, int, np.ndarray, tuple[int, int] | None]] = [(-len(sample), 0, sample, None)]
    closed: list[tuple[int, int] | None] = []
    made = 1
    while parts and len(parts) + len(closed) < leaves:
        _, _, values, parent = heapq.heappop(parts)
        found = _split(values) if len(values) > 8 else None
        if found is None:
            closed.append(parent)
            continue
        point, radius = found
        node = len(nodes)
        nodes.append([int(point), radius, 0, 0])
        if parent:
            nodes[parent[0]][parent[1]] = node
        near = _far(values, point) <= radius
        for side, child in ((values[near], 2), (values[~near], 3)):
            heapq.heappush(parts, (-len(side), made, side, (node, child)))
            made += 1
    for leaf, parent in enumerate([*(p for *_, p in parts), *closed]):
        if parent:
            nodes[parent[0]][parent[1]] = -1 - leaf
    return [tuple(n) for n in nodes]


def route(tree: list[tuple[int, int, int, int]], values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is_home) of every shard a value lives in or visits."""
    rows = np.arange(len(values))
    if not tree:
        return rows, np.zeros(len(values), np.int64), np.ones(len(values), bool)
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0, rows, np.ones(len(values), bool))]
    while todo:
        at, idx, home = todo.pop()
        if not len(idx):
            continue
        if at < 0:
            found.append((idx, -1 - at, home))
            continue
        point, radius, inner, outer = tree[at]
        d = _far(values[idx], np.uint64(point))
        near = d <= radius
        to_inner = np.where(home, near, d - distance <= radius)
        to_outer = d + distance > radius  # a home row of the inner side visits; others live or visit there
        todo.append((inner, idx[to_inner], home[to_inner]))
        todo.append((outer, idx[to_outer], (home & ~near)[to_outer]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([np.full(len(f[0]), f[1]) for f in found]), np.concatenate([f[2] for f in found]))


class _Forest:
    """Union-find over row numbers, vectorised over the links of one row."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.parent[rows]
        while True:
            up = self.parent[at]
            if np.array_equal(up, at):
                self.parent[rows] = at
                return at
            at = up

    def join(self, rows: np.ndarray) -> None:
        roots = np.unique(self.roots(rows))
        self.parent[roots] = roots[0]


def link_within(values: np.ndarray, home: np.ndarray, distance: int) -> np.ndarray:
    """Root row of every row after linking each home row with all rows within the distance."""
    forest = _Forest(len(values))
    todo = [(np.nonzero(home)[0], np.nonzero(~home)[0])]
    while todo:
        own, guests = todo.pop()
        if not len(own):
            continue
        found = _split(values[own]) if len(own) > LEAF_ROWS else None
        if found is not None:
            point, radius = found
            d, g = _far(values[own], point), _far(values[guests], point)
            near = d <= radius
            visit = own[near & (d + distance > radius)]
            # a split pays only while it leaves most rows on one side
            if len(visit) + len(guests) < 3 * len(own):
                todo.append((own[near], guests[g - distance <= radius]))
                todo.append((own[~near], np.concatenate([guests[g + distance > radius], visit])))
                continue
        all_rows = np.concatenate([own, guests])
        theirs = values[all_rows]
        step = max(1, (1 << 21) // len(all_rows))
        for begin in range(0, len(own), step):
            part = own[begin:begin + step]
            close = np.bitwise_count(values[part][:, None] ^ theirs[None, :]) <= distance
            for i in np.nonzero(close.sum(axis=1) > 1)[0]:
                forest.join(all_rows[close[i]])
    return forest.roots(np.arange(len(values)))


def link_fingerprints(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that span each component of the distinct fingerprints within ``distance`` bits."""
    spark = distinct.sparkSession
    total = distinct.count()
    shards = max(1, -(-total // SHARD_ROWS))
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE * shards).toPandas()["fp"].to_numpy(np.int64) if shards > 1 else np.zeros(0, np.int64)
    tree = build_tree(sample.view(np.uint64), shards) if len(sample) else []

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def routed(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            values = np.concatenate(parts)
            rows, shard, home = route(tree, values.view(np.uint64), distance)
            for a in range(0, len(rows), 1 << 17):
                b = a + (1 << 17)
                yield pa.RecordBatch.from_arrays([pa.array(values[rows[a:b]], pa.int64()), pa.array(shard[a:b], pa.int64()), pa.array(home[a:b])], names=["fp", "shard", "home"])

        waiting: list[np.ndarray] = []
        for batch in batches:
            waiting.append(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, waiting)) >= ROUTE_ROWS:
                yield from routed(waiting)
                waiting = []
        if waiting:
            yield from routed(waiting)

    routed = written(distinct.select("fp").mapInArrow(visits, "fp long, shard long, home boolean"), "routed")
    # one row for each shard of more than one block of home rows
    large = routed.where("home").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), blocks)
    # at most one for every BLOCK_ROWS fingerprints
    dealt = (routed.join(bounded_broadcast(large, total // BLOCK_ROWS), "shard", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("fp", "shard", (F.col("home") & (F.col("block") == mine)).alias("home"), "block"))

    def link(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        signed = frame["fp"].to_numpy(np.int64)
        root = link_within(signed.view(np.uint64), frame["home"].to_numpy(bool), distance)
        other = root != np.arange(len(root))
        return pd.DataFrame({"a": signed[other], "b": signed[root[other]]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(max(parts, shards), "shard", "block").groupBy("shard", "block").applyInPandas(link, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), for every row."""
    prints = written(fingerprints(documents, shingle), "fingerprints")
    # copies fold to one row each before anything else moves
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fp")
    members = connected_components(link_fingerprints(distinct, distance))
    named = distinct.join(members.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = written(named.join(heads, "component").select("fp", "component_id"), "component-ids")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
