"""Near-duplicate embeddings: iterative quantisation and multi-index Hamming tables.

Rotations of the principal axes are learned (on a bounded sample) so that the
signs of the rotated vectors are balanced bits that lose little; each start of
the iteration gives another rotation, and together they make a code.  The
code is cut into substrings, one hash table each.  A substring has ``SPARE``
bits more than the number of vectors needs, so buckets stay as small at any
number of rows; longer substrings need more tables, so what lies in all buckets grows by a
power of about 1.3.  A vector lives in a table under its own substring and probes the
neighbours that differ in its ``WEAK`` bits nearest to their cut, those that a near
vector most likely has otherwise.  Two vectors meet in a table when either probes the
other.  Tables are added until ``SURE`` of the pairs planted at the threshold
around the sample's vectors, and of the sample's own close pairs, meet and
differ in no more bits of the whole code than the reach measured on the same
pairs.  Where ``LEARNED`` rotations do not do (data far off the origin, a
few dimensions), random rotations about the origin follow: there two vectors
part by their angle alone, whatever the data.

Buckets hold ids alone.  Those that can hold a pair fetch the codes; only rows with a
partner within the reach go on, fetch their vectors and are reranked by the
cosine in double precision, so only true links remain.

Equal vectors fold into one class first and are counted by their number, so a
large group of copies costs one row.  A bucket gives per-vector link counts
and a spanning forest, never its pairs; a pair that meets several times
counts in the first table, and there in the bucket of the smaller substring, only.
Buckets over ``BLOCK_ROWS`` are cut into a grid of block pairs, so no task
holds more than two blocks and none is capped.

Vectors of different lengths have no cosine: each length has its own rotations
and tables.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; a null vec_id takes part but cannot name a component; repeated
vec_ids stay separate rows; equal cosines need no order, as every link counts; the empty table gives no rows; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.components import connected_components
from pricelens.llm.shared import written

#: Distinct vectors that the rotations are learned from, at most.
SAMPLE_ROWS = 8_192
ITERATIONS = 30
#: Learned rotations, at most; random ones about the origin follow.
LEARNED = 6
#: Bits of a substring over the binary logarithm of the number of vectors, and the fewest bits.
SPARE = 5
FEWEST_BITS = 12
#: Least certain bits of a substring that are probed in every combination.
WEAK = 3
#: Tables added at a time until ``SURE`` of the measured pairs meet within the reach.
MORE_TABLES = 2
SURE = 0.95
#: Share of every set of measured pairs that the reach in bits covers.
REACHED = 0.995
#: Vectors of the sample that pairs are planted around, and whose own pairs are looked at.
MEASURED_ROWS = 2_048
#: Rows of a bucket on either side of a block pair, at most about.
BLOCK_ROWS = 4_096
#: Rows of all buckets that one group of a task holds, on average.
SHARD_ROWS = 8_192
THRESHOLD = 0.9


def rotations(sample: np.ndarray, draw: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(projection [dims, dims], cuts [dims]) without end: principal axes turned so that signs quantise with least error, then random ones."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    reduced = centred @ axes
    dims = sample.shape[1]
    for _ in range(LEARNED):
        turn = np.linalg.qr(draw.standard_normal((dims, dims)))[0]
        for _ in range(ITERATIONS):
            signs = np.where(reduced @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(reduced.T @ signs)
            turn = left @ right
        projection = axes @ turn
        yield projection, mean @ projection
    while True:
        yield np.linalg.qr(draw.standard_normal((dims, dims)))[0], np.zeros(dims)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their norm in double precision, safe from overflow and underflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def planted(vectors: np.ndarray, cosine: float, draw: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sets of pairs to measure: partners at exactly ``cosine`` in free directions and towards other vectors, and the pairs at ``cosine`` or over."""
    rows = np.resize(draw.permutation(len(vectors)), MEASURED_ROWS)
    out = []
    for towards in (draw.standard_normal((len(rows), vectors.shape[1])), vectors[draw.permutation(rows)]):
        base = vectors[rows]
        side = towards - (towards * base).sum(axis=1, keepdims=True) * base
        size = np.sqrt((side * side).sum(axis=1))
        apart = size > 1e-6  # a partner along the vector itself has no direction to plant in
        out.append((base[apart], cosine * base[apart] + np.sqrt(1 - cosine * cosine) * side[apart] / size[apart, None]))
    some = vectors[rows[:len(vectors)]]
    a, b = np.nonzero(np.triu(some @ some.T >= cosine, 1))
    thin = draw.permutation(len(a))[:1 << 16]
    out.append((some[a[thin]], some[b[thin]]))
    return [pair for pair in out if len(pair[0])]


@dataclass
class Tables:
    """Projection and cuts of all bits; substrings of ``width`` bits, one a table; ``reach``: bits in which links differ at most."""

    projection: np.ndarray
    cuts: np.ndarray
    width: int
    reach: int

    @property
    def number(self) -> int:
        return len(self.cuts) // self.width

    def bits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signs [rows, tables, width], numbers of the least certain bits [rows, tables, WEAK])."""
        margins = (vectors @ self.projection - self.cuts).reshape(len(vectors), self.number, self.width)
        return margins >= 0, np.argpartition(np.abs(margins), WEAK - 1, axis=2)[:, :, :WEAK].astype(np.uint8)

    def words(self, signs: np.ndarray) -> np.ndarray:
        return signs.reshape(len(signs), self.number, self.width) @ (1 << np.arange(self.width, dtype=np.int64))

    def codes(self, signs: np.ndarray, weak: np.ndarray) -> list[bytes]:
        """Signs and least certain bits of each row, packed."""
        packed = np.packbits(signs.reshape(len(signs), self.number * self.width), axis=1, bitorder="little")
        return [row.tobytes() for row in np.concatenate([packed, weak.reshape(len(weak), self.number * WEAK)], axis=1)]

    def read(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(packed signs as 64-bit integers, substrings, masks of their least certain bits) of some rows."""
        size = -(-self.number * self.width // 8)
        raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), size + self.number * WEAK)
        signs = np.unpackbits(raw[:, :size], axis=1, bitorder="little")[:, :self.number * self.width]
        packed = np.zeros((len(codes), -(-size // 8) * 8), np.uint8)
        packed[:, :size] = raw[:, :size]
        weak = raw[:, size:].reshape(len(codes), self.number, WEAK)
        return packed.view("<u8"), self.words(signs), masks(weak)


def masks(weak: np.ndarray) -> np.ndarray:
    """[rows, tables] integers with the bits of the given numbers set."""
    return (np.int64(1) << weak.astype(np.int64)).sum(axis=2)


def probes(words: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """[rows, tables, 2 ** WEAK] substrings to look under: the own one first, then all that differ in weak bits only."""
    chosen = (np.arange(1 << WEAK)[:, None] >> np.arange(WEAK) & 1).astype(np.int64)
    return words[:, :, None] ^ ((np.int64(1) << weak.astype(np.int64)) @ chosen.T)


def meet(words_a: np.ndarray, masks_a: np.ndarray, words_b: np.ndarray, masks_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[pairs, tables] whether a probes b's own substring, and b that of a."""
    apart = words_a ^ words_b
    return apart & ~masks_a == 0, apart & ~masks_b == 0


def code_tables(vectors: np.ndarray, cosine: float, rows: int, seed: int = 7) -> Tables:
    """As many tables for ``rows`` vectors as it takes for ``SURE`` of every set of measured pairs to meet within the reach."""
    width = max(FEWEST_BITS, (rows - 1).bit_length() + SPARE)
    draw = np.random.default_rng(seed)
    pairs = planted(vectors, cosine, draw)
    met = [np.zeros(len(a), bool) for a, _ in pairs]
    apart = [np.zeros(len(a), np.int64) for a, _ in pairs]
    endless = rotations(vectors, draw)
    projection, cuts = np.zeros((vectors.shape[1], 0)), np.zeros(0)
    used = 0
    while True:
        wanted = used + MORE_TABLES * width
        while len(cuts) < wanted:
            turn, cut = next(endless)
            projection, cuts = np.concatenate([projection, turn], axis=1), np.concatenate([cuts, cut])
        fresh = Tables(projection[:, used:wanted], cuts[used:wanted], width, 0)
        used = wanted
        for (a, b), m, d in zip(pairs, met, apart, strict=True):
            (signs_a, weak_a), (signs_b, weak_b) = fresh.bits(a), fresh.bits(b)
            one, other = meet(fresh.words(signs_a), masks(weak_a), fresh.words(signs_b), masks(weak_b))
            m |= (one | other).any(axis=1)
            d += (signs_a != signs_b).sum(axis=(1, 2))
        reach = max((int(np.quantile(d, REACHED, method="higher")) for d in apart), default=0)
        if all((m & (d <= reach)).mean() >= SURE for m, d in zip(met, apart, strict=True)):
            return Tables(projection[:, :used], cuts[:used], width, reach)


class _Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.parent[rows]
        while not np.array_equal(up := self.parent[at], at):
            at = up
        self.parent[rows] = at
        return at

    def join(self, rows: np.ndarray) -> None:
        roots = np.unique(self.roots(rows))
        self.parent[roots] = roots[0]


@dataclass
class Cell:
    """Rows of one block pair of a bucket: substring ``word`` of table ``slot``."""

    packed: np.ndarray
    words: np.ndarray
    masks: np.ndarray
    home: np.ndarray
    visit: np.ndarray
    slot: int
    word: int

    def pairs(self, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(home rows, visiting rows) of the pairs within the reach that are counted here, home rows rising.

        A pair of two rows that live here comes in both orders, any other once.
        """
        own, others = np.nonzero(self.home)[0], np.nonzero(self.visit)[0]
        step = max(1, (1 << 19) // max(1, len(others)))
        for begin in range(0, len(own), step):
            part = own[begin:begin + step]
            apart = np.zeros((len(part), len(others)), np.int64)
            for k in range(self.packed.shape[1]):
                apart += np.bitwise_count(self.packed[part, k][:, None] ^ self.packed[others, k][None, :])
            near, far = np.nonzero(apart <= reach)
            for a in range(0, len(near), 1 << 16):
                x, y = part[near[a:a + (1 << 16)]], others[far[a:a + (1 << 16)]]
                one, other = meet(self.words[x], self.masks[x], self.words[y], self.masks[y])
                first = (one | other).argmax(axis=1) == self.slot
                theirs = self.words[y, self.slot]
                # where each probes the other, the bucket of the smaller substring counts
                here = (theirs == self.word) | ~one[:, self.slot] | (self.word < theirs)
                good = first & here & (x != y)
                yield x[good], y[good]


def partners(cell: Cell, reach: int) -> np.ndarray:
    """Whether a row is in any pair counted in the cell."""
    told = np.zeros(len(cell.home), bool)
    for x, y in cell.pairs(reach):
        told[x] = told[y] = True
    return told


def bucket_links(cell: Cell, vectors: np.ndarray, weight: np.ndarray, cosine: float, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(linked weight of every row, root of every row in a spanning forest) of one cell."""
    found = np.zeros(len(vectors), np.int64)
    forest = _Forest(len(vectors))
    step = max(1, (1 << 21) // vectors.shape[1])
    for x, y in cell.pairs(reach):
        close = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", vectors[x[a:a + step]], vectors[y[a:a + step]]) >= cosine for a in range(0, len(x), step))])
        x, y = x[close], y[close]
        np.add.at(found, x, weight[y])
        visitor = cell.words[y, cell.slot] != cell.word
        np.add.at(found, y[visitor], weight[x[visitor]])
        rows, begins = np.unique(x, return_index=True)
        for row, theirs in zip(rows, np.split(y, begins[1:]), strict=False):
            forest.join(np.append(theirs, row))
    return found, forest.roots(np.arange(len(vectors)))


def usable(embedding: str = "embedding"):
    """Whether a vector can have a cosine: known, finite and not all zero."""
    c = F.col(embedding)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def link_classes(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, links): for class a the links found in some bucket, and another class b it is linked to (or a itself).

    ``classes`` has id, embedding, copies; all of one length.
    """
    spark = classes.sparkSession
    sample = classes.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE_ROWS).collect()
    if not sample:
        return spark.createDataFrame([], "a long, b long, links long")
    tables = code_tables(unit(np.array([r.embedding for r in sample], np.float64)), cosine, classes.count())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1_024):
                part = batch.slice(begin, 1_024)
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                signs, weak = tables.bits(unit(flat.reshape(part.num_rows, -1)))
                # the own substring of a table stands at every multiple of 2 ** WEAK
                keys = probes(tables.words(signs), weak) | (np.arange(tables.number, dtype=np.int64) << tables.width)[None, :, None]
                each = tables.number << WEAK
                listed = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * each, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(tables.codes(signs, weak), pa.binary()), listed], names=["id", "code", "keys"])

    coded = written(classes.select("id", "embedding").mapInArrow(index, "id long, code binary, keys array<long>"), "itq-index")
    # buckets hold ids and keys only; one that nobody lives in, or with one row, has no pair
    indexed = coded.select("id", F.posexplode("keys").alias("place", "key")).select("id", "key", (F.col("place") % (1 << WEAK) == 0).alias("own"))
    buckets = indexed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("lived")).where("n > 1 and lived")
    placed = indexed.join(buckets.select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "key")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # block i of the rows that live in the bucket meets block j of all its rows
    along = F.transform(F.filter(every, lambda j: F.col("own") | (j == mine)), lambda j: F.struct(mine.alias("i"), j.alias("j"), F.col("own").alias("home"), (j == mine).alias("visit")))
    down = F.transform(F.filter(every, lambda i: i != mine), lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(False).alias("home"), F.lit(True).alias("visit")))
    cells = written(placed.withColumn("cell", F.explode(F.concat(along, down))).select("id", "key", "cell.*"), "itq-cells")

    def dealt(rows: DataFrame) -> DataFrame:
        shards = max(1, -(-rows.count() // SHARD_ROWS))
        return rows.withColumn("shard", F.pmod(F.xxhash64("key", "i", "j"), F.lit(shards)))

    def each_cell(frame: pd.DataFrame) -> Iterator[tuple[slice, Cell]]:
        keys = frame[["key", "i", "j"]].to_numpy(np.int64)
        cuts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, [len(keys)]])
        packed, words, weak = tables.read(frame["code"].tolist())
        home, visit = frame["home"].to_numpy(bool), frame["visit"].to_numpy(bool)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1 and home[a:b].any():
                s, key = slice(a, b), int(keys[a, 0])
                yield s, Cell(packed[s], words[s], weak[s], home[s], visit[s], key >> tables.width, key & (1 << tables.width) - 1)

    def within_reach(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "i", "j"], kind="stable", ignore_index=True)
        told = np.zeros(len(frame), bool)
        for s, cell in each_cell(frame):
            told[s] = partners(cell, tables.reach)
        return frame.loc[told, ["id", "key", "i", "j", "home", "visit"]]

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "i", "j"], kind="stable", ignore_index=True)
        vectors = unit(np.array(frame["embedding"].tolist(), np.float64))
        ids, weight = frame["id"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64)
        out = []
        for s, cell in each_cell(frame):
            found, root = bucket_links(cell, vectors[s], weight[s], cosine, tables.reach)
            told = (found > 0) | (root != np.arange(len(root)))
            if told.any():
                out.append(np.stack([ids[s][told], ids[s][root[told]], found[told]]))
        done = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"a": done[0], "b": done[1], "links": done[2]})

    codes = coded.select("id", "code")
    kept = written(dealt(cells).join(codes, "id").groupBy("shard").applyInPandas(within_reach, cells.schema), "itq-reach")
    return dealt(kept).join(codes, "id").join(classes.select("id", "copies", "embedding"), "id").groupBy("shard").applyInPandas(link, "a long, b long, links long")


def near_duplicates(embeddings: DataFrame, cosine: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    rows = embeddings.select("vec_id", "embedding", usable().alias("usable"))
    folded = rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = written(folded.withColumn("id", F.monotonically_increasing_id()), "itq-classes")
    # a length that one class has alone has nothing to link
    lengths = classes.groupBy(F.size("embedding").alias("length")).count().where("count > 1").orderBy("length").select("length").collect()
    each = [written(link_classes(classes.where(F.size("embedding") == r["length"]), cosine), "itq-links") for r in lengths]
    links = reduce(DataFrame.unionAll, each) if each else rows.sparkSession.createDataFrame([], "a long, b long, links long")
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    members = connected_components(links.select("a", "b"))
    named = (classes.join(counts, classes["id"] == counts["a"], "left").join(members, classes["id"] == members["node"], "left")
             .select("embedding", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    heads = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = named.join(heads, "component").select("embedding", "n_links", "component_id")
    linked = rows.where("usable").join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
