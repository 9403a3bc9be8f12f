"""Exact substring dedup across documents by external induced suffix sorting.

A byte goes when some ``WINDOW``-byte string over it also starts in a document
with a smaller doc_id.  To find equal strings without moving every suffix of the
corpus:

1. Documents are packed into chunks, runs of chunks into groups, and written
   once, bucketed by group, so later steps meet them without shuffling text.
   What moves is packed by group and shard: more input makes longer
   rows of it, not a row for every chunk and shard.
2. Every window of ``WINDOW`` bytes is owned by an anchor, the smallest hash of
   a ``GRAM``-byte string inside it.  Equal windows have equal anchors, and the
   windows one anchor owns are a short run, its cell (under 2 x ``WINDOW`` bytes
   of text).  Only (anchor hash, cell hash, smallest doc) per distinct cell of
   a chunk is shuffled, packed into a few bytes: copies are folded before they
   move, so a hot passage is one entry a chunk.
3. Per shard of anchor hashes: cells whose anchor occurs in one document are
   done; a cell that equals one of a smaller document is wholly covered; the
   first occurrences of all other cells go on, with their text.
4. Per shard, cells that share no ``WINDOW - KEY_STEP + 1`` bytes over the
   anchor with another document share no window and are left out.  The text of
   the others is one string, and its suffixes are sorted with common prefixes by :mod:`induced`.  Runs of suffixes that share
   ``WINDOW`` bytes are the equal windows; those not in the smallest document of
   their run are marked in their cell's mask.
5. Back at the chunks, covered cells and masks become removed bytes.

Hash values only group: distinct texts with one anchor hash are told apart by
the sort, and a cell counts as equal to another by 96 bits.

Edge cases: null text is empty, and texts under ``WINDOW`` bytes lose nothing;
a null doc_id ranks after all others; rows with equal doc_ids take nothing from
one another and each get their own result row; the empty table gives no
rows; a text of any length is cut into chunks that many tasks search, and put
together by one; columns of the input are kept unless an output column has
their name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricelens.llm.induced import SuffixOrder
from pricelens.llm.shared import shared_folder, written

WINDOW = 50
GRAM = 16
#: Text bytes of a chunk (one document at least); rows of this size stay small objects for the JVM's collector.
CHUNK_BYTES = 1 << 18
#: Packed bytes at which a group of chunks is full; a group is held by one task at a time.
GROUP_BYTES = 8 << 20
#: Cells of a shard that is judged, and of one that is sorted, on average, at most.
SHARD_CELLS = 1_500_000
SORT_CELLS = 25_000
#: Sorted shards that are dealt together, at most, and sorted one after the other.
SORTS_DEALT = 8
#: Parts of a shard that are judged one after the other, which bounds the memory of its sort.
JUDGED_PARTS = 8
#: Bytes hashed at a time: few enough that the arrays stay in a core's cache.
BLOCK_BYTES = 1 << 15
#: Offsets of an anchor in a window that one key of a cell stands for.
KEY_STEP = 7

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACE_BITS = np.uint64(22)
_PLACE = np.uint64((1 << 22) - 1)
NEW, COVERED, FIRST = 0, 1, 2
NO_DOC = np.uint64((1 << 64) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of the ``gram`` (a power of two) bytes from each position on."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < gram:
        h = h[:-width] * np.uint64(pow(int(_BASE), width, 1 << 64)) + h[width:]
        width *= 2
    return _mixed(h)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    bases = np.full((2, n), [[_BASE], [np.uint64(pow(int(_BASE), -1, 1 << 64))]])
    bases[:, 0] = 1
    return tuple(np.multiply.accumulate(bases, axis=1))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def cell_counts(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of each cell in order of place, cells of each document) for documents laid end to end."""
    grams = WINDOW - GRAM + 1
    windows = np.maximum(sizes - WINDOW + 1, 0)
    if not windows.any():
        return np.zeros(0, np.uint8), np.zeros(len(sizes), np.int64)
    owner = np.empty(len(data) - WINDOW + 1, np.int64)  # of every place, whether a window of one document starts there or not
    for at in range(0, len(owner), BLOCK_BYTES):
        hashes = _gram_hashes(data[at:at + BLOCK_BYTES + WINDOW - 1], GRAM)
        keys = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        owner[at:at + BLOCK_BYTES] = (_least(keys, grams) & _PLACE).astype(np.int64) + at
    owner = owner[_ranges(np.cumsum(sizes) - sizes, windows)]
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    ends = np.cumsum(windows)
    new[(ends - windows)[windows > 0]] = True
    cuts = np.nonzero(new)[0]
    return np.diff(cuts, append=len(owner)).astype(np.uint8), np.diff(np.searchsorted(cuts, ends), prepend=0)


def _text_bytes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes end to end, bytes of each text) of a column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]], np.diff(at)


class Chunk:
    """The documents of one chunk row, with their cells."""

    def __init__(self, rows: bytes, counts: bytes):
        self.batch = pa.ipc.open_stream(rows).read_next_batch()
        self.data, self.sizes = _text_bytes(self.batch.column("_text"))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.rank = self.batch.column("_rank").to_numpy(zero_copy_only=False)
        self.count = np.frombuffer(counts, np.uint8).astype(np.int64)
        windows = np.maximum(self.sizes - WINDOW + 1, 0)
        flat = np.cumsum(self.count) - self.count  # place among all windows of the chunk
        self.owner = np.searchsorted(np.cumsum(windows), flat, side="right")
        self.low = flat + (self.begin - (np.cumsum(windows) - windows))[self.owner] if len(flat) else flat

    def cells(self, buckets: int) -> None:
        """Distinct (anchor, cell) entries in order of shard, with their smallest doc and a member cell."""
        n = len(self.low)
        anchor, content = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        powers, inverse = _powers(BLOCK_BYTES + 4 * WINDOW)
        place = self.low // BLOCK_BYTES
        for b in np.unique(place):
            cells = slice(*np.searchsorted(place, [b, b + 1]))  # places rise
            at = int(b) * BLOCK_BYTES
            piece = self.data[at:at + BLOCK_BYTES + 2 * WINDOW]
            low = self.low[cells] - at
            end = low + self.count[cells] - 1 + WINDOW
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers[:len(piece)], out=sums[1:])
            content[cells] = _mixed((sums[end] - sums[low]) * inverse[low] + self.count[cells].astype(np.uint64))
            # the owner of a cell is the least gram of its first window
            keys = _gram_hashes(piece, GRAM)
            least = _least((keys >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(keys), dtype=np.uint64), WINDOW - GRAM + 1)
            # the least of many hashes is a small number: mixed once more, shards of it are even
            anchor[cells] = _mixed(keys[(least[low] & _PLACE).astype(np.int64)] ^ _BASE)
        doc = self.rank[self.owner]
        order = np.argsort(anchor)
        tied = np.zeros(n, bool)
        tied[1:] = anchor[order[1:]] == anchor[order[:-1]]
        tied[:-1] |= tied[1:]
        ties = order[tied]
        order[tied] = ties[np.lexsort((doc[ties], content[ties], anchor[ties]))]
        a, c = anchor[order], content[order]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.entry = np.empty(n, np.int64)  # of each cell
        self.entry[order] = np.cumsum(new) - 1
        self.member = order[new]  # a cell of the smallest doc
        self.anchor, self.content, self.first = a[new], c[new], doc[order][new]
        self.cuts = self.shards(buckets)

    def sorted_counts(self, picked: np.ndarray, count: int) -> np.ndarray:
        """How many of the ``picked`` entries each of ``count`` shards has."""
        return np.diff(np.searchsorted(picked, self.shards(count)))

    def shards(self, count: int) -> np.ndarray:
        """Where each of ``count`` shards begins among the entries (shards rise with the anchor), and their end."""
        return np.searchsorted(((self.anchor >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64), np.arange(count + 1))


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ``sizes[i]`` places from each ``begin[i]`` on."""
    return np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Dealt:
    """Places of a group's entries, which are kept by shard and in it by chunk; its chunks take theirs in their order."""

    def __init__(self, counts: np.ndarray):
        self.at = np.cumsum(counts) - counts

    def take(self, counts: np.ndarray) -> np.ndarray:
        """Places of the next chunk's entries, of which each shard has ``counts``."""
        places = _ranges(self.at, counts)
        self.at = self.at + counts
        return places


def _low_bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_low_bytes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    return out.view("<u8")[:, 0]


def _pack_docs(docs: np.ndarray) -> bytes:
    base = int(docs.min()) if len(docs) else 0
    span = int(docs.max()) - base if len(docs) else 0
    width = max(1, (span.bit_length() + 7) // 8)
    return np.array([base, width], "<u8").tobytes() + _low_bytes(docs - np.uint64(base), width)


def _unpack_docs(data: bytes, n: int) -> np.ndarray:
    base, width = np.frombuffer(data, "<u8", 2)
    return _from_low_bytes(data[16:], n, int(width)) + base


def pack_chunks(documents: DataFrame, text: str) -> DataFrame:
    """The documents as chunk rows (group, chunk, rows, counts, cells), written once and bucketed by group.

    A group has the number of its first chunk.
    """
    spark = documents.sparkSession
    source = documents.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).drop(text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = number = TaskContext.get().partitionId() << 32
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").cast(pa.int64())
            signed = ids.fill_null(0).to_numpy(zero_copy_only=False)
            rank = np.where(ids.is_null().to_numpy(zero_copy_only=False), NO_DOC, signed.view(np.uint64) ^ np.uint64(1 << 63))
            batch = batch.append_column("_rank", pa.array(rank, pa.uint64()))
            sizes = pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(sizes) // CHUNK_BYTES
            cuts = np.concatenate([[0], np.nonzero(part[1:] != part[:-1])[0] + 1, [len(part)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.take(pa.array(np.arange(a, b)))
                counts, _ = cell_counts(*_text_bytes(rows.column("_text")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                packed = sink.getvalue().to_pybytes()
                if held >= GROUP_BYTES:
                    group, held = number, 0
                yield _table([(group, number, packed, counts.tobytes(), len(counts))], (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), ["group", "chunk", "rows", "counts", "cells"])
                number += 1
                held += len(packed)

    name = f"text_chunks_{uuid.uuid4().hex}"
    (source.mapInArrow(pack, "group long, chunk long, rows binary, counts binary, cells long").write.format("parquet").option("compression", "zstd")
     .option("path", shared_folder(spark, "chunks")).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "group").saveAsTable(name))
    chunks = spark.table(name)  # analysed here: its files and buckets are known without the catalog
    spark.sql(f"DROP TABLE {name}")  # an external table, so the files stay
    return chunks.select("group", "chunk", "rows", "counts", "cells")


def _chunks(rows: pa.Table) -> Iterator[Chunk]:
    """The chunks of a group in their order, one at a time."""
    for i in np.argsort(rows["chunk"].to_numpy()).tolist():
        yield Chunk(rows["rows"][i].as_py(), rows["counts"][i].as_py())


def _first_entries(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, group, n, anchors, contents, docs) packed per group and shard, the entries of its chunks one after the other."""

    def run(rows: pa.Table) -> pa.Table:
        found = []
        for chunk in _chunks(rows):
            chunk.cells(buckets)
            found.append((np.diff(chunk.cuts), chunk.anchor, chunk.content, chunk.first))
        counts = np.sum([f[0] for f in found], axis=0)
        dealt, entries = Dealt(counts), np.empty((3, counts.sum()), np.uint64)
        for n, *own in found:
            entries[:, dealt.take(n)] = own
        anchors, contents = _low_bytes(entries[0], 6), _low_bytes(entries[1], 6)
        group, end, out = rows["group"][0].as_py(), np.cumsum(counts).tolist(), []
        for b in np.nonzero(counts)[0].tolist():
            z, a = end[b], end[b - 1] if b else 0
            out.append((b, group, z - a, anchors[6 * a:6 * z], contents[6 * a:6 * z], _pack_docs(entries[2, a:z])))
        return pa.Table.from_batches([_table(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), ["bucket", "group", "n", "anchors", "contents", "docs"])])

    # bucketed by group: nothing is shuffled here
    return chunks.select("group", "chunk", "rows", "counts").groupBy("group").applyInArrow(run, "bucket long, group long, n long, anchors binary, contents binary, docs binary")


def _table(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def judge_entries(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """State of each entry of a shard.

    NEW: its anchor is in one document, or in one cell of which it is the first
    occurrence; COVERED: the cell is in a smaller document; FIRST: first
    occurrence of a cell whose anchor has other cells as well.
    """
    out = np.empty(len(anchor), np.uint8)
    part = (_mixed(anchor) % np.uint64(JUDGED_PARTS)).astype(np.uint8)
    for p in range(JUDGED_PARTS):
        at = np.nonzero(part == p)[0]
        if len(at):
            out[at] = _judge(anchor[at], content[at], doc[at])
    return out


def _judge(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    n = len(anchor)
    order = np.lexsort((content, anchor))
    a, c, d = anchor[order], content[order], doc[order]
    new_anchor, new_cell = np.ones(n, bool), np.ones(n, bool)
    new_anchor[1:] = a[1:] != a[:-1]
    new_cell[1:] = new_anchor[1:] | (c[1:] != c[:-1])
    anchor_at, cell_at = np.nonzero(new_anchor)[0], np.nonzero(new_cell)[0]
    of_anchor, of_cell = np.cumsum(new_anchor) - 1, np.cumsum(new_cell) - 1
    shared = np.minimum.reduceat(d, anchor_at) != np.maximum.reduceat(d, anchor_at)
    several = np.add.reduceat(new_cell, anchor_at, dtype=np.int64) > 1
    state = np.where(d > np.minimum.reduceat(d, cell_at)[of_cell], COVERED, np.where((shared & several)[of_anchor], FIRST, NEW))
    out = np.empty(n, np.uint8)
    out[order] = state
    return out


def _judged(entries: DataFrame) -> DataFrame:
    """(group, bucket, states, firsts) for every packed entry row; ``firsts`` counts its FIRST entries."""

    def run(rows: pa.Table) -> pa.Table:
        sizes = rows["n"].to_numpy()
        total = int(sizes.sum())
        state = judge_entries(_from_low_bytes(_joined(rows["anchors"]), total, 6), _from_low_bytes(_joined(rows["contents"]), total, 6),
                              np.concatenate([_unpack_docs(x.as_py(), int(n)) for x, n in zip(rows["docs"], sizes, strict=True)]))
        ends = np.cumsum(sizes)
        parts = [state[e - n:e] for e, n in zip(ends, sizes, strict=True)]
        return pa.table({"group": rows["group"], "bucket": rows["bucket"], "states": pa.array([x.tobytes() for x in parts], pa.binary()),
                         "firsts": pa.array([int((x == FIRST).sum()) for x in parts], pa.int64())})

    return entries.groupBy("bucket").applyInArrow(run, "group long, bucket long, states binary, firsts long")


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(x.as_py() for x in column)


def _group_states(told: pa.Table, buckets: int) -> tuple[Dealt, np.ndarray]:
    """(places, states) of a group's entries."""
    told = told.sort_by("bucket")
    counts = np.zeros(buckets, np.int64)
    counts[told["bucket"].to_numpy()] = pc.binary_length(told["states"]).to_numpy()
    return Dealt(counts), np.frombuffer(_joined(told["states"]), np.uint8)


def _group_masks(told: pa.Table, shards: int, sorts: int) -> tuple[Dealt, np.ndarray]:
    """(places, masks) of a group's FIRST entries."""
    told = told.sort_by("shard")
    counts = np.zeros((shards, sorts), np.int64)
    counts[told["shard"].to_numpy()] = np.frombuffer(_joined(told["counts"]), "<i4").reshape(-1, sorts)
    return Dealt(counts.ravel()), np.frombuffer(_joined(told["masks"]), "<u8")


def _first_cells(chunks: DataFrame, judged: DataFrame, buckets: int, shards: int, sorts: int) -> DataFrame:
    """(shard, group, counts, sizes, docs, text) of the FIRST cells of each group and shard.

    A shard is ``sorts`` sorted ones; its cells are in their order, and within
    one (of ``counts`` cells) in the order of the chunks and their entries.
    """

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        places, states = _group_states(told, buckets)
        found, texts, at = [], [], 0
        for chunk in _chunks(rows):
            chunk.cells(buckets)
            picked = np.nonzero(states[places.take(np.diff(chunk.cuts))] == FIRST)[0]
            cells = chunk.member[picked]
            found.append((chunk.sorted_counts(picked, shards * sorts), chunk.low[cells] + at, chunk.count[cells] + WINDOW - 1, chunk.first[picked]))
            texts.append(chunk.data)
            at += len(chunk.data)
        data, counts = np.concatenate(texts), np.sum([f[0] for f in found], axis=0)
        total = int(counts.sum())
        dealt, low, size, docs = Dealt(counts), np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.uint64)
        for n, *cells in found:
            to = dealt.take(n)
            low[to], size[to], docs[to] = cells
        counts = counts.reshape(shards, sorts)
        group, end, out = rows["group"][0].as_py(), np.cumsum(counts.sum(axis=1)).tolist(), []
        for b in np.nonzero(counts.any(axis=1))[0].tolist():
            s = slice(end[b - 1] if b else 0, end[b])
            out.append((b, group, counts[b].astype("<i4").tobytes(), size[s].astype(np.uint8).tobytes(), _pack_docs(docs[s]), data[_ranges(low[s], size[s])].tobytes()))
        return pa.Table.from_batches([_table(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), ["shard", "group", "counts", "sizes", "docs", "text"])])

    return (chunks.select("group", "chunk", "rows", "counts").groupBy("group").cogroup(judged.select("group", "bucket", "states").groupBy("group"))
            .applyInArrow(run, "shard long, group long, counts binary, sizes binary, docs binary, text binary"))


def sharing_cells(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which cells may share a window with a cell of another doc.

    Equal windows have their anchor at the same offset, so what lies within
    them whatever the offset in a range of ``KEY_STEP`` is equal too: a key for
    each range.
    """
    out = np.zeros(len(sizes), bool)
    if not len(sizes):
        return out
    begin = np.cumsum(sizes) - sizes
    ends = begin + sizes
    grams = WINDOW - GRAM + 1
    first = _gram_hashes(text[(begin[:, None] + np.arange(WINDOW)).T], GRAM)  # of every cell's first window
    # the leftmost least, as owners are told
    anchor = begin + np.argmin(first >> _PLACE_BITS, axis=0)
    powers, inverse = _powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    for least in range(0, grams, KEY_STEP):
        most = min(least + KEY_STEP, grams) - 1
        low, high = anchor - least, anchor + WINDOW - most
        inside = np.nonzero((low >= begin) & (high <= ends))[0]
        if not len(inside):
            continue
        key = (sums[high[inside]] - sums[low[inside]]) * inverse[low[inside]]
        order = np.argsort(key)
        inside, key = inside[order], key[order]
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        at, doc = np.nonzero(heads)[0], docs[inside]
        out[inside] |= (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at))[np.cumsum(heads) - 1]
    return out


def mark_windows(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray, spill: str | None = None) -> np.ndarray:
    """Mask of each cell: bit j is set when its j-th window is in a cell of a smaller doc.

    ``text`` holds the cells end to end, ``sizes`` their bytes; the sorter's
    queues go to ``spill`` beyond their memory budget.
    """
    masks = np.zeros(len(sizes), np.uint64)
    if not len(sizes):
        return masks
    used = np.bincount(text, minlength=256) > 0
    if used.sum() > 255:
        raise ValueError("text that uses every byte value can't be separated")
    code = np.cumsum(used).astype(np.uint8)  # keeps order, leaves 0 for separators
    begin = np.cumsum(sizes + 1) - sizes - 1
    whole = np.zeros(int(sizes.sum()) + len(sizes), np.uint8)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    inside = np.ones(len(whole), bool)
    inside[begin + sizes] = False
    whole[inside] = code[text]
    # a window starts where WINDOW bytes are left in its cell: count the starts open at each place
    edges = np.zeros(len(whole) + 1, np.int8)
    edges[begin] = 1
    edges[begin + sizes - WINDOW + 1] -= 1
    windows = np.cumsum(edges[:-1], dtype=np.int8) > 0
    for positions, common in SuffixOrder(whole, WINDOW, spill=spill).buckets():
        run = np.cumsum(common < WINDOW)
        at = windows[positions]
        positions, run = positions[at], run[at]
        if not len(run):
            continue
        new = np.ones(len(run), bool)
        new[1:] = run[1:] != run[:-1]
        doc = docs[owner[positions]]
        least = np.minimum.reduceat(doc, np.nonzero(new)[0])[np.cumsum(new) - 1]
        hit = positions[doc > least]
        np.bitwise_or.at(masks, owner[hit], np.uint64(1) << (hit - begin[owner[hit]]).astype(np.uint64))
    return masks


def _marked(cells: DataFrame) -> DataFrame:
    """(group, shard, counts, masks) for every row of cells."""
    spill = shared_folder(cells.sparkSession, "queues")

    def run(rows: pa.Table) -> pa.Table:
        counts = np.stack([np.frombuffer(x.as_py(), "<i4") for x in rows["counts"]]).astype(np.int64)
        sizes = np.frombuffer(_joined(rows["sizes"]), np.uint8).astype(np.int64)
        ends = np.cumsum(counts).reshape(counts.shape)  # of each row's cells of each sorted shard
        docs = np.concatenate([_unpack_docs(x.as_py(), int(n)) for x, n in zip(rows["docs"], counts.sum(axis=1), strict=True)])
        text, byte = np.frombuffer(_joined(rows["text"]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        masks = np.zeros(len(sizes), np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # cells, text

        def mark() -> None:
            own = np.concatenate([x for x, _ in held])
            masks[own] = mark_windows(np.concatenate([x for _, x in held]), sizes[own], docs[own], spill)
            held.clear()

        for end, n in zip(ends.T, counts.T, strict=True):
            own = _ranges(end - n, n)
            piece = np.concatenate([text[a:b] for a, b in zip(byte[end - n].tolist(), byte[end].tolist(), strict=True)])
            sharing = sharing_cells(piece, sizes[own], docs[own])
            if held and sum(len(x) for x, _ in held) + sharing.sum() > SORT_CELLS:
                mark()
            held.append((own[sharing], piece[np.repeat(sharing, sizes[own])]))
        mark()
        packed = pa.array([masks[a:b].astype("<u8").tobytes() for a, b in zip((ends[:, 0] - counts[:, 0]).tolist(), ends[:, -1].tolist(), strict=True)], pa.binary())
        return pa.table({"group": rows["group"], "shard": rows["shard"], "counts": rows["counts"], "masks": packed})

    return cells.groupBy("shard").applyInArrow(run, "group long, shard long, counts binary, masks binary")


def removed_bytes(chunk: Chunk, state: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether each byte of the chunk goes, by the states of its entries and the masks of the FIRST ones."""
    mask = np.zeros(len(state), np.uint64)
    mask[state == FIRST] = masks
    starts = np.zeros(len(chunk.data) + 1, np.int32)
    whole = (state[chunk.entry] == COVERED) | (chunk.rank[chunk.owner] > chunk.first[chunk.entry])
    np.add.at(starts, chunk.low[whole], 1)
    np.add.at(starts, chunk.low[whole] + chunk.count[whole] - 1 + WINDOW, -1)
    part = np.nonzero(~whole & (mask[chunk.entry] != 0))[0]
    if len(part):
        bits = np.unpackbits(mask[chunk.entry[part]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        at = chunk.low[part[row]] + bit
        np.add.at(starts, at, 1)
        np.add.at(starts, at + WINDOW, -1)
    return np.cumsum(starts[:-1]) > 0


OUTPUT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def dedup_substrings(documents: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its text's remaining bytes and the counts of what went.

    ``text`` becomes the remaining bytes as a string (a character cut in two
    becomes U+FFFD); n_bytes, n_removed, n_spans and kept_sha256 (of the bytes)
    are added.
    """
    kept_columns = [c for c in documents.columns if c not in OUTPUT]
    documents = documents.select(*[F.col(f"`{c}`") for c in kept_columns])
    spark = documents.sparkSession
    chunks = pack_chunks(documents, text)
    cells = chunks.agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-cells // SHARD_CELLS))
    judged = written(_judged(_first_entries(chunks, buckets)), "cell-states")
    firsts = judged.agg(F.coalesce(F.sum("firsts"), F.lit(0))).first()[0]
    shards = max(parts, -(-firsts // (SORT_CELLS * SORTS_DEALT)))
    sorts = max(1, -(-firsts // (SORT_CELLS * shards)))
    masks = written(_marked(_first_cells(chunks, judged, buckets, shards, sorts)), "cell-masks")
    told = judged.select("group", "bucket", "states").unionByName(masks, allowMissingColumns=True)
    schema = T.StructType([documents.schema[c] if c != text else T.StructField(c, T.StringType()) for c in kept_columns]
                          + [T.StructField(c, T.LongType() if c != "kept_sha256" else T.StringType()) for c in OUTPUT])

    wanted = to_arrow_schema(schema)

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        of_entry, states = _group_states(told.filter(pc.is_valid(told["states"])), buckets)
        of_first, masks = _group_masks(told.filter(pc.is_valid(told["masks"])), shards, sorts)
        out = []
        for chunk in _chunks(rows):
            chunk.cells(buckets)
            state = states[of_entry.take(np.diff(chunk.cuts))]
            gone = removed_bytes(chunk, state, masks[of_first.take(chunk.sorted_counts(np.nonzero(state == FIRST)[0], shards * sorts))])
            texts, removed, spans, digests = [], [], [], []
            for a, n in zip(chunk.begin.tolist(), chunk.sizes.tolist(), strict=True):
                cut = gone[a:a + n]
                left = chunk.data[a:a + n][~cut].tobytes()
                removed.append(int(cut.sum()))
                spans.append(int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1)))
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "replace"))
            made = {"n_bytes": pa.array(chunk.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
                    text: pa.array(texts, pa.string())}
            # times come in the session's zone and are wanted in UTC: the same values
            out.append(pa.RecordBatch.from_arrays([made[c] if c in made else chunk.batch.column(c).cast(wanted.field(c).type) for c in (*kept_columns, *OUTPUT)], names=[*kept_columns, *OUTPUT]))
        return pa.Table.from_batches(out)

    return chunks.select("group", "chunk", "rows", "counts").groupBy("group").cogroup(told.groupBy("group")).applyInArrow(run, schema)
