"""Ranked lexical search of many items at once, by sharing sums among them.

A document's score for an item is a sum over the item's terms, so sets of terms
that several items hold need to be summed once a document.  Shared sets are mined by
rounds: every item's nodes (at first its terms, repeats one by one) are put in
order of how many items hold them, neighbours that ``SHARED`` items or more have
together become a new node, and again until no pair is common enough.  The nodes
form a graph: a task fills the terms' accumulators of a block of documents, adds
each shared node once from its two parts, level by level, and sums the few nodes left
of every item.  Each task keeps the best documents of every item; those
are merged first by item and salt, then by item.

The corpus is read once for each part of the items (a part has about
``PART_TERMS`` term occurrences, so a usual benchmark is one part): one scan cuts
texts into terms and writes, for every document, its number of terms and the
counts of the part's terms; statistics and scores come from that table.  What is sent to tasks is one
part's terms and graph.  Items of equal terms are one.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII;
only A-Z are lower-cased.  Weights, lengths and scores are integers as the
docstring of ``search`` says.

Edge cases: a null or empty text has no terms: such documents don't count, such
items have no rows; whole texts are read, however long; rows that repeat a
doc_id are documents of their own, rows that repeat an item_id items of their
own; equal scores go by ascending doc_id, null last; empty tables give
no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.shared import written

#: Term occurrences of the items sent to tasks at a time, about.
PART_TERMS = 1 << 17
#: Items that must share two nodes for their sum to become a node.
SHARED = 3
#: Accumulators (nodes times documents) a task holds at a time.
CELLS = 1 << 21
#: Groups that an item's candidates are merged in first.
SALTS = 64

_TERM_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes([b + 32 if 0x41 <= b <= 0x5A else b if b in _TERM_BYTES else 0x20 for b in range(256)])


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return text.encode().translate(_FOLD).split()


class Graph:
    """Sums shared by items: leaves are terms, a shared node is the sum of two nodes.

    ``levels`` lists (node, left, right) arrays in the order to add them, ``rest`` the
    nodes whose sum is an item, ``cuts`` where each item's begin.
    """

    def __init__(self, items: list[list[int]], n_terms: int, shared: int = SHARED):
        # the k-th occurrence of a term in an item is a node's key of its own while mining
        lists = [[(t, k) for t, n in Counter(item).items() for k in range(n)] for item in items]
        names = {x: i for i, x in enumerate(dict.fromkeys(x for own in lists for x in own))}
        term_of = [t for t, _ in names]
        nodes = [[names[x] for x in own] for own in lists]
        made: list[tuple[int, int]] = []
        while True:
            held = Counter(x for own in nodes for x in own)
            nodes = [sorted(own, key=lambda x: (-held[x], x)) for own in nodes]
            pairs = Counter(p for own in nodes for p in zip(own, own[1:], strict=False))
            wanted = {p: n for p, n in pairs.items() if n >= shared}
            if not wanted:
                break
            new: dict[tuple[int, int], int] = {}
            for i, own in enumerate(nodes):
                out, j = [], 0
                while j < len(own):
                    pair = tuple(own[j:j + 2])
                    # of two overlapping pairs the more common one is taken
                    if wanted.get(pair, 0) and wanted[pair] >= wanted.get(tuple(own[j + 1:j + 3]), 0):
                        out.append(new.setdefault(pair, len(term_of) + len(made) + len(new)))
                        j += 2
                    else:
                        out.append(own[j])
                        j += 1
                nodes[i] = out
            made += new
        # leaves of one term are the same accumulator; numbers of shared nodes follow those of the terms
        n_keys = len(term_of)
        number = term_of + [n_terms + i for i in range(len(made))]
        depth = [0] * len(number)
        by_level: dict[int, list[tuple[int, int, int]]] = {}
        for i, (a, b) in enumerate(made):
            depth[n_keys + i] = 1 + max(depth[a], depth[b])
            by_level.setdefault(depth[n_keys + i], []).append((number[n_keys + i], number[a], number[b]))
        self.n_nodes, self.n_items = n_terms + len(made), len(items)
        self.levels = [tuple(np.array(c, np.int64) for c in zip(*by_level[d], strict=True)) for d in sorted(by_level)]
        self.rest = np.array([number[x] for own in nodes for x in own], np.int64)
        self.cuts = np.cumsum([0, *map(len, nodes)])[:-1].astype(np.int64)

    def additions(self) -> int:
        """Sums a document costs."""
        return sum(len(x[0]) for x in self.levels) + len(self.rest) - self.n_items

    def scores(self, row: np.ndarray, term: np.ndarray, part: np.ndarray, n_rows: int) -> np.ndarray:
        """[items, rows] sums, from what each (row, term) adds; every item has a term at least."""
        acc = np.zeros((self.n_nodes, n_rows), np.int64)
        acc[term, row] = part
        for node, left, right in self.levels:
            acc[node] = acc[left] + acc[right]
        return np.add.reduceat(acc[self.rest], self.cuts, axis=0)


class Best:
    """The best documents of every item among those seen: highest score, then lowest doc_id (null last)."""

    def __init__(self, top: int):
        self.top = top
        self.rows = np.zeros((3, 0), np.int64)  # item, doc, score
        self.floor: np.ndarray | None = None

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        if self.floor is None:
            self.floor = np.ones(len(scores), np.int64)
        item, at = np.nonzero(scores >= self.floor[:, None])
        if not len(item):
            return
        rows = np.concatenate([self.rows, np.stack([item, docs[at], scores[item, at]])], axis=1)
        rows = rows[:, np.lexsort((rows[1], -rows[2], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, np.arange(rows.shape[1]) - first < self.top]
        full = np.nonzero(np.bincount(self.rows[0], minlength=len(scores)) == self.top)[0]
        # rows of an item end with its lowest score: less can't enter
        self.floor[full] = self.rows[2][np.searchsorted(self.rows[0], full, "right") - 1]


NO_ID = np.iinfo(np.int64).max


def document_terms(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the document), term and tf (of the vocabulary's); documents without terms are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.get
        for batch in batches:
            n, ids, counts, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                words = terms(text)
                n.append(len(words))
                own = Counter(filter(None, map(find, words)))
                ids += own.keys()
                counts += own.values()
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, term array<int>, tf array<int>").where("n > 0")


def best_of_part(counted: DataFrame, graph: Graph, n_docs: int, n_terms: int, weight: np.ndarray, top: int) -> DataFrame:
    """(class, doc_id, score): the best documents of every item of a part."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(top)
        step = max(1, CELLS // (graph.n_nodes + len(graph.rest)))
        for batch in batches:
            doc = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            n = batch.column("n").to_numpy()
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            for a in range(0, batch.num_rows, step):
                ids, tfs = batch.column("term").slice(a, step), batch.column("tf").slice(a, step)
                row = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy())
                term, tf = ids.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[a:a + step][row]))
                best.add(graph.scores(row, term, part, len(ids)), doc[a:a + step])
        item, doc, total = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == NO_ID), pa.array(total)], names=["class", "doc_id", "score"])

    found = counted.where(F.size("term") > 0).mapInArrow(score, "class long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
    for keys in (["class", "salt"], ["class"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return salted.select("class", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """item_id, item (a number of the row), rank, doc_id, score: the ``top`` documents of each (item_id, text) with a score above 0.

    With N documents that have terms, L terms in all of them, n in the
    document, df documents that hold a term, and tf its occurrences in the document: a term's weight is
    floor(1000 ln((2N + 2) / (2df + 1))), m is 100 - 75 + (75 n N) div L, and the
    score the sum, over the item's terms with repeats, of weight times (10^9 tf) div (1000 tf + 8 m).
    """
    spark = documents.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(terms(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array([[w.decode() for w in x] for x in own], pa.list_(pa.string()))], names=["item", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = written(rows.mapInArrow(cut, f"item long, item_id {items.schema['item_id'].dataType.simpleString()}, terms array<string>").where(F.size("terms") > 0)
                    .withColumn("key", F.md5(F.array_join("terms", " "))), "search-items")
    folded = written(asked.groupBy("key").agg(F.any_value("terms").alias("terms")), "search-classes")
    total = folded.agg(F.sum(F.size("terms"))).first()[0]
    if not total:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, item long, rank int, doc_id long, score long")
    parts = -(-total // PART_TERMS)
    found = []
    for part in range(parts):
        # a part's items, about PART_TERMS occurrences of terms, are all that comes to the driver
        own = folded.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).orderBy("key").collect()
        if not own:
            continue
        vocabulary = {w.encode(): i + 1 for i, w in enumerate(sorted({w for r in own for w in r["terms"]}))}  # 0 would not count as found
        graph = Graph([[vocabulary[w.encode()] for w in r["terms"]] for r in own], len(vocabulary) + 1)
        counted = written(document_terms(documents, vocabulary), "search-terms")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["term"]: r["df"] for r in counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary) + 1)], np.int64)
        best = best_of_part(counted, graph, n_docs, max(1, n_terms), weight, top)
        keys = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(own)], "class long, key string")
        found.append(written(best.join(keys, "class").select("key", "rank", "doc_id", "score"), "search-best"))
    told = reduce(DataFrame.unionByName, found)
    return asked.select("key", "item", "item_id").join(told, "key").select("item_id", "item", "rank", "doc_id", "score")
