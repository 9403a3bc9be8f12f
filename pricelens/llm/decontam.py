"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

Test items are indexed once: postings of impacts, items of similar length in
blocks, and for every term the largest impact in each block.  Every document is
cut into half-overlapping passages and each passage is a query.  Impacts are
scaled by the item's score against itself, so one threshold serves items of any
length: a passage must reach ``MIN_SCORE`` of what the item's own text scores.
WAND's pivot test - can the summed maxima of the query's terms reach the
threshold - is made for all passages and blocks of an Arrow batch at once; of
the postings of a passage's terms only those in blocks that can are read and
their items scored exactly, and all items above the threshold are retrieved,
with no top-k.  A retrieved item is then
verified on five-word shingles of the document: ``MIN_OVERLAP`` of those of its
question and of its answer must occur, or ``MIN_OVERLAP`` of those of the whole
item, as one changed word can take every shingle of a short answer.

An item's answer is its last sentence, the rest is its question (an item of
one sentence is split in half).  A half of fewer words than a shingle is
verified by its whole word sequence.  Words are lower-cased runs of letters,
digits, ``_`` and non-ASCII characters.

The number of items, their mean length and the document frequencies are counted
once over the whole benchmark, so scores don't depend on its parts.  Items of
equal text fold into one, which is counted by their number; their ids are joined
back at the end.  The texts are split by hash into parts of about ``PART_ITEMS``;
every document meets every part.  One part with the frequencies of its own words
is what is collected and sent to tasks at a time, and its results are written
before the next is sent, so its size has a bound whatever the benchmark's.

Edge cases: null and empty texts of documents match nothing; null, empty or
wordless items are never matched; repeated items match each on their own;
null ids stay null; a document of any length is searched whole, window by
window, by one task; rows that repeat a doc_id are judged each; empty tables
give no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.shared import written

K1, B = 1.2, 0.75
#: Items in a block.
BLOCK_ITEMS = 4
#: Share of an item's self-score that a passage must reach.
MIN_SCORE = 0.7
MIN_OVERLAP = 0.8
SHINGLE = 5
#: Words of half a passage, at least; widened to the longest item of the part.
HALF_PASSAGE = 64
#: Distinct texts of a part, on average.
PART_ITEMS = 1_000

_CUT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c == 95 or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_CUT).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    whole = sentences[0] if sentences else []
    half = (len(whole) + 1) // 2
    return whole[:half], whole[half:]


def shingles(words: list[bytes], width: int = SHINGLE) -> set[tuple[bytes, ...]]:
    width = min(width, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if width else set()


@dataclass
class Statistics:
    """Of the whole benchmark; ``frequency`` holds the words of one part at least."""

    items: int
    mean_words: float
    frequency: dict[bytes, int]


@dataclass
class Index:
    """One part of the benchmark; items are numbered by rising length, ``BLOCK_ITEMS`` to a block."""

    item_ids: list[int | None]
    halves: list[tuple[list[bytes], list[bytes]]]  # words of question and answer, which are the item's words end to end
    terms: dict[bytes, int]
    #: Postings of term t: items[starts[t]:starts[t + 1]] and their impacts.
    starts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    #: [terms + 1, blocks] largest impact of each term in each block; the last row is of unknown words.
    block_max: np.ndarray
    half: int

    @cached_property
    def keys(self) -> np.ndarray:
        """term * items + item of every posting, rising."""
        return np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * len(self.item_ids) + self.items


def build_index(items: list[tuple[int | None, str | None]], statistics: Statistics | None = None) -> Index:
    """Index of some items by the statistics given, or by their own."""
    known = sorted(((words_of(t or ""), i, question_answer(t or "")) for i, t in items), key=lambda x: len(x[0]))
    known = [x for x in known if x[0]]
    own_words = Counter(t for w, _, _ in known for t in set(w))
    if statistics is None:
        statistics = Statistics(len(known), sum(len(w) for w, _, _ in known) / max(1, len(known)), own_words)
    n, mean, frequency = statistics.items, statistics.mean_words, statistics.frequency
    terms = {t: k for k, t in enumerate(sorted(own_words))}
    postings: list[list[tuple[int, float]]] = [[] for _ in terms]
    blocks = -(-len(known) // BLOCK_ITEMS)
    block_max = np.zeros((len(terms) + 1, blocks), np.float32)
    for number, (words, _, _) in enumerate(known):
        own = {}
        for t, c in Counter(words).items():
            idf = log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5))
            own[terms[t]] = idf * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean))
        whole = sum(own.values())
        for t, x in own.items():
            postings[t].append((number, x / whole))
            block_max[t, number // BLOCK_ITEMS] = max(block_max[t, number // BLOCK_ITEMS], x / whole)
    longest = len(known[-1][0]) if known else 0
    return Index([i for _, i, _ in known], [h for _, _, h in known], terms, np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64),
                 np.array([i for p in postings for i, _ in p], np.int64), np.array([x for p in postings for _, x in p], np.float64), block_max, max(HALF_PASSAGE, longest))


def retrieve(index: Index, documents: list[list[bytes]], min_score: float = MIN_SCORE, read: list[tuple[int, int]] | None = None) -> dict[tuple[int, int], float]:
    """(document, item) -> best passage score, for every pair that reaches the threshold.

    ``read`` gets, for every passage that opens a block, the postings read and those its terms have.
    """
    if not index.terms or not documents:
        return {}
    none, n_items = len(index.terms), len(index.item_ids)
    look = index.terms.get
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    terms = np.concatenate([np.fromiter(map(look, w, repeat(none)), np.int64, len(w)) for w in documents])
    doc = np.repeat(np.arange(len(documents)), sizes)
    within = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # halves of passages are numbered through all documents, with one spare between documents
    halves = -(-sizes // index.half) + 1
    first = np.cumsum(halves) - halves
    part = first[doc] + within // index.half
    seen = terms < none
    # distinct terms of each half; a term in both halves of a passage counts twice, so bounds only err upwards
    keys = np.unique(part[seen] * (none + 1) + terms[seen])
    key_part, key_term = keys // (none + 1), keys % (none + 1)
    if not len(keys):
        return {}
    present, begins = np.unique(key_part, return_index=True)
    total = int(halves.sum())
    sums = np.zeros((total + 1, index.block_max.shape[1]), np.float32)
    sums[present] = np.add.reduceat(index.block_max[key_term], begins, axis=0)
    bounds = sums[:-1] + sums[1:]
    bounds[first + halves - 1] = 0  # no passage starts in a spare
    passages, opened = np.nonzero(bounds >= min_score - 1e-4)
    edges = np.searchsorted(key_part, np.arange(total + 2))
    best: dict[tuple[int, int], float] = {}
    owner = np.repeat(np.arange(len(documents)), halves)
    for p in np.unique(passages):
        blocks = opened[slice(*np.searchsorted(passages, [p, p + 1]))]
        query = np.unique(key_term[edges[p]:edges[p + 2]])
        # a term's postings are in item order, so those of a block lie together: the rest is never read
        begin = np.searchsorted(index.keys, (query[:, None] * n_items + blocks * BLOCK_ITEMS).ravel())
        counts = np.searchsorted(index.keys, (query[:, None] * n_items + np.minimum((blocks + 1) * BLOCK_ITEMS, n_items)).ravel()) - begin
        places = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        if read is not None:
            read.append((len(places), int((index.starts[query + 1] - index.starts[query]).sum())))
        scores = np.zeros(n_items)
        np.add.at(scores, index.items[places], index.impacts[places])
        for item in np.nonzero(scores >= min_score - 1e-9)[0]:
            pair = (int(owner[p]), int(item))
            best[pair] = max(float(scores[item]), best.get(pair, 0.0))
    return best


def matches(index: Index, texts: list[str], min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """(text, item number, score, question overlap, answer overlap) of every verified pair."""
    documents = [words_of(t) for t in texts]
    found = retrieve(index, documents, min_score)
    out = []
    cache: tuple[int, dict[int, set]] = (-1, {})
    for (row, item), score in sorted(found.items()):
        if cache[0] != row:
            cache = (row, {})
        question, answer = index.halves[item]
        overlaps = []
        for part in (question, answer, question + answer):
            width = min(SHINGLE, len(part))
            if not width:
                overlaps.append(1.0)
                continue
            if width not in cache[1]:
                cache[1][width] = shingles(documents[row], width) if len(documents[row]) >= width else set()
            wanted = shingles(part)
            overlaps.append(len(wanted & cache[1][width]) / len(wanted))
        *overlaps, whole = overlaps
        if min(overlaps) >= min_overlap or whole >= min_overlap:
            out.append((row, item, score, *overlaps))
    return out


@dataclass
class Benchmark:
    """``texts``: part, number, text, terms (word and frequency in the whole benchmark); ``ids``: number, item_id of every item."""

    texts: DataFrame
    ids: DataFrame
    parts: int
    items: int
    mean_words: float

    def indexes(self) -> Iterator[Index]:
        """Indexes of the parts by number, built on the driver one at a time."""
        for p in range(self.parts):
            rows = self.texts.where(F.col("part") == p).orderBy("text").collect()
            frequency = {bytes(t.term): t.frequency for r in rows for t in r.terms}
            yield build_index([(r.number, r.text) for r in rows], Statistics(self.items, self.mean_words, frequency))


def fold(benchmark: DataFrame) -> Benchmark:
    known = benchmark.select("item_id", "text").where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            distinct = [sorted(set(w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("copies"), pa.array(map(len, words), pa.int64()), pa.array(distinct, pa.list_(pa.binary()))], names=["text", "copies", "n_words", "words"])

    folded = known.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).mapInArrow(run, "text string, copies long, n_words long, words array<binary>")
    texts = written(folded.where("n_words > 0").withColumn("number", F.monotonically_increasing_id()), "benchmark-texts")
    total = texts.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("copies"), F.lit(0)).alias("items"), F.coalesce(F.sum(F.col("copies") * F.col("n_words")), F.lit(0)).alias("words")).first()
    parts = -(-total["texts"] // PART_ITEMS)
    frequency = texts.select("copies", F.explode("words").alias("term")).groupBy("term").agg(F.sum("copies").alias("frequency"))
    terms = (texts.select("number", F.explode("words").alias("term")).join(frequency, "term")
             .groupBy("number").agg(F.collect_list(F.struct("term", "frequency")).alias("terms")))
    told = texts.join(terms, "number").select(F.pmod(F.xxhash64("text"), F.lit(max(1, parts))).alias("part"), "number", "text", "terms")
    ids = known.join(texts.select("text", "number"), "text").select("number", "item_id")
    return Benchmark(written(told, "benchmark-parts"), written(ids, "benchmark-ids"), parts, total["items"], total["words"] / max(1, total["items"]))


def _runs(texts: list[str], limit: int = 1 << 20) -> Iterator[slice]:
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item it holds: doc_id, item_id, bm25 (share of the self-score), question_overlap, answer_overlap.

    One scan of the documents for each part of the benchmark; only what is found is joined, to the ids of its item's text.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = documents.sparkSession
    schema = "doc_id long, number long, bm25 double, question_overlap double, answer_overlap double"

    def against(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, words = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                rows = [(ids[s.start + r], index.item_ids[i], *rest) for s in _runs(words) for r, i, *rest in matches(index, words[s])]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=["doc_id", "number", "bm25", "question_overlap", "answer_overlap"])

        return texts.mapInArrow(run, schema)

    tests = fold(benchmark)
    found = []
    for index in tests.indexes():
        shared = spark.sparkContext.broadcast(index)
        found.append(written(against(shared), "leaks"))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], schema.replace("number", "item_id"))
    return reduce(DataFrame.unionAll, found).join(tests.ids, "number").select("doc_id", "item_id", "bm25", "question_overlap", "answer_overlap")


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, whole rows.

    All parts of the benchmark but the last write the SHA-256 of the texts they
    find, as equal texts hold equal items; the last part is met by the rows that remain.
    """
    spark = documents.sparkSession
    tests = fold(benchmark)

    def leaking(shared, texts: list[str]) -> set[int]:
        return {s.start + r for s in _runs(texts) for r, *_ in matches(shared.value, texts[s])}

    def found_by(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                digests = sorted({hashlib.sha256(texts[i].encode()).hexdigest() for i in leaking(shared, texts)})
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string())], names=["gone"])

        return documents.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "gone string")

    def kept_by(frame: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gone = leaking(shared, [t or "" for t in batch.column("text").to_pylist()])
                yield batch.filter(pa.array([i not in gone for i in range(batch.num_rows)], pa.bool_()))

        return frame.mapInArrow(run, documents.schema)

    left, found = documents, []
    for p, index in enumerate(tests.indexes()):
        shared = spark.sparkContext.broadcast(index)
        if p < tests.parts - 1:
            found.append(written(found_by(shared), "leaking-texts"))
            shared.destroy()
            continue
        if found:
            gone = reduce(DataFrame.unionAll, found).distinct()
            left = left.join(gone, F.sha2(left["text"], 256) == gone["gone"], "left_anti")
        left = kept_by(left, shared)
    return left
