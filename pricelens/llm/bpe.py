"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is held as two small arrays: the ids of its parts and the merge
rank of each adjacent pair.  The lowest rank is found by scanning, its right
part is deleted, and the two ranks beside it are looked up again.  Words over
``LONG_WORD`` bytes keep the same pairs in a heap instead, so that a long run
of letters costs n log n and not n squared.

Edge cases: null text is empty (no ids, empty decoding); special tokens in
a text become their ids, as the tokenizer file says; empty tables give no
rows; repeated rows are encoded each; a text of any length is encoded whole in
one task, n log n in its longest word; extra columns, whatever their names, are
dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tokenbin import PieceEncoder, slices

LONG_WORD = 64
#: Pieces a worker's codec remembers in a generation; only a memory bound.
CACHE_PIECES = 250_000
NO_RANK = 1 << 60

# Fixed value: the split pattern of byte-level BPE tokenizers (published with the tokenizer files).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the rest for letters from 256 on."""
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class BytePairCodec:
    """Vocabulary, merges and added tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocabulary: dict[str, int] = data["model"]["vocab"]
        self.byte_ids = [vocabulary[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.size = max([*vocabulary.values(), *self.added.values()]) + 1
        table = [b""] * self.size
        for word, i in vocabulary.items():
            table[i] = bytes(byte_of[c] for c in word)
        for word, i in self.added.items():
            table[i] = word.encode()
        self.token_bytes = table
        self.split = regex.compile(SPLIT)
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def word(self, data: bytes) -> list[int]:
        """Ids of one word (already split off), given as its bytes."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) < 2:
            return ids
        return self._scan(ids) if len(ids) <= LONG_WORD else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        merges = self.merges
        none = (NO_RANK, -1)
        found = [merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        ranks = [f[0] for f in found]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            ids[i] = merges[ids[i], ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), none)[0]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), none)[0]
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        """The same merges in the same order: lowest rank first, leftmost among equals."""
        merges, n = self.merges, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i] = merges[pair][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (p := (ids[left], ids[after[left]])) in merges:
                    heapq.heappush(heap, (merges[p][0], left, p))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.added_split.split(text) if self.added_split else [text]:
            if part in self.added:
                out.append(self.added[part])
            else:
                for w in self.split.findall(part):
                    out += self.word(w.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """Bytes of all ids in order; sequences that are no UTF-8 become U+FFFD."""
        table = self.token_bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


_CODECS: dict[str, tuple[BytePairCodec, PieceEncoder]] = {}


def codec(path: str) -> tuple[BytePairCodec, PieceEncoder]:
    """One codec and its cache of pieces per worker process."""
    if path not in _CODECS:
        own = BytePairCodec(path)
        _CODECS[path] = own, PieceEncoder(lambda texts: [np.array(own.encode(t), "<u4").tobytes() for t in texts], CACHE_PIECES)
    return _CODECS[path]


def encode_documents(documents: DataFrame, tokenizer: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (where ``keep_ids``), ids_sha256, decoded_sha256, one row per document.

    One scan, no shuffle; a task holds an Arrow batch and a bounded cache of
    pieces of text.  ``decoded_sha256`` is of the text decoded from the ids.
    """
    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * keep_ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, encoder = codec(tokenizer)
        numerals = [str(i) for i in range(own.size)]
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for part in slices(texts):
                sizes, ids_hash, text_hash = [], [], []
                encoded = encoder.batch(texts[part])
                for data in encoded:
                    ids = np.frombuffer(data, "<u4").tolist()
                    sizes.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join([numerals[i] for i in ids]).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                columns = {"doc_id": doc_ids.slice(part.start, part.stop - part.start), "n_tokens": pa.array(sizes, pa.int64())}
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)))
                columns |= {"ids_sha256": pa.array(ids_hash), "decoded_sha256": pa.array(text_hash)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
