"""Substring dedup and its suffix sorter against brute force."""

import hashlib
import random

import numpy as np
import pytest

from pricelens.llm import induced, suffix
from pricelens.llm.queries import QUERIES
from pricelens.llm.shared import table

SMALL = "/root/testdata/sf0.001"


def expected(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each (doc_id, text) row."""
    rank = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - 49):
            w = data[i:i + 50]
            first[w] = min(first.get(w, float("inf")), rank(d))
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if first[data[i:i + 50]] < rank(d):
                gone[i:i + 50] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((rank(d), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((float("inf") if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed, monkeypatch, tmp_path):
    rng = random.Random(seed)
    monkeypatch.setattr(induced, "BLOCK", rng.choice([3, 17, 1 << 17]))
    parts = [bytes(rng.choice([1, 2, 3, 255][:rng.randint(1, 4)]) for _ in range(rng.randint(1, 90))) for _ in range(14)]
    parts += parts[:4] + [parts[0][:30] + parts[-1], b"\x04" * 120, b"\x04" * 120]
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    found = list(induced.SuffixOrder(text, 50, budget=rng.choice([0, 500, 1 << 20]), spill=f"file://{tmp_path}").buckets())[::-1]
    assert not list(tmp_path.iterdir())  # every spilled queue has been read back and removed
    order, common = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    whole = text.tobytes() + bytes(60)
    assert sorted(order.tolist()) == list(range(len(text) - 1))  # all but the last separator
    for i in range(1, len(order)):
        a, b = whole[order[i - 1]:][:50], whole[order[i]:][:50]
        assert a <= b
        same = next((k for k in range(50) if a[k] != b[k]), 50)
        assert common[i] == same or max(order[i - 1], order[i]) + same >= len(text) - 1


def odd_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 8))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(5)]
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 400, "ab" * 120, passages[0], passages[0], passages[0][:60], "\x00" * 80, "\x00\x01" * 60]
    for _ in range(60):
        body = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        body.insert(rng.randint(0, 3), rng.choice(passages)[rng.randint(0, 40):])
        texts.append("".join(body))
    texts += [texts[20], texts[21] + "tail", "head" + texts[22]]
    ids = [None, None, *rng.sample(range(-40, 4000), len(texts) - 4), 7, 7]
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_documents(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 2_000)
    rows = odd_rows(seed)
    docs = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], "doc_id long, text string, n_bytes string, row int").repartition(3)
    result = suffix.dedup_substrings(docs).cache()
    assert result.columns == ["doc_id", "text", "row", *suffix.OUTPUT]
    assert got(result) == expected(rows)


def test_long_document_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 256)
    rng = random.Random(4)
    long = "".join(rng.choice("abcd ") for _ in range(6000))
    rows = [(1, long[500:3000]), (2, long), (3, long[100:900] + long[4000:4070])]
    counts, cells = suffix.cell_counts(np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.array([len(t) for _, t in rows]))
    assert counts.sum() == sum(len(t) - 49 for _, t in rows) and cells.sum() == len(counts) and counts.max() <= 35
    assert [r[1:] for r in expected(rows)] == [r[1:] for r in got(suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")))]


def test_empty_table(spark):
    assert suffix.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    assert got(QUERIES["op8_suffix_dedup"](spark, SMALL)) == expected(rows)


def test_shards_are_even():
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(5000)) for _ in range(12)]
    data, sizes = suffix._text_bytes(pa.array(texts))
    counts, _ = suffix.cell_counts(data, sizes)
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(12), pa.uint64())], names=["_text", "_rank"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    chunk = suffix.Chunk(sink.getvalue().to_pybytes(), counts.tobytes())
    chunk.cells(16)
    share = np.diff(chunk.cuts) / len(chunk.anchor)
    assert share.max() < 0.1 and share.min() > 0.03


def test_rows_dealt_do_not_multiply_with_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 2_000)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(2_000))) for i in range(40)]
    chunks = suffix.pack_chunks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "text")
    assert chunks.count() >= 20
    assert suffix._first_entries(chunks, 64).count() <= 64


@pytest.mark.parametrize("group_bytes", [1, 9_000, 1 << 20])
def test_groups_and_sorts_of_any_size(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(suffix, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(suffix, "SORT_CELLS", 5)
    monkeypatch.setattr(suffix, "SORTS_DEALT", 3)
    rows = odd_rows(3)
    assert got(suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))) == expected(rows)


@pytest.mark.parametrize("seed", range(4))
def test_cells_left_out_share_no_window(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("ab ") for _ in range(rng.randint(9, 30))) for _ in range(12)]
    texts = ["".join(rng.choice(words) for _ in range(12)) for _ in range(30)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    doc_sizes = np.array([len(t) for t in texts])
    counts, per_document = suffix.cell_counts(data, doc_sizes)
    sizes = counts.astype(np.int64) + suffix.WINDOW - 1
    inside = np.cumsum(counts.astype(np.int64)) - counts - np.repeat((np.cumsum(np.maximum(doc_sizes - 49, 0)) - np.maximum(doc_sizes - 49, 0)), per_document)
    begin = inside + np.repeat(np.cumsum(doc_sizes) - doc_sizes, per_document)
    cells = np.concatenate([data[b:b + n] for b, n in zip(begin, sizes, strict=True)])
    docs = np.repeat(np.arange(30, dtype=np.uint64), per_document)
    sharing = suffix.sharing_cells(cells, sizes, docs)
    holders = {}
    for b, n, d in zip(begin, sizes, docs, strict=True):
        for at in range(b, b + n - 49):
            holders.setdefault(data[at:at + 50].tobytes(), set()).add(int(d))
    must = [any(len(holders[data[at:at + 50].tobytes()]) > 1 for at in range(b, b + n - 49)) for b, n in zip(begin, sizes, strict=True)]
    assert sharing[must].all() and 0 < sum(must) and sharing.sum() < len(sizes)


def test_times_of_another_zone(spark):
    from pyspark.sql import functions as F

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = F.timestamp_seconds(F.col("id") + 86_400)
        docs = spark.range(4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the same text "), 9).alias("text"), at.alias("at"), F.array(F.struct(at.alias("t"))).alias("nested"))
        kept = suffix.dedup_substrings(docs).select("doc_id", "n_removed", F.unix_seconds("at"), F.unix_seconds(F.col("nested")[0]["t"])).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(tuple, kept)) == [(i, 126 * (i > 0), 86_400 + i, 86_400 + i) for i in range(4)]
