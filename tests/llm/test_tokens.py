"""Token files and byte-pair codec against the tokenizers library, on odd texts and whole tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelens.llm import bpe, tokenbin
from pricelens.llm.queries import QUERIES, TOKENIZER, vocabulary_size
from pricelens.llm.shared import shared_folder, table

SMALL = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n \nb", "a\n\n b", "x\t y", "tab \there", "don't we'll I'm",
    "<|endoftext|>", "a <|endoftext|>b", "x <|endoftext|> y<|endoftext|>", "\x1c a \x1cb", "\u00a0a \u00a0 b", "\u3000 \u3000x", "１２ ３ Ⅷ½ a1b2",
    "Ééà ñ 漢字 かな 🎉🎉 e\u0301", "a" * 500, "ab" * 300, "!" * 200, "=-" * 150, "1" * 300, "\r\n\r\n x", "end \n", " \n", " <|endoftext|>", "'s 's'S",
    "Foo.\nBar, baz!!\n\nQux.\n Zap.\nÉté,\nü.x|y $a*b", "a.\n", ".\nA", "a,b;c:d", "x<|endoftext|>.\nB", "don't.\nI'm!", "word\u0301,\nA", "ŽŁ.,\nż!", "a#\n1", "##\nß,",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_codec_equals_library(library):
    own = bpe.BytePairCodec(TOKENIZER)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab e\n\t.'s0é漢 \u00a0") for _ in range(rng.randint(1, 120))) for _ in range(400)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, repr(t)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == t


def test_scan_and_heap_agree():
    own = bpe.BytePairCodec(TOKENIZER)
    rng = random.Random(5)
    for _ in range(200):
        word = "".join(rng.choice("abcdetion") for _ in range(rng.randint(2, 90))).encode()
        ids = [own.byte_ids[b] for b in word]
        assert own._scan(list(ids)) == own._heap(list(ids))


@pytest.mark.parametrize("limit", [5, 100_000])
def test_pieces_do_not_change_the_encoding(library, limit):
    encoder = tokenbin.library_encoder(TOKENIZER, "<u4")
    encoder = tokenbin.PieceEncoder(encoder.encode, limit=limit)
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice("ab  \n\t.'0é\u00a0\x1c,!<|") for _ in range(60)) for _ in range(600)]
    for _ in range(2):
        for t, data in zip(texts, encoder.batch(texts), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_usual_texts_are_told_without_the_expression(monkeypatch):
    blanks = [c for c in map(chr, range(0x110000)) if c.isspace()]
    texts = ["", " ", "a b\nc", "é ü", "a<b", "\x01", "a\n", "a \n", "a  b", " a", "漢 字"] + [t for c in blanks for t in (f"a{c}b", f"a {c}b", f"a{c} b", f"a{c}", f"漢 {c}")]
    assert [tokenbin.is_odd(t) for t in texts] == [tokenbin._ODD.search(t) is not None for t in texts]
    monkeypatch.setattr(tokenbin, "_ODD", None)  # costs a sixth of the encoding where it is not needed
    assert not tokenbin.is_odd("plain words, and\nlines é") and tokenbin.is_odd("two  blanks")


def odd_documents(spark):
    rows = [(i, t, "en", "s", len(t), i) for i, t in enumerate(ODD)] + [(900, None, None, None, None, 1), (None, "no id", "en", "s", 5, 1), (3, ODD[3], "en", "s", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start long").repartition(3)


def test_odd_documents(spark, library):
    docs = odd_documents(spark)
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    got = tokenbin.token_files(docs, shared_folder(spark, "t"), TOKENIZER, vocabulary_size(TOKENIZER)).orderBy("start").collect()
    start = 0
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    coded = {r.doc_id: r for r in bpe.encode_documents(docs, TOKENIZER).collect()}
    assert coded[900].n_tokens == 0 and coded[900].ids == [] and coded[900].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    for i, t in enumerate(ODD):
        assert coded[i].ids == library.encode(t, add_special_tokens=False).ids


def test_few_files_beside_the_token_files(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "concat('text ', id) text")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        files = tokenbin.token_files(docs, shared_folder(spark, "t"), TOKENIZER, vocabulary_size(TOKENIZER))
        rows = files.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len({r.file for r in rows}) > 3 and len(rows) == 4000
    assert len(files.inputFiles()) == 1  # the manifest; one a task before, each made by processes that the JVM starts
    assert len({r.task for r in rows}) <= 3
    assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokenbin.token_files(none, shared_folder(spark, "t"), TOKENIZER, 50_257).count() == 0
    assert bpe.encode_documents(none, TOKENIZER).count() == 0


def test_wide_ids_and_remote_read(tmp_path):
    from pyarrow import fs

    local = fs.LocalFileSystem()
    tokenbin.write_index(local, f"{tmp_path}/a.idx", tokenbin.id_type(70_000), [7, None], [2, 5])
    assert tokenbin.id_type(70_000) == "<u4" and tokenbin.id_type(65_536) == "<u2"
    dtype, ids, offsets = tokenbin.read_index(local, f"{tmp_path}/a.idx")
    assert (dtype, ids, offsets.tolist()) == ("<u4", [7, None], [0, 2, 5])
    (tmp_path / "a.bin").write_bytes(np.arange(5, dtype="<u4").tobytes())
    assert tokenbin.map_ids(local, f"{tmp_path}/a.bin", dtype).tolist() == tokenbin.map_ids(fs.SubTreeFileSystem("/", local), f"{tmp_path}/a.bin"[1:], dtype).tolist()


def test_queries_against_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}
    files = {r.doc_id: r for r in QUERIES["op2_token_files"](spark, SMALL).collect()}
    coded = {r.doc_id: r for r in QUERIES["op3_bpe"](spark, SMALL).collect()}
    assert docs.keys() == files.keys() == coded.keys()
    start = 0
    for doc_id in sorted(docs):
        ids = library.encode(docs[doc_id], add_special_tokens=False).ids
        f, c = files[doc_id], coded[doc_id]
        assert (f.start, f.n_tokens, f.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        assert (c.n_tokens, c.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert c.decoded_sha256 == hashlib.sha256(docs[doc_id].encode()).hexdigest()
        start += len(ids) + 1
