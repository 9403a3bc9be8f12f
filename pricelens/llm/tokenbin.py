"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A range sort by doc_id gives every task a run of documents in order; the task
encodes them and writes two files, ids (``.bin``, flat unsigned integers in
the narrowest width the vocabulary allows) and documents (``.idx``, header,
doc_ids and 64-bit offsets into the ids).  The place of a file's first id in
the whole stream is the prefix sum of the files before it.  Readers map the
files into memory where the store is a local or mounted folder.

Edge cases: null and empty text is its end id alone; a null doc_id sorts first;
rows that repeat a doc_id, equal ones too, stay separate rows in an order fixed
by the text, and may lie in several files; a text of any length is one row of
one task, encoded whole; empty tables give no rows; extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.shared import store, unique_name, written

MAGIC = b"TOKIDX01"
END_ID = 0
#: Atoms of text whose ids a worker remembers in a generation; only a memory bound,
#: atoms beyond it are encoded again.
CACHE_PIECES = 600_000
#: Atoms handed to the library in one text.
JOINED_PIECES = 4_096
#: Token files a task reads back, one after another: reading costs a small part of encoding, and what writes
#: the rows makes files for each task (without Hadoop's native library an executor starts processes for them).
FILES_READ = 4
MANIFEST = "path string, first_task int, n_docs long, n_tokens long"

# A pre-tokenizer of the byte-level family always starts a new token at a
# space that a non-space follows, and ends one between a letter and a mark, and
# after a line end that follows a mark (plain letters and marks only, so that no
# tokenizer's tables can see it otherwise).  The atoms between such places can
# be encoded alone, and equal atoms once.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = ".,;:!?|$&%*#"
_CUT = re.compile(r" (?=\S)")
_INNER = re.compile(f"(?<=[{_LETTER}])(?=[{_MARK}])|(?<=[{_MARK}]\\n)(?=[{_LETTER}])")
#: Stands before an atom that no space goes before.
BARE = "\x01"
# Texts that are cut in Python: a space that starts no word, the sign for bare atoms, and what may start a control string.
_ODD = re.compile(r" (?:\s|$)|[\x01<]")
# A text without any of these is told by three plain searches: all blanks but the space and the line end, and the signs above.
_RARE = [*"\x01<\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680", *map(chr, range(0x2000, 0x200b)), *"\u2028\u2029\u202f\u205f\u3000"]


def is_odd(text: str) -> bool:
    """Whether ``_ODD`` finds anything, without the expression for the usual text."""
    for c in _RARE:
        if c in text:
            return _ODD.search(text) is not None
    return "  " in text or " \n" in text or text[-1:] == " "


def atoms(text: str) -> list[str]:
    """Keys of the atoms whose encodings, joined, are the encoding of the text.

    A key that starts with ``BARE`` stands for the rest of it, any other for
    itself with a space before it.  A piece that might hold a control string stays whole.
    """
    out = []
    for i, piece in enumerate(_CUT.split(text)):
        first, *rest = [piece] if "<" in piece else _INNER.split(piece)
        out.append(first if i else BARE + first)
        out += [BARE + x for x in rest]
    return out


def atom_lists(texts: pa.Array) -> pa.Array:
    """``atoms`` of every text that isn't odd, by Arrow; null for null."""
    marked = pc.replace_substring_regex(texts, f"([{_LETTER}])([{_MARK}])", f"\\1 {BARE}\\2")
    marked = pc.replace_substring_regex(marked, f"([{_MARK}]\\n)([{_LETTER}])", f"\\1 {BARE}\\2")
    return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(BARE, texts.type), marked, pa.scalar("", texts.type)), " ")


def spelled(key: str) -> str:
    """The text a key stands for."""
    return key[1:] if key[:1] == BARE else " " + key


class PieceEncoder:
    """Ids of whole texts by way of remembered atoms.

    ``encode`` gives the ids of a list of strings, as little-endian bytes of
    ``dtype``.  The texts of a batch are cut into atoms and these folded to the
    distinct ones by Arrow, so Python looks up each atom once a batch, and only
    unknown ones are encoded.  Two generations of the cache are kept: when the
    young one is full it becomes the old one, so memory is bounded and frequent
    atoms stay.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_PIECES, dtype: str = "<u4"):
        self.encode, self.limit, self.dtype = encode, limit, dtype
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _lookup(self, keys: list[str]) -> list[bytes]:
        """Ids of every key; all unknown ones are encoded in one call."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        held = [*map(young.get, keys)]
        missing = [i for i, h in enumerate(held) if h is None]
        fresh = []
        for i in missing:
            k = keys[i]
            known = old.get(k)
            if known is None:
                fresh.append(k)
            else:
                young[k] = held[i] = known
        young.update(zip(fresh, self.encode([spelled(k) for k in fresh]), strict=True))
        for i in missing:
            held[i] = young[keys[i]]
        return held

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of each text in them: one more than texts)."""
        if not texts:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        odd = {i: pa.array(atoms(t), pa.large_string()) for i, t in enumerate(texts) if is_odd(t)}
        lists = atom_lists(pa.array([None if i in odd else t for i, t in enumerate(texts)] if odd else texts, pa.large_string()))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        flat = lists.flatten()
        if odd:  # the atoms of odd texts go to their places between the others
            begins = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            runs, done = [], 0
            for i, own in odd.items():
                runs += [flat.slice(done, begins[i] - done), own]
                done, sizes[i] = begins[i], len(own)
            flat = pa.concat_arrays([*runs, flat.slice(done)])
        folded = flat.dictionary_encode()
        at = folded.indices.to_numpy()
        held = self._lookup(folded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # every atom's bytes in its places, one after another
        placed = pa.array(held, pa.large_binary()).take(folded.indices)
        _, offsets, data = placed.buffers()
        ends = np.frombuffer(offsets, np.int64, len(placed) + 1)
        ids = np.frombuffer(data, self.dtype, int(ends[-1]) // np.dtype(self.dtype).itemsize) if ends[-1] else np.zeros(0, self.dtype)
        return ids, ends[np.concatenate([[0], np.cumsum(sizes)])] // ids.itemsize

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        ids, bounds = self.flat(texts)
        data, cuts = ids.tobytes(), (bounds * ids.itemsize).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def encode_joined(tokenizer, widths: np.ndarray, dtype: str, texts: list[str]) -> list[bytes]:
    """Ids of each piece, many pieces to a call of the library.

    Pieces that start with a space and a non-space can follow one another in one
    text without changing each other's tokens; so can pieces without blanks at
    either end if each has a line end before it, which is one token.  The ids
    are cut apart again by the bytes their tokens stand for; a run of pieces
    that does not come apart, and any other piece, is encoded alone.
    """
    out = [b""] * len(texts)
    spaced = [i for i, t in enumerate(texts) if t[:1] == " " and t[1:2].strip()]
    lined = [i for i, t in enumerate(texts) if t[:1].strip() and t[-1:].strip()] if len(spaced) < len(texts) else []
    alone = list(set(range(len(texts))).difference(spaced, lined))
    size = np.dtype(dtype).itemsize
    for group, before in ((spaced, ""), (lined, "\n")):
        for a in range(0, len(group), JOINED_PIECES):
            part = group[a:a + JOINED_PIECES]
            held = [texts[i] for i in part]
            ids = np.array(tokenizer.encode_batch_fast([before + before.join(held)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(widths[ids])
            wanted = np.cumsum(np.fromiter((len(t.encode()) for t in held), np.int64, len(held)) + len(before))
            cuts = np.searchsorted(ends, wanted) + 1
            begins = np.concatenate([[0], cuts[:-1]])
            if not len(ids) or cuts[-1] > len(ids) or not np.array_equal(ends[cuts - 1], wanted) or (before and (widths[ids[begins]] != 1).any()):
                alone += part
                continue
            data = ids.astype(dtype).tobytes()
            for i, x, y in zip(part, ((begins + len(before)) * size).tolist(), (cuts * size).tolist(), strict=True):
                out[i] = data[x:y]
    if alone:
        for i, e in zip(alone, tokenizer.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype).tobytes()
    return out


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def library_encoder(path: str, dtype: str) -> PieceEncoder:
    """One encoder per worker process for a byte-level tokenizer file of the tokenizers library."""
    key = (path, dtype)
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        # a byte-level token has one letter for each byte; added tokens are plain text
        widths = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            widths[i] = len(token)
        for i, token in tokenizer.get_added_tokens_decoder().items():
            widths[i] = len(token.content.encode())
        _ENCODERS[key] = PieceEncoder(lambda texts: encode_joined(tokenizer, widths, dtype, texts), dtype=dtype)
    return _ENCODERS[key]


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def slices(texts: list[str], limit: int = 1 << 21) -> Iterator[slice]:
    """Runs of texts of about ``limit`` characters, at least one text each."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; the manifest: path, first_task, n_docs, n_tokens.

    One shuffle: the range sort.  A task holds its documents' offsets and one
    Arrow batch of text, never its ids.
    """
    dtype = id_type(vocabulary)
    spark = documents.sparkSession
    # the hash parts rows that repeat a doc_id, however many
    ordered = (documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
               .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "hash")
               .sortWithinPartitions("doc_id", "hash", "text").drop("hash"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = library_encoder(tokenizer, dtype)
        end = np.array([end_id], dtype).tobytes()
        width = np.dtype(dtype).itemsize
        filesystem, root = store(folder)
        filesystem.create_dir(root, recursive=True)
        out, name, doc_ids, ends, at = None, "", [], [], 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in slices(texts):
                if out is None:
                    name = unique_name("tokens", "")
                    out = filesystem.open_output_stream(f"{root}/{name}.bin", compression=None)
                coded = encoder.batch(texts[part])
                out.write(end.join([*coded, b""]))
                for data in coded:
                    at += len(data) // width + 1
                    ends.append(at)
                doc_ids += ids[part]
        if out is not None:
            out.close()
            write_index(filesystem, f"{root}/{name}.idx", dtype, doc_ids, ends)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([at], pa.int64())],
                                             names=["path", "first_task", "n_docs", "n_tokens"])

    return ordered.mapInArrow(write, MANIFEST)


def write_index(filesystem: fs.FileSystem, path: str, dtype: str, doc_ids: list[int | None], ends: list[int]) -> None:
    """Header (magic, id width, documents), null flags, doc_ids and n + 1 offsets, all little-endian 64-bit but the flags."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    with filesystem.open_output_stream(path, compression=None) as out:
        out.write(MAGIC + np.array([np.dtype(dtype).itemsize, len(doc_ids)], "<u8").tobytes())
        out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([0, *ends], "<u8").tobytes() + known.tobytes())


def read_index(filesystem: fs.FileSystem, path: str) -> tuple[str, list[int | None], np.ndarray]:
    with filesystem.open_input_stream(path, compression=None) as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"{path} is no token index")
    width, n = np.frombuffer(data, "<u8", 2, 8)
    n = int(n)
    ids = np.frombuffer(data, "<i8", n, 24)
    offsets = np.frombuffer(data, "<u8", n + 1, 24 + 8 * n)
    known = np.frombuffer(data, np.uint8, n, 32 + 16 * n)
    return f"<u{int(width)}", [int(i) if k else None for i, k in zip(ids, known, strict=True)], offsets


def map_ids(filesystem: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """The ids as an array over the file: mapped where the store is a folder, else read."""
    if isinstance(filesystem, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with filesystem.open_input_stream(path, compression=None) as f:
        return np.frombuffer(f.read(), dtype)


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: ids in all files before.  One row per task, so the window is small."""
    before = Window.orderBy("first_task").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                dtype, doc_ids, offsets = read_index(filesystem, f"{root}/{row['path']}.idx")
                ids = map_ids(filesystem, f"{root}/{row['path']}.bin", dtype)
                bounds = offsets.astype(np.int64).tolist()
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
                starts = np.asarray(offsets[:-1], np.int64) + row["base"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(np.diff(offsets.astype(np.int64)), pa.int64()), pa.array(sums, pa.int64()), pa.array([row["path"]] * len(doc_ids))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    tasks = -(-int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")) // FILES_READ)
    return manifest.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_files(documents: DataFrame, folder: str, tokenizer: str, vocabulary: int) -> DataFrame:
    """Write the token files of ``documents`` under ``folder`` and read them back.

    The bases are summed before the manifest is written, so it is one small file
    and not one for each task.
    """
    manifest = written(with_bases(write_tokens(documents, folder, tokenizer, vocabulary)), "token-manifest")
    return read_tokens(manifest, folder)
