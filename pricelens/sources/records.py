"""Records of quoted text files, read in parallel inside a file.

A quoted field may hold line ends, so whether a line starts a record depends on
every quote before it in the file.  A ``multiLine`` reader therefore gives a file to one
task.  Here a file is read as lines, in splits:

1. every split counts its quotes; whether a split begins inside quotes is the
   parity of the sum over the splits before it in its file (one row a split);
2. every task then cuts the lines of its splits into records: a line that ends
   outside quotes ends a record (doubled quotes count twice, so they change nothing);
3. what a split's edge cuts in two, the end of one split and the beginning of
   the next, is joined in a small table of at most two rows a split.

Nothing moves but those rows.  Quotes must be doubled inside quoted fields and
not stand alone in bare ones; a record whose quotes don't close (at the end of
its file, or for more than ``MAX_SPLITS`` splits) is told as ``unclosed``, in
the latter case split by split, so that one stray quote can't gather the rest of a
file in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.operators.joins import BROADCAST_MAX_ROWS
from pricelens.session import landed

LINE, FILE, SPLIT_AT = "line", "file", "split_at"
RECORD, UNCLOSED, FIRST = "record", "unclosed", "first"
#: Splits that one record may touch.
MAX_SPLITS = 64

# What a task tells: a whole record, the first record of a file, and the parts
# of records that a split's edge has cut: the end of one, a split without any
# record's end, the begin of one.
WHOLE, HEADER, END, THROUGH, BEGIN = range(5)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, file, split_at`` of text files, one task for every split."""
    return lines_of(spark.read.option("lineSep", "\n").text(path))


def lines_of(text: DataFrame) -> DataFrame:
    """The same from a text scan (batch, or a micro-batch of a stream); a file goes by 64 bits of its path's hash."""
    return text.select(F.col("value").alias(LINE), F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(SPLIT_AT))


def _quotes() -> F.Column:
    return F.length(LINE) - F.length(F.replace(F.col(LINE), F.lit('"'), F.lit("")))


def open_splits(lines: DataFrame) -> DataFrame:
    """``file, split_at, inside`` of the splits that begin (``inside``) or end inside quotes."""
    counted = lines.groupBy(FILE, SPLIT_AT).agg(F.sum(_quotes()).alias("quotes"))
    upto = Window.partitionBy(FILE).orderBy(SPLIT_AT)  # one row a split
    counted = counted.withColumn("after", F.sum("quotes").over(upto.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    before = (F.col("after") + F.col("quotes")) % 2
    return landed(counted.select(FILE, SPLIT_AT, (before == 1).alias("inside"), "after").where("inside or after = 1").drop("after"), "open-splits")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order -> whole records and the parts at split edges: file, split_at, kind, record."""
    place, begun, fresh, held, inside = None, False, True, [], 0  # of the split under way

    def told(kinds, records) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, place[0])), pa.array(np.full(n, place[1])), pa.array(kinds, pa.int32()), pa.array(records, pa.string())],
                                          names=[FILE, SPLIT_AT, "kind", RECORD])

    for batch in batches:
        if not batch.num_rows:
            continue
        lines, quotes = batch.column(0), batch.column(3).to_numpy().astype(np.int64)
        name, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        cuts = np.nonzero((at[1:] != at[:-1]) | (name[1:] != name[:-1]))[0] + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            here = (int(name[a]), int(at[a]))
            if here != place:
                if held:
                    yield told([BEGIN if begun or not fresh else THROUGH], ["\n".join(held)])
                place, held, inside = here, [], int(bool(batch.column(4)[a].as_py()))
                fresh = bool(inside)  # so far nothing but the rest of another split's record
                begun = False
            after = (inside + np.cumsum(quotes[a:b])) & 1
            ends = np.nonzero(after == 0)[0]
            inside = int(after[-1])
            part = lines.slice(a, b - a)
            if not len(ends):
                held += part.to_pylist()
                continue
            kind = np.zeros(len(ends), np.int32)
            if not begun:
                kind[0] = END if fresh else HEADER if place[1] == 0 else WHOLE
                begun, fresh = True, False
            if len(ends) == b - a and not held:
                yield told(kind, part)
                continue
            texts, records, begin = part.to_pylist(), [], 0
            for e in ends.tolist():
                own = texts[begin:e + 1] if not held else held + texts[begin:e + 1]
                records.append(own[0] if len(own) == 1 else "\n".join(own))
                held, begin = [], e + 1
            held = texts[begin:]
            yield told(kind, records)
    if held:
        yield told([BEGIN if begun or not fresh else THROUGH], ["\n".join(held)])


def _cut_lines(lines: DataFrame, inside: DataFrame) -> DataFrame:
    """``file, split_at, kind, record`` of the lines, given the splits that begin inside quotes."""
    known = lines.withColumn("quotes", _quotes()).withColumn("inside", F.lit(False))
    n = inside.count()
    pieces = -(-n // BROADCAST_MAX_ROWS)  # joins that keep the lines where they are, each with a side of bounded size
    for piece in range(pieces):
        side = inside if pieces == 1 else inside.where(F.pmod(F.xxhash64(FILE, SPLIT_AT), F.lit(pieces)) == piece)
        known = (known.join(F.broadcast(side.withColumn("met", F.lit(True))), [FILE, SPLIT_AT], "left")
                 .withColumn("inside", F.col("inside") | F.coalesce("met", F.lit(False))).drop("met"))
    rows = known.select(LINE, FILE, SPLIT_AT, "quotes", "inside")
    return rows.mapInArrow(_cut, f"{FILE} long, {SPLIT_AT} long, kind int, {RECORD} string")


def records(lines: DataFrame) -> DataFrame:
    """``record, unclosed, first`` of every record of the files; ``first`` marks the first of each file.

    Blank lines between records are left out.  The lines are read twice, and once
    more where records lie across splits.
    """
    parted = open_splits(lines)
    cut = _cut_lines(lines, parted.where("inside").select(FILE, SPLIT_AT))
    odd = (F.length(RECORD) - F.length(F.replace(F.col(RECORD), F.lit('"'), F.lit("")))) % 2 == 1
    out = cut.where(F.col("kind") <= HEADER).select(RECORD, F.lit(False).alias(UNCLOSED), (F.col("kind") == HEADER).alias(FIRST))
    tidy = F.regexp_replace(RECORD, "\r$", "")
    if parted.isEmpty():
        return out.withColumn(RECORD, tidy).where(F.trim(RECORD) != "")
    parts = landed(cut.where(F.col("kind") > HEADER), "records-cut")
    in_file = Window.partitionBy(FILE).orderBy(SPLIT_AT, "kind")  # at most two rows a split
    chained = parts.withColumn("chain", F.sum(F.when(F.col("kind") == BEGIN, 1).otherwise(0)).over(in_file))
    sizes = chained.groupBy(FILE, "chain").agg(F.count(F.lit(1)).alias("n"))
    chained = chained.join(sizes, [FILE, "chain"])
    together = (chained.where(F.col("n") <= MAX_SPLITS).groupBy(FILE, "chain")
                .agg(F.sort_array(F.collect_list(F.struct(SPLIT_AT, "kind", RECORD))).alias("parts"))
                .select(F.array_join(F.transform("parts", lambda p: p[RECORD]), "\n").alias(RECORD)))
    apart = chained.where(F.col("n") > MAX_SPLITS).select(RECORD)
    for more, broken in ((together, odd), (apart, F.lit(True))):
        out = out.unionByName(more.select(RECORD, broken.alias(UNCLOSED), F.lit(False).alias(FIRST)))
    return out.withColumn(RECORD, tidy).where(F.trim(RECORD) != "")
