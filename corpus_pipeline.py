"""The corpus pipeline: quality, near copies, repeated passages, leaked test items, tokens.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` chains them over ``documents``, each result written as
parquet in the shared folder and reread as the next one's input, so a lost
executor never costs more than the stage it was in.

Rows that repeat a doc_id are judged on their own in the near-copy stage, so
of equal rows one stays.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import bpe, decontam, quality, simhash, suffix
from pricelens.llm.queries import SIMHASH_DISTANCE, SIMHASH_SHINGLE, TOKENIZER
from pricelens.llm.shared import table, written


#: Column that tells rows apart inside the near-copy stage.
ROW_KEY = "_near_copies_row"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps (score at or over its threshold)."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, and of its rows the smallest text hash."""
    # doc_ids may repeat or be null, so rows get a key of their own; it must not change between reads
    rows = written(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()), "keyed")
    groups = simhash.near_duplicates(rows.select(F.col(ROW_KEY).alias("doc_id"), "text"), SIMHASH_SHINGLE, SIMHASH_DISTANCE)
    member = written(groups.select(F.col("doc_id").alias(ROW_KEY), "component_id"), "copies")
    order = rows.select(ROW_KEY, F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.xxhash64("text").alias("hash"), ROW_KEY).alias("place"))
    heads = member.join(order, ROW_KEY).groupBy("component_id").agg(F.min("place").alias("place")).select(f"place.{ROW_KEY}")
    gone = written(member.select(ROW_KEY).join(heads, ROW_KEY, "left_anti"), "copies-gone")
    return rows.join(gone, ROW_KEY, "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a smaller doc_id has as well; ``n_chars`` follows the text."""
    left = suffix.dedup_substrings(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def leaked_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the text decoded from them."""
    return bpe.encode_documents(docs, TOKENIZER)


STAGES = [
    ("quality", quality_filter),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("leaked_items", leaked_items),
    ("tokens", tokens),
]

#: Models, reachability and subword merges: no SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
