"""Incremental landing of raw listing exports with Structured Streaming.

Scrapes arrive as new export files over time.  The repair and quarantine
steps are stateless projections, so the batch functions run unchanged on each
micro-batch:

    lines of raw CSV files (readStream) -> records -> repair -> one write,
    partitioned into accepted rows and quarantined records

Every record is parsed once and both outcomes leave in the same write.  A batch
writes to a folder named by its id, replacing what a failed attempt left
there, and the checkpoint (under the shared folder) replays a batch with the
same id and files, so a restarted job never lands a file twice.
``availableNow`` processes whatever is there and stops; without it the job
keeps running on a processing-time trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens import schema as S
from pricelens.sources import files, records

ACCEPTED = "accepted"
QUARANTINE = "quarantine"
OUTCOME = "outcome"
BATCH = "batch"

LANDED = T.StructType([*S.LISTING.fields, T.StructField(S.N_FIELDS, T.IntegerType()), T.StructField(S.REASON, T.StringType()), T.StructField(S.RECORD, T.StringType()),
                       T.StructField(BATCH, T.LongType()), T.StructField(OUTCOME, T.StringType())])


def raw_stream(spark: SparkSession, raw_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return records.lines_of(reader.text(raw_dir))


def land(spark: SparkSession, raw_dir: str, out_dir: str, checkpoint_dir: str, available_now: bool = True,
         processing_time: str = "1 minute", max_files_per_trigger: int | None = None):
    """Start the landing; returns the running query (already finished with ``available_now``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        outcome = F.when(F.col(S.REASON).isNull(), F.lit(ACCEPTED)).otherwise(F.lit(QUARANTINE))
        (files.repair(files.listing_records(batch)).drop(files.WRAPPED).withColumn(OUTCOME, outcome)
              .write.mode("overwrite").partitionBy(OUTCOME).parquet(f"{out_dir}/{BATCH}={batch_id}"))

    w = (raw_stream(spark, raw_dir, max_files_per_trigger).writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    started = w.start()
    if available_now:
        started.awaitTermination()
        if started.exception() is not None:
            raise RuntimeError(f"landing stream failed: {started.exception()}")
    return started


def read_landed(spark: SparkSession, out_dir: str, name: str = ACCEPTED) -> DataFrame:
    """Batch view of one outcome (its directories alone are read)."""
    rows = spark.read.schema(LANDED).parquet(out_dir).filter(F.col(OUTCOME) == name)
    return rows.select(*S.LISTING_COLUMNS) if name == ACCEPTED else rows.select(S.URL, S.N_FIELDS, S.REASON, S.RECORD)
