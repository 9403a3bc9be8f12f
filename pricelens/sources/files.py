"""Listing files: raw CSV scan with repair and quarantine, CSV/parquet sinks.

Raw listing exports have three kinds of records:

* plain: 13 fields;
* wrapped: the whole record is one quoted field (``"a,b,""c"",..."``), so a
  CSV reader sees one column and 12 nulls;
* over-long: more fields than the header (stray commas) -- these cannot be
  placed and go to a quarantine instead of silently shifting columns, as do
  records with a value that its column's type cannot read.

The scan cuts the files into records in parallel (``sources.records``), so one
large export is read by many tasks.  Every record is then judged by its text:
unwrapped, counted in fields and parsed once with ``from_csv`` into texts, which
``try_cast`` reads by the columns' types.  The first record of each file must be the
schema's header.  Records of fewer fields are padded with nulls; one empty field
after the last (a lone trailing comma) is dropped.  After the repair the rows
are landed as parquet and every later job reads that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens import schema as S
from pricelens.sources import records

LINE_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
TOO_LONG = "too many fields"
UNCLOSED = "unclosed quote"
WRAPPED = "_wrapped"


def read_raw_listings(spark: SparkSession, path: str) -> DataFrame:
    """Raw scan: ``record`` (its text) and ``unclosed`` of every record but the headers; a header with other names raises."""
    return listing_records(records.read_lines(spark, path))


def listing_records(lines: DataFrame) -> DataFrame:
    header = ",".join(S.LISTING_COLUMNS)
    same = F.lower(F.replace(F.replace(F.col(records.RECORD), F.lit('"'), F.lit("")), F.lit("\ufeff"), F.lit(""))) == header
    wrong = F.raise_error(F.concat(F.lit("the header is not that of listings: "), F.left(F.col(records.RECORD), F.lit(200)))).cast("boolean")
    data = F.when(~F.col(records.FIRST), F.lit(True)).when(same, F.lit(False)).otherwise(wrong)
    return records.records(lines).where(data).select(records.RECORD, records.UNCLOSED)


def raw_preview(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The first ``n`` raw lines in text order, headers left out, as they stand in the files: ``line``."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    header = ",".join(S.LISTING_COLUMNS)
    return lines.filter(F.lower("line") != header).orderBy("line").limit(n)


def field_count(record: Column) -> Column:
    """Fields of one CSV record: commas outside quoted stretches, plus one."""
    quoted = F.regexp_replace(record, '"(?:[^"]++|"")*+"', "")
    bare = F.when(F.contains(record, F.lit('"')), quoted).otherwise(record)
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def repair(raw: DataFrame, schema: T.StructType = S.LISTING) -> DataFrame:
    """The listing columns, and for every record ``n_fields``, ``reason`` (null: accepted), ``record`` (its whole text where it is not)
    and whether it was wrapped (has one field in all).

    ``raw`` is ``read_raw_listings``' output.  One parse: the texts stand behind a generator, which the optimizer does not
    copy into what uses them.
    """
    names = [f.name for f in schema.fields]
    text = F.col(records.RECORD)
    alone = field_count(text) == 1
    quoted = alone & text.startswith('"') & text.endswith('"') & (F.length(text) > 1)
    line = F.when(quoted, F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))).otherwise(text)
    told = raw.select(text.alias(S.RECORD), records.UNCLOSED, alone.alias(WRAPPED), line.alias("_line"))
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    parsed = F.struct(F.from_csv("_line", S.ddl(texts), LINE_OPTIONS).alias("_t"), field_count(F.col("_line")).alias(S.N_FIELDS),
                      F.col("_line").endswith(",").alias("_trailing"))
    told = told.select(S.RECORD, records.UNCLOSED, WRAPPED, F.inline(F.array(parsed)))
    trailing = (F.col(S.N_FIELDS) == len(names) + 1) & F.col("_trailing")
    reason = F.when(F.col(records.UNCLOSED), F.lit(UNCLOSED)).when((F.col(S.N_FIELDS) > len(names)) & ~trailing, F.lit(TOO_LONG))
    columns = []
    for f in schema.fields:
        own = F.nullif(F.col(f"_t.{f.name}"), F.lit(""))
        typed = own if isinstance(f.dataType, T.StringType) else own.try_cast(f.dataType)
        columns.append(typed.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            reason = reason.when(own.isNotNull() & typed.isNull(), F.lit(f"unreadable {f.name}"))
    told = told.select(*columns, S.N_FIELDS, reason.alias(S.REASON), S.RECORD, WRAPPED)
    return told.withColumn(S.RECORD, F.when(F.col(S.REASON).isNotNull(), F.col(S.RECORD)))


def accepted(repaired: DataFrame) -> DataFrame:
    """Rows that fit the header: the 13 listing columns."""
    return repaired.filter(F.col(S.REASON).isNull()).select(*S.LISTING_COLUMNS)


def quarantine(repaired: DataFrame) -> DataFrame:
    """Records that cannot be placed: ``url`` (first field), ``n_fields``, ``reason`` and the whole ``record`` as it stood in the file."""
    return repaired.filter(F.col(S.REASON).isNotNull()).select(S.URL, S.N_FIELDS, S.REASON, S.RECORD)


def _audit_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("raw"), F.count_if(WRAPPED).alias("wrapped"),
            F.count_if(F.col(S.REASON).isNotNull()).alias("quarantined"), F.count_if(F.col(S.REASON).isNull()).alias("accepted")]


AUDIT_STAGES = ["raw", "wrapped", "quarantined", "accepted"]


def land_repaired(raw: DataFrame, path: str) -> dict[str, int]:
    """Write the repaired records to ``path/rows`` as parquet, the audit's counts beside them; the counts.

    They are taken while the rows are written (``observe``): no second job reads anything.
    """
    seen = Observation("repair")
    repair(raw).observe(seen, *_audit_counts()).write.mode("errorifexists").parquet(f"{path}/rows")
    counts = {stage: seen.get.get(stage, 0) for stage in AUDIT_STAGES}
    raw.sparkSession.createDataFrame([(s, counts[s], i) for i, s in enumerate(AUDIT_STAGES)], "stage string, n_rows long, step int") \
        .coalesce(1).write.mode("errorifexists").parquet(f"{path}/audit")
    return counts


def repair_audit(raw: DataFrame) -> DataFrame:
    """``stage, n_rows, step``: raw records, wrapped among them, quarantined, accepted -- one scan, one aggregate."""
    row = repair(raw).agg(*_audit_counts())
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(s).cast("long").alias("n_rows"), F.lit(i).alias("step"))
        for i, s in enumerate(AUDIT_STAGES)])))


# --- sinks ----------------------------------------------------------------------

#: Rows a compressed text file.  A reader gives such a file to one task whole, and several small ones together: few rows keep its sorts in memory.
COMPRESSED_FILE_ROWS = 100_000


def write_listings_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Standardized CSV: every field quoted, doubled quotes inside, header per file; plain, or compressed in files of bounded size."""
    out = df.write.mode("errorifexists").option("header", "true").option("quoteAll", "true").option("quote", '"').option("escape", '"').option("nullValue", "")
    if compression:
        out = out.option("compression", compression).option("maxRecordsPerFile", COMPRESSED_FILE_ROWS)
    out.csv(path)


#: Tasks that share the rows of one directory of a partitioned write.
PARTITION_FILES = 4


def write_listings_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """The hand-off format for every later job; optionally partitioned (e.g. by date)."""
    if partition_by is None:
        df.write.mode("errorifexists").parquet(path)
        return
    # Rows of a directory meet in a few tasks (a salt splits a hot one), so a
    # task does not open a file for every directory.
    clustered = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(PARTITION_FILES))).repartition(F.col(partition_by), F.col("_salt")).drop("_salt")
    clustered.write.mode("errorifexists").partitionBy(partition_by).parquet(path)


def write_raw_export(df: DataFrame, path: str, wrapped: Column, extra: Column, texts: dict[str, Column] | None = None, file_rows: int = COMPRESSED_FILE_ROWS) -> None:
    """Write rows as a raw export: ``wrapped`` rows as one quoted field, rows with a non-null ``extra`` string followed by it
    (it brings its own commas), and columns in ``texts`` replaced where that text is not null.

    Used to make repair inputs from the test tables; each output file
    starts with the header line, as a real export does.  The files are
    gzipped, of at most ``file_rows`` rows each.
    """
    def shown(c: str) -> Column:
        if c not in (texts or {}):
            return F.col(c)
        own = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if isinstance(S.LISTING[c].dataType, T.TimestampNTZType) else F.col(c).cast("string")
        return F.coalesce(texts[c], own).alias(c)

    line = F.to_csv(F.struct(*[shown(c) for c in S.LISTING_COLUMNS]), {"quote": '"', "escape": '"'})
    line = F.when(extra.isNotNull(), F.concat(line, extra)).otherwise(line)
    line = F.when(wrapped, F.concat(F.lit('"'), F.replace(line, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(line)
    header = ",".join(S.LISTING_COLUMNS)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % F.lit(file_rows) == 0  # by its place in its task, which starts a file every so many rows
    out = df.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value"))
    out.write.mode("errorifexists").option("compression", "gzip").option("maxRecordsPerFile", file_rows).text(path)


# --- published tables -------------------------------------------------------------

METRICS_SCHEMA = "epoch INT, MSE DOUBLE, MAE DOUBLE, RMSE DOUBLE, R2 DOUBLE"


def read_metrics_csv(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Metric tables (unnamed leading index = epoch), one per run, unioned with a ``run`` column."""
    frames = [spark.read.option("header", "true").schema(METRICS_SCHEMA).csv(p).withColumn("run", F.lit(run))
              for run, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def write_predictions_csv(forecast: DataFrame, path: str, prompts) -> None:
    """Publish ``prompt, day, price`` wide: an unnamed row index (row ``i`` is day ``i + 1``), one column a prompt."""
    wide = forecast.groupBy("day").pivot("prompt", list(prompts)).agg(F.max(S.PRICE))
    rows = wide.select((F.col("day") - 1).alias("_c0"), *[F.col(f"`{p}`") for p in prompts])
    rows.coalesce(1).sortWithinPartitions("_c0").write.option("header", "true").csv(path)  # one row a day


def read_predictions_csv(spark: SparkSession, path: str, prompts=None) -> DataFrame:
    """A published wide forecast table: ``day`` (row index + 1) and one price column a prompt.

    The first header field may be empty or any name.  With ``prompts`` the
    price columns must be exactly these, else they are taken from the header.
    """
    header = spark.read.csv(path).first()  # the header line is the file's first record
    if header is None:
        raise ValueError(f"{path} has no header")
    names = list(header)[1:]
    if prompts is not None and names != list(prompts):
        raise ValueError(f"{path} has the prompts {names}, not {list(prompts)}")
    schema = T.StructType([T.StructField("_row", T.IntegerType())] + [T.StructField(p, T.DoubleType()) for p in names])
    rows = spark.read.option("header", "true").schema(schema).csv(path)
    return rows.select((F.col("_row") + 1).alias("day"), *[F.col(f"`{p}`") for p in names])
