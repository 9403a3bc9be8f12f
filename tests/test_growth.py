"""What moves and is written as the tables grow: one narrow shuffle a large join, no sort, compressed exports."""

import gzip
from pathlib import Path

from pyspark.sql import functions as F

from pricelens import schema as S
from pricelens.sources import files, tables

HEADER = ",".join(S.LISTING_COLUMNS)


def star(spark, folder):
    """A few rows of the five tables: keys that are null, unknown or repeated."""
    rows = {
        "lineitem": ([(1, 1, 1, 1, 2.0, 10.0, "R", "F", None), (None, 1, 2, 2, 1.0, 20.0, "N", "O", None), (9, 2, 1, 7, 1.0, 30.0, "N", "F", None),
                      (1, 3, 1, 3, 1.0, 1.0, "R", "F", None), (1, None, 1, 4, 1.0, 1.0, "R", "F", None), (1, 1, None, 5, 1.0, 1.0, "R", "F", None), (1, 1, 7, 6, 1.0, 1.0, "R", "F", None)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "part": ([(1, "red widget", "B1", "steel"), (1, "red again", "B2", "tin"), (2, "blue", None, None), (None, "none", "B", "x")], "p_partkey long, p_name string, p_brand string, p_type string"),
        "supplier": ([(1, 1), (2, 2), (None, 1)], "s_suppkey long, s_nationkey int"),
        "nation": ([(1, "POLAND"), (2, "PERU")], "n_nationkey int, n_name string"),
        "orders": ([(1, None, "1-URGENT"), (None, None, "5-LOW")], "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string"),
    }
    for name, (values, ddl) in rows.items():
        spark.createDataFrame(values, ddl).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_listings_move_keys_and_codes_alone_and_sort_nothing(spark, tmp_path):
    df = tables.listings_from_tables(spark, star(spark, tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 4 and not any("n_name" in line for line in moved)
    got = {(r[S.URL], r[S.VOIVODESHIP], r[S.NAME], r[S.OFFER_FROM], r[S.PRICE]) for r in df.collect()}
    assert df.count() == 5 and got == {("1-1-1-1", "POLAND", "red widget", "1-URGENT", 10.0), ("1-1-1-1", "POLAND", "red again", "1-URGENT", 10.0),
                                       ("2-1-2", "PERU", "red widget", None, 20.0), ("2-1-2", "PERU", "red again", None, 20.0), ("9-7-2-1", "POLAND", "blue", None, None)}


def listing_rows(spark, n):
    own = spark.range(n).select(*[(F.concat(F.lit(f"{c} "), F.col("id")) if f.dataType.simpleString() == "string" else F.lit(None)).cast(f.dataType).alias(f.name)
                                  for f in S.LISTING.fields for c in [f.name]])
    return own.coalesce(1)


def test_a_compressed_raw_export_has_a_header_in_every_file(spark, tmp_path):
    df = listing_rows(spark, 25)
    out = tmp_path / "raw"
    files.write_raw_export(df, str(out), F.col(S.URL).endswith("3"), F.when(F.col(S.URL).endswith(" 4"), F.lit(",x")), file_rows=10)
    lines = [gzip.decompress(p.read_bytes()).decode().splitlines() for p in Path(out).glob("*.gz")]
    assert sorted(map(len, lines)) == [6, 11, 11] and all(part[0] == HEADER for part in lines)
    rep = files.repair(files.read_raw_listings(spark, str(out)))
    assert files.quarantine(rep).count() == 1
    assert sorted(map(str, files.accepted(rep).collect())) == sorted(map(str, df.where(~F.col(S.URL).endswith(" 4")).collect()))


def test_a_compressed_csv_sink_reads_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "COMPRESSED_FILE_ROWS", 10)
    df, out = listing_rows(spark, 25), tmp_path / "std"
    files.write_listings_csv(df, str(out), compression="gzip")
    assert len(list(Path(out).glob("*.csv.gz"))) == 3
    assert sorted(map(str, files.accepted(files.repair(files.read_raw_listings(spark, str(out)))).collect())) == sorted(map(str, df.collect()))
