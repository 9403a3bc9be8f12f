"""Raw CSV scan: wrapped, short, over-long, multi-line and trailing-comma records."""

import pytest

from pricelens import schema as S
from pricelens.sources import files

HEADER = ",".join(S.LISTING_COLUMNS)


def _fields(url, name="phone", desc="nice"):
    return [url, "Mazowieckie", "2021-01-02T10:00:00", name, "2500.0", "iPhone", "Używane", "Osoba",
            "Sprawny", desc, "2021-01-01T09:30:00", "17.0", ""]


def _line(fields):
    return ",".join(fields)


def _wrap(line):
    return '"' + line.replace('"', '""') + '"'


def _write(tmp_path, lines):
    p = tmp_path / "raw.csv"
    p.write_text(HEADER + "\n" + "\n".join(lines) + "\n", encoding="utf-8")
    return str(p)


def test_repair_and_quarantine(spark, tmp_path):
    quoted_desc = _fields("u3", desc='"big, shiny"')
    lines = [
        _line(_fields("u1")),                                   # plain
        _wrap(_line(_fields("u2", name="iphone 11 pro"))),      # wrapped
        _wrap(_line(quoted_desc)),                              # wrapped, inner quotes and comma
        _line(_fields("u4")[:5]),                               # short: padded with nulls
        _line(_fields("u5") + ["stray"]),                       # over-long: quarantine
        _wrap(_line(_fields("u6") + ["stray"])),                # wrapped and over-long
        _line(_fields("u7")) + ",",                             # lone trailing comma: accepted
        _line(_fields("u8", desc='"two\nlines"')),              # multi-line quoted field
        "u9",                                                   # single field
    ]
    lines += [
        _line(_fields("x1") + ["", "a", "b"]),                  # 16 fields, the 14th empty
        _wrap(_line(_fields("x2") + ["", "c"])),                # wrapped, 15 fields, the 14th empty
        _line(_fields("x3")[:4] + ["2 500 zl"] + _fields("x3")[5:]),      # unreadable price
        _wrap(_line(_fields("x4")[:10] + ["wczoraj"] + _fields("x4")[11:])),  # wrapped, unreadable date
        _line(_fields("x5", desc='"one, ""two"", three"')),     # quoted commas are no fields
    ]
    raw = files.read_raw_listings(spark, _write(tmp_path, lines))
    rep = files.repair(raw)
    good = {r[S.URL]: r for r in files.accepted(rep).collect()}
    bad = {r[S.URL]: r for r in files.quarantine(rep).collect()}
    assert {u: (r[S.N_FIELDS], r[S.REASON]) for u, r in bad.items()} == {
        "u5": (14, files.TOO_LONG), "u6": (14, files.TOO_LONG), "x1": (16, files.TOO_LONG), "x2": (15, files.TOO_LONG),
        "x3": (13, "unreadable price"), "x4": (13, "unreadable added_at")}
    assert bad["x1"][S.RECORD] == lines[9] and bad["x2"][S.RECORD] == lines[10]  # whole, nothing lost
    assert sorted(good) == ["u1", "u2", "u3", "u4", "u7", "u8", "u9", "x5"]
    assert good["x5"][S.DESCRIPTION] == 'one, "two", three'
    assert good["u2"][S.NAME] == "iphone 11 pro" and good["u2"][S.PRICE] == 2500.0
    assert good["u3"][S.DESCRIPTION] == "big, shiny"
    assert good["u4"][S.PRICE] == 2500.0 and good["u4"][S.BRAND] is None
    assert good["u8"][S.DESCRIPTION] == "two\nlines"
    assert good["u9"][S.NAME] is None
    assert str(good["u1"][S.ADDED_AT]) == "2021-01-01 09:30:00"
    audit = {r["stage"]: r["n_rows"] for r in files.repair_audit(raw).collect()}
    assert audit == {"raw": 14, "wrapped": 6, "quarantined": 6, "accepted": 8}
    plan = files.repair_audit(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and plan.count("from_csv") == 1


def test_a_reordered_header_raises(spark, tmp_path):
    p = tmp_path / "raw.csv"
    names = [S.LISTING_COLUMNS[1], S.LISTING_COLUMNS[0], *S.LISTING_COLUMNS[2:]]
    p.write_text(",".join(names) + "\n" + _line(_fields("a")) + "\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_raw_listings(spark, str(p)).collect()


def test_raw_preview_is_the_text_as_it_stands(spark, tmp_path):
    lines = [_wrap(_line(_fields("b"))), _line(_fields("a")), "c"]
    shown = [r["line"] for r in files.raw_preview(spark, _write(tmp_path, lines), 2).collect()]
    assert shown == [lines[0], lines[1]]


def test_csv_sink_round_trip(spark, tmp_path):
    lines = [_line(_fields("a", desc='say "hi", ok')), _line(_fields("b"))]
    df = files.accepted(files.repair(files.read_raw_listings(spark, _write(tmp_path, lines))))
    out = str(tmp_path / "std")
    files.write_listings_csv(df, out)
    back = files.accepted(files.repair(files.read_raw_listings(spark, out)))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_published_predictions_table(spark, tmp_path):
    prompts = ["iphone 11 64gb", "iphone 11 pro"]
    published = tmp_path / "published.csv"
    published.write_text(",iphone 11 64gb,iphone 11 pro\n0,2000.5,3000.0\n1,1999.0,\n", encoding="utf-8")
    rows = files.read_predictions_csv(spark, str(published), prompts).orderBy("day").collect()
    assert [tuple(r) for r in rows] == [(1, 2000.5, 3000.0), (2, 1999.0, None)]
    assert files.read_predictions_csv(spark, str(published)).columns == ["day", *prompts]
    with pytest.raises(ValueError, match="prompts"):
        files.read_predictions_csv(spark, str(published), prompts[::-1])
    long = spark.createDataFrame([("a b", 1, 2.5), ("a b", 2, 2.0), ("c", 1, 7.0), ("c", 2, 8.0)], "prompt string, day int, price double")
    files.write_predictions_csv(long, str(tmp_path / "own"), ["a b", "c"])
    back = files.read_predictions_csv(spark, str(tmp_path / "own"), ["a b", "c"]).orderBy("day").collect()
    assert [tuple(r) for r in back] == [(1, 2.5, 7.0), (2, 2.0, 8.0)]
