"""Records cut in parallel: quotes, line ends and wrapped records across the edges of splits."""

import random

import pytest

from pricelens import schema as S
from pricelens.sources import files, records
from tests.test_files import HEADER, _fields, _line, _wrap


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _random_record(draw):
    parts = []
    for _ in range(draw.randint(1, 4)):
        inner = "".join(draw.choice(["a", "bc", " ", ",", "\n", "\n\n", '""', "é"]) for _ in range(draw.choice([0, 2, 5, 90])))
        parts.append(f'"{inner}"' if draw.random() < 0.6 else "x" * draw.randint(0, 30))
    return ",".join(parts)


def _plain(text):
    """Records of a text, by one pass over its characters."""
    out, own, inside = [], "", False
    for c in text:
        if c == "\n" and not inside:
            out.append(own)
            own = ""
        else:
            inside ^= c == '"'
            own += c
    return [r.removesuffix("\r") for r in [*out, own] if r.strip(" \r")]


@pytest.mark.parametrize("seed", range(4))
def test_cut_like_one_pass(spark, tmp_path, tiny_splits, seed):
    draw, wanted = random.Random(seed), []
    for i in range(3):
        end = draw.choice(["\n", "\r\n"])
        text = end.join(_random_record(draw) for _ in range(40)) + draw.choice(["", end])
        (tmp_path / f"f{i}.csv").write_text(text, encoding="utf-8", newline="")
        wanted += _plain(text)
    lines = records.read_lines(spark, str(tmp_path))
    assert lines.select("file", "split_at").distinct().count() > 30
    got = records.records(lines)
    assert got.rdd.getNumPartitions() > 8  # one file is many tasks' work
    rows = got.collect()
    assert sorted(r["record"] for r in rows) == sorted(wanted)
    assert not any(r["unclosed"] for r in rows)


def test_without_edges_inside_quotes_the_lines_are_read_twice_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n"a\nb"\nc\n', encoding="utf-8")
    got = records.records(records.read_lines(spark, str(tmp_path)))
    assert "Union" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["record"], r["first"]) for r in got.collect()] == [("h", True), ('"a\nb"', False), ("c", False)]


def test_unclosed_quotes_are_told(spark, tmp_path, tiny_splits, monkeypatch):
    (tmp_path / "a.csv").write_text("h\nok\n" + 'bad"' + "\nline" * 200 + "\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("h\nfine\n", encoding="utf-8")
    rows = records.records(records.read_lines(spark, str(tmp_path))).collect()
    assert sorted(r["record"][:4] for r in rows if not r["unclosed"]) == ["fine", "h", "h", "ok"]
    whole = [r["record"] for r in rows if r["unclosed"]]
    assert whole == ['bad"' + "\nline" * 200]
    monkeypatch.setattr(records, "MAX_SPLITS", 3)
    apart = [r["record"] for r in records.records(records.read_lines(spark, str(tmp_path))).collect() if r["unclosed"]]
    assert len(apart) > 3 and sorted("\n".join(apart).split("\n")) == sorted(whole[0].split("\n"))


def test_repair_of_one_file_in_many_splits(spark, tmp_path, tiny_splits):
    lines = []
    for i in range(60):
        own = _fields(f"u{i}", desc='"two\nlines, ""quoted"""' if i % 3 else "plain")
        lines.append(_wrap(_line(own)) if i % 4 == 0 else _line(own + (["x"] if i % 10 == 7 else [])))
    (tmp_path / "raw.csv").write_text(HEADER + "\n" + "\n".join(lines) + '\nlast,"open\n', encoding="utf-8")
    raw = files.read_raw_listings(spark, str(tmp_path))
    assert raw.rdd.getNumPartitions() > 8
    told = files.repair(raw)
    good = {r[S.URL]: r[S.DESCRIPTION] for r in files.accepted(told).collect()}
    assert good == {f"u{i}": 'two\nlines, "quoted"' if i % 3 else "plain" for i in range(60) if i % 4 == 0 or i % 10 != 7}
    bad = {r[S.URL]: r[S.REASON] for r in files.quarantine(told).collect()}
    assert {k: v for k, v in bad.items() if k != "last"} == {f"u{i}": files.TOO_LONG for i in range(60) if i % 10 == 7 and i % 4}
    assert bad["last"] == files.UNCLOSED


def test_no_files_rows_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("", encoding="utf-8")
    (tmp_path / "b.csv").write_text(HEADER + "\n\n  \n", encoding="utf-8")
    assert files.read_raw_listings(spark, str(tmp_path)).count() == 0
