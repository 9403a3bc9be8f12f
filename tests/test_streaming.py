"""Streaming landing: restart from the checkpoint picks up only new files, exactly once."""

from pricelens import schema as S
from pricelens.streaming import landing
from tests.test_files import HEADER, _fields, _line, _wrap


def _export(path, lines):
    path.write_text(HEADER + "\n" + "\n".join(lines) + "\n", encoding="utf-8")


def test_incremental_landing_exactly_once(spark, tmp_path):
    raw, out, ckpt = tmp_path / "raw", tmp_path / "out", tmp_path / "ckpt"
    raw.mkdir()
    _export(raw / "day1.csv", [_line(_fields("a")), _wrap(_line(_fields("b"))), _line(_fields("c") + ["x"])])
    landing.land(spark, str(raw), str(out), str(ckpt))
    first = sorted(r[S.URL] for r in landing.read_landed(spark, str(out)).collect())
    assert first == ["a", "b"]

    _export(raw / "day2.csv", [_line(_fields("d")), _wrap(_line(_fields("e") + ["y"]))])
    landing.land(spark, str(raw), str(out), str(ckpt))  # restart: same checkpoint
    accepted = sorted(r[S.URL] for r in landing.read_landed(spark, str(out)).collect())
    bad = sorted(r[S.URL] for r in landing.read_landed(spark, str(out), landing.QUARANTINE).collect())
    assert accepted == ["a", "b", "d"]
    assert bad == ["c", "e"]
