"""Distributed scan of a windows-1253 log; bytes decoded by Python's own codec."""
import datetime as dt

from qtrail.sources import auditlog as A


def _write(tmp_path, name, chunks):
    p = tmp_path / name
    p.write_bytes(b"".join(chunks))
    return str(p)


def test_scan_cp1253(spark, tmp_path):
    greek = "[10/12/2024 08:00:00] 7 Ελεγκτης QUERY      : SELECT A FROM T WHERE P='ΑΒΓ1234'".encode("cp1253")
    high = b"[10/12/2024 08:00:01] 8 x " + bytes(range(0x80, 0x100)) + b" tail"
    path = _write(tmp_path, "a.log", [
        greek, b"\r\n",
        b"continuation of the statement\n",
        high, b"\n",
        b"[31/02/2024 00:00:00] 9 x bad date\n",
        b"\n",
        b"[1/2/2024 8:0:0] 10 x unpadded \xa0\r",
        b"[10/12/2024 08:00:02] 11 x last line without newline",
    ])
    got = A.read_audit_log(spark, path).orderBy("seq").select("ts", "line").collect()
    day = dt.datetime(2024, 12, 10, 8)
    assert [tuple(r) for r in got] == [
        (day, "[10/12/2024 08:00:00] 7 Ελεγκτης QUERY      : SELECT A FROM T WHERE P='ΑΒΓ1234'"),
        (day.replace(second=1), "[10/12/2024 08:00:01] 8 x " + bytes(range(0x80, 0x100)).decode("cp1253", "replace") + " tail"),
        (dt.datetime(2024, 2, 1, 8), "[1/2/2024 8:0:0] 10 x unpadded"),
        (day.replace(second=2), "[10/12/2024 08:00:02] 11 x last line without newline"),
    ]


def test_scan_multi_file_order(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    sizes = {"20241210.log": 3, "20241211.log": 50, "20241212.log": 10}
    expected = []
    for name, n in sizes.items():
        lines = [f"[10/12/2024 08:00:{i % 60:02d}] {name[:8]} x QUERY      : SELECT {i}" for i in range(n)]
        (d / name).write_text("\n".join(lines) + "\n", encoding="cp1253")
        expected += lines
    got = [r.line for r in A.read_audit_log(spark, str(d)).orderBy("seq").collect()]
    assert got == expected


def test_statement_lines(spark, tmp_path):
    path = _write(tmp_path, "s.log", [
        "[10/12/2024 08:00:00] 7 Ελεγκτης QUERY      : SELECT A FROM T WHERE X='q' AND Y=3\n".encode("cp1253"),
        "[10/12/2024 08:00:01] 7 Άλλος QUERY      : SELECT B FROM T\n".encode("cp1253"),
        "[10/12/2024 08:00:02] 7 Ελεγκτης TRANSACTION: UPDATE T SET A=1\n".encode("cp1253"),
        "no bracket Ελεγκτης QUERY\n".encode("cp1253"),
    ])
    got = [r.line for r in A.read_statement_lines(spark, path).orderBy("seq").collect()]
    assert got == ["       SELECT A FROM T WHERE X=? AND Y=3", "UPDATE  T SET A=1"]


def test_codepage_table_is_total():
    src, dst = A.codepage_table("cp1253")
    assert len(src) == len(dst) > 100
    assert dst[src.index("\xc1")] == "Α"
