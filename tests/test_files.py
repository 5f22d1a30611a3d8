"""Files read by several tasks: logs in a code page, JSON arrays cut at any byte, sorted outputs."""
import json
import random

import pytest
from pyspark.sql import functions as F

from qtrail.sinks import files as K
from qtrail.sources import auditlog as A
from qtrail.sources import tables as TB


def _records(spark, path, split):
    rows = TB.array_records(spark, str(path), split).collect()
    return [json.loads(r.text) for r in sorted(rows, key=lambda r: (r.file, r.record))], sorted((r.file, r.record) for r in rows)


def _odd_objects(n):
    rng = random.Random(n)
    parts = ['{', '}', '[', ']', '"', '\\', '\\"', '},{', '\n', 'ΑΒΓ', '😀', ',', ':', ' ', 'x', '\\\\', '}"']
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
    return [{"k" + text(): text(), "n": [text(), {"d": [{}, {"e": text()}], "}": [[]]}, i], "i": i} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 1, 4])
@pytest.mark.parametrize("split", [None, 64, 1000])
def test_array_objects_at_any_cut(spark, tmp_path, indent, split):
    """Brackets, quotes and escapes inside strings and keys, nested objects, on one line or many."""
    objects = _odd_objects(40)
    (tmp_path / "a.json").write_text(json.dumps(objects, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    found, places = _records(spark, tmp_path / "a.json", split)
    assert found == objects and [r for _, r in places] == list(range(40))


def test_array_files_and_empty_arrays(spark, tmp_path):
    objects = _odd_objects(9)
    for name, part in (("a", objects[:4]), ("b", []), ("c", objects[4:])):
        (tmp_path / f"{name}.json").write_text(json.dumps(part, indent=2), encoding="utf-8")
    (tmp_path / "d.json").write_text("")
    found, places = _records(spark, tmp_path, 50)
    assert found == objects and [r for _, r in places] == [0, 1, 2, 3, 0, 1, 2, 3, 4]


def test_one_array_file_is_read_by_several_tasks(spark, tmp_path):
    rows = [(f"E{i:03d}", 3, 0, [(f"2024-12-10 08:00:{j:02d}", f"line }} {{ \"{j}\" [") for j in range(3)]) for i in range(200)]
    table = spark.createDataFrame(rows, "entity string, query_count bigint, chunk bigint, grouped_lines array<struct<timestamp:string,normalized_line:string>>")
    K.write_json_arrays(table, str(tmp_path / "arr"), ["entity", "chunk"], rows_per_file=150)
    files = sorted((tmp_path / "arr").glob("part=*/*.txt"))
    assert [len(json.loads(f.read_text())) for f in files] == [150, 50]
    lines = A.read_raw_lines(spark, str(files[0]), None, 4096, separator="}")
    assert lines.select("block").distinct().count() > 5
    split = TB.read_trace_json(spark, str(tmp_path / "arr"), array=True, split_bytes=4096)
    whole = spark.read.schema(TB.trace_schema()).option("multiLine", True).json(str(tmp_path / "arr"))
    text = lambda df: sorted(map(str, df.select("entity", "query_count", "chunk", F.col("grouped_lines.normalized_line")).collect()))
    assert text(split) == text(whole) and len(text(split)) == 200
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "4096"  # the caller's session is as it was


def test_log_in_a_code_page_by_splits(spark, tmp_path):
    """Three files, one larger than a split; Greek text, characters that the page lacks, odd ends of lines."""
    lines = [(i, "d1" if i < 20 else "d2" if i < 900 else "d3", f"[10/12/2024 08:00:{i % 60:02d}] {i} Ελεγκτης QUERY      : SELECT {'Ω' * (i % 50)}") for i in range(1000)]
    raw = spark.createDataFrame(lines, "seq int, day string, value string").repartition(7)
    K.write_log(raw, str(tmp_path / "log"), "day")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "log").rglob("*.txt")))
    assert data.decode("cp1253").splitlines() == [v for _, _, v in lines]
    back = A.read_audit_log(spark, str(tmp_path / "log"), split_bytes=2000)
    assert back.select("block").distinct().count() > 10
    assert [r.line for r in back.orderBy("seq").collect()] == [v.strip() for _, _, v in lines]
    assert [r.line for r in A.read_audit_log(spark, str(tmp_path / "log")).orderBy("seq").collect()] == [v.strip() for _, _, v in lines]


def test_code_page_bytes_both_ways(spark):
    for page in ("cp1253", "cp1252", "latin-1", "iso8859-7"):
        table = bytes(range(32, 256)).decode(page, errors="replace").replace("�", "")
        df = spark.createDataFrame([(table + "中é😀Ŵ",)], "v string")
        out = df.select(A.encode_codepage(F.col("v"), page).cast("binary").alias("b")).first().b
        assert bytes(out) == (table + "中é😀Ŵ").encode(page, errors="replace"), page


def test_rows_in_written_order(spark, tmp_path):
    rows = [(f'q "{i}", x', 100 - i) for i in range(50)]
    df = spark.createDataFrame(rows, "q string, n bigint").repartition(5).orderBy(F.desc("n"))
    K.write_csv(df, str(tmp_path / "csv"))
    back = TB.read_rows_in_order(spark, str(tmp_path / "csv"), "q string, n bigint", 200).orderBy("pos").collect()
    assert [tuple(r) for r in back] == [(i, *r) for i, r in enumerate(rows)]
