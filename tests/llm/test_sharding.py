"""Operator 11: the curve against its defining properties, the cut against plain counting."""
import itertools
import zlib

import pytest
from llm_tables import docs, edge_rows, frame
from pyspark.sql import functions as F

from qtrail.llm import queries, sharding


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_and_steps_to_a_neighbour(spark, dims, bits):
    points = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), [f"c{i}" for i in range(dims)])
    cells = [F.col(f"c{i}").cast("int") for i in range(dims)]
    path = points.select("*", sharding.curve_index(cells, bits).alias("at")).orderBy("at").collect()
    assert [r["at"] for r in path] == list(range(1 << bits * dims))
    for a, b in zip(path, path[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(dims)) == 1


def _placed(rows):
    return sorted((r["shard"], r["slot"]) for r in rows)


def _lawful(rows, shards):
    counts = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert _placed(rows) == [(s, k) for s in range(shards) for k in range(counts[s])]


def test_edge_rows_and_clashing_columns(spark):
    table = frame(spark, edge_rows()).withColumns({"shard": F.lit("mine"), "curve": F.lit("mine"), "_pid2": F.lit(1)})
    done = sharding.hilbert_shards(table, shards=3)
    rows = done.collect()
    assert len(rows) == len(edge_rows()) and set(done.columns) == set(table.columns) | set(sharding.RESULT)
    _lawful(rows, 3)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in rows if r["text"] is not None) == \
        sorted((i is None, i, t) for i, t, *_ in edge_rows() if t is not None)


def test_empty_table_and_fewer_rows_than_shards(spark):
    assert sharding.hilbert_shards(frame(spark, [])).count() == 0
    _lawful(sharding.hilbert_shards(docs(spark, ["a", "b", "c"])).collect(), 8)


def test_cells_hold_equal_counts(spark):
    """The cell of a value: how many rows lie before it, half of its own counted, scaled to 16 cells."""
    values = [None] * 5 + [1] * 40 + [2] * 15 + [900] * 30 + [10 ** 9] * 10
    texts = ["https://x.example/" + "abcde"[i % 5] for i in range(100)]
    table = spark.createDataFrame(list(zip(range(100), values, texts)), "doc_id bigint, v bigint, t string")
    n, fine = sharding._fine_steps(table, ["v", "t"])
    cells = sharding._cells(table, fine, n, 4)
    found = {tuple(r) for r in table.select("v", fine[0].alias("fine")).join(cells.filter("dim = 0"), "fine").select("v", "cell").distinct().collect()}
    order = sorted(set(values), key=lambda v: (v is not None, v))
    want, before = set(), 0
    for v in order:
        want.add((v, (2 * before + values.count(v)) * 16 // 200))
        before += values.count(v)
    assert found == want
    by_text = {tuple(r) for r in table.select("t", fine[1].alias("fine")).join(cells.filter("dim = 1"), "fine").select("t", "cell").distinct().collect()}
    assert by_text == {("https://x.example/" + c, (2 * i + 1) * 20 * 16 // 200) for i, c in enumerate("abcde")}


def test_types_and_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    table = spark.sql("select id as doc_id, date_add(date'2024-01-01', cast(id % 7 as int)) as d, timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int)) as ts, "
                      "id % 2 = 0 as b, cast(id as decimal(10,2)) as m, cast(concat('k', id % 3) as binary) as y from range(60)")
    _lawful(sharding.hilbert_shards(table, ["d", "ts", "b", "m", "y"], shards=7).collect(), 7)
    odd = spark.createDataFrame([(i, v) for i, v in enumerate([inf, -inf, nan, None, 0.0, -1.5, 3.0, 1e300])], "doc_id bigint, v double")
    order = [r.v for r in sharding.hilbert_shards(odd, ["v"], shards=1).orderBy("slot").collect()]
    assert order[2:] == [-inf, -1.5, 0.0, 3.0, 1e300, inf] and {str(v) for v in order[:2]} == {"nan", "None"}


def test_repeated_rows_are_spread(spark):
    """Equal rows are parted by their place: no partition of the order holds most of them."""
    table = docs(spark, ["one"] * 50).select(F.lit(1).alias("doc_id"), "text", "lang", "source", "n_chars").repartition(10).cache()
    rows = sharding.hilbert_shards(table).collect()
    _lawful(rows, 8)
    assert len(rows) == 50


def test_shards_prune_and_query_digests(spark):
    done = queries.op11_hilbert_shards(spark, "/root/testdata/sf0.001")
    rows = done.collect()
    _lawful(rows, 8)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {(d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in table.collect()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert sorted((r.doc_id, r.shard, r.slot) for r in queries.op11_hilbert_shards(spark, "/root/testdata/sf0.001").collect()) == \
        sorted((r.doc_id, r.shard, r.slot) for r in rows)


def test_manifest_and_written_shards(spark, tmp_path):
    """A reader of one language and a length range skips shards by the manifest; in the order of ids it skips none."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = sharding.hilbert_shards(table)
    folder = str(tmp_path / "shards")
    sharding.write_shards(placed, folder)
    back = spark.read.parquet(folder)
    assert back.count() == table.count() and set(back.columns) == set(placed.columns)
    by_id = table.withColumn("shard", F.expr("cast(doc_id * 8 div 1000 as int)"))

    def touched(shards):
        rows, total = sharding.manifest(shards).collect(), 0
        for lang in ("en", "de", "es", "fr"):
            for low, high in ((0, 300), (300, 900), (900, 10 ** 6)):
                total += sum(r.min_lang <= lang <= r.max_lang and r.min_n_chars <= high and r.max_n_chars >= low for r in rows)
        return total
    assert touched(back) < 0.75 * touched(by_id)
