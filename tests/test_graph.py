"""Chains vs a brute-force path enumeration; components vs union-find."""
import itertools
import random

from pyspark.sql import functions as F

from qtrail.operators import graph as G

EDGES = [("a", "b", 0.9), ("b", "c", 0.5), ("c", "a", 0.8), ("a", "a", 0.7), ("b", "d", 0.3), ("d", "b", 1.0),
         ("c", "e", 0.125)]


def _conf(spark, edges=EDGES):
    return spark.createDataFrame([(s, e, 10, 20, c) for s, e, c in edges],
                                 "normalized_query string, next_query string, count bigint, total_count bigint, "
                                 "confidence double")


def _brute_paths(edges, ids, min_c, max_len, revisit):
    out = set()
    adj = {}
    for s, e, c in edges:
        adj.setdefault(ids[s], []).append((ids[e], c))

    def walk(path, conf):
        if len(path) - 1 >= max_len:
            return
        for nxt, c in adj.get(path[-1], []):
            if not revisit and nxt in path:
                continue
            nc = conf * c
            if nc >= min_c:
                out.add((tuple(path + [nxt]), nc))
                walk(path + [nxt], nc)

    for start in adj:
        walk([start], 1.0)
    return out


def test_legend_and_edges(spark):
    leg = {r.query: r.id for r in G.legend(_conf(spark)).collect()}
    assert leg == {"a": "Q1", "b": "Q2", "c": "Q3", "d": "Q4", "e": "Q5"}
    kinds = {r.query: r.kind for r in G.vertices(spark.createDataFrame(
        [("SELECT 1", "Q1", 1), ("INSERT INTO X", "Q2", 2), ("UPDATE X", "Q3", 3)], "query string, id string, ordinal long")).collect()}
    assert kinds == {"SELECT 1": "read", "INSERT INTO X": "insert", "UPDATE X": "write"}


def test_chains_match_brute_force(spark):
    conf = _conf(spark)
    leg = G.legend(conf)
    ids = {r.query: r.id for r in leg.collect()}
    e = G.edges(conf, leg)
    for revisit in (False, True):
        for min_c, max_len in ((0.01, 5), (0.4, 2), (0.8, 1)):
            got = {(tuple(r.path), r.confidence) for r in G.chains(e, min_c, max_len, revisit).collect()}
            assert got == _brute_paths(EDGES, ids, min_c, max_len, revisit), (revisit, min_c, max_len)


def test_chain_graph_is_threshold_filter(spark):
    conf = _conf(spark)
    leg = G.legend(conf)
    e = G.edges(conf, leg)
    graph = G.chain_graph(e, 0.5)
    on_chains = {pair for r in G.chains(e, 0.5, 3).collect() for pair in zip(r.path, r.path[1:])}
    assert on_chains == {(r.start_id, r.end_id) for r in graph.collect()}
    got = {(r.start_id, r.end_id, r.label) for r in graph.collect()}
    assert got == {("Q1", "Q2", "0.90"), ("Q2", "Q3", "0.50"), ("Q3", "Q1", "0.80"), ("Q4", "Q2", "1.00")}
    comps = {r.query: r.component_id for r in G.query_components(graph, leg).collect()}
    assert comps == {"a": 1, "b": 1, "c": 1, "d": 1}


def _union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {v: min(u for u in range(n) if find(u) == find(v)) for v in range(n)}


def test_contraction_is_a_star_forest_of_each_chunk():
    import pyarrow as pa
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i + 1, i) for i in range(300, 900)] + [(7000, 7000)] * 3
    rnd.shuffle(edges)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*edges[i:i + 50])], names=["u", "v"]) for i in range(0, len(edges), 50)]
    for chunk in (50, 200, 10_000):
        parts = [list(zip(*(c.to_pylist() for c in b.columns))) for b in G._contraction(chunk)(iter(batches))]
        assert len(parts) == -(-len(edges) // chunk)
        for part in parts:
            roots = {lo for hi, lo in part if hi != lo}
            assert all(hi >= lo for hi, lo in part) and len({hi for hi, _ in part}) == len(part)
            assert not roots & {hi for hi, _ in part}
        star = list(itertools.chain.from_iterable(parts))
        assert set(itertools.chain.from_iterable(star)) == set(itertools.chain.from_iterable(edges))
        n = 901
        small = lambda es: [(a, b) for a, b in es if a < n]
        assert _union_find(n, small(star)) == _union_find(n, small(edges))


def test_contraction_saves_rounds(spark, monkeypatch):
    """A path read in order by few tasks needs two tests of the forest at most; without contraction more."""
    asked = []
    test = G._is_star_forest
    monkeypatch.setattr(G, "_is_star_forest", lambda e: asked.append(1) or test(e))
    path = spark.range(0, 4000, 1, 4).selectExpr("id src", "id + 1 dst")
    got = G.connected_components(path)
    assert got.count() == 4001 and got.filter("component <> 0").isEmpty()
    with_contraction, _ = len(asked), asked.clear()
    monkeypatch.setattr(G, "CHUNK", 1)
    spread = spark.range(0, 4000, 1, 4).repartition(64, "id").selectExpr("id src", "id + 1 dst")
    assert G.connected_components(spread).filter("component <> 0").isEmpty()
    assert with_contraction < len(asked)


def test_connected_components_random(spark):
    rnd = random.Random(7)
    n = 400
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(100, 160)]           # a long path (many rounds)
    edges += [(5, 5)]                                         # self-loop only vertex
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.vertex: r.component for r in G.connected_components(df).collect()}
    present = set(itertools.chain.from_iterable(edges))
    ref = _union_find(n, edges)
    assert got == {v: ref[v] for v in present}


def test_hub_vertex(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000, 5001)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = G.connected_components(df).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert sorted((r.component, r.n) for r in got) == [(0, 3000), (5000, 2)]


def test_hubs_and_many_components(spark):
    """A low hub, a high hub, chains and many small components."""
    edges = spark.range(1, 40_000).selectExpr("0L src", "id dst").union(spark.range(100_000, 120_000).selectExpr("id src", "999999L dst"))
    edges = edges.union(spark.range(200_000, 220_000).selectExpr("id - id % 4 src", "id dst"))
    got = G.connected_components(edges).groupBy("component").agg(F.count("*").alias("n"))
    sizes = {r.component: r.n for r in got.collect()}
    assert sizes.pop(0) == 40_000 and sizes.pop(100_000) == 20_001
    assert sizes == {c: 4 for c in range(200_000, 220_000, 4)}
