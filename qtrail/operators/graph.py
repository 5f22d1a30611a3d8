"""Query graph as vertex and edge DataFrames.

The reference collects the pair table to the driver and runs a recursive DFS
and networkx.  Here:

* legend (G1): distinct endpoints numbered ``Q1..Qn`` in text order by a
  distributed dense index;
* chains (G3/G4): breadth-first expansion, one join per level between the
  frontier and the edge table, pruned by the minimum confidence at every
  level, each frontier written to the shared checkpoint folder;
* components (G6): every task contracts the edges it reads to a star forest
  before they are shuffled, then large-star / small-star rounds (Kiveris et al.,
  2014), each round written to the shared checkpoint folder, O(log n) rounds,
  stopping as soon as the edges form a star forest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import drop_stored, materialize, stored
from .ordering import dense_index

CHUNK = 1 << 20  # edges that a task contracts at a time


def legend(confidence: DataFrame, start: str = "normalized_query", end: str = "next_query") -> DataFrame:
    """Distinct start and end queries, ids ``Q1..Qn`` by ascending text.

    Columns ``query, id, ordinal``."""
    queries = (confidence.select(F.col(start).alias("query"))
               .union(confidence.select(F.col(end).alias("query"))).distinct())
    numbered = dense_index(queries, ["query"], name="ordinal", start=1)
    return numbered.select("query", F.concat(F.lit("Q"), F.col("ordinal").cast("string")).alias("id"), "ordinal")


def vertices(legend_df: DataFrame) -> DataFrame:
    """Legend with the statement kind of each query (P14: read / insert / write)."""
    return legend_df.withColumn("kind", T.statement_kind("query"))


def edges(confidence: DataFrame, legend_df: DataFrame, start: str = "normalized_query",
          end: str = "next_query") -> DataFrame:
    """The confidence table with endpoints mapped to legend ids.

    Columns ``start_id, end_id, start_ordinal, end_ordinal, confidence, count, total_count``."""
    s = legend_df.select(F.col("query").alias("_s"), F.col("id").alias("start_id"),
                         F.col("ordinal").alias("start_ordinal"))
    e = legend_df.select(F.col("query").alias("_e"), F.col("id").alias("end_id"),
                         F.col("ordinal").alias("end_ordinal"))
    return (confidence.join(s, F.col(start) == F.col("_s")).join(e, F.col(end) == F.col("_e"))
            .select("start_id", "end_id", "start_ordinal", "end_ordinal",
                    F.col("confidence").cast("double").alias("confidence"),
                    F.col("count").cast("bigint").alias("count"),
                    F.col("total_count").cast("bigint").alias("total_count")))


def chains(edge_df: DataFrame, min_confidence: float = 0.01, max_length: int = 5,
           allow_revisit: bool = False, sort: bool = False, materialized: bool = False) -> DataFrame:
    """G3 ``build_query_chains`` (``allow_revisit=False``) and G4 (``True``).

    Every path of 1..``max_length`` edges starting at a node with out-edges whose
    left-to-right confidence product is ``>= min_confidence`` (inclusive, F15);
    extension stops at paths below the minimum.  Without revisits a node never
    repeats in a path (self-loops are skipped).  Columns
    ``path ARRAY<STRING>, length INT, confidence DOUBLE``.  ``materialized=True``
    says the edge table is already a written table; its size is known either way,
    so Catalyst chooses the join.  The levels are written while this is built."""
    if max_length < 1:
        raise ValueError("max_length counts edges and must be >= 1")
    step_df = edge_df.select("start_id", "end_id", "confidence")
    step_df = step_df if materialized else materialize(step_df, "chain-edges")
    step = step_df.select(F.col("start_id").alias("_from"), F.col("end_id").alias("_to"),
                          F.col("confidence").alias("_c"))
    first = step.filter(F.col("_c") >= min_confidence)
    if not allow_revisit:
        first = first.filter(F.col("_from") != F.col("_to"))
    frontier = materialize(first.select(F.array("_from", "_to").alias("path"),
                                        (F.lit(1.0) * F.col("_c")).alias("confidence")), "chains")
    levels = [frontier]
    for _ in range(1, max_length):
        grown = (frontier.join(step, F.element_at("path", -1) == F.col("_from"))
                 .select("path", "_to", (F.col("confidence") * F.col("_c")).alias("confidence")))
        if not allow_revisit:
            grown = grown.filter(~F.array_contains("path", F.col("_to")))
        frontier = materialize(grown.filter(F.col("confidence") >= min_confidence)
                               .select(F.concat("path", F.array("_to")).alias("path"), "confidence"), "chains")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for lvl in levels[1:]:
        out = out.unionByName(lvl)
    out = out.select("path", (F.size("path") - 1).alias("length"), "confidence")
    return out.orderBy(F.desc("confidence"), "path") if sort else out


def chain_graph(edge_df: DataFrame, min_confidence: float = 0.01, allow_revisit: bool = False) -> DataFrame:
    """The edges used by the kept chains, with a two-decimal label.

    No confidence exceeds 1, so an edge lies on a kept chain exactly if it is one:
    its own confidence reaches the minimum and, without revisits, it is no
    self-loop.  Columns
    ``start_id, end_id, start_ordinal, end_ordinal, confidence, count, total_count, label``."""
    kept = edge_df.filter(F.col("confidence") >= min_confidence)
    if not allow_revisit:
        kept = kept.filter(F.col("start_id") != F.col("end_id"))
    return kept.withColumn("label", T.confidence_label("confidence"))


def connected_components(edge_df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected connected components of a graph with BIGINT vertex ids.

    Returns ``(vertex, component)`` where ``component`` is the smallest vertex
    id of the component; every endpoint (also of self-loops) is a vertex.
    Tasks first contract the edges they read, ``CHUNK`` at a time (``_contraction``), so
    round one shuffles at most one edge for each vertex of a chunk.  Large-star / small-star rounds run while this is built.  Each vertex's
    minimum is written before it is joined to the edges: both join sides are
    then plain scans, so the skew rule can split the edges of a hub; a round's
    tables are deleted as soon as the next round stands."""
    spark = edge_df.sparkSession
    e = (edge_df.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v"))
         .filter(F.col("u").isNotNull() & F.col("v").isNotNull()))
    # canonical undirected edges stored as (hi, lo), hi >= lo; self-loops only name a vertex
    start, _ = stored(e.mapInArrow(_contraction(CHUNK), "hi bigint, lo bigint").distinct(), "component-edges")
    cur, path = start.filter(F.col("hi") != F.col("lo")), None
    while not _is_star_forest(cur):
        large, scratch = _to_minimum(_large_star_sides(cur))
        cur, more = _to_minimum(_small_star_sides(large))
        done, scratch = scratch + more[:-1], more[-1]
        drop_stored(spark, *done, *([path] if path else []))
        path = scratch
    itself = start.select(F.explode(F.array("hi", "lo")).alias("vertex")).withColumn("root", F.col("vertex"))
    return (itself.unionByName(cur.select(F.col("hi").alias("vertex"), F.col("lo").alias("root")))
            .groupBy("vertex").agg(F.min("root").alias("component")))


def _contraction(chunk: int):
    """A function of a task's edges (u, v): for each ``chunk`` of them a star forest with
    the same components, edges (hi, lo) from every vertex to the smallest of its component;
    a vertex alone (self-loops only) points to itself.

    Made inside a function so that it reaches the workers by value: they need not have
    this package."""
    import numpy as np
    import pyarrow as pa

    def star(edges):
        vertices, at = np.unique(np.concatenate([np.concatenate(side) for side in zip(*edges)]), return_inverse=True)
        a, b = at[:len(at) // 2], at[len(at) // 2:]
        label = np.arange(len(vertices))
        while len(a):
            x, y = label[a], label[b]
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)  # hook the larger root of an edge to the smaller
            np.minimum.at(label, y, low)
            while not np.array_equal(label[label], label):
                label = label[label]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        told = (label != np.arange(len(label))) | (np.bincount(label, minlength=len(label)) == 1)
        return pa.RecordBatch.from_arrays([pa.array(vertices[told]), pa.array(vertices[label[told]])], names=["hi", "lo"])

    def contract(batches):
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            rows += batch.num_rows
            if rows >= chunk:
                yield star(held)
                held, rows = [], 0
        if rows:
            yield star(held)

    return contract


def _is_star_forest(edges_hl: DataFrame) -> bool:
    """True when every vertex points to exactly one smaller vertex and no
    target points anywhere: each component is then a star around its minimum
    (edges keep connectivity), which is where large/small-star rounds end."""
    sides = edges_hl.select(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges_hl.select(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return (sides.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty())


def _large_star_sides(edges_hl: DataFrame):
    """(minima of closed neighbourhoods, larger neighbours to be joined to them, no extra rows)."""
    both = (edges_hl.select(F.col("hi").alias("x"), F.col("lo").alias("y"))
            .union(edges_hl.select(F.col("lo").alias("x"), F.col("hi").alias("y"))))
    return both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), both.filter(F.col("y") > F.col("x")), False


def _small_star_sides(edges_hl: DataFrame):
    """(minima of smaller neighbours, the smaller neighbours, and every centre itself)."""
    both = edges_hl.select(F.col("hi").alias("x"), F.col("lo").alias("y"))
    return both.groupBy("x").agg(F.min("y").alias("m")), both, True


def _to_minimum(sides):
    """Join every ``y`` to the minimum of its ``x``; the edges and the paths written, theirs last."""
    minima, spokes, centres = sides
    minima, minima_path = stored(minima, "component-minima")
    out = spokes.join(minima, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo"))
    out = out.filter(F.col("hi") != F.col("lo"))
    if centres:
        out = out.union(minima.select(F.col("x").alias("hi"), F.col("m").alias("lo"))).distinct()
    edges, path = stored(out, "component-edges")
    return edges, [minima_path, path]


def query_components(graph_edges: DataFrame, legend_df: DataFrame) -> DataFrame:
    """G6 ``get_connected_components``: components of the chain graph (undirected),
    numbered from 1 by their smallest legend ordinal; members as query text.

    Columns ``component_id, query``."""
    comp = connected_components(graph_edges, "start_ordinal", "end_ordinal")
    roots = comp.select("component").distinct()
    numbered = dense_index(roots, ["component"], name="component_id", start=1)
    return (comp.join(numbered, "component")
            .join(legend_df.select(F.col("ordinal").alias("vertex"), "query"), "vertex")
            .select("component_id", "query"))
