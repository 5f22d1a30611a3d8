"""Result sinks (K1-K5): distributed CSV / JSON / log writers.

Everything is written by the executors in parallel; nothing is collected to
the driver.  Nested per-key lists (traces, component members) are written in
bounded chunks so no single row or task has to hold a hot key's whole list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from ..sources.auditlog import DEFAULT_CODEPAGE, encode_codepage


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """K1 / K2: CSV folder with header; quotes escaped by doubling so SQL text
    with commas, quotes and backslashes round-trips.  ``single_file`` uses
    ``coalesce(1)`` and is meant for small catalogues only."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", True).option("escape", '"')
     .csv(path))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: JSON Lines folder (one object per row, non-ASCII kept as UTF-8)."""
    df.write.mode(mode).json(path)


def write_json_arrays(df: DataFrame, path: str, order, rows_per_file: int = 100_000, mode: str = "overwrite") -> None:
    """K3 in the reference's layout: pretty-printed JSON arrays, rows in ``order`` (total), at most
    ``rows_per_file`` in a file; each file is a valid array of its own, in the folder ``part=k``."""
    placed = dense_index(df, order, name="_i")
    n = placed.count()
    at, last = F.col("_i") % rows_per_file, F.lit(n - 1)
    value = F.concat(F.when(at == 0, "[\n").otherwise(""), F.to_json(F.struct(*df.columns), {"pretty": "true"}),
                     F.when((at == rows_per_file - 1) | (F.col("_i") == last), "\n]").otherwise(","))
    (placed.select("_i", F.floor(F.col("_i") / rows_per_file).alias("part"), value.alias("value"))
     .repartition("part").sortWithinPartitions("part", "_i").select("part", "value").write.mode(mode).partitionBy("part").text(path))


def write_log(raw: DataFrame, path: str, by: str, codepage: str | None = DEFAULT_CODEPAGE, mode: str = "overwrite") -> None:
    """Log lines (seq, value) as text files in ``codepage``: a folder ``<by>=…`` for each value of the
    column ``by`` (monotone in ``seq``, such as the day), so that paths sort as the lines do."""
    # sorted by ``by`` first, so that the writer of partitioned folders sorts nothing again
    (raw.repartitionByRange("seq").sortWithinPartitions(by, "seq")
     .select(by, encode_codepage(F.col("value"), codepage).alias("value")).write.mode(mode).partitionBy(by).text(path))


def write_legend(legend_df: DataFrame, path: str) -> None:
    """K4: legend CSV with the reference's header ``Query,ID``."""
    write_csv(legend_df.select(F.col("query").alias("Query"), F.col("id").alias("ID")), path)


def component_members(components: DataFrame, chunk_size: int = 10_000) -> DataFrame:
    """K5 shape: ``(component_id, chunk, queries ARRAY<STRING>)`` with members
    sorted by text, at most ``chunk_size`` per row."""
    idx = dense_index(components.select("component_id", "query"), ["component_id", "query"], name="_i")
    first = idx.groupBy("component_id").agg(F.min("_i").alias("_first"))
    ranked = idx.join(first, "component_id").withColumn(
        "chunk", F.floor((F.col("_i") - F.col("_first")) / chunk_size).cast("bigint"))
    return (ranked.groupBy("component_id", "chunk")
            .agg(F.sort_array(F.collect_list("query")).alias("queries")))


def write_components(components: DataFrame, path: str, chunk_size: int = 10_000) -> None:
    """K5: components as JSON Lines ``{component_id, chunk, queries}``."""
    write_json(component_members(components, chunk_size), path)
