"""Problem 4: lines repeated across one source's texts.

Nodes are line wordings of a source, weighted by the number of rows they stand in; edges join wordings on consecutive
lines, weighted likewise. High-support nodes and edges are kept, their connected components are the boilerplate blocks,
and every line that matches a node of a block is removed.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.lineage import materialize

# Names of months, which stand in dates.
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sept sep oct nov dec"


@dataclass(frozen=True)
class BoilerplateConfig:
    min_rows: int = 8  # a repeated line stands in at least so many rows of its source
    min_share: float = 0.1  # and in at least this share of them
    broadcast_letters: int = 8_000_000  # candidate wordings are broadcast up to so many letters in all
    seed_share: float = 0.5  # the undamaged wording alone has at least this share of the support of all its misread forms


def wordings(text: Column) -> Column:
    """The wording of every line: letters only, lower case, months removed. One pass over the whole text."""
    months = "|".join(sorted(MONTHS.split(), key=len, reverse=True))
    other = r"[^a-z\n\p{L}]"  # neither letter nor line end; the plain range stands first because it is decided by a bit test
    return F.split(F.regexp_replace(F.lower(text), rf"(?m)(?:{other}++|^)(?:(?:{months})(?!\p{{L}}){other}*+)*+", ""), "\n")


def tolerance(n: Column) -> Column:
    """Edits that one misread word may make in a wording of n letters."""
    return F.when(n >= 20, 3).when(n >= 10, 2).when(n >= 6, 1).otherwise(0)


def same_wording(a: Column, b: Column) -> Column:
    """a is b, or b with one misread word. A single damaged word leaves the beginning or the end of the line intact."""
    end = F.when(F.length(b) >= 12, 4).otherwise(2)
    near = F.abs(F.length(a) - F.length(b)) <= 3
    intact = (F.substring(a, F.lit(1), end) == F.substring(b, F.lit(1), end)) | (F.right(a, end) == F.right(b, end))
    d = F.levenshtein(a, b, 3)
    return near & intact & (d >= 0) & (d <= tolerance(F.least(F.length(a), F.length(b))))


def candidate_nodes(lines: DataFrame, sizes: DataFrame, cfg: BoilerplateConfig) -> DataFrame:
    """(source, nodes): per source its frequent wordings, most frequent first, without misread forms of a more frequent one.

    A wording needs seed_share of the wanted share of rows, so a source has at most 1 / (seed_share * min_share) times the
    mean number of lines of a text: the array is bounded whatever the size of the source.
    """
    counts = lines.select("source", F.explode(F.array_distinct("keys")).alias("key")).where("key <> ''").groupBy("source", "key").agg(F.count("*").alias("c"))
    least = F.greatest(F.lit(cfg.min_rows * cfg.seed_share), F.col("n") * cfg.min_share * cfg.seed_share)
    frequent = counts.where(F.col("c") >= cfg.min_rows * cfg.seed_share).join(sizes, "source").where(F.col("c") >= least)
    ranked = frequent.groupBy("source", "n").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "key"))).getField("key").alias("all"))
    # a wording gives way only to one that itself stays
    first = F.aggregate("all", F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda y: same_wording(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    return ranked.select("source", "n", first.alias("nodes"))


def matches(df: DataFrame, key: str, source: str, text: str, cfg: BoilerplateConfig) -> DataFrame:
    """(key, source, n, found): per row the array of (line_no, node) of its lines that match a candidate node."""
    lines = df.select(F.col(key).alias("id"), F.col(source).alias("source"), wordings(F.col(text)).alias("keys")).where(F.col("source").isNotNull())
    sizes = df.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    nodes = materialize(candidate_nodes(lines, sizes, cfg))
    letters = nodes.agg(F.sum(F.length("source") + F.aggregate("nodes", F.lit(0), lambda a, x: a + F.length(x)))).first()[0] or 0
    if letters <= cfg.broadcast_letters:  # else a shuffle join by source, whose hot partitions adaptive execution splits
        nodes = F.broadcast(nodes)
    joined = lines.where(F.col("keys").isNotNull()).join(nodes, "source")
    node = lambda k: F.when(F.array_contains("nodes", k), k).otherwise(F.get(F.filter("nodes", lambda t: same_wording(k, t)), F.lit(0)))
    found = F.filter(F.transform("keys", lambda k, i: F.struct((i + 1).alias("line_no"), F.when(k != "", node(k)).alias("node"))), lambda x: x.node.isNotNull())
    return materialize(joined.select("id", "source", "n", found.alias("found")).where(F.size("found") > 0))


def _label(group: pd.DataFrame) -> pd.DataFrame:
    """Connected components of one source's kept nodes (a bounded number, see candidate_nodes)."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(group["node"], group["next"]):
        ra = root(a)
        if b is not None and not pd.isna(b):
            rb = root(b)
            parent[max(ra, rb)] = min(ra, rb)
    out = [(group["source"].iloc[0], x, root(x)) for x in sorted(parent)]
    return pd.DataFrame(out, columns=["source", "node", "block"])


def blocks(found: DataFrame, cfg: BoilerplateConfig) -> DataFrame:
    """(source, node, support, block): the high-support nodes, each with its block, named by the block's first node."""
    wanted = F.greatest(F.lit(cfg.min_rows), F.col("n") * cfg.min_share)
    nodes = found.select("source", "n", F.explode(F.array_distinct(F.transform("found", lambda x: x.node))).alias("node")).groupBy("source", "n", "node").agg(F.count("*").alias("support")).where(F.col("support") >= wanted)
    steps = F.array_distinct(F.filter(F.transform("found", lambda x, i: F.struct(x.node.alias("node"), F.get("found", i + 1).node.alias("next"), (F.get("found", i + 1).line_no == x.line_no + 1).alias("ok"))), lambda e: e.ok))
    edges = found.select("source", "n", F.explode(steps).alias("e")).groupBy("source", "n", F.col("e.node").alias("node"), F.col("e.next").alias("next")).agg(F.count("*").alias("w")).where(F.col("w") >= wanted)
    kept = nodes.select("source", "node")
    inside = edges.join(kept, ["source", "node"], "left_semi").join(kept.withColumnRenamed("node", "next"), ["source", "next"], "left_semi").select("source", "node", "next")
    graph = kept.withColumn("next", F.lit(None).cast("string")).unionByName(inside)
    labelled = graph.groupBy("source").applyInPandas(_label, "source string, node string, block string")
    return nodes.select("source", "node", "support").join(labelled, ["source", "node"])


def repeated_lines(df: DataFrame, key: str = "chunk_id", source: str = "source", text: str = "content", cfg: BoilerplateConfig = BoilerplateConfig()) -> DataFrame:
    """(key, line_no, source, block): every line that its source repeats; line numbers count from 1.

    Rows with a null source or text have no such line; blank lines never count. Copies are rows of their own, each in
    the support. A source of fewer than min_rows rows repeats nothing.
    """
    found = matches(df, key, source, text, cfg)
    occurrences = found.select("id", "source", F.explode("found").alias("f")).select("id", "source", "f.line_no", "f.node")
    return occurrences.join(blocks(found, cfg).select("source", "node", "block"), ["source", "node"]).select(F.col("id").alias(key), "line_no", "source", "block")


def remove_repeated(df: DataFrame, key: str = "chunk_id", source: str = "source", text: str = "content", cfg: BoilerplateConfig = BoilerplateConfig()) -> DataFrame:
    """df with the repeated lines taken out of its text, and n_removed. The key must be unique; null texts stay null."""
    lines = repeated_lines(df, key, source, text, cfg).groupBy(key).agg(F.collect_set("line_no").alias("_drop"))
    columns = [c for c in df.columns if c not in ("_drop", "n_removed")]
    kept = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains("_drop", i + 1))
    return df.select(*columns).join(lines, key, "left").select(
        *[F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(f"`{c}`") for c in columns],
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).alias("n_removed"),
    )
