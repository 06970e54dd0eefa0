"""Fusion, blending and selection of ranked lists. Rank is a column; every order ends in a unique key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.config import RetrievalConfig
from quillspark.functions.encode import split_words, tokens

LISTS = {"dense": 0, "sparse": 1}
POOLED_ROWS = 1 << 24  # rows of the pools for which a chunk's text is sent to Python once; for each so many more once more


def content_key() -> Column:
    """What a chunk is the same by in fusion and selection: source, page and content, whatever id a delivery has."""
    part = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    return F.sha2(F.concat_ws("\u0001", part("source", "UnknownSource"), part("page_number", "UnknownPage"), part("content", "")), 256)


def keyed_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with doc_key; a chunk that the table lacks is only the same as itself. chunks has doc_key or what it is made of."""
    keys = chunks.select("chunk_id", "doc_key" if "doc_key" in chunks.columns else content_key().alias("doc_key"))
    return hits.join(keys, "chunk_id", "left").withColumn("doc_key", F.coalesce("doc_key", F.col("chunk_id").cast("string")))


def numbered_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """keyed_hits with the smallest id of the same key as doc_key, an eighth of a key's bytes."""
    keys = chunks.select("chunk_id", "doc_key" if "doc_key" in chunks.columns else content_key().alias("doc_key"))
    first = keys.groupBy("doc_key").agg(F.min("chunk_id").alias("first"))
    numbers = keys.join(first, "doc_key").select("chunk_id", F.col("first").alias("doc_key"))
    return hits.join(numbers, "chunk_id", "left").withColumn("doc_key", F.coalesce("doc_key", "chunk_id"))


def fuse(hits: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, doc_key, rrf, first_seen, rnk): reciprocal rank fusion of a bag of hits (query_id, chunk_id, doc_key, retriever, rnk).

    Chunks of one doc_key are one candidate, which stands under the id seen first. Ranks count from 0 in the sum; a chunk
    that stands twice in a list counts twice. Ties keep the order of first sight, dense list before sparse list.
    """
    place = (F.when(F.col("retriever") == "dense", F.lit(0)).otherwise(F.lit(1)) * 1_000_000 + F.col("rnk")).cast("bigint")
    first = F.min(F.struct(place.alias("place"), "chunk_id"))
    fused = hits.groupBy("query_id", "doc_key").agg(F.round(F.sum(1.0 / (F.col("rnk") - 1 + k)), 12).alias("rrf"), first.alias("_first"))
    named = fused.select("query_id", F.col("_first.chunk_id").alias("chunk_id"), "doc_key", "rrf", F.col("_first.place").alias("first_seen"))
    return named.withColumn("rnk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "first_seen", "chunk_id")))


def fused_only(fused: DataFrame, most: int) -> DataFrame:
    """The pool without a reranker: the first `most` candidates by their fused score, which stands as combined too."""
    return fused.where(F.col("rnk") <= most).withColumn("rerank", F.lit(None).cast("double")).withColumn("combined", F.col("rrf"))


@dataclass(frozen=True)
class TwoSided:
    """A scorer whose work on each text is done once a text, before questions and chunks meet."""

    question: Callable[[Column], Column]
    content: Callable[[Column], Column]
    pair: Callable[[Column, Column], Column]
    #: lists of texts, UTF-8, and places in them -> scores of the pairs: the same for a batch, where a text meets many
    batch: Callable[[list[bytes | None], list[bytes | None], np.ndarray, np.ndarray], np.ndarray] | None = None

    def __call__(self, question: Column, content: Column) -> Column:
        return self.pair(self.question(question), self.content(content))


def _distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def _shares(questions: list[bytes | None], contents: list[bytes | None], q: np.ndarray, c: np.ndarray) -> np.ndarray:
    asked, has = [frozenset(split_words(x or b"")) for x in questions], {}
    out, order = np.zeros(len(q)), np.argsort(c, kind="stable")
    at = -1
    for i, j, k in zip(order.tolist(), q[order].tolist(), c[order].tolist()):
        if k != at:
            at, has = k, set(split_words(contents[k] or b""))
        if asked[j]:
            out[i] = len(asked[j] & has) / len(asked[j])
    return out


#: Default reranker: share of the question's distinct tokens that the text has.
overlap_score = TwoSided(_distinct_tokens, _distinct_tokens, lambda asked, has: F.coalesce(F.try_divide(F.size(F.array_intersect(asked, has)), F.size(asked)), F.lit(0.0)), _shares)


def _batch_scores(pool: DataFrame, asked: DataFrame, stored: DataFrame, batch: Callable) -> DataFrame:
    """pool with _score. The pairs of a chunk are gathered before they meet its text, which is sent and worked out once,
    whatever number of questions it meets. Pairs without their chunk or question have no row."""
    block = F.pmod(F.xxhash64("query_id"), F.lit(1 + pool.count() // POOLED_ROWS))
    pairs = pool.join(asked, "query_id").repartition("chunk_id").groupBy("chunk_id", block.alias("_b")).agg(F.collect_list(F.struct(*[F.col(c) for c in pool.columns], "_question")).alias("_pairs"))

    def scores(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("_pairs")
            rows, c = lists.flatten(), lists.value_parent_indices().to_numpy()
            questions = rows.field("_question").dictionary_encode()
            q = questions.indices.fill_null(len(questions.dictionary)).to_numpy(zero_copy_only=False)
            found = batch([*questions.dictionary.cast(pa.binary()).to_pylist(), None], part.column("_content").cast(pa.binary()).to_pylist(), q, c)
            yield pa.RecordBatch.from_arrays([*[rows.field(name) for name in names], pa.array(found, pa.float64())], [*names, "_score"])

    names = pool.columns
    return stored.join(pairs, "chunk_id").select("_content", "_pairs").mapInArrow(scores, StructType([*pool.schema.fields, StructField("_score", DoubleType())]))


def rerank(fused: DataFrame, questions: DataFrame, chunks: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), scorer=overlap_score) -> DataFrame:
    """fused, cut to the pool, with a rerank score of (question text, chunk content). Only texts of the pool are joined."""
    pool = fused.where(F.col("rnk") <= cfg.rerank_pool)
    asked, stored = questions.select("query_id", F.col("text").alias("_question")), chunks.select("chunk_id", F.col("content").alias("_content"))
    if isinstance(scorer, TwoSided) and scorer.batch:
        return _batch_scores(pool, asked, stored, scorer.batch).withColumn("rerank", F.round("_score", 6)).drop("_score")
    if isinstance(scorer, TwoSided):
        asked = asked.withColumn("_question", scorer.question(F.col("_question")))
        stored = stored.join(pool.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("_content", scorer.content(F.col("_content")))
        score = scorer.pair
    else:  # few bytes but much work per row: spread over all cores, which adaptive coalescing by size would not do
        pool, score = pool.repartition(fused.sparkSession.sparkContext.defaultParallelism, "query_id", "chunk_id"), scorer
    joined = pool.join(asked, "query_id").join(stored, "chunk_id")
    return joined.withColumn("rerank", F.round(score(F.col("_question"), F.col("_content")), 6)).drop("_question", "_content")


def blend(reranked: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """reranked with combined (min-max normalised within the query, then weighted) and rnk by it; a lone candidate keeps its raw score."""
    w = Window.partitionBy("query_id")
    norm = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0))
    combined = F.when(F.count("*").over(w) == 1, F.col("rerank")).otherwise(F.lit(cfg.rrf_weight) * norm("rrf") + F.lit(cfg.rerank_weight) * norm("rerank"))
    scored = reranked.withColumn("combined", F.round(combined, 9)).withColumnRenamed("rnk", "prior")
    return scored.withColumn("rnk", F.row_number().over(w.orderBy(F.col("combined").desc(), "prior"))).drop("prior")


def filter_entity(ranked: DataFrame, detected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Where a question names exactly one customer, only that customer's chunks; after scoring, so that scores stay those of the pool."""
    owners = chunks.select("chunk_id", "customer")
    named = ranked.join(detected.select("query_id", "filter_name"), "query_id", "left").join(owners, "chunk_id", "left")
    return named.where(F.col("filter_name").isNull() | (F.col("customer") == F.col("filter_name"))).drop("filter_name")


def dynamic_k(ranked: DataFrame, score: str, threshold: float, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, k): how many chunks go on, those at or over the threshold, within bounds; with dynamic_k off, max_chunks."""
    if not cfg.dynamic_k:
        return ranked.select("query_id").distinct().withColumn("k", F.lit(cfg.max_chunks).cast("int"))
    good = F.count_if(F.col(score) >= threshold)
    return ranked.groupBy("query_id").agg(F.least(F.greatest(good, F.lit(cfg.min_chunks)), F.lit(cfg.max_chunks)).cast("int").alias("k"))


def take_k(ranked: DataFrame, ks: DataFrame) -> DataFrame:
    """The first k of every question by rnk, with pos from 1."""
    placed = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rnk")))
    return placed.join(ks, "query_id").where("pos <= k").drop("k")


def select_balanced(ranked: DataFrame, targets: DataFrame, ks: DataFrame, per_entity: int = 2) -> DataFrame:
    """(query_id, chunk_id, customer, pos): of the target customers' chunks first up to per_entity each in rank order, then
    round by round one of each customer in order of name, k in all. ranked has query_id, chunk_id, customer, rnk; where it
    has doc_key, of chunks with one key only the first by rnk takes part."""
    kept = ranked.join(targets.select("query_id", "customer"), ["query_id", "customer"], "left_semi")
    if "doc_key" in ranked.columns:
        copy = Window.partitionBy("query_id", "doc_key").orderBy("rnk")
        kept = kept.withColumn("_copy", F.row_number().over(copy)).where("_copy = 1").drop("_copy")
    turn = kept.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "customer").orderBy("rnk")))
    late = F.col("rn") > per_entity
    w = Window.partitionBy("query_id").orderBy(late, F.when(~late, F.col("rnk")), "rn", "customer")
    return turn.withColumn("pos", F.row_number().over(w)).join(ks, "query_id").where("pos <= k").select("query_id", "chunk_id", "customer", "pos")
