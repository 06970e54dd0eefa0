"""The question pipeline, for any number of questions in one plan."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.config import RetrievalConfig
from quillspark.operators import answers, entities, ranking, retrieval
from quillspark.operators.index import Index, NotReady
from quillspark.plans.lineage import materialize

EMPTY_QUESTION = "Please enter a valid query."  # fixed value
GENERAL_ERROR = "Error processing query via MapReduce chain."  # fixed value
TOKENS_KNOWN = 1000  # distinct tokens of the questions that are looked up to prune the scan

Scorer = Callable[[Column, Column], Column]
EMPTY_HITS = "query_id bigint, chunk_id bigint, rnk int"


class Timings(dict):
    """Seconds by stage, in order; a stage counts what it made Spark run."""

    def stage(self, name: str, run: Callable[[], DataFrame]) -> DataFrame:
        start = time.perf_counter()
        out = run()
        self[name] = time.perf_counter() - start
        return out


def valid_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The questions with a text, trimmed, and of the others (query_id, answer), the request for a valid one."""
    text = F.btrim("text", F.lit(" \t\r\n"))
    good = questions.withColumn("text", text).where(F.col("text") != "")
    return good, questions.where(text.isNull() | (text == "")).select("query_id", F.lit(EMPTY_QUESTION).alias("answer"))


def dense_hits(questions: DataFrame, index: Index, cfg: RetrievalConfig) -> DataFrame:
    """(query_id, chunk_id, rnk) of the exact dense search; empty without an encoder."""
    if index.dense is None:
        return questions.sparkSession.createDataFrame([], EMPTY_HITS)
    asked = materialize(index.dense(questions, "query_id", "text"))
    return retrieval.dense_top(asked, index.vectors, cfg.top_dense).select("query_id", "chunk_id", "rnk")


def sparse_hits(questions: DataFrame, index: Index, cfg: RetrievalConfig) -> DataFrame:
    """(query_id, chunk_id, rnk) of the sparse search; empty without an encoder or where the index has no postings."""
    if index.sparse is None or index.postings.isEmpty():
        return questions.sparkSession.createDataFrame([], EMPTY_HITS)
    asked = materialize(index.sparse(questions, "query_id", "text"))
    few = [r["token"] for r in asked.select("token").distinct().limit(TOKENS_KNOWN + 1).collect()]  # only looked up; more are left to the join
    docs = index.postings_of(few) if few and len(few) <= TOKENS_KNOWN else index.postings
    return retrieval.sparse_top(asked, docs, cfg.top_sparse, index.chunks.count()).select("query_id", "chunk_id", "rnk")


def hits_of(questions: DataFrame, index: Index, cfg: RetrievalConfig, dense: DataFrame | None = None) -> DataFrame:
    """Bag of (query_id, chunk_id, retriever, rnk) of both searches, each written before the next begins; a given dense list
    stands for the dense search."""
    near = dense_hits(questions, index, cfg) if dense is None else dense.where(F.col("rnk") <= cfg.top_dense).select("query_id", "chunk_id", "rnk")
    label = lambda df, name: df.withColumn("retriever", F.lit(name))
    near = materialize(label(near, "dense"))
    return near.unionByName(materialize(label(sparse_hits(questions, index, cfg), "sparse")))


def ranked_chunks(questions: DataFrame, chunks: DataFrame, hits: DataFrame, cfg: RetrievalConfig, scorer: Scorer | None = ranking.overlap_score, keyed: Callable[[DataFrame, DataFrame], DataFrame] = ranking.keyed_hits) -> DataFrame:
    """(query_id, chunk_id, doc_key, rrf, rerank, combined, rnk): the pool of every question. Without a reranker the pool is
    max_chunks and combined the fused score."""
    fused = ranking.fuse(keyed(hits, chunks), cfg.rrf_k)
    if scorer is None or not cfg.rerank:
        return ranking.fused_only(fused, cfg.max_chunks)
    fused = materialize(fused.where(F.col("rnk") <= cfg.rerank_pool))  # ids and scores, read for the pool and for its texts
    return ranking.blend(ranking.rerank(fused, questions, chunks, cfg, scorer), cfg)


def _pool(questions: DataFrame, chunks: DataFrame, hits: DataFrame, cfg: RetrievalConfig, scorer: Scorer | None) -> tuple[DataFrame, bool]:
    """The written pool, and whether it was reranked. A given model that raises an error leaves its pool in fused order; whatever
    else fails (memory, disk, workers, the default scorer) is an error here too."""
    if scorer is None or not cfg.rerank:
        return materialize(ranked_chunks(questions, chunks, hits, cfg, None, ranking.numbered_hits)), False
    fused = materialize(ranking.fuse(ranking.numbered_hits(hits, chunks), cfg.rrf_k).where(F.col("rnk") <= cfg.rerank_pool))
    try:
        return materialize(ranking.blend(ranking.rerank(fused, questions, chunks, cfg, scorer), cfg)), True
    except PythonException as error:
        if scorer is ranking.overlap_score:
            raise
        warnings.warn(f"reranking failed, the fused order stands: {str(error)[:300]}", stacklevel=3)
        return materialize(ranking.fused_only(fused, cfg.rerank_pool)), False


def select_chunks(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, names: DataFrame | None, cfg: RetrievalConfig, reranked: bool) -> tuple[DataFrame, DataFrame | None]:
    """(query_id, chunk_id, pos) of what each question is answered from, and the customers detected.

    A question that names one customer gets that customer's chunks only; one that names several gets chunks of each in
    turn; others get the best chunks.
    """
    threshold = cfg.combined_threshold if reranked else cfg.rrf_threshold
    if names is None:
        return ranking.take_k(ranked, ranking.dynamic_k(ranked, "combined", threshold, cfg)).select("query_id", "chunk_id", "pos"), None
    detected = entities.detect_entities(questions, names)
    owned = ranking.filter_entity(ranked, detected, chunks)
    several = detected.where(F.size("names") > 1)
    ks = ranking.dynamic_k(owned, "combined", threshold, cfg)
    best = ranking.take_k(owned.join(several, "query_id", "left_anti"), ks).select("query_id", "chunk_id", "pos")
    targets = several.select("query_id", F.explode("names").alias("customer"))
    balanced = ranking.select_balanced(owned, targets, ks, cfg.per_entity).select("query_id", "chunk_id", "pos")
    return best.unionByName(balanced), detected


def ask(questions: DataFrame, index: Index, cfg: RetrievalConfig | None = None, filter_entities: bool = True, scorer: Scorer | None = ranking.overlap_score, dense: DataFrame | None = None, timings: Timings | None = None) -> DataFrame:
    """(query_id, pos, chunk_id, source, page_number, score, citation, reranked): what each question is answered from.

    Questions without a text or without a hit have no row. Texts of chunks are read for the bounded pool alone. reranked is
    false where the scores are the fused ones, because no reranker is wanted or the given one failed.
    """
    cfg, timings = cfg or index.cfg, Timings() if timings is None else timings
    asked, _ = valid_questions(questions)
    hits = timings.stage("retrieval", lambda: hits_of(asked, index, cfg, dense))
    # ids and scores of a bounded pool per question; everything after reads it several times
    start = time.perf_counter()
    ranked, reranked = _pool(asked, index.chunks, hits, cfg, scorer)
    timings["fusion and rerank"] = time.perf_counter() - start
    chosen, _ = select_chunks(asked, ranked, index.chunks, index.names if filter_entities else None, cfg, reranked)
    chosen = timings.stage("selection", lambda: materialize(chosen))
    about = index.chunks.select("chunk_id", "source", "page_number", answers.A.citation(F.col("source"), F.col("page_number"), F.col("customer"), F.col("clause"), F.col("hierarchy")).alias("citation"))
    return chosen.join(ranked.select("query_id", "chunk_id", F.col("combined").alias("score")), ["query_id", "chunk_id"]).join(about, "chunk_id").select("query_id", "pos", "chunk_id", "source", "page_number", "score", "citation", F.lit(reranked).alias("reranked"))


def explain_retrieval(hits: DataFrame, ranked: DataFrame, selected: DataFrame) -> DataFrame:
    """Every candidate with its rank in each list, its scores, its final rank and the position it was selected at, if it was.
    hits has doc_key."""
    lists = hits.groupBy("query_id", "doc_key").agg(F.min(F.when(F.col("retriever") == "dense", F.col("rnk"))).alias("dense_rnk"), F.min(F.when(F.col("retriever") == "sparse", F.col("rnk"))).alias("sparse_rnk"))
    chosen = selected.select("query_id", "chunk_id", "pos")
    return ranked.join(lists, ["query_id", "doc_key"]).join(chosen, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "dense_rnk", "sparse_rnk", "rrf", "rerank", "combined", "rnk", "pos")


def answer_questions(
    questions: DataFrame,
    selected: DataFrame,
    chunks: DataFrame,
    detected: DataFrame | None = None,
    cfg: RetrievalConfig = RetrievalConfig(),
    extract: answers.Extractor = answers.shared_sentences,
    synthesiser: answers.Synthesiser = answers.joined_extracts,
    ks: DataFrame | None = None,
) -> DataFrame:
    """(query_id, answer, sources, is_error): the answer made from the extracts, with citations; a fixed sentence where
    nothing was selected (with the k of the question, from ks), and for a question without a text."""
    asked, refused = valid_questions(questions)
    texts = answers.synthesise(answers.map_extract(selected, asked, chunks, extract), asked, synthesiser).withColumn("answer", F.coalesce("answer", F.lit(GENERAL_ERROR)))
    cited = answers.citations(selected, chunks).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cite_no", "label"))).alias("c"))
    out = questions.select("query_id").join(texts.unionByName(refused), "query_id", "left").join(cited, "query_id", "left")
    specific, limit = F.lit(None).cast("string"), F.lit(str(cfg.min_chunks if cfg.dynamic_k else cfg.max_chunks))
    if detected is not None:
        out = out.join(detected.select("query_id", "filter_name"), "query_id", "left")
        specific = F.concat(F.lit("Could not find relevant documents specifically for '"), F.col("filter_name"), F.lit("' matching your query."))
    if ks is not None:
        out = out.join(ks, "query_id", "left")
        limit = F.coalesce(F.col("k").cast("string"), limit)
    general = F.concat(F.lit("Could not find relevant documents for your query after selection (Limit: "), limit, F.lit(" chunks)."))
    out = out.withColumn("answer", F.coalesce("answer", specific, general))
    return out.select("query_id", "answer", F.coalesce(F.transform("c", lambda x: x.label), F.array().cast("array<string>")).alias("sources"), answers.A.is_error(F.col("answer")).alias("is_error"))


def ask_and_answer(questions: DataFrame, index: Index | None, cfg: RetrievalConfig | None = None, scorer: Scorer | None = ranking.overlap_score, extract: answers.Extractor = answers.shared_sentences, synthesiser: answers.Synthesiser = answers.joined_extracts, timings: Timings | None = None) -> DataFrame:
    """(query_id, answer, sources, is_error, reranked): the whole pipeline of one or many questions; reranked as in ask. Without
    an index, or with a reranker wanted but none given, NotReady."""
    if index is None:
        raise NotReady("System not ready. Details: index missing.")
    cfg, timings = cfg or index.cfg, Timings() if timings is None else timings
    if cfg.rerank and scorer is None:
        raise NotReady("System not ready. Details: reranker enabled but missing.")
    asked, _ = valid_questions(questions)
    hits = timings.stage("retrieval", lambda: hits_of(asked, index, cfg))
    start = time.perf_counter()
    ranked, reranked = _pool(asked, index.chunks, hits, cfg, scorer)
    timings["fusion and rerank"] = time.perf_counter() - start
    chosen, detected = select_chunks(asked, ranked, index.chunks, index.names, cfg, reranked)
    chosen = timings.stage("selection", lambda: materialize(chosen))
    return timings.stage("answer", lambda: materialize(answer_questions(questions, chosen, index.chunks, detected, cfg, extract, synthesiser).withColumn("reranked", F.lit(reranked))))
