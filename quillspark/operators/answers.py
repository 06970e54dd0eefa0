"""From selected chunks to extracts, an answer and citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import answer as A
from quillspark.functions.encode import tokens

#: (question, excerpt) -> what of the excerpt bears on the question; empty or null where nothing does
Extractor = Callable[[Column, Column], Column]
#: (question, joined extracts) -> answer
Synthesiser = Callable[[Column, Column], Column]
SEPARATOR = "\n\n---\n\n"  # fixed value: stands between the extracts that the answer is made from


def shared_sentences(question: Column, excerpt: Column) -> Column:
    """Default extractor: the sentences that share a token with the question."""
    asked = F.array_distinct(tokens(question))
    parts = F.filter(F.regexp_extract_all(excerpt, F.lit(r"([^.\n]+)"), F.lit(1)), lambda s: F.arrays_overlap(tokens(s), asked))
    return F.array_join(F.transform(parts, lambda s: F.trim(s)), " ")


def joined_extracts(question: Column, summaries: Column) -> Column:
    """Default answer: every extract that found something, under its own heading line; if none did, the sentence that says so."""
    parts = F.split(summaries, SEPARATOR)
    useful = F.filter(parts, lambda p: ~p.endswith(A.NOTHING_FOUND))
    return F.when(F.size(useful) > 0, F.array_join(useful, "\n\n")).otherwise(F.lit(A.NOTHING_FOUND))


def model_provider(predict: Callable[[list[str], list[str]], list[str]]) -> Callable[[Column, Column], Column]:
    """An extractor, synthesiser or scorer from a model's batch function on (questions, texts)."""

    def column(question: Column, text: Column) -> Column:
        def batches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for asked, texts in parts:
                yield pd.Series(predict([q or "" for q in asked], [t or "" for t in texts]))

        return F.pandas_udf(batches, "string")(question, text)

    return column


def map_extract(selected: DataFrame, questions: DataFrame, chunks: DataFrame, extract: Extractor = shared_sentences) -> DataFrame:
    """(query_id, pos, extract): for every selected chunk its metadata line, " --- ", and what the extractor finds in it, or a fixed sentence."""
    about = chunks.select("chunk_id", "content", F.regexp_replace(A.prompt_header(F.col("source"), F.col("page_number"), F.col("customer"), F.col("clause")), "\n---\n$", "").alias("head"))
    joined = selected.select("query_id", "pos", "chunk_id").join(questions.select("query_id", "text"), "query_id").join(about, "chunk_id")
    # the excerpt is cleaned as a model is shown it
    found = joined.select("query_id", "pos", "head", extract(F.col("text"), A.without_fences(F.coalesce("content", F.lit("")))).alias("e"))
    return found.select("query_id", "pos", F.concat("head", F.lit(" --- "), F.when(F.col("e") != "", F.col("e")).otherwise(A.NOTHING_FOUND)).alias("extract"))


def reduce_concat(extracts: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """(query_id, answer): extracts in order of position; as many as chunks were selected."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "extract")))
    return extracts.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x.extract), separator).alias("answer"))


def synthesise(extracts: DataFrame, questions: DataFrame, model: Synthesiser = joined_extracts) -> DataFrame:
    """(query_id, answer): one call of the model per question on all its extracts."""
    joined = reduce_concat(extracts).join(questions.select("query_id", "text"), "query_id")
    return joined.select("query_id", model(F.col("text"), F.col("answer")).alias("answer"))


def citations(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, cite_no, label): one per file and page, built from its first chunk, in order of position."""
    about = chunks.select("chunk_id", "source", "page_number", "customer", "clause", "hierarchy")
    joined = selected.select("query_id", "pos", "chunk_id").join(about, "chunk_id")
    first = joined.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "source", "page_number").orderBy("pos"))).where("n = 1")
    label = A.citation(F.col("source"), F.col("page_number"), F.col("customer"), F.col("clause"), F.col("hierarchy"))
    return first.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("cite_no"), label.alias("label"))


def prompt_documents(chunks: DataFrame) -> DataFrame:
    """(chunk_id, document): header and content without code fences, as a model is shown it."""
    head = A.prompt_header(F.col("source"), F.col("page_number"), F.col("customer"), F.col("clause"))
    return chunks.select("chunk_id", F.concat(head, A.without_fences(F.coalesce("content", F.lit("")))).alias("document"))
