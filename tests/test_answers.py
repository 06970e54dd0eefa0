"""Final answers and the explanation of a retrieval."""

import pytest
from pyspark.sql import functions as F

from quillspark.config import RetrievalConfig
from quillspark.operators import answers, index
from quillspark.plans import ask

CHUNKS = "chunk_id bigint, source string, page_number int, content string, customer string, clause string, hierarchy array<string>"


def tables(spark):
    chunks = spark.createDataFrame([(1, "f", 1, "Storage fees rise. Doors close at noon.", "c", "5.1", ["5.1"]), (2, "f", 2, "Nothing else", None, None, []), (3, "g", 1, None, "c", "N/A", ["2", "2.1"])], CHUNKS)
    questions = spark.createDataFrame([(1, "which fees"), (2, "doors?"), (3, None)], "query_id bigint, text string")
    selected = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id bigint, pos int, chunk_id bigint")
    return questions, selected, chunks


def test_answers(spark):
    questions, selected, chunks = tables(spark)
    detected = spark.createDataFrame([(1, None), (2, "Acme"), (3, None)], "query_id bigint, filter_name string")
    got = {r.query_id: r for r in ask.answer_questions(questions, selected, chunks, detected).collect()}
    assert got[1].answer == "Source: f | Page: 1 | Customer: c | Clause: 5.1 --- Storage fees rise" and not got[1].is_error
    assert got[1].sources == ["f (Customer: c) - Page 1 (Clause: 5.1)", "f (Customer: Unknown Customer) - Page 2", "g (Customer: c) - Page 1 (Section: 2.1)"]
    assert got[2].answer == "Could not find relevant documents specifically for 'Acme' matching your query." and got[2].sources == [] and got[2].is_error
    assert got[3].answer == ask.EMPTY_QUESTION
    assert ask.answer_questions(questions.limit(0), selected, chunks).count() == 0


def test_explanation(spark):
    _, selected, _ = tables(spark)
    hits = spark.createDataFrame([(1, 1, "a", "dense", 1), (1, 1, "a", "sparse", 2), (1, 9, "b", "sparse", 1)], "query_id bigint, chunk_id bigint, doc_key string, retriever string, rnk int")
    ranked = spark.createDataFrame([(1, 1, "a", 0.03, 0.5, 0.9, 1), (1, 9, "b", 0.01, 0.1, 0.2, 2)], "query_id bigint, chunk_id bigint, doc_key string, rrf double, rerank double, combined double, rnk int")
    got = {r.chunk_id: (r.dense_rnk, r.sparse_rnk, r.rnk, r.pos) for r in ask.explain_retrieval(hits, ranked, selected).collect()}
    assert got == {1: (1, 2, 1, 1), 9: (None, 1, 2, None)}


def opened(spark, tmp_path, **options):
    where = str(tmp_path / "idx")
    _, _, chunks = tables(spark)
    index.build_index(chunks, where, buckets=2, **options)
    return index.open_index(spark, where, spark.createDataFrame([("c",), ("Gone Foods",)], "name string"))


def test_pipeline_on_an_index(spark, tmp_path):
    idx, seen = opened(spark, tmp_path), ask.Timings()
    questions = spark.createDataFrame([(1, "which fees"), (2, "  "), (3, "doors at gone foods"), (4, "zzz")], "query_id bigint, text string")
    got = {r.query_id: r for r in ask.ask_and_answer(questions, idx, timings=seen).collect()}
    assert list(seen) == ["retrieval", "fusion and rerank", "selection", "answer"] and all(t > 0 for t in seen.values())
    assert "Storage fees rise" in got[1].answer and got[1].sources[0].startswith("f (Customer: c) - Page 1")
    assert got[2].answer == ask.EMPTY_QUESTION and got[2].sources == []
    assert got[3].answer == "Could not find relevant documents specifically for 'Gone Foods' matching your query." and got[3].is_error
    with pytest.raises(index.NotReady):
        ask.ask_and_answer(questions, None)
    with pytest.raises(index.NotReady, match="reranker"):
        ask.ask_and_answer(questions, idx, scorer=None)


def test_models_are_parameters(spark, tmp_path):
    idx = opened(spark, tmp_path)
    questions = spark.createDataFrame([(1, "which fees")], "query_id bigint, text string")
    shout = answers.model_provider(lambda asked, texts: [f"{q}: {len(t)}" for q, t in zip(asked, texts)])
    got = ask.ask_and_answer(questions, idx, scorer=lambda q, c: F.length(c) / 100.0, extract=shout, synthesiser=lambda q, s: F.upper(s)).first()
    assert "WHICH FEES: " in got.answer

    def broken(question, content):
        def fail(texts):
            raise ValueError("no model")
            yield

        from collections.abc import Iterator

        import pandas as pd

        fail.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(fail, "double")(content)

    with pytest.warns(UserWarning, match="fused order"):
        rows = ask.ask(questions, idx, scorer=broken, filter_entities=False).orderBy("pos").collect()
    assert rows and rows[0].score <= 2 / 60  # fused scores


def test_dense_only(spark, tmp_path):
    idx = opened(spark, tmp_path, sparse=None)
    questions = spark.createDataFrame([(1, "which fees")], "query_id bigint, text string")
    assert ask.sparse_hits(questions, idx, idx.cfg).count() == 0
    assert [r.chunk_id for r in ask.ask(questions, idx, RetrievalConfig(rerank=False), filter_entities=False).orderBy("pos").collect()] == [1, 2]


def test_a_failure_is_no_result(spark, tmp_path, monkeypatch):
    """Only a given model that raises leaves the fused order, and the rows say so; other failures of the pool were taken for that before."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.errors import PySparkException

    from quillspark.operators import ranking

    idx = opened(spark, tmp_path)
    questions = spark.createDataFrame([(1, "which fees")], "query_id bigint, text string")

    def fail(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raise ValueError("no model")
        yield

    broken = F.pandas_udf(fail, "double")
    assert {r.reranked for r in ask.ask(questions, idx, filter_entities=False).collect()} == {True}
    with pytest.warns(UserWarning, match="fused order"):
        assert {r.reranked for r in ask.ask(questions, idx, scorer=lambda q, c: broken(c), filter_entities=False).collect()} == {False}
    with pytest.warns(UserWarning, match="fused order"):
        assert [r.reranked for r in ask.ask_and_answer(questions, idx, scorer=lambda q, c: broken(c)).collect()] == [False]
    for scorer in (ranking.overlap_score, lambda q, c: F.length(c) / 100.0):
        with monkeypatch.context() as m:
            m.setattr(ranking, "rerank", lambda pool, *_: pool.withColumn("rerank", F.raise_error(F.lit("no space left")).cast("double")))
            with pytest.raises(PySparkException, match="no space left"):
                ask.ask(questions, idx, scorer=scorer, filter_entities=False)
    with monkeypatch.context() as m:
        m.setattr(ranking, "rerank", lambda pool, *_: pool.withColumn("rerank", broken(F.col("doc_key").cast("string"))))
        with pytest.raises(PySparkException, match="no model"):
            ask.ask(questions, idx, filter_entities=False)


def test_a_failing_pool_is_an_error_by_customer(spark, tmp_path, monkeypatch):
    from pyspark.errors import PySparkException

    from quillspark.operators import ranking

    idx = opened(spark, tmp_path)
    questions = spark.createDataFrame([(1, "which fees of c"), (2, "doors")], "query_id bigint, text string")
    monkeypatch.setattr(ranking, "rerank", lambda pool, *_: pool.withColumn("rerank", F.raise_error(F.lit("no space left")).cast("double")))
    with pytest.raises(PySparkException, match="no space left"):
        ask.ask(questions, idx)
    with pytest.raises(PySparkException, match="no space left"):
        ask.ask_and_answer(questions, idx)
