"""Encoders, ranked lists and reranking work on batches: no row for each place in a text, each place in a list or each text of a pair."""

from dataclasses import replace

import numpy as np

from quillspark.functions import encode
from quillspark.operators import ranking, retrieval
from quillspark.plans import lineage


def test_texts_are_counted_without_a_row_for_each_token(spark, monkeypatch):
    monkeypatch.setattr(encode, "BATCH_BYTES", 8)
    docs = spark.createDataFrame([(1, "a B-b a"), (2, "KK İs Été"), (3, None), (4, "..."), (1, "a c"), (None, "q"), (None, "r q"), (5, "one " * 9)], "k bigint, t string")
    found = encode.token_weights(docs, "k", "t")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.k, r.token): round(float(np.expm1(r.weight))) for r in found.collect()}
    assert got == {(1, "a"): 3, (1, "b"): 2, (1, "c"): 1, (2, "kk"): 1, (2, "i"): 1, (2, "s"): 1, (2, "t"): 1, (None, "q"): 2, (None, "r"): 1, (5, "one"): 9}
    vectors = {r.k: r.embedding for r in encode.hashed_vectors(docs, "k", "t", 16).collect()}
    assert set(vectors) == {1, 2, None, 5} and sorted(map(abs, vectors[5])) == [0.0] * 15 + [1.0]
    assert encode.rounded(np.array([0.0078125, -0.0078125, -1e-9]), 6).tolist() == [0.007813, -0.007813, 0.0]
    assert not np.signbit(encode.rounded(np.array([-1e-9]), 6)[0])


def test_lists_are_merged_a_few_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(900)], "chunk_id bigint, embedding array<double>")
    q = v.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    want = sorted(map(tuple, retrieval.dense_top(q, v, 7).collect()))
    monkeypatch.setattr(retrieval, "GROUP_VALUES", 1024)
    monkeypatch.setattr(retrieval, "MERGED_LISTS", 2)
    found = retrieval.dense_top(q, v, 7)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == want and len(want) == 63


def test_a_pool_meets_each_text_once(spark):
    questions = spark.createDataFrame([(1, "cold fees cold"), (2, "Fees"), (3, None), (4, "?")], "query_id bigint, text string")
    chunks = spark.createDataFrame([(1, "cold store FEES"), (2, "fees"), (3, None)], "chunk_id bigint, content string")
    pool = spark.createDataFrame([(q, c, c) for q in (1, 2, 3, 4, 9) for c in (1, 2, 3, 8)] + [(1, 1, 500)], "query_id bigint, chunk_id bigint, rnk int")
    found = ranking.rerank(pool, questions, chunks)
    assert "array_intersect" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.query_id, r.chunk_id, r.rnk, r.rerank) for r in found.collect())
    assert got == [(q, c, c, {(1, 1): 1.0, (1, 2): 0.5, (2, 1): 1.0, (2, 2): 1.0}.get((q, c), 0.0)) for q in (1, 2, 3, 4) for c in (1, 2, 3)]
    plain = ranking.rerank(pool, questions, chunks, scorer=replace(ranking.overlap_score, batch=None))
    assert sorted((r.query_id, r.chunk_id, r.rnk, r.rerank) for r in plain.collect()) == got


def test_released_leaves_the_setting_as_it_was(spark):
    before = spark.conf.get(lineage.CLEANUP)
    with lineage.released(spark):
        assert spark.conf.get(lineage.CLEANUP) == "true"
    assert spark.conf.get(lineage.CLEANUP) == before
