"""Fusion, blending, selection, detection, traces and citations on traced cases and against loops."""

import random

import numpy as np
import pytest

from quillspark.config import RetrievalConfig
from quillspark.functions import encode
from quillspark.operators import answers, entities, graph, index, ranking, retrieval, trace

HITS = "query_id bigint, chunk_id bigint, doc_key string, retriever string, rnk int"


def test_fusion(spark):
    hits = spark.createDataFrame([(1, 10, "a", "dense", 1), (1, 20, "b", "dense", 2), (1, 20, "b", "sparse", 1), (1, 30, "c", "sparse", 2)], HITS)
    got = [(r.chunk_id, r.rrf) for r in ranking.fuse(hits).orderBy("rnk").collect()]
    assert [c for c, _ in got] == [20, 10, 30]
    assert np.allclose([s for _, s in got], [1 / 61 + 1 / 60, 1 / 60, 1 / 61])
    assert ranking.fuse(spark.createDataFrame([], HITS)).count() == 0


def test_deliveries_of_one_text_are_one_candidate(spark):
    chunks = spark.createDataFrame([(1, "f", 1, "same"), (2, "f", 1, "same"), (3, "f", 2, "same"), (4, None, None, None), (5, None, None, None)], "chunk_id bigint, source string, page_number int, content string")
    bag = spark.createDataFrame([(1, 2, "dense", 1), (1, 1, "dense", 2), (1, 1, "sparse", 1), (1, 3, "sparse", 2), (1, 4, "sparse", 3), (1, 5, "sparse", 4), (1, 99, "sparse", 5)], "query_id bigint, chunk_id bigint, retriever string, rnk int")
    got = {r.chunk_id: r.rrf for r in ranking.fuse(ranking.keyed_hits(bag, chunks)).collect()}
    assert set(got) == {2, 3, 4, 99}  # the id seen first stands for its text; a chunk that is not there only for itself
    assert np.isclose(got[2], 1 / 60 + 1 / 61 + 1 / 60) and np.isclose(got[4], 1 / 62 + 1 / 63)
    ranked = spark.createDataFrame([(1, 1, "k", "A", 1), (1, 2, "k", "A", 2), (1, 3, "m", "A", 3), (1, 4, "n", "B", 4)], "query_id bigint, chunk_id bigint, doc_key string, customer string, rnk int")
    targets, ks = spark.createDataFrame([(1, "A"), (1, "B")], "query_id bigint, customer string"), spark.createDataFrame([(1, 5)], "query_id bigint, k int")
    assert [r.chunk_id for r in ranking.select_balanced(ranked, targets, ks).orderBy("pos").collect()] == [1, 3, 4]


def test_pool_without_rerank_and_fixed_k(spark):
    cfg = RetrievalConfig(max_chunks=20, dynamic_k=False)
    fused = spark.createDataFrame([(1, i, str(i), 1.0 / i, i, i) for i in range(1, 31)], "query_id bigint, chunk_id bigint, doc_key string, rrf double, first_seen bigint, rnk int")
    pool = ranking.fused_only(fused, 30)
    assert ranking.dynamic_k(pool, "combined", 0.5, cfg).first().k == 20
    assert ranking.take_k(pool, ranking.dynamic_k(pool, "combined", 0.0, RetrievalConfig(max_chunks=25))).count() == 25
    assert ranking.fused_only(fused, 12).count() == 12


def test_blend_and_k(spark):
    rows = spark.createDataFrame([(1, 1, 0.03, 1.0, 1), (1, 2, 0.02, 3.0, 2), (1, 3, 0.01, 2.0, 3), (2, 9, 0.5, 0.2, 1)], "query_id bigint, chunk_id bigint, rrf double, rerank double, rnk int")
    got = {(r.query_id, r.chunk_id): (r.combined, r.rnk) for r in ranking.blend(rows).collect()}
    assert got == {(1, 1): (0.4, 2), (1, 2): (0.8, 1), (1, 3): (0.3, 3), (2, 9): (0.2, 1)}
    ks = {r.query_id: r.k for r in ranking.dynamic_k(ranking.blend(rows), "combined", 0.4).collect()}
    assert ks == {1: 2, 2: 1}
    many = spark.createDataFrame([(1, i, 0.9) for i in range(30)], "query_id bigint, chunk_id bigint, s double")
    assert ranking.dynamic_k(many, "s", 0.4).first().k == 12


def loop_select(customers, targets, k, per=2):
    """Two passes: up to `per` of each target in order, then round by round in order of name."""
    out, count = [], dict.fromkeys(targets, 0)
    for i, c in enumerate(customers):
        if len(out) < k and c in count and count[c] < per:
            out.append(i)
            count[c] += 1
    while len(out) < k:
        before = len(out)
        for c in sorted(targets):
            left = [i for i, x in enumerate(customers) if x == c and i not in out]
            if left and len(out) < k:
                out.append(left[0])
        if len(out) == before:
            break
    return out


def test_balanced_selection(spark):
    rng = random.Random(2)
    cases = [("AAAABCAB", "AB", 5)] + [("".join(rng.choice("ABCD") for _ in range(rng.randint(1, 14))), "".join(sorted(rng.sample("ABCD", rng.randint(1, 3)))), rng.randint(1, 12)) for _ in range(60)]
    ranked = spark.createDataFrame([(q, i, c, i + 1) for q, (cs, _, _) in enumerate(cases) for i, c in enumerate(cs)], "query_id bigint, chunk_id bigint, customer string, rnk int")
    targets = spark.createDataFrame([(q, t) for q, (_, ts, _) in enumerate(cases) for t in ts], "query_id bigint, customer string")
    ks = spark.createDataFrame([(q, k) for q, (_, _, k) in enumerate(cases)], "query_id bigint, k int")
    got = {}
    for r in ranking.select_balanced(ranked, targets, ks).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q, (cs, ts, k) in enumerate(cases):
        assert got.get(q, []) == loop_select(cs, ts, k), cases[q]


def loop_detect(query, names):
    keywords = {}
    for name in sorted(names):
        base = name
        for s in (" Pty Ltd", " Pty Limited", " Ltd", " Limited", " Inc"):
            if base.lower().endswith(s.lower()):
                base = base[: -len(s)].strip()
                break
        if base.split():
            keywords[base.split()[0].lower()] = name
            keywords[name.lower().replace(" ", "")] = name
    import re

    masked, out = query.lower(), []
    for k in sorted(keywords, key=lambda k: (-len(k), k)):
        m = re.search(rf"\b{re.escape(k)}\b", masked)
        if m and keywords[k] not in out:
            out.append(keywords[k])
            masked = masked[: m.start()] + "_" * len(k) + masked[m.end() :]
    return sorted(out)


def test_detection(spark):
    names = ["Acme Foods", "Beta Co", "Acme Storage Ltd", "Zeta (G.B.)", "O'Neil Meats", '"Quoted" Foods', "", "   "]
    queries = ["Compare ACME and beta", "acmed fees", "betaco or beta", "acmefoods?", "fees of o'neil and zeta", "quoted", "", None, "acme acme acmefoods"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {r.query_id: (r.names, r.filter_name) for r in entities.detect_entities(q, n).collect()}
    for i, text in enumerate(queries):
        expected = loop_detect(text or "", names)
        assert got[i] == (expected, expected[0] if len(expected) == 1 else None), text
    assert entities.detect_entities(q, n.limit(0)).where("size(names) > 0").count() == 0


def test_dense_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[5] = x[7]  # a tie
    v = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "chunk_id bigint, embedding array<float>").repartition(4)
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in retrieval.dense_top(q, v, 10).orderBy("query_id", "rnk").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for i in range(0, 300, 20):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1)).round(6)
        assert got[i] == sorted(range(300), key=lambda k: (d[k], k))[:10]
    assert retrieval.dense_top(q.limit(0), v, 10).count() == 0


def test_sparse(spark):
    docs = spark.createDataFrame([(1, "Cold store fees"), (2, "cold cold cold"), (3, None), (4, "")], "chunk_id bigint, content string")
    asked = spark.createDataFrame([(1, "cold fees"), (2, None)], "query_id bigint, text string")
    got = retrieval.sparse_top(retrieval.postings(asked, "query_id", "text"), retrieval.postings(docs, "chunk_id", "content")).orderBy("rnk").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 1), (1, 2)]


def test_traces(spark):
    runs = spark.createDataFrame([("r1", None, "a@x.example", ["t"]), ("r2", "r1", None, None), ("r3", "r2", "", ["user:a@x.example"]), ("r4", "r3", "b@x.example", []), ("r5", "gone", None, None), ("r6", "r4", None, ["z"])], "run_id string, parent_run_id string, email string, tags array<string>")
    assert {r.run_id: r.email for r in trace.inherit_email(runs).collect()} == {"r1": "a@x.example", "r2": "a@x.example", "r3": "a@x.example", "r4": "b@x.example", "r5": None, "r6": "b@x.example"}
    tags = {r.run_id: r.tags for r in trace.tag_runs(runs).collect()}
    assert tags["r3"] == ["user:a@x.example"] and tags["r5"] == [] and tags["r6"] == ["z", "user:b@x.example"]


def test_graph_and_citations(spark):
    chunks = spark.createDataFrame(
        [(1, "f", 1, "see Clause 5.2 and clause 5.1", "5.1", "c", ["5", "5.1"]), (2, "f", 1, "Clause 5.3", "5.2", None, []), (3, "f", 2, "Clause 5.1", "5.3", "c", []), (4, "g", 1, None, None, "c", ["2"])],
        "chunk_id bigint, source string, page_number int, content string, clause string, customer string, hierarchy array<string>",
    )
    edges = graph.reference_edges(chunks)
    assert {(r.src, r.dst) for r in edges.collect()} == {("5.1", "5.2"), ("5.2", "5.3"), ("5.3", "5.1")}
    assert graph.closure(edges).count() == 9
    picked = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 3, 3), (1, 4, 4)], "query_id bigint, pos int, chunk_id bigint")
    labels = [r.label for r in answers.citations(picked, chunks).orderBy("cite_no").collect()]
    assert labels == ["f (Customer: Unknown Customer) - Page 1 (Clause: 5.2)", "f (Customer: c) - Page 2 (Clause: 5.3)", "g (Customer: c) - Page 1 (Section: 2)"]


CHUNKS = "chunk_id bigint, source string, page_number int, content string, customer string, clause string, hierarchy array<string>"


def small_index(spark, tmp_path, **options):
    rows = [(1, "f", 1, "cold store fees", "Acme", "1", ["1"]), (2, "f", 2, "fees and more fees", "Beta", None, []), (3, "g", 1, None, None, "N/A", None), (4, "f", 1, "cold store fees", "Acme", "1", ["1"])]
    where = str(tmp_path / "idx")
    index.build_index(spark.createDataFrame(rows, CHUNKS), where, buckets=2, **options)
    return where


def test_index(spark, tmp_path):
    where = str(tmp_path / "idx")
    assert index.missing(spark, where) == list(index.ARTEFACTS)
    with pytest.raises(index.NotReady, match="chunks missing"):
        index.open_index(spark, where)
    assert small_index(spark, tmp_path) == where and index.missing(spark, where) == []
    assert index.build_index(spark.createDataFrame([], CHUNKS), where) == []
    idx = index.open_index(spark, where)
    assert idx.postings.count() == 9 and idx.postings_of(["cold"]).count() == 2 and idx.vectors.count() == 3
    spark.sql(f"DROP TABLE {index._table(where + '/postings')}")  # as in a session that did not write it
    assert index.open_index(spark, where).postings.count() == 9


def test_sums_over_buckets_need_no_shuffle(spark, tmp_path):
    idx = index.open_index(spark, small_index(spark, tmp_path))
    asked = spark.createDataFrame([(1, "fees"), (2, "cold fees")], "query_id bigint, text string")
    found = retrieval.sparse_top(encode.token_weights(asked, "query_id", "text"), idx.postings)
    rows = [(r.query_id, r.chunk_id) for r in found.orderBy("query_id", "rnk").collect()]
    assert rows == [(1, 2), (1, 1), (1, 4), (2, 1), (2, 4), (2, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "chunk_id" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)


def test_encoders(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, None), (3, "")], "k bigint, t string")
    weights = lambda df: {(r.k, r.token): round(r.weight, 6) for r in df.collect()}
    assert weights(encode.token_weights(docs, "k", "t")) == {(1, "a"): 1.098612, (1, "b"): 0.693147}
    model = encode.model_weights(lambda texts: [{"x": float(len(t)), "minus": -1.0} for t in texts])
    assert weights(model(docs, "k", "t")) == {(1, "x"): round(float(np.log1p(5)), 6)}
    places = spark.createDataFrame([(1, "a", 2.0), (1, "a", 5.0), (1, "b", -1.0)], "k bigint, token string, activation double")
    assert weights(encode.pooled(places, "k")) == {(1, "a"): round(float(np.log1p(5)), 6)}
    vector = encode.hashed_vectors(docs, "k", "t", 16).collect()
    assert [r.k for r in vector] == [1] and np.isclose(np.linalg.norm(vector[0].embedding), 1, atol=1e-5)
    assert encode.model_vectors(lambda texts: [[len(t), 1] for t in texts])(docs, "k", "t").orderBy("k").first().embedding == [5.0, 1.0]


def test_settings_from_the_environment():
    cfg = RetrievalConfig.from_env(env={"QUILLSPARK_TOP_DENSE": "7", "QUILLSPARK_RERANK": "off", "QUILLSPARK_MIN_SIMILARITY": "0.5"})
    assert (cfg.top_dense, cfg.rerank, cfg.min_similarity, cfg.top_sparse) == (7, False, 0.5, 100)


def test_dense_leaves_out_vectors_of_another_length(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 1.0])], "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id bigint, embedding array<double>")
    assert [(r.query_id, r.chunk_id) for r in retrieval.dense_top(q, v, 5).orderBy("rnk").collect()] == [(1, 1), (1, 4)]
    assert retrieval.dense_top(q, v.limit(0), 5).count() == 0


def test_dense_keeps_the_smallest_ids_of_many_copies(spark, monkeypatch):
    rng = np.random.default_rng(3)
    near = rng.normal(size=16)
    ids = rng.permutation(3000)
    rows = [(int(k), (near if i % 3 == 0 else near + 1 + rng.random(16)).tolist()) for i, k in enumerate(ids)]
    copies = sorted(int(k) for i, k in enumerate(ids) if i % 3 == 0)
    v = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, near.tolist()), (2, (near + 0.01).tolist())], "query_id bigint, embedding array<double>")
    for values in (retrieval.GROUP_VALUES, 8192):
        monkeypatch.setattr(retrieval, "GROUP_VALUES", values)  # small groups and blocks
        for got in (retrieval.dense_top(q, v.coalesce(1), 10), retrieval.dense_above(q, v.coalesce(1), 0.7, 10)):
            for k in (1, 2):
                assert [r.chunk_id for r in got.where(f"query_id = {k}").orderBy("rnk").collect()] == copies[:10]


def test_similarities_that_round_to_the_same_are_ties(spark):
    rows = [(100 - k, [0.01 + k * 2e-6, 0.0]) for k in range(60)]  # the farther, the smaller the id
    v = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id bigint, embedding array<double>")
    want = sorted((-round(1 - round(x[0], 6) ** 2 / 2, 6), k) for k, x in rows)[:5]
    assert [(-r.similarity, r.chunk_id) for r in retrieval.dense_above(q, v, 0.7, 5).orderBy("rnk").collect()] == want


def test_many_questions_meet_posting_lists(spark, monkeypatch):
    """The same result in groups of chunks and blocks of questions as by the join, without a row for each product."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 12))) for i in range(400)] + [(900, None), (901, "w1 w1 w2"), (902, "w2 w1 w1")], "chunk_id bigint, content string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(40)] + [(50, "w1 w2"), (51, "w2 w1"), (52, "nowhere"), (53, None)], "query_id bigint, text string")
    q, d = retrieval.postings(asked, "query_id", "text"), retrieval.postings(docs, "chunk_id", "content")
    want = sorted(map(tuple, retrieval.sparse_top(q, d, 7).collect()))
    for rows, chunks, block in ((0, 1 << 14, 1 << 20), (0, 20, 30)):
        for name, value in (("JOINED_ROWS", rows), ("GROUP_CHUNKS", chunks), ("BLOCK_ROWS", block)):
            monkeypatch.setattr(retrieval, name, value)
        found = retrieval.sparse_top(q, d, 7)
        assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == want
    assert len({r[0] for r in want}) == 42


def test_nearest_rows_by_a_first_look_in_single_precision():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x /= np.sqrt((x**2).sum(1))[:, None]
    x[100:300] = x[:200] + 1e-6 * rng.normal(size=(200, 16))  # nearer than single precision tells apart
    ids, norms = rng.permutation(3000), (x**2).sum(1)
    for query in x[:40]:
        squared = ((query**2).sum() + norms - 2 * x @ query).astype(np.float32)
        chosen, distance = retrieval.nearest_rows(squared, x, query, ids, 20, norms=norms)
        exact = np.sqrt(((x - query) ** 2).sum(1)).round(6)
        assert chosen.tolist() == np.lexsort((ids, exact))[:20].tolist() and (distance == exact[chosen]).all()


def test_an_index_sends_texts_and_not_tokens(spark, tmp_path):
    """The texts' way to their bucket is the only exchange of either encoder's plan."""
    chunks = spark.createDataFrame([(i, "s", 1, f"cold store w{i} w{i % 7}", None, None, ["1"]) for i in range(60)], "chunk_id bigint, source string, page_number int, content string, customer string, clause string, hierarchy array<string>")
    plans = []

    def seen(encoder):
        def encode_(*args):
            plans.append((out := encoder(*args))._jdf.queryExecution().executedPlan().toString())
            return out

        return encode_

    index.build_index(chunks, str(tmp_path / "i"), sparse=seen(encode.token_weights), dense=seen(encode.hashed_vectors), buckets=4, parts=2)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1], plans
    got = index.open_index(spark, str(tmp_path / "i"))
    assert got.postings.count() == 233 and got.vectors.count() == 60


def test_numbered_hits_unite_what_keyed_hits_unite(spark):
    chunks = spark.createDataFrame([(1, "s", 1, "a"), (2, "s", 1, "a"), (3, "s", 2, "a"), (4, None, None, None), (5, None, None, None)], "chunk_id bigint, source string, page_number int, content string")
    hits = spark.createDataFrame([(1, i, "dense", i) for i in (1, 2, 3, 4, 5, 77)], "query_id bigint, chunk_id bigint, retriever string, rnk int")
    got = {r.chunk_id: r.doc_key for r in ranking.numbered_hits(hits, chunks).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 77: 77}
