import random
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import mixing as M
from quillspark.llm import packing as P
from quillspark.llm import ranking as R
from quillspark.llm import tokens as T


def best_fit(sizes, capacity):
    """Best fit decreasing, item by item."""
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [(space, i) for i, space in enumerate(left) if space >= s]
        if fits:
            left[min(fits)[1]] -= s
        else:
            left.append(capacity - s)
    return len(left)


def test_plan_equals_best_fit_by_items():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randint(1, 60)
        histogram = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
        used, covered = Counter(), Counter()
        for length, first, last, container, per in P.plan_slots(histogram, capacity):
            for rank in range(first, last + 1):
                used[container + (rank - first) // per] += length
                covered[length, rank] += 1
        assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
        assert covered == Counter({(s, r): 1 for s, n in histogram.items() for r in range(n)})
        assert len(used) == best_fit([s for s, n in histogram.items() for _ in range(n)], capacity)


def test_pack(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["cold", "store", "pallet", "of", "goods"]) for _ in range(rng.randint(0, 120))) for _ in range(300)] + ["cold " * 5000, None, "", "same", "same", "a" * 20000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 3)], "doc_id bigint, text string, container int")
    rows = P.pack(df, capacity=100).collect()
    used = Counter()
    for r in rows:
        used[r.container] += r.n_tokens
    assert max(used.values()) <= 100 and {r.doc_id for r in rows} == set(range(len(texts)))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all((len(v) > 1) == (v[0].doc_tokens > 100) for k, v in by.items() if k != 3)
    long = sorted(by[300], key=lambda r: r.piece_no)
    assert sum(r.n_tokens for r in long) == long[0].doc_tokens and [r.start_token for r in long] == [100 * i for i in range(len(long))]
    row = P.report(P.pack(df, capacity=100), 100).first()
    assert row.containers == len(used) and row.containers <= row.fewest_possible + 2
    empty = P.pack(df.limit(0))
    assert empty.count() == 0 and P.report(empty).first().containers == 0


def test_rank_is_a_rank(spark):
    df = spark.createDataFrame([(i, i % 3, i % 5) for i in range(400)] + [(1, 1, 1)] * 5, "k bigint, g int, o int")
    got = R.with_rank(df, ["g"], "k", F.col("o"), salts=7).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r._rank, r.o))
    for rows in by.values():
        rows.sort()
        assert [x for x, _ in rows] == list(range(len(rows))) and [o for _, o in rows] == sorted(o for _, o in rows)


def test_no_window_holds_a_source(spark):
    """30,000 documents of one source and one length: every window is over one salt, the salts of a bucket, or the buckets."""
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("big").alias("source"), F.lit(100).alias("n_tokens"))
    ranked = R.with_rank(df, ["source"], "doc_id", F.floor(F.log2("n_tokens") * 4))
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) == 3 and any("row_number() windowspecdefinition(_salt#" in w for w in windows)  # the other two are over counts
    parts = df.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(R.SALTS))).count().agg(F.max("count")).first()[0]
    assert parts < 3 * 30_000 / R.SALTS and ranked.agg(F.count_distinct("_rank"), F.max("_rank")).first() == (30_000, 29_999)


def test_draw_is_systematic(spark):
    """Copies of documents in order of rank differ by one at most, and their sums stay within one of what is expected."""
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.array_join(F.array_repeat(F.lit("goods"), (F.col("id") % 40 + 1).cast("int")), " ").alias("text"))
    targets = spark.createDataFrame([("s", 1.0, 3)], "source string, target_share double, max_repeats int")
    report = M.report(df, targets, total=50_000).first()
    assert abs(report.copies - 2000 * 50_000 / report.tokens_available) <= 1 and report.most_repeats <= 2 and abs(report.tokens - 50_000) < 500
    other = M.mix(df, targets, total=50_000, seed=8).count()
    assert abs(other - report.copies) <= 1


def test_rates():
    targets = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 4), ("none", 0.1, 3)]
    rates = M.plan_rates(targets, {"a": 100, "b": 1000, "c": 100, "other": 5})
    assert rates["a"] == 2 and rates["none"] == 0 and abs(rates["b"] * 1000 / 200 - 0.6) < 1e-9
    capped = M.plan_rates(targets, {"a": 100, "b": 1000, "c": 100}, total=2000)
    assert capped["a"] == 2 and capped["c"] == 4 and capped["b"] == 1
    assert M.plan_rates([], {}) == {} and M.plan_rates(targets, {}) == dict.fromkeys(["a", "b", "c", "none"], 0.0)


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, s, " ".join("goods" for _ in range(rng.randint(0, 60)))) for i, s in enumerate(rng.choice(["big"] * 8 + ["mid"] * 3 + ["small", "unlisted"]) for _ in range(3000))]
    docs += [(9000, None, "text"), (9001, "big", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 2), ("small", 0.2, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in M.report(df, targets).collect()}
    assert set(report) == {"big", "mid", "small", "absent"} and report["absent"].tokens == 0
    for s, share in (("big", 0.4), ("mid", 0.4), ("small", 0.2)):
        assert abs(report[s].actual_share - share) < 0.01 and report[s].most_repeats <= report[s].max_repeats
    rows = M.mix(df, targets).collect()
    assert Counter(r.source for r in rows) == Counter({s: report[s].copies for s in ("big", "mid", "small")})
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)
    assert M.mix(df.limit(0), targets).count() == 0 and M.mix(df, targets.limit(0)).count() == 0


def test_token_counts(spark):
    enc = T.encoder(T.VOCABULARY)
    texts = ["cold store", "", None, "ünï ćødé", "<|endoftext|>", "a" * 50_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.n_tokens("t")).collect()]
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
