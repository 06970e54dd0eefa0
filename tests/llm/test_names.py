from itertools import combinations

from quillspark.llm import names as N

GROUPS = [
    ["Baganatrel Cold Logistics and Sons", "baganartel cold logistics", "bagantarelcoldlogistics & sons", "Baganatrel Cold Log. + Sons B.V.", "Cold Logistics, Baganatrel and Sons Ltd", "Baga natrel Cold Logistics", "Baganatrel Cold Logistics t/a Baganatrel Ltd"],
    ["Baganatrel Meats Manufacturing Ltd", "MEATS, BAGANATREL MANUF.", '"Bagantrel Meats Mfg"'],
    ["Costefiker Meats Australia Ltd", "Coistefiker Meats Aust.", "Costefiker Meats (Australia)"],
    ["Costefiker Meats Canada", "Costefiker Meats CA Ltd."],
    ["Brarebacun Fresh Produce", "Brarebacun F.P. B.V.", "The Brarebacun", "Brarebacun F.P., Limited"],
    ["Edward Katherine Cizumasal", "Cizumasal, Ted K.", "E. Katherine Cizumaal", "NED KATHERINE CIZNUMASAL", "Cizumásal, E K, Dr"],
    ["Katherine Luhopibror", "K. Luhopibror"],
    ["Patricia Luhopibror", "LUHOPIBROR, PATRICIA, DR", "Mr Trish Luhopibror", "P. Luopibror", "luhopibror pat"],
    ["???"],
    [""],
]


def test_links(spark):
    rows = [(k * 100 + i, n) for k, group in enumerate(GROUPS) for i, n in enumerate(group)] + [(5000, None)]
    df = spark.createDataFrame(rows, "entity_id bigint, name string")
    resolved = N.resolve(df)
    cluster = {r.entity_id: r.cluster for r in resolved.collect()}
    assert set(cluster) == {i for i, n in rows if n is not None}
    for (a, na), (b, nb) in combinations([r for r in rows if r[1] is not None], 2):
        assert (cluster[a] == cluster[b]) == (a // 100 == b // 100), (na, nb)
    pairs = {(r.entity_id_1, r.entity_id_2) for r in N.pairs(resolved).collect()}
    assert pairs == {(a, b) for a, b in combinations(sorted(cluster), 2) if a // 100 == b // 100}


def test_ambiguous_stay_alone(spark):
    df = spark.createDataFrame([(1, "Tovarix Meats Ltd"), (2, "Tovarix Dairy Ltd"), (3, "Tovarix"), (4, "Alexander Kirastetas"), (5, "Andrew Kirastetas"), (6, "A. Kirastetas")], "entity_id bigint, name string")
    assert len({r.cluster for r in N.resolve(df).collect()}) == 6


def test_edges(spark):
    schema = "entity_id bigint, name string, cluster int, label string, core string"
    df = spark.createDataFrame([(1, "Acmetor Foods", 9, "x", "y"), (2, "Acmetor Foods", 9, "x", "y"), (3, "a " * 3000, 1, "", ""), (4, "x" * 3000, 1, "", "")], schema)
    got = {r.entity_id: r.cluster for r in N.resolve(df).collect()}
    assert got[1] == got[2] == 1 and len(got) == 4
    assert N.resolve(df.limit(0)).count() == 0 and N.pairs(N.resolve(df.limit(0))).count() == 0


def test_chains_merge_over_rounds(spark):
    """Each spelling is one slip from the next only; the union of spellings carries the link on."""
    names = ["Bortelan Foods", "Bortelam Foods", "Bortolam Foods", "Bartolam Foods", "Bartolem Foods"]
    df = spark.createDataFrame(list(enumerate(names)), "entity_id bigint, name string")
    assert {r.cluster for r in N.resolve(df).collect()} == {0}


def clusters(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "entity_id bigint, name string")
    got = {r.entity_id: r.cluster for r in N.resolve(df).collect()}
    return [got[i] for i in range(len(names))]


def test_what_only_looks_alike_stays_apart(spark):
    names = ["Anna Abcdefg", "Anna Bcdefga", "Abcdefgh Foods", "Bcdefgha Foods", "John Li", "John Lo", "Mary Wood", "Mary Wold", "John A. Smith", "John B. Smith"]
    assert clusters(spark, names) == list(range(10))


def test_initials_unite_and_carry_on(spark):
    # the middle initial comes with one spelling and decides for another; a name without it joins the only one it can mean
    assert clusters(spark, ["Charles James Stimofokol", "Charles Stimofokal", "C. J. Stimofokol", "Chuck J. Stimofokol"]) == [0, 0, 0, 0]
    assert clusters(spark, ["John A. Smithson", "John B. Smithson", "John Smithson"]) == [0, 1, 2]


def test_one_slip(spark):
    from pyspark.sql import functions as F

    cases = [("abcde", "abcde", True), ("abcde", "abde", True), ("abcde", "abxde", True), ("abcde", "abdce", True), ("abcde", "bcdea", False), ("abcde", "badce", False), ("abcde", "abc", False), ("aabb", "abab", True), ("x" * 60, "x" * 61, True)]
    got = spark.createDataFrame(cases, "a string, b string, want boolean").select("a", "b", "want", N.one_slip(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.got == r.want == N._one_slip(r.a, r.b) for r in got), got


def test_near_spellings_are_all_found(spark):
    import random

    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.choice((3, 4, 5, 6, 7, 40, 41, 42, 43, 44)))) for _ in range(150)}
    words |= {w[:i] + "z" + w[i + 1 :] for w in list(words)[:60] for i in (0, len(w) // 2)} | {w[1] + w[0] + w[2:] for w in list(words)[:40]} | {w[:20] + w[21] + w[20] + w[22:] for w in words if len(w) > 40}
    base = spark.createDataFrame([("org", w) for w in sorted(words)], "kind string, core string")
    got = {(r.core, r.other) for r in N.near_cores(base).collect()}
    want = {(a, b) for a in words for b in words if a == b or min(len(a), len(b)) >= N.LEAST_CORE and N._one_slip(a, b)}
    assert got == want


def test_one_frequent_surname_makes_no_pairs(spark):
    """20,000 records of one surname: what is joined grows with the spellings, not with the records."""
    rows = [(i, f"{g} {'ABCDEFGH'[i % 8]}. Smithson") for i, g in ((i, ["John", "Mary", "Anna", "Peter"][i // 8 % 4]) for i in range(20_000))] + [(30_000, "J. Smithson"), (30_001, "John Smithsen")]
    got = {r.entity_id: r.cluster for r in N.resolve(spark.createDataFrame(rows, "entity_id bigint, name string")).collect()}
    assert len({got[i] for i in range(20_000)}) == 32 and got[30_000] == 30_000 and got[30_001] == 30_001


def test_a_name_of_any_length(spark):
    assert clusters(spark, ["q" * 100_000 + " Foods", "q" * 99_999 + " Foods", "b " * 50_000]) == [0, 0, 2]


def test_rounds_take_few_jobs_of_the_driver(spark):
    """Every exchange is a job with a thread of the driver: 143 of them for these names, and more for a table, filled its memory before."""
    names = ["Bortelan Foods", "Bortelam Foods", "Bortolam Foods", "Bartolam Foods", "Bartolem Foods", "Bartolem", "Anna Smithson", "A. Smithson"]
    df = spark.createDataFrame(list(enumerate(names)), "entity_id bigint, name string")
    spark.sparkContext.setJobGroup("few jobs", "")
    try:
        assert [r.cluster for r in N.resolve(df).orderBy("entity_id").collect()] == [0, 0, 0, 0, 0, 0, 6, 6]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert jobs < 110, jobs
