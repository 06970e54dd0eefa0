from quillspark.llm import boilerplate as B

SCHEMA = "chunk_id bigint, source string, content string"


def corpus():
    rows = []
    for k in range(40):
        lines = [f"Compiled for Acme by the records room; last checked {k % 28 + 1} May 20{10 + k % 10}", f"{k}.1 Unique heading {chr(97 + k % 26) * 5}", "word " * 5 + chr(97 + k % 26) * 7 + chr(97 + k // 26) * 9, "", "Share this clause: link | mail"]
        if k == 3:
            lines[0] = "Compiled for Acme by the rccords room; last checked 2"  # one misread word
        if k == 4:
            lines[0] = "COMPILED  FOR ACME, BY THE RECORDS ROOM; LAST CHECKED 2024-01-01"
        if k % 6 == 0:
            lines.append("Rare note on the side of it")  # seven rows, under the limit
        rows.append((k, "a", "\n".join(lines)))
    rows += [(100 + k, "b", "Same line here again") for k in range(7)]
    rows += [(200 + k, "c", "Line of a big source\n" + f"text {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}") for k in range(9)] + [(300 + k, "c", f"other {chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(91)]
    rows += [(900, None, "Same line here again"), (901, "a", None), (902, "a", "")]
    return rows


def test_lines(spark):
    got = {(r.chunk_id, r.line_no) for r in B.repeated_lines(spark.createDataFrame(corpus(), SCHEMA)).collect()}
    assert got == {(k, n) for k in range(40) for n in (1, 5)}  # source c: nine rows are less than a tenth


def test_blocks_join_consecutive_lines(spark):
    rows = [(k, "s", "First line of the notice\nsecond line of the notice\n" + chr(97 + k) * 6 + "\nalone at the foot of it") for k in range(12)]
    found = B.matches(spark.createDataFrame(rows, SCHEMA), "chunk_id", "source", "content", B.BoilerplateConfig())
    blocks = {r.node: r.block for r in B.blocks(found, B.BoilerplateConfig()).collect()}
    assert len(set(blocks.values())) == 2 and blocks["firstlineofthenotice"] == blocks["secondlineofthenotice"]


def test_removal_and_edges(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    clean = {r.chunk_id: r for r in B.remove_repeated(df).collect()}
    assert len(clean) == len(corpus())
    assert clean[0].content.split("\n")[0].startswith("0.1 Unique") and clean[0].n_removed == 2
    assert clean[901].content is None and clean[902].content == "" and clean[900].content == "Same line here again"
    twice = df.unionByName(df)  # every row delivered again: supports double, source b passes
    assert {r.chunk_id for r in B.repeated_lines(twice).collect()} >= {100}
    assert B.repeated_lines(df.limit(0)).count() == 0
    odd = df.withColumnRenamed("source", "n_removed").selectExpr("chunk_id", "n_removed", "content", "'a' AS source", "'z' AS node")
    assert B.remove_repeated(odd).count() == len(corpus())


def test_a_chain_of_near_wordings_loses_none(spark):
    """B is near A and C near B, but C not near A: B gives way to A, and C stays, as B does not."""
    a, b, c = "the quick notice of the harbour", "the quick notize of the harbouz", "the quick notize of thz harbouzq"
    rows = [(k, "s", a) for k in range(30)] + [(100 + k, "s", b) for k in range(20)] + [(200 + k, "s", c) for k in range(12)]
    lines = B.repeated_lines(spark.createDataFrame(rows, SCHEMA), cfg=B.BoilerplateConfig(min_rows=8, min_share=0.1))
    assert {r.chunk_id for r in lines.collect()} == {r[0] for r in rows}


def test_wording_has_letters_only(spark):
    from pyspark.sql import functions as F

    cases = {"© Acme 2024": "acme", "1 Notice": "notice", "(a) May 3, June: Été\n\n7 x": "aété||x", "march": "", "marching": "marching", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.array_join(B.wordings(F.col("t")), "|").alias("w")).collect()
    assert {r.t: r.w for r in got} == cases
