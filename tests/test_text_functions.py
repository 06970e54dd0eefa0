"""Column functions against plain Python on edge cases, and the hand-traced cases of the grammar."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import answer as A
from quillspark.functions import naming
from quillspark.functions import text as T


def column(spark, values, expression, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expression(F.col("v"))).collect()]


TEXTS = ["", " ", "one", "a\tb\nc", "a\x0bb\x1cc d　e\xa0f", "x " * 5000, None, "line\r\nnext\rlast\n", "\n\n", "a b\x85c"]


def test_word_count_is_that_of_split(spark):
    assert column(spark, TEXTS, T.word_count) == [None if t is None else len(t.split()) for t in TEXTS]


def test_lines_are_those_of_splitlines(spark):
    got = column(spark, TEXTS, T.split_lines)
    assert got == [None if t is None else t.splitlines() for t in TEXTS]


@pytest.mark.parametrize(
    "line, clause, title, valid",
    [
        ("12 months prior notice", "12", "months prior notice", False),
        ("10 (Procedure)", "10", "(Procedure)", False),
        ("4 Part 1", "4", "Part 1", False),
        ("12 Term", "12", "Term", True),
        ("1.1 lower case start", "1.1", "lower case start", True),
        ("  Clause 3.2(a)  Fees", "3.2(a)", "Fees", True),
        ("4. Term", "", "", False),
        ("plain text", "", "", False),
    ],
)
def test_header_grammar(spark, line, clause, title, valid):
    row = spark.createDataFrame([(line,)], "v string").select(T.header_id(F.col("v")).alias("c"), T.header_title(F.col("v")).alias("t")).select("c", "t", T.is_valid_clause(F.col("c"), F.col("t")).alias("ok")).first()
    assert (row.c, row.t, row.ok) == (clause, title, valid)


def test_levels_and_noise(spark):
    assert column(spark, ["1", "1.1", "1.1(a)", "2.3.4"], T.clause_level) == [0, 1, 2, 2]
    assert column(spark, ["", "  ", "12", "DocuSign Envelope ID: 1", "(a)", "text 12"], T.is_spurious) == [True, True, True, True, False, False]
    assert column(spark, ["(a) x", "b) y", "1. z", "Term. q", "plain words"], T.is_list_item) == [True, True, True, True, False]


def test_titles(spark):
    assert column(spark, ["Fees ,;:", "Fees", None], T.clean_title_end) == ["Fees", "Fees", None]
    assert column(spark, ["**_x_**", "*a", "__", "_ *b* _", "plain"], T.strip_emphasis) == ["x", "*a", "", "*b*", "plain"]  # blanks inside the marks end the peeling
    assert column(spark, [" ".join("abcdef")], lambda c: T.truncate_title(c, 4)) == ["a b c d..."]
    pairs = spark.createDataFrame([("Fees and", "more words here"), ("Fees and", "(a) item"), ("Fees", "more"), ("Fees or:", "x " * 20), ("", "x")], "t string, n string")
    got = [r[0] for r in pairs.select(T.extend_title(F.col("t"), F.col("n"))).collect()]
    assert got == ["Fees and more words here", "Fees and", "Fees", "Fees or: " + " ".join("x" * 10), ""]


def test_references(spark):
    text = "see Clause 5.2(a) of, Clause 7.1. Then clause 9, Schedule 4 Part 3. Clause 5.1"
    found = spark.createDataFrame([(text,)], "v string").select(F.explode(T.references(F.col("v"))).alias("r")).select(T.normalize_reference(F.col("r"))).collect()
    assert [r[0] for r in found] == ["5.2", "7.1", "9", "Schedule-4-3", "5.1"]


def test_names(spark):
    assert column(spark, [' "Acme Foods Pty Ltd." ', "Zinc", None, "", "unknown customer", "Nowel Sp. z o.o."], naming.normalize_customer) == ["Acme Foods", "Z", "Unknown Customer", "Unknown Customer", "Unknown Customer", "Nowel"]
    assert column(spark, ["USA", "uk", " Chile. ", None, "unknown region"], naming.standardize_country) == ["United States", "United Kingdom", "Chile", "Unknown Region", "Unknown Region"]
    assert column(spark, ["Acme Foods Pty Ltd", "Ltd", "", None], naming.keyword) == ["acme", "ltd", None, None]
    providers = ("own store",)
    assert column(spark, ["Own Store"], lambda c: naming.normalize_customer(c, providers)) == ["Unknown Customer"]


def test_answers(spark):
    assert column(spark, ["```python\nx\n```", "x", ""], A.without_fences) == ["x", "x", ""]
    assert column(spark, ["Error: x", "Could not find it", "fine"], A.is_error) == [True, True, False]
    assert column(spark, ["abc", ""], lambda c: A.preview(c, 2)) == ["ab...", ""]
    row = spark.createDataFrame([("f.pdf", 2, None, None, ["1", "1.1"])], "s string, p int, c string, k string, h array<string>")
    assert row.select(A.citation(*map(F.col, "spckh"))).first()[0] == "f.pdf (Customer: Unknown Customer) - Page 2 (Section: 1.1)"
    assert row.select(A.prompt_header(*map(F.col, "spck"))).first()[0] == "Source: f.pdf | Page: 2 | Customer: Unknown | Clause: N/A\n---\n"


def test_html(spark):
    assert column(spark, ["<p>a &amp; b</p><script>x()</script>", "a <br/> b", None], T.plain_html) == ["a & b", "a b", None]


def test_tables_and_formulas(spark):
    grid = "5.1 Fees\n+---+\n| a |\n+---+\nrest"
    from quillspark.operators import graph

    chunk = spark.createDataFrame([(1, grid, "5.1", "f")], "chunk_id bigint, content string, clause string, source string")
    row = graph.grid_tables(chunk).first()
    assert row.grid.startswith("+---+") and row.grid.endswith("+---+") and row.context.startswith("Clause 5.1")
    formula = r"\text{Balancing Payment} = \left(\frac{A}{B} \times $ 2,600,000\right) - $ 2,600,000"
    assert graph.formulas(chunk.withColumn("content", F.lit("x " + formula + " y"))).first().formula == formula
