"""Chunks against hand-traced cases; the parallel stack against one sequential pass."""

import random

import pytest

from quillspark.config import RetrievalConfig
from quillspark.operators import chunking as C

CFG = RetrievalConfig()
SCHEMA = "row_id bigint, source string, page_number int, content string, customer string, region string"


def chunks_of(text, cfg=CFG):
    return C.PageParser(cfg).parse(text)


def test_header_list_spurious_and_header_only():
    text = "1.1 Storage fees apply monthly and are\npayable within thirty days of invoice\n(a) by bank transfer; or\n12\n2. Term\n2.1 The term is five years."
    chunks, floor, stack = chunks_of(text)
    assert len(chunks) == 1
    body, low, open_ = chunks[0]
    assert body.split("\n") == [text.split("\n")[i] for i in (0, 1, 2, 4)]
    assert open_ == [("1.1", "Storage fees apply monthly and are payable within thirty days of invoice", 1)]
    assert stack == [("2.1", "The term is five years.", 1)] and floor == 1


@pytest.mark.parametrize("last, expected", [(None, [7, 2]), ("plain word " * 25, [7, 3]), ("5.1 Real header " + "w " * 47, [7, 3])])
def test_token_split_moves_the_tail(last, expected):
    lines = [f"l{i} " + "word " * 49 for i in range(9)] + ([last] if last else [])
    chunks, _, stack = chunks_of("\n".join(lines))
    assert [len(c[0].split("\n")) for c in chunks] == expected
    assert stack == []  # a header right after a split is content
    assert "\n".join(c[0] for c in chunks).split() == "\n".join(lines).split()


def test_stack():
    text = "\n".join(f"{c} Some heading words\nbody of the clause here.\n(x) item of it" for c in ("4.1", "4.1(a)", "4.1(b)", "5.1"))
    chunks, _, _ = chunks_of(text)
    assert [[x[0] for x in c[2]] for c in chunks] == [["4.1"], ["4.1", "4.1(a)"], ["4.1", "4.1(b)"], ["5.1"]]


def test_rejected_headers_stay_inside():
    chunks, _, _ = chunks_of("4.2 Notice is given in writing as follows here and now\n10 (Service levels) apply\n12 months prior notice is needed for all of this")
    assert len(chunks) == 1 and chunks[0][2][0][0] == "4.2"


def _sequential(pages, cfg):
    """Page after page with one stack per file, the plain way."""
    stacks, out = {}, {}
    for row_id, source, _, content in sorted(pages, key=lambda p: (p[1], p[2], p[0])):
        stack = stacks.get(source, [])
        if len((content or "").split()) <= cfg.page_gate_words:
            if (content or "").strip():
                out[row_id] = [(content, [x[0] for x in stack])]
            continue
        chunks, floor, own = C.PageParser(cfg).parse(content)
        out[row_id] = [(c, [x[0] for x in stack if x[2] < f] + [x[0] for x in s]) for c, f, s in chunks]
        stacks[source] = [x for x in stack if x[2] < floor] + own
    return out


def test_stack_over_pages_equals_sequential_pass(spark):
    rng = random.Random(4)
    cfg = RetrievalConfig(page_gate_words=12, chunk_words=60)
    pages = []
    for source in ("a", "b", "c"):
        for number in range(1, 12 if source != "a" else 600):
            lines = []
            for _ in range(rng.randint(0, 6)):
                clause = ".".join(str(rng.randint(1, 9)) for _ in range(rng.randint(1, 4))) + rng.choice(["", "(a)"])
                lines.append(rng.choice([f"{clause} Heading of words that goes on for quite some time here", "(a) an item of the list which is long", "plain text " * 6, "", "17"]))
            pages.append((len(pages) + 1, source, number, "\n".join(lines)))
    df = spark.createDataFrame([(*p, "Acme", None) for p in pages], SCHEMA)
    got = {}
    for r in C.chunk_pages(df, cfg).orderBy("row_id", "chunk_seq").collect():
        got.setdefault(r.row_id, []).append((r.content, r.hierarchy))
    assert got == {k: v for k, v in _sequential(pages, cfg).items() if v}


def test_edge_cases(spark):
    rows = [(1, "a", 1, None, None, None), (2, "a", 2, "", None, None), (3, None, None, "short page", None, None), (4, "b", 1, "word " * 400, None, None), (4, "b", 1, "word " * 400, None, None), (5, "b", 2, "w" * 200_000, None, None)]
    got = C.chunk_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.row_id for r in got} == {3, 4, 5}
    assert next(r for r in got if r.row_id == 3).clause == "N/A" and next(r for r in got if r.row_id == 4).clause is None
    assert C.chunk_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_gate_and_headers(spark):
    df = spark.createDataFrame([(1, "a", 1, "w " * 350, None, None), (2, "a", 2, "w " * 351, None, None), (3, "a", 3, None, None, None)], SCHEMA)
    assert [(r.n_words, r.whole_page) for r in C.page_gate(df).orderBy("row_id").collect()] == [(350, True), (351, False), (0, True)]
    assert C.header_lines(df).count() == 0


def test_a_page_that_cannot_be_parsed_stays_whole(spark):
    class Broken(C.PageParser):
        def parse(self, text):
            if "boom" in text:
                raise ValueError(text[:10])
            return super().parse(text)

    cfg = RetrievalConfig(page_gate_words=5)
    rows = [(1, "a", 1, "4.1 Heading of the clause\nsome words that follow it here", "Acme", None, "x"), (2, "a", 2, "boom " * 9, "Acme", None, "y"), (3, "a", 3, "short page", "Acme", None, None)]
    pages = spark.createDataFrame(rows, SCHEMA + ", note string")
    got = C.chunk_pages(pages, cfg, Broken).orderBy("row_id").collect()
    assert [(r.row_id, r.clause, r.hierarchy, r.whole_page, r.note) for r in got] == [(1, "4.1", ["4.1"], False, "x"), (2, "4.1", ["4.1"], True, "y"), (3, "4.1", ["4.1"], True, None)]


def test_emphasis(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import text as T

    cases = {"**bold**": "bold", "* *x* *": "*x*", "_a*": "_a*", " **_x_** ": "x", "**": "", "*": "*", "": "", "plain": "plain"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.strip_emphasis(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases and all(C._title([k], None, CFG) == v for k, v in cases.items())
