"""The driver contract on the smallest tables; the rest must work without the optional subpackage."""

from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "pos", "chunk_id", "source", "page_number", "score", "citation"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["scan_page_profile", "hierarchical_chunks", "hybrid_ask_by_customer", "rrf_fusion", "header_parse", "title_cleanup", "name_normalize", "sparse_topn", "rerank_blend", "reference_closure", "trace_tags", "smart_select"])
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from quillspark.plans import catalog

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rows = lambda frame: sorted(map(repr, frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(catalog.ORACLE[name]).df())


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[1] / "quillspark"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quillspark.llm" not in path.read_text(), path
