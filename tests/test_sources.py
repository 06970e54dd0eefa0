"""Sources, sinks and the incremental ingest."""

from pyspark.sql import functions as F

from quillspark.config import PAGE_BREAK
from quillspark.sources import pages as P
from quillspark.streaming import ingest


def test_scan_and_extract(spark, tmp_path):
    for name, body in (("a.pdf", b"one\ftwo"), ("B.PDF", b" "), ("c.pdf", b"boom"), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(body)

    def extractor(data):
        if data == b"boom":
            raise ValueError("broken file")
        return [{"text": t} for t in data.decode().split("\f")] if data.strip() else None

    files = P.scan_pdfs(spark, str(tmp_path))
    assert files.count() == 3
    got = {(r.source, r.page_number): (r.ok, r.content) for r in P.extract_pages(files, extractor).collect()}
    assert got == {("a.pdf", 1): (True, "one"), ("a.pdf", 2): (True, "two"), ("B.PDF", None): (False, None), ("c.pdf", None): (False, None)}


def test_choice_of_text(spark):
    rows = spark.createDataFrame([("short", "a longer scan"), ("short", "tiny"), ("x" * 60, "y" * 90), (None, "scan"), (None, None)], "d string, s string")
    assert [r[0] for r in rows.select(P.choose_text(F.col("d"), F.col("s"))).collect()] == ["a longer scan", "short", "x" * 60, "scan", ""]


def test_first_and_latest_pages(spark):
    schema = "row_id bigint, source string, page_number int, content string, loaded_at timestamp"
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", 1, "one", t), (2, "a", 1, "one again", t + dt.timedelta(1)), (3, "a", 6, "six", t), (4, "a", 2, None, None), (5, "a", 2, "two", None)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.row_id for r in P.latest_pages(df).collect()) == [2, 3, 5]
    assert P.first_pages(P.latest_pages(df)).first().text == "one again" + PAGE_BREAK + "two"


def test_names(spark, tmp_path):
    rows = spark.createDataFrame([(" Acme ",), ("",), (None,), ("Unknown Customer",), ("Acme",), ("Beta",)], "customer string")
    path = str(tmp_path / "names")
    P.write_names(P.known_names(rows, "customer"), path)
    assert [r.name for r in P.read_names(spark, path).orderBy("name").collect()] == ["Acme", "Beta"]
    assert P.read_names(spark, str(tmp_path / "none")).count() == 0
    props = spark.sql("SELECT map('a', '1', 'b', CAST(NULL AS STRING)) AS p")
    assert props.select(P.scalar_properties(F.col("p"))).first()[0] == {"a": "1"}


def test_stream(spark, tmp_path):
    import datetime as dt

    schema = "row_id bigint, source string, page_number int, content string, loaded_at timestamp"
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", 1, "text", t), (2, "a", 1, "text", t + dt.timedelta(hours=2)), (3, "a", 2, "other words", t)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = ingest.deduplicate(ingest.read_page_stream(spark, str(tmp_path / "in"), schema))
    ingest.write_pages(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    sums = ingest.loads_per_window(spark.createDataFrame(rows, schema)).first()
    assert (sums.pages, sums.words) == (3, 4)


def test_ocr_and_properties(spark, tmp_path):
    for name, body in (("a.pdf", b"short\fa text that is long enough to stand by itself, as it has fifty letters"), ("b.pdf", b"none")):
        (tmp_path / name).write_bytes(body)

    def ocr(data, number):
        if data == b"none":
            raise ValueError("no image")
        return "read from the image"

    pages = P.extract_pages(P.scan_pdfs(spark, str(tmp_path)), lambda d: [{"text": t, "rotated": 90, "boxes": [1], "none": None} for t in d.decode().split("\f")], ocr)
    got = {(r.source, r.page_number): r for r in pages.collect()}
    assert got["a.pdf", 1].content == "read from the image" and got["a.pdf", 1].ocr and got["a.pdf", 1].props == {"rotated": "90"}
    assert not got["a.pdf", 2].ocr and got["b.pdf", 1].content == "none"


def test_parties(spark):
    rows = [
        (1, "a", 1, "Agreement between (1) Polar Quay Ltd, a keeper; and (2) Acme Foods and Sons Pty Ltd, a company"),
        (2, "a", 2, "The store is in Poland. Acme Foods and Sons Pty Ltd has its seat in New Zealand."),
        (3, "b", 1, None),
        (4, "c", 2, "no first page, Acme in Poland"),
        (5, "d", 1, "between Beta Inc and Polar Quay Ltd"),
    ]
    got = P.detect_parties(spark.createDataFrame(rows, "row_id bigint, source string, page_number int, content string"), P.first_party(("polar quay",)), P.nearest_country(["Poland", "New Zealand"]))
    assert {r.source: (r.customer, r.region) for r in got.collect()} == {"a": ("Acme Foods and Sons", "New Zealand"), "b": ("Unknown Customer", "Unknown Region"), "c": ("Unknown Customer", "Unknown Region"), "d": ("Beta", "Unknown Region")}


def test_files_to_chunks(spark, tmp_path):
    from quillspark.plans import documents

    (tmp_path / "a.pdf").write_bytes(b"between Acme Foods Ltd and others\f" + b"5.1 Fees for storage of goods\n" + b"word " * 360)
    chunks = documents.load_documents(spark, str(tmp_path), lambda d: [{"text": t, "size": 1.5} for t in d.decode().split("\f")], customer=P.first_party(), region=P.nearest_country(["Poland"]))
    got = chunks.orderBy("page_number", "chunk_seq").collect()
    assert [(r.customer, r.clause, r.whole_page, r.props) for r in got] == [("Acme Foods", "N/A", True, {"size": "1.5"}), ("Acme Foods", "5.1", False, {"size": "1.5"})]
    assert documents.load_documents(spark, str(tmp_path), lambda d: None).count() == 0
    parser = documents.DocumentParser()
    assert set(parser.extract_financials(chunks)) == {"tables", "formulas"} and parser.build_references(chunks).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import types

    from quillspark.plans import lineage

    fake = types.SimpleNamespace(sparkContext=types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", getConf=lambda: {}), conf={})
    import pytest

    with pytest.raises(ValueError, match="share"):
        lineage.ensure_checkpoint_dir(fake)
