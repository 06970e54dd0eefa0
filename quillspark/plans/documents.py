"""From files to chunks, and the parser as one object."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import UNKNOWN_CUSTOMER, UNKNOWN_REGION, RetrievalConfig
from quillspark.operators import chunking, graph
from quillspark.plans.lineage import materialize
from quillspark.sources import pages as P


def load_pages(
    spark: SparkSession,
    directory: str,
    extractor: Callable[[bytes], list[dict] | str | None],
    ocr: Callable[[bytes, int], str | None] | None = None,
    customer: P.CustomerModel | None = None,
    region: P.RegionModel | None = None,
    providers: tuple[str, ...] = (),
    cfg: RetrievalConfig = RetrievalConfig(),
) -> DataFrame:
    """(row_id, source, page_number, content, ocr, props, customer, region) of all PDF files of a folder, written once, as
    extraction is the dearest step. Files that fail have no page here (see extract_pages)."""
    extracted = P.extract_pages(P.scan_pdfs(spark, directory), extractor, ocr, cfg.ocr_trigger).where("ok")
    pages = materialize(extracted.select(F.monotonically_increasing_id().alias("row_id"), "source", "page_number", "content", "ocr", "props"))
    if customer is None:
        return pages.withColumns({"customer": F.lit(UNKNOWN_CUSTOMER), "region": F.lit(UNKNOWN_REGION)})
    none = lambda text, name: F.lit(None).cast("string")
    return pages.join(P.detect_parties(pages, customer, region or none, providers, cfg.region_pages), "source", "left")


def load_documents(spark: SparkSession, directory: str, extractor: Callable[[bytes], list[dict] | str | None], cfg: RetrievalConfig = RetrievalConfig(), **models) -> DataFrame:
    """Chunks of all PDF files of a folder, with chunk_id; page properties stay in props. models as in load_pages."""
    chunks = materialize(chunking.chunk_pages(load_pages(spark, directory, extractor, cfg=cfg, **models), cfg))
    return chunks.select(F.monotonically_increasing_id().alias("chunk_id"), "*")


class DocumentParser:
    """The parsing operators behind one name."""

    def __init__(self, cfg: RetrievalConfig = RetrievalConfig()) -> None:
        self.cfg = cfg

    def parse(self, pages: DataFrame) -> DataFrame:
        return chunking.chunk_pages(pages, self.cfg)

    def extract_financials(self, chunks: DataFrame) -> dict[str, DataFrame]:
        return {"tables": graph.grid_tables(chunks), "formulas": graph.formulas(chunks)}

    def build_references(self, chunks: DataFrame) -> DataFrame:
        return graph.reference_edges(chunks)
