"""Pages as they come from an extractor: sources, fall-back between direct and scanned text, first pages, properties."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import PAGE_BREAK, UNKNOWN_CUSTOMER
from quillspark.functions.naming import normalize_customer, standardize_country
from quillspark.functions.text import strip

PAGE_SCHEMA = "source string, ok boolean, error string, page_number int, content string, ocr boolean, props map<string, string>"

#: (first page's text) -> name of the customer, empty or null where it has none
CustomerModel = Callable[[Column], Column]
#: (text of the first pages, customer) -> country
RegionModel = Callable[[Column, Column], Column]


def scan_pdfs(spark: SparkSession, directory: str) -> DataFrame:
    """(path, content) of the PDF files of a folder, not of its subfolders, in any case of the suffix; empty files are not listed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(directory).select("path", "content")


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[dict] | str | None], ocr: Callable[[bytes, int], str | None] | None = None, trigger: int = 50) -> DataFrame:
    """One row per page by a pluggable extractor of file bytes; a file that fails or gives nothing is one row with ok false.

    The extractor gives a list of pages with `text` or else `content`, or one string, which is page 1. Their other keys are
    properties: those with a string, number or boolean stay, as text. Where a page's text is shorter than the trigger, ocr
    is asked for the page (file bytes, number) and taken if it is strictly longer; if it fails, the direct text stands.
    """

    def scanned(data: bytes, number: int) -> str:
        try:
            return ocr(data, number) or ""
        except Exception:  # a page that cannot be read must not lose its file
            return ""

    def page(data: bytes, number: int, p: dict) -> tuple:
        direct = p.get("text", p.get("content")) or ""
        other = scanned(data, number) if ocr is not None and len(direct.strip()) < trigger else ""
        better = len(other.strip()) > len(direct.strip())
        props = {str(k): str(v) for k, v in p.items() if k not in ("text", "content") and isinstance(v, (str, int, float, bool))}
        return number, other if better else direct, better, props

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                name = str(path).rsplit("/", 1)[-1]
                try:
                    data = bytes(content)
                    pages = extractor(data)
                    pages = [{"text": pages}] if isinstance(pages, str) else pages or []
                    rows += [(name, True, None, *page(data, k, p)) for k, p in enumerate(pages, 1)] or [(name, False, "no pages", None, None, None, None)]
                except Exception as error:  # one bad file must not stop the others
                    rows.append((name, False, str(error)[:500], None, None, None, None))
            yield pd.DataFrame(rows, columns=["source", "ok", "error", "page_number", "content", "ocr", "props"])

    return files.mapInPandas(run, PAGE_SCHEMA)


def first_party(providers: tuple[str, ...] = ()) -> CustomerModel:
    """Default customer model: of the parties that a text lists after `between`, numbered (1), (2) or joined by `and`, the
    first with a capital letter and none of the (lower-case) providers' names in it."""

    def model(text: Column) -> Column:
        listed = F.regexp_extract(text, r"(?is)\bbetween\b[\s:]*(.{1,600})", 1)
        parts = F.when(listed.rlike(r"^\(\d\)"), F.split(listed, r"\(\d\)")).otherwise(F.split(listed, r"(?i)\band\b"))
        names = F.filter(F.transform(parts, lambda x: F.btrim(F.regexp_extract(x, r"^\s*([^,(;\n]*)", 1))), lambda x: x.rlike("[A-Z]"))
        foreign = lambda x: ~F.exists(F.array(*map(F.lit, providers)), lambda p: F.lower(x).contains(p)) if providers else F.lit(True)
        return F.get(F.filter(names, foreign), F.lit(0))

    return model


def nearest_country(countries: list[str], within: int = 200) -> RegionModel:
    """Default region model: the first of the given countries that follows the customer's name within so many characters of
    one line, before a semicolon."""
    places = "|".join(re.escape(c) for c in sorted(countries, key=len, reverse=True))

    def model(text: Column, customer: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)\Q"), customer, F.lit(rf"\E[^;\n]{{0,{within}}}?\b({places})\b"))
        return F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(1)), F.lit(""))

    return model


def detect_parties(pages: DataFrame, customer: CustomerModel, region: RegionModel, providers: tuple[str, ...] = (), most: int = 5) -> DataFrame:
    """(source, customer, region), one row per source: the cleaned customer on page 1, and where there is one, the country
    that the first pages give for it; else the unknown sentinels. pages has row_id, source, page_number, content."""
    opening = pages.where("page_number = 1").groupBy("source").agg(F.min_by(F.coalesce("content", F.lit("")), "row_id").alias("first"))
    named = pages.select("source").distinct().join(opening, "source", "left").select("source", normalize_customer(customer(F.coalesce("first", F.lit(""))), providers).alias("customer"))
    texts = first_pages(pages, most).select("source", "text")
    joined = named.join(texts, "source", "left")
    known = F.col("customer") != UNKNOWN_CUSTOMER
    return joined.select("source", "customer", standardize_country(F.when(known, region(F.coalesce("text", F.lit("")), F.col("customer")))).alias("region"))


def choose_text(direct: Column, scanned: Column, trigger: int = 50) -> Column:
    """Direct text, unless it is shorter than the trigger and the scanned text is strictly longer."""
    a, b = F.coalesce(direct, F.lit("")), F.coalesce(scanned, F.lit(""))
    return F.when((F.length(strip(a)) < trigger) & (F.length(strip(b)) > F.length(strip(a))), b).otherwise(a)


def latest_pages(pages: DataFrame) -> DataFrame:
    """The last delivery of every (source, page_number); the larger row_id decides between equal times."""
    newest = pages.groupBy("source", "page_number").agg(F.max(F.struct(F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0))).alias("t"), "row_id")).alias("_newest"))
    return pages.join(newest.select(F.col("_newest.row_id").alias("row_id")), "row_id", "left_semi")


def first_pages(pages: DataFrame, most: int = 5) -> DataFrame:
    """(source, n_pages, text): the first pages of each source, joined in page order. At most `most` rows a source meet."""
    few = pages.where(F.col("page_number").between(1, most))
    joined = F.array_sort(F.collect_list(F.struct("page_number", "row_id", F.coalesce("content", F.lit("")).alias("text"))))
    return few.groupBy("source").agg(joined.alias("p")).select("source", F.size("p").alias("n_pages"), F.array_join(F.transform("p", lambda x: x.text), PAGE_BREAK).alias("text"))


def scalar_properties(props: Column) -> Column:
    return F.map_filter(props, lambda _, v: v.isNotNull())


def known_names(rows: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed names, without blanks and the unknown sentinel."""
    name = F.trim(F.col(column))
    return rows.select(name.alias("name")).where((F.col("name") != "") & (F.col("name") != UNKNOWN_CUSTOMER)).distinct()


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary of names, one a line; empty where the file is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "name string")
    return known_names(spark.read.text(path), "value")


def write_names(names: DataFrame, path: str) -> None:
    """Overwrite a dictionary of names, sorted."""
    names.select("name").distinct().orderBy("name").coalesce(1).write.mode("overwrite").text(path)
