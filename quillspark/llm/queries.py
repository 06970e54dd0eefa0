"""The pN_ queries of the corpus-preparation operators: callables of (spark, directory) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import boilerplate, canonical, mixing, names, ocr, packing, pii, split, toxicity
from quillspark.sources.tables import read_table


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return split.oversized(read_table(spark, directory, "chunk_out"), "chunk_id")


def p1_pieces(spark: SparkSession, directory: str) -> DataFrame:
    chunks = read_table(spark, directory, "chunk_out").select("chunk_id", "source", "page_number", "chunk_seq", "content")
    return split.split_pieces(chunks)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return names.pairs(names.resolve(read_table(spark, directory, "entity").select("entity_id", "name")))


def p2_clusters(spark: SparkSession, directory: str) -> DataFrame:
    """Every entity with its cluster, and how many spellings the cluster has."""
    resolved = names.resolve(read_table(spark, directory, "entity").select("entity_id", "name"))
    return resolved.join(resolved.groupBy("cluster").agg(F.count("*").alias("spellings")), "cluster").select("entity_id", "cluster", "spellings")


def p2_customers(spark: SparkSession, directory: str) -> DataFrame:
    """Every intake row with the cluster of its customer as typed; null where no customer is named."""
    typed = read_table(spark, directory, "intake").select("intake_id", "customer")
    entities = read_table(spark, directory, "entity").select("entity_id", F.col("name").alias("customer"))
    resolved = names.resolve(entities, "entity_id", "customer")
    return typed.join(entities.join(resolved, "entity_id"), "customer", "left").select("intake_id", "customer", "cluster")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return pii.found(read_table(spark, directory, "page_in").select("row_id", "content")).select("row_id", "kind", "start_pos")


def p3_redacted(spark: SparkSession, directory: str) -> DataFrame:
    return pii.redact(read_table(spark, directory, "page_in").select("row_id", "source", "page_number", "content"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return boilerplate.repeated_lines(read_table(spark, directory, "chunk_out").select("chunk_id", "source", "content")).select("chunk_id", "line_no")


def p4_clean(spark: SparkSession, directory: str) -> DataFrame:
    return boilerplate.remove_repeated(read_table(spark, directory, "chunk_out").select("chunk_id", "source", "content"))


def p4_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """The boilerplate blocks of each source: its repeated wordings, their support and the block they belong to."""
    found = boilerplate.matches(read_table(spark, directory, "chunk_out"), "chunk_id", "source", "content", boilerplate.BoilerplateConfig())
    return boilerplate.blocks(found, boilerplate.BoilerplateConfig())


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return ocr.found(read_table(spark, directory, "page_in").select("row_id", "source", "page_number", "content", "ocr"))


def p5_repaired(spark: SparkSession, directory: str) -> DataFrame:
    return ocr.repair(read_table(spark, directory, "page_in").select("row_id", "source", "page_number", "content", "ocr"))


def _forms(spark: SparkSession, directory: str) -> DataFrame:
    return canonical.written_forms(spark, read_table(spark, directory, "region_ref"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    names = read_table(spark, directory, "region_ref").select(F.col("name").alias("region"))
    typed = read_table(spark, directory, "intake").select("intake_id", "region").join(names, "region", "left_anti")
    mapped = canonical.map_values(typed, "region", _forms(spark, directory))
    return mapped.where(F.col("entry_id").isNotNull()).select("intake_id", F.col("entry_id").alias("region_id"))


def p6_mapping(spark: SparkSession, directory: str) -> DataFrame:
    """Every intake row with the entry its region means; region_id is null where no region was typed, 0 where none is meant."""
    mapped = canonical.map_values(read_table(spark, directory, "intake").select("intake_id", "region"), "region", _forms(spark, directory))
    names = read_table(spark, directory, "region_ref").select(F.col("region_id").cast("int").alias("entry_id"), F.col("name").alias("canonical"))
    return mapped.join(names, "entry_id", "left").select("intake_id", "region", F.col("entry_id").alias("region_id"), "canonical", "distance")


def p6_unmatched(spark: SparkSession, directory: str) -> DataFrame:
    return canonical.unmatched(read_table(spark, directory, "intake"), "region", _forms(spark, directory))


def p7_containers(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack(read_table(spark, directory, "documents"))


def p7_report(spark: SparkSession, directory: str) -> DataFrame:
    return packing.report(packing.pack(read_table(spark, directory, "documents")))


def p8_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mix(read_table(spark, directory, "documents"), read_table(spark, directory, "mix_target"))


def p8_report(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.report(read_table(spark, directory, "documents"), read_table(spark, directory, "mix_target"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.score(read_table(spark, directory, "documents").select("doc_id", "text")).where("toxic").select("doc_id")


def p9_scores(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.score(read_table(spark, directory, "documents").select("doc_id", "source", "text"))


def p9_rates(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.rates(toxicity.score(read_table(spark, directory, "documents").select("source", "text")))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_clusters, p2_customers, p3_found, p3_redacted, p4_found, p4_clean, p4_blocks, p5_found, p5_repaired, p6_found, p6_mapping, p6_unmatched, p7_containers, p7_report, p8_mix, p8_report, p9_found, p9_scores, p9_rates)}
