"""All named queries of the retrieval engine: callables of (spark, directory) -> DataFrame."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.config import RetrievalConfig
from quillspark.functions import answer as A
from quillspark.functions import naming
from quillspark.functions import text as T
from quillspark.functions.encode import hashed_vectors
from quillspark.operators import answers, chunking, entities, graph, index, ranking, retrieval, trace
from quillspark.plans import ask as asking
from quillspark.plans.lineage import ensure_checkpoint_dir, materialize
from quillspark.plans.oracle import ORACLE  # noqa: F401
from quillspark.sources import pages as P
from quillspark.sources.tables import read_table

CFG = RetrievalConfig()


def _pages(spark, d):
    return read_table(spark, d, "page_in")


def _chunks(spark, d):
    return read_table(spark, d, "chunk_out")


def _questions(spark, d):
    return read_table(spark, d, "question")


def _hits(spark, d):
    return read_table(spark, d, "hit").select("query_id", "chunk_id", "retriever", "score", "rnk")


def scan_page_profile(spark: SparkSession, d: str) -> DataFrame:
    n = T.word_count(F.col("content"))
    return _pages(spark, d).groupBy("source").agg(F.count("*").alias("pages"), F.coalesce(F.sum(n), F.lit(0)).alias("n_words"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n_chars"), F.count_if(F.col("content").isNull()).alias("n_null"))


def document_plain_text(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.plain_html(F.col("text")).alias("plain"))


def ocr_fallback_choice(spark, d):
    direct, scanned = F.when(~F.col("ocr"), F.col("content")), F.when(F.col("ocr"), F.col("content"))
    return _pages(spark, d).select("row_id", F.md5(P.choose_text(direct, scanned, CFG.ocr_trigger)).alias("text_md5"), F.length(P.choose_text(direct, scanned, CFG.ocr_trigger)).alias("n_chars"))


def latest_page_deliveries(spark, d):
    return P.latest_pages(_pages(spark, d)).select("row_id", "source", "page_number")


def first_n_pages_concat(spark, d):
    out = P.first_pages(_pages(spark, d), CFG.region_pages)
    return out.select("source", "n_pages", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def known_entities(spark, d):
    return P.known_names(read_table(spark, d, "intake"), "customer")


def page_gate(spark, d):
    return chunking.page_gate(_pages(spark, d), CFG).select("row_id", "n_words", "whole_page")


def line_explode_spurious(spark, d):
    lines = _pages(spark, d).select("row_id", F.posexplode(T.split_lines(F.col("content"))).alias("i", "line"))
    return lines.select("row_id", (F.col("i") + 1).alias("line_no"), T.is_spurious(F.col("line")).alias("spurious"))


def list_item_flag(spark, d):
    lines = _pages(spark, d).select("row_id", F.posexplode(T.split_lines(F.col("content"))).alias("i", "line"))
    return lines.where(T.is_list_item(F.col("line"))).select("row_id", (F.col("i") + 1).alias("line_no"))


def header_parse(spark, d):
    return chunking.header_lines(_pages(spark, d))


def title_cleanup(spark, d):
    title = F.col("clause_title")
    return _chunks(spark, d).where(title.isNotNull()).select("chunk_id", T.strip_emphasis(T.truncate_title(T.clean_title_end(title), 4)).alias("short_title"), T.clean_title_end(title).alias("clean_title"))


def title_extend(spark, d):
    following = F.element_at(T.split_lines(F.col("content")), 2)
    return _chunks(spark, d).where("clause_title IS NOT NULL AND content IS NOT NULL").where(F.size(T.split_lines(F.col("content"))) > 1).select("chunk_id", T.extend_title(F.col("clause_title"), following).alias("extended"))


def hierarchy_stack(spark, d):
    found = chunking.header_lines(_pages(spark, d)).where("valid")
    ordered = found.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("clause_id").alias("id"), "level"))).alias("h"))  # the headers of one page
    stacks = chunking.fold_hierarchy(F.transform("h", lambda x: F.struct(x.id.alias("id"), x.level.alias("level"))))
    return ordered.select("row_id", F.explode(F.arrays_zip(F.col("h").line_no.alias("line_no"), stacks.alias("s"))).alias("z")).select("row_id", "z.line_no", F.array_join("z.s", ">").alias("stack"))


def hierarchical_chunks(spark, d):
    chunks = chunking.chunk_pages(_pages(spark, d).select("row_id", "source", "page_number", "content", "customer", "region"), CFG)
    return chunks.withColumn("hierarchy", F.array_join("hierarchy", ">"))


EXCLUDED = ("litribigox beverages group", "lestuvolas foods and sons ltd", "polar quay storage")  # lower-case names that are no customers here


def name_normalize(spark, d):
    return read_table(spark, d, "intake").select("intake_id", naming.clean_name(F.col("customer")).alias("cleaned"), naming.normalize_customer(F.col("customer"), EXCLUDED).alias("normalized"))


def country_standardize(spark, d):
    return read_table(spark, d, "intake").select("intake_id", naming.standardize_country(F.col("region")).alias("country"))


def keyword_dictionary(spark, d):
    return entities.keyword_dictionary(read_table(spark, d, "entity"))


def entity_detect(spark, d):
    found = entities.detect_entities(_questions(spark, d), read_table(spark, d, "entity"))
    return found.select("query_id", F.array_join("names", "|").alias("names"), "filter_name")


def sparse_encode(spark, d):
    out = retrieval.postings(_chunks(spark, d), "chunk_id", "content")
    return out.select("chunk_id", "token", F.round("weight", 6).alias("weight"))


def sparse_topn(spark, d):
    chunks = _chunks(spark, d)
    return retrieval.sparse_top(retrieval.postings(_questions(spark, d), "query_id", "text"), retrieval.postings(chunks.select("chunk_id", "content").repartition("chunk_id"), "chunk_id", "content"), CFG.top_sparse, chunks.count())  # texts are sent, not tokens


def _vectors(spark, d):
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return v.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "embedding"), v


def dense_topk(spark, d):
    return retrieval.dense_top(*_vectors(spark, d), CFG.top_dense)


def dense_threshold(spark, d):
    return retrieval.dense_above(*_vectors(spark, d), CFG.min_similarity, CFG.top_dense).withColumn("similarity", F.round("similarity", 4))


def _keyed(spark, d):
    return ranking.keyed_hits(_hits(spark, d), _chunks(spark, d))


def rrf_fusion(spark, d):
    return ranking.fuse(_keyed(spark, d), CFG.rrf_k).select("query_id", "chunk_id", "rrf", "first_seen", "rnk")


def _blended(spark, d):
    """The scored pool of the table of hits, written once, as most of what follows reads it several times."""
    return materialize(asking.ranked_chunks(_questions(spark, d), _chunks(spark, d), _hits(spark, d), CFG))


def rerank_blend(spark, d):
    return _blended(spark, d).select("query_id", "chunk_id", "rrf", "rerank", F.round("combined", 6).alias("combined"), "rnk")


def fused_without_rerank(spark, d):
    """The path without a reranker: a pool of max_chunks, the fused score with its own threshold, K from it."""
    ranked = ranking.fused_only(ranking.fuse(_keyed(spark, d), CFG.rrf_k), CFG.max_chunks)
    return ranking.take_k(ranked, ranking.dynamic_k(ranked, "combined", CFG.rrf_threshold, CFG)).select("query_id", "chunk_id", "pos", F.col("combined").alias("score"))


def fixed_k(spark, d):
    """K with the dynamic choice switched off."""
    ranked = _blended(spark, d)
    return ranking.take_k(ranked, ranking.dynamic_k(ranked, "combined", CFG.combined_threshold, replace(CFG, dynamic_k=False))).select("query_id", "chunk_id", "pos")


def single_entity_filter(spark, d):
    detected = entities.detect_entities(_questions(spark, d), read_table(spark, d, "entity"))
    return ranking.filter_entity(_blended(spark, d), detected, _chunks(spark, d)).select("query_id", "chunk_id", "customer", "rnk")


def dynamic_k_combined(spark, d):
    return ranking.dynamic_k(_blended(spark, d), "combined", CFG.combined_threshold, CFG)


def dynamic_k_rrf(spark, d):
    return ranking.dynamic_k(ranking.fuse(_keyed(spark, d), CFG.rrf_k), "rrf", CFG.rrf_threshold, CFG)


def smart_select(spark, d):
    """Targets of a query: the two customers with most candidates in it."""
    blended = _blended(spark, d)
    owned = blended.join(_chunks(spark, d).select("chunk_id", "customer"), "chunk_id").where("customer IS NOT NULL AND customer <> 'Unknown Customer'")
    counts = owned.groupBy("query_id", "customer").agg(F.count("*").alias("n"))
    targets = counts.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n").desc(), "customer"))).where("r <= 2")
    return ranking.select_balanced(owned, targets, ranking.dynamic_k(blended, "combined", CFG.combined_threshold, CFG), CFG.per_entity)


def _chosen(ranked):
    return ranking.take_k(ranked, ranking.dynamic_k(ranked, "combined", CFG.combined_threshold, CFG))


def _selected(spark, d):
    return _chosen(_blended(spark, d))


def citations(spark, d):
    return answers.citations(_selected(spark, d), _chunks(spark, d))


def map_extract(spark, d):
    return answers.map_extract(_selected(spark, d), _questions(spark, d), _chunks(spark, d))


def reduce_concat(spark, d):
    return answers.reduce_concat(map_extract(spark, d))


def answer_questions(spark, d):
    ranked = _blended(spark, d)
    out = asking.answer_questions(_questions(spark, d), materialize(_chosen(ranked).select("query_id", "chunk_id", "pos")), _chunks(spark, d), cfg=CFG)
    return out.select("query_id", "answer", F.array_join("sources", "; ").alias("sources"), "is_error")


def explain_retrieval(spark, d):
    ranked = _blended(spark, d)
    return asking.explain_retrieval(_keyed(spark, d), ranked, _chosen(ranked)).withColumn("combined", F.round("combined", 6))


def answer_error_class(spark, d):
    answer = F.when(F.col("text").contains("?"), F.concat(F.lit("Error: "), F.col("text"))).otherwise(F.col("text"))
    return _questions(spark, d).select("query_id", A.is_error(answer).alias("is_error"))


def prompt_header_clean(spark, d):
    return answers.prompt_documents(_chunks(spark, d)).select("chunk_id", F.md5("document").alias("document_md5"), F.length("document").alias("n_chars"))


def debug_preview(spark, d):
    joined = _hits(spark, d).join(_chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    return joined.select("query_id", "retriever", "rnk", "chunk_id", A.preview(F.col("content"), CFG.preview_chars).alias("preview"))


def reference_edges(spark, d):
    return graph.reference_edges(_chunks(spark, d))


def reference_closure(spark, d):
    return graph.closure(graph.reference_edges(_chunks(spark, d)))


def _financial(spark, d):
    """Chunks that read like pages of charges: the customer's clause with a table of rules and plus signs, and a formula."""
    amount = F.format_string("%,d", F.col("chunk_id") * 1000)
    rule = F.lit("+-----------+-----------+")
    table = F.concat_ws("\n", rule, F.concat(F.lit("| charge    | "), F.rpad(amount, 9, " "), F.lit(" |")), rule)
    formula = F.concat(F.lit(r"\text{Balancing Payment} = \left(\frac{A}{B} \times "), F.when(F.col("chunk_id") % 2 == 0, F.lit("$")).otherwise(F.lit("")), F.lit(r"2,600,000\right) - $ 2,600,000"))
    parts = F.concat_ws("\n", F.concat_ws(" ", "clause", "clause_title"), table, F.lit("The charge is balanced each year by"), formula, F.when(F.col("chunk_id") % 3 == 0, table))
    return _chunks(spark, d).where("clause_title IS NOT NULL").select("chunk_id", parts.alias("content"))


def grid_tables(spark, d):
    """All chunks as they are, and the same with tables, as the tables given have none."""
    return graph.grid_tables(_chunks(spark, d).select("chunk_id", "content").unionByName(_financial(spark, d)))


def formula_extract(spark, d):
    found = graph.formulas(_chunks(spark, d).select("chunk_id", "content").unionByName(_financial(spark, d)))
    return found.withColumn("variables", F.array_join("variables", ","))


PROVIDERS = ("polar quay storage", "northmoor cold stores")  # invented, as the tables name no service provider
COUNTRIES = ("Australia", "New Zealand", "United Kingdom", "Ireland", "Poland", "USA", "Germany", "Mexico")


def _openings(spark, d):
    """Two opening pages for every intake row, written from its fields, as the tables' pages have no list of parties."""
    rows = read_table(spark, d, "intake")
    name, region = F.coalesce("customer", F.lit("the undersigned")), F.coalesce("region", F.lit("no fixed place"))
    provider = F.when(F.col("intake_id") % 2 == 0, F.lit("Polar Quay Storage Pty Ltd")).otherwise(F.lit("Northmoor Cold Stores Limited"))
    first = F.concat(F.lit("STORAGE AGREEMENT\nbetween (1) "), F.when(F.col("intake_id") % 3 == 0, provider).otherwise(name), F.lit(", a company; and (2) "), F.when(F.col("intake_id") % 3 == 0, name).otherwise(provider), F.lit(", the keeper"))
    second = F.concat(F.lit("The depot lies in Poland. "), name, F.lit(" has its seat in "), region, F.lit("."))
    page = lambda k, text: rows.select((F.col("intake_id") * 2 + k).alias("row_id"), F.col("intake_id").cast("string").alias("source"), F.lit(k + 1).alias("page_number"), text.alias("content"))
    return page(0, first).unionByName(page(1, second))


def party_detect(spark, d):
    """Customer and country of a file from its first pages, the providers' own names left out."""
    return P.detect_parties(_openings(spark, d), P.first_party(PROVIDERS), P.nearest_country(list(COUNTRIES)), PROVIDERS, CFG.region_pages)


def property_filter(spark, d):
    """Properties of pages that have a value."""
    props = F.create_map(F.lit("customer"), F.col("customer"), F.lit("region"), F.col("region"), F.lit("ocr"), F.col("ocr").cast("string"))
    kept = P.scalar_properties(props)
    return _pages(spark, d).select("row_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("names"), F.size(kept).alias("n"))


def entity_dictionary(spark, d):
    """The dictionary of known customers, written sorted and read again."""
    where = f"{ensure_checkpoint_dir(spark)}/names-{_digest(d)}-{spark.sparkContext.applicationId}"
    P.write_names(P.known_names(read_table(spark, d, "intake"), "customer"), where)
    return P.read_names(spark, where)


def _runs(spark, d):
    """A tree of runs: question, retriever, retrieved chunk; only the question knows who asks."""
    hits = _hits(spark, d).select("query_id", "retriever", "rnk", "chunk_id").distinct()
    q = F.concat(F.lit("q"), F.col("query_id"))
    r = F.concat(q, F.lit("/"), F.col("retriever"))
    none, tags = F.lit(None).cast("string"), F.array(F.col("retriever"))
    roots = _questions(spark, d).select(q.alias("run_id"), none.alias("parent_run_id"), F.col("asked_by").alias("email"), F.array(F.lit("root")).alias("tags"))
    lists = hits.select(r.alias("run_id"), q.alias("parent_run_id"), none.alias("email"), tags.alias("tags")).distinct()
    leaves = hits.select(F.concat(r, F.lit("/"), F.col("rnk"), F.lit("/"), F.col("chunk_id")).alias("run_id"), r.alias("parent_run_id"), none.alias("email"), tags.alias("tags"))
    return roots.unionByName(lists).unionByName(leaves)


def trace_email_inherit(spark, d):
    return trace.inherit_email(_runs(spark, d))


def trace_tags(spark, d):
    return trace.tag_runs(_runs(spark, d)).select("run_id", F.array_join("tags", ",").alias("tags"))


def _digest(d):
    return hashlib.md5(d.encode()).hexdigest()[:12]


def _index(spark, d):
    """The index of the chunk table in the shared folder, built where it is missing, once a session."""
    where = f"{ensure_checkpoint_dir(spark)}/index-{_digest(d)}-{spark.sparkContext.applicationId}"
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(8, partitions // 4)
    index.build_index(_chunks(spark, d).select("chunk_id", "source", "page_number", "content", "customer", "clause", "hierarchy"), where, buckets=buckets, parts=max(1, partitions // buckets))
    return index.open_index(spark, where, read_table(spark, d, "entity"), cfg=CFG)


def index_roundtrip(spark, d):
    """What the index holds, read back: per artefact its rows and a digest of each chunk's part, so that a wrong weight shows."""
    idx = _index(spark, d)
    chunks = idx.chunks.select("chunk_id", F.lit(1).alias("rows"), F.md5(F.concat_ws("|", "source", "page_number", "content", "customer", "clause", F.array_join("hierarchy", ">"))).alias("digest"))
    entry = F.concat_ws("=", "token", F.round(F.col("weight") * 1_000_000).cast("bigint").cast("string"))
    postings = idx.postings.groupBy("chunk_id").agg(F.count("*").cast("int").alias("rows"), F.md5(F.array_join(F.array_sort(F.collect_list(entry)), ",")).alias("digest"))
    vectors = idx.vectors.select("chunk_id", F.lit(1).alias("rows"), F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), ",")).alias("digest"))
    label = lambda df, name: df.select(F.lit(name).alias("artefact"), "chunk_id", "rows", "digest")
    return label(chunks, "chunks").unionByName(label(postings, "postings")).unionByName(label(vectors, "vectors"))


def dense_encode(spark, d):
    """Vectors of the questions; their places as whole millionths."""
    out = hashed_vectors(_questions(spark, d), "query_id", "text", CFG.vector_size)
    return out.select("query_id", F.array_join(F.transform("embedding", lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), ",").alias("vector"))


def dense_ask(spark, d):
    """The dense half alone: encoded questions against the index's vectors."""
    asked, _ = asking.valid_questions(_questions(spark, d))
    return asking.dense_hits(asked, _index(spark, d), CFG)


def sparse_ask(spark, d):
    """The sparse half alone: the index's postings, pruned to the questions' tokens."""
    asked, _ = asking.valid_questions(_questions(spark, d))
    return asking.sparse_hits(asked, _index(spark, d), CFG)


def hybrid_ask(spark, d):
    """Flagship: dense and sparse search of the index, fusion, rerank, blend, dynamic K and citations for every question."""
    return asking.ask(_questions(spark, d), _index(spark, d), CFG, filter_entities=False).withColumn("score", F.round("score", 6)).drop("reranked")


def hybrid_ask_by_customer(spark, d):
    """The same with the customers that a question names: one filters, several are balanced."""
    return asking.ask(_questions(spark, d), _index(spark, d), CFG).withColumn("score", F.round("score", 6)).drop("reranked")


def dense_only_ask(spark, d):
    """The pipeline on an index without postings: the dense list alone is fused, and nothing is reranked."""
    idx = replace(_index(spark, d), sparse=None)
    return asking.ask(_questions(spark, d), idx, replace(CFG, rerank=False), filter_entities=False).withColumn("score", F.round("score", 9)).drop("citation", "reranked")


QUERIES = {
    f.__name__: f
    for f in (
        scan_page_profile, document_plain_text, ocr_fallback_choice, latest_page_deliveries, first_n_pages_concat, party_detect, property_filter, known_entities, entity_dictionary, page_gate, line_explode_spurious, list_item_flag,
        header_parse, title_cleanup, title_extend, hierarchy_stack, hierarchical_chunks, name_normalize, country_standardize, keyword_dictionary, entity_detect, sparse_encode, dense_encode,
        sparse_topn, dense_topk, dense_threshold, rrf_fusion, rerank_blend, fused_without_rerank, fixed_k, single_entity_filter, dynamic_k_combined, dynamic_k_rrf, smart_select, citations, map_extract,
        reduce_concat, answer_questions, explain_retrieval, answer_error_class, prompt_header_clean, debug_preview, reference_edges, reference_closure, grid_tables, formula_extract, trace_email_inherit, trace_tags,
        index_roundtrip, dense_ask, sparse_ask, hybrid_ask, hybrid_ask_by_customer, dense_only_ask,
    )
}
