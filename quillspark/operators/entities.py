"""Which customers a question names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import naming


def keyword_dictionary(names: DataFrame) -> DataFrame:
    """(keyword, name): the first word and the whole name without blanks; of names that share a keyword the last, in order, has it."""
    ranked = names.select("name").distinct()
    first = ranked.select(naming.keyword(F.col("name")).alias("keyword"), "name")
    whole = ranked.select(naming.full_keyword(F.col("name")).alias("keyword"), "name", naming.keyword(F.col("name")).alias("k")).where("k IS NOT NULL").select("keyword", "name")
    return first.where("keyword IS NOT NULL").unionByName(whole).groupBy("keyword").agg(F.max("name").alias("name"))


def detect_entities(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, names, filter_name): all customers named, and the one to filter by where exactly one is.

    Longer keywords go first and hide what they cover. A keyword stands between word boundaries, so its first run of word
    characters is one of the question's runs: an equality join on it finds the candidates.
    """
    words = r"[\p{L}\p{N}_]+"
    dictionary = keyword_dictionary(names).withColumn("run", F.regexp_extract("keyword", f"({words})", 1)).where("run <> ''")
    asked = questions.select("query_id", F.lower("text").alias("q"))
    runs = asked.select("query_id", "q", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(f"({words})"), F.lit(1)))).alias("run"))
    pattern = lambda k: F.concat(F.lit(r"(?U)\b\Q"), k, F.lit(r"\E\b"))
    hits = runs.join(dictionary, "run").where(F.regexp_instr("q", pattern(F.col("keyword"))) > 0)
    sorted_ = F.array_sort(F.collect_set(F.struct((-F.length("keyword")).alias("n"), "keyword", "name")))
    found = hits.groupBy("query_id", "q").agg(sorted_.alias("k"))
    start = F.struct(F.col("q").alias("q"), F.array().cast("array<string>").alias("names"))

    def step(acc, k):
        at = F.regexp_instr(acc.q, pattern(k.keyword))
        hit = (at > 0) & ~F.array_contains(acc.names, k["name"])
        masked = F.overlay(acc.q, F.repeat(F.lit("_"), F.length(k.keyword)), at)
        return F.when(hit, F.struct(masked.alias("q"), F.concat(acc.names, F.array(k["name"])).alias("names"))).otherwise(acc)

    named = found.select("query_id", F.aggregate("k", start, step).names.alias("names"))
    return questions.select("query_id").join(named, "query_id", "left").select("query_id", F.array_sort(F.coalesce("names", F.array())).alias("names"), F.when(F.size("names") == 1, F.get("names", F.lit(0))).alias("filter_name"))
