"""Presentation of chunks and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip

# Phrases that mark an answer as an error, and the sentence for an extract without a hit.
ERROR_PHRASES = ("Error:", "Could not find", "System not ready", "Found relevant documents, but none matched")
NOTHING_FOUND = "No relevant information found in this document."


def prompt_header(source: Column, page: Column, customer: Column, clause: Column) -> Column:
    label = lambda name, value, default: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit(default)))
    return F.concat(F.concat_ws(" | ", label("Source", source, "Unknown"), label("Page", page, "N/A"), label("Customer", customer, "Unknown"), label("Clause", clause, "N/A")), F.lit("\n---\n"))


def without_fences(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "(?m)^```[a-zA-Z]*\\n", ""), "(?m)\\n```$", ""))


def citation(source: Column, page: Column, customer: Column, clause: Column, hierarchy: Column) -> Column:
    base = F.concat(F.coalesce(source, F.lit("Unknown Source")), F.lit(" (Customer: "), F.coalesce(customer, F.lit("Unknown Customer")), F.lit(") - Page "), F.coalesce(page.cast("string"), F.lit("N/A")))
    section = F.try_element_at(hierarchy, F.lit(-1))
    return F.when(clause.isNotNull() & (clause != "") & (clause != "N/A"), F.concat(base, F.lit(" (Clause: "), clause, F.lit(")"))).when(section.isNotNull(), F.concat(base, F.lit(" (Section: "), section, F.lit(")"))).otherwise(base)


def preview(text: Column, chars: int = 250) -> Column:
    return F.when(text != "", F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def is_error(answer: Column) -> Column:
    out = F.lit(False)
    for phrase in ERROR_PHRASES:
        out = out | answer.contains(phrase)
    return out
