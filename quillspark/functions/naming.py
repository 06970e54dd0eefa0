"""Cleaning of detected customer and country names, and the keywords by which questions name customers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.config import UNKNOWN_CUSTOMER, UNKNOWN_REGION

# Suffixes and synonyms, in the order in which they are tried.
COMPANY_SUFFIXES = r"(?i)\s?(?:pty limited|pty ltd|limited|ltd|inc|llc|plc)$"
POLISH_SUFFIXES = ("sp. z o.o", "sp z o o")
US_NAMES = ("usa", "us", "united states of america")
UK_NAMES = ("uk", "united kingdom", "great britain", "g.b.")
KEYWORD_SUFFIXES = r"(?i)^(.*?)(?: pty ltd| pty limited| ltd| limited| inc)$"


def clean_name(name: Column) -> Column:
    """Punctuation and emphasis off the ends, blanks collapsed, a trailing bracket and a Polish legal form removed."""
    out = F.btrim(F.btrim(name, F.lit(" ,.()\"'")), F.lit("*_"))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    out = F.trim(F.regexp_replace(out, r"\s+\([^)]+\)$", ""))
    for suffix in POLISH_SUFFIXES:
        out = F.when(F.lower(out).endswith(suffix), F.btrim(F.substring(out, F.lit(1), F.length(out) - len(suffix)), F.lit(" ,."))).otherwise(out)
    return F.btrim(out, F.lit(" ,."))


def strip_company_suffix(name: Column) -> Column:
    """One legal form off the end, also where no blank stands before it."""
    return F.btrim(F.regexp_replace(name, COMPANY_SUFFIXES, ""), F.lit(" ,."))


def normalize_customer(name: Column, providers: tuple[str, ...] = ()) -> Column:
    """The cleaned name; the unknown sentinel for null, empty, unknown and the given (lower-case) providers' own names."""
    cleaned = clean_name(name)
    low = F.lower(cleaned)
    unknown = cleaned.isNull() | (cleaned == "") | (low == UNKNOWN_CUSTOMER.lower())
    if providers:
        unknown = unknown | low.isin(*providers)
    return F.when(unknown, F.lit(UNKNOWN_CUSTOMER)).otherwise(strip_company_suffix(cleaned))


def standardize_country(region: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(F.btrim(region, F.lit(" ,.()\"'*_")), r"\s+", " "))
    low = F.lower(cleaned)
    return F.when(cleaned.isNull() | (cleaned == "") | (low == UNKNOWN_REGION.lower()), F.lit(UNKNOWN_REGION)).when(low.isin(*US_NAMES), F.lit("United States")).when(low.isin(*UK_NAMES), F.lit("United Kingdom")).otherwise(cleaned)


def keyword(name: Column) -> Column:
    """First word of the name without its legal form, lower case; null where there is none."""
    base = F.regexp_extract(name, KEYWORD_SUFFIXES, 1)
    first = F.regexp_extract(F.when(name.rlike(KEYWORD_SUFFIXES), base).otherwise(name), r"(\S+)", 1)
    return F.when(first != "", F.lower(first))


def full_keyword(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit(""))
