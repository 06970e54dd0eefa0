"""Text functions on columns: words, lines, clause headers, titles, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split() sees it; a character class that Java and RE2 read alike.
SPACE = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The grammar of clause headers and the marks of lines without content.
CLAUSE_ID = r"(?:[0-9]+\.)*[0-9]+(?:\([a-zA-Z]+\))?"
HEADER = rf"^[{SPACE}]*(?:Clause[{SPACE}]+)?({CLAUSE_ID})[ \t]+([^{SPACE}].*)"
LIST_ITEM = rf"^[{SPACE}]*\(?[a-zA-Z0-9]+[.)]"
ENVELOPE = "(?i)docusign envelope id:"
DIGITS_ONLY = rf"^[{SPACE}]*[0-9]+[{SPACE}]*$"
INCOMPLETE_ENDINGS = ("or", "and", "but", "for", "nor", "yet", "(")
REFERENCE = r"(?i)\b(Clause\s[0-9.]+(?:\([a-zA-Z]+\))?|Schedule\s[0-9]+\sPart\s[0-9]+)\b"
GRID_TABLE = r"(?s)(\+[-+]+?\+[\n\r].*?\+[-+]+?\+)"
FORMULA = r"(?is)(\\text\{Balancing Payment\}\s*=\s*\\left\(\\frac\{A\}\{B\}\s*\\times\s*\$?\s*2,600,000\\right\)\s*-\s*\$?\s*2,600,000)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def split_lines(text: Column) -> Column:
    """Lines at every line boundary, without an empty last one; a null text gives null, an empty one no lines."""
    parts = F.split(text, r"\R|[\x1c-\x1e]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_spurious(line: Column) -> Column:
    return (strip(line) == "") | line.rlike(ENVELOPE) | line.rlike(DIGITS_ONLY)


def is_list_item(line: Column) -> Column:
    return strip(line).rlike(LIST_ITEM)


def header_id(line: Column) -> Column:
    return F.regexp_extract(strip(line), HEADER, 1)


def header_title(line: Column) -> Column:
    return F.regexp_extract(strip(line), HEADER, 2)


def is_valid_clause(clause: Column, title: Column) -> Column:
    """A clause id with a title; a bare integer is not one where the title reads like the rest of a sentence or a reference."""
    several = word_count(title) > 1
    sentence = title.rlike(r"^\p{Ll}") & several
    doubtful = clause.rlike("^[0-9]+$") & (sentence | title.startswith("(") | (F.lower(title).startswith("part ") & several))
    return F.coalesce(clause.rlike(f"^{CLAUSE_ID}$") & (title != "") & ~doubtful, F.lit(False))


def clause_level(clause: Column) -> Column:
    return F.length(clause) - F.length(F.translate(clause, ".(", ""))


def clean_title_end(title: Column) -> Column:
    return F.rtrim(title, F.lit(" ,;:"))


def truncate_title(title: Column, most: int = 40) -> Column:
    w = words(title)
    return F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("..."))).otherwise(title)


def extend_title(title: Column, following: Column, most: int = 10) -> Column:
    """The title, with up to `most` words of the next line where it ends in a conjunction and that line isn't a list item."""
    last = F.lower(F.regexp_replace(F.try_element_at(words(title), F.lit(-1)), "[.,:;]+$", ""))
    extra = F.slice(words(following), 1, most)
    more = last.isin(*INCOMPLETE_ENDINGS) & (F.size(extra) > 0) & ~is_list_item(following)
    return F.when(F.coalesce(more, F.lit(False)), F.concat(title, F.lit(" "), F.array_join(extra, " "))).otherwise(title)


def strip_emphasis(title: Column) -> Column:
    """Peel matching marks * or _ off both ends as often as they match; blanks go before the first and after the last peel."""
    bare = strip(title)
    marks = F.length(F.regexp_extract(bare, "^[*_]*", 0))
    paired = lambda t: (F.length(t) >= 2) & t.rlike("^[*_]") & (F.left(t, F.lit(1)) == F.right(t, F.lit(1)))
    peel = lambda t, _: F.when(paired(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return F.when(marks > 0, strip(F.aggregate(F.sequence(F.lit(1), marks), bare, peel))).otherwise(bare)


def normalize_reference(ref: Column) -> Column:
    bare = strip(F.regexp_replace(strip(ref), r"\.+$", ""))
    clause = strip(F.substring(bare, F.lit(7), F.length(bare)))
    parts = F.filter(F.transform(F.split(F.lower(F.substring(bare, F.lit(9), F.length(bare))), "part"), strip), lambda p: p != "")
    return F.when(F.lower(bare).startswith("clause"), clause).when(F.lower(bare).startswith("schedule"), F.concat(F.lit("Schedule-"), F.array_join(parts, "-"))).otherwise(bare)


def references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))


def grid_tables(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(GRID_TABLE), F.lit(1))


def formulas(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FORMULA), F.lit(1))


def plain_html(text: Column) -> Column:
    """Text without tags, common entities decoded, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "), r"<[^<>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, "[ \t]+", " "))
