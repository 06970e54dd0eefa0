"""Hierarchy-aware chunking of pages.

Pages are parsed independently and in parallel. What a page needs from the pages before it is only the stack of open
clauses, and a page changes that stack in one way: entries at or above its lowest level go, its own entries come. Window
functions over small page summaries give every page its opening stack, first within blocks of pages, then over blocks, so
that no task holds the pages of one source.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import RetrievalConfig
from quillspark.functions import text as T
from quillspark.plans.lineage import materialize

BLOCK_PAGES = 256
STACK = "array<struct<id: string, title: string, level: int>>"
PARSED = f"row_id bigint, chunk_seq int, content string, floor int, stack {STACK}, failed boolean"

_SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_HEADER = re.compile(rf"(?:Clause[{_SPACE}]+)?({T.CLAUSE_ID})[ \t]+([^{_SPACE}].*)")
_ITEM = re.compile(r"\(?[a-zA-Z0-9]+[.)]")
_ENVELOPE = re.compile(T.ENVELOPE)
_DEEP = 1 << 30


def page_gate(pages: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """pages with n_words and whole_page: pages of at most page_gate_words words stay whole."""
    n = F.coalesce(T.word_count(F.col("content")), F.lit(0))
    return pages.withColumn("n_words", n).withColumn("whole_page", F.col("n_words") <= cfg.page_gate_words)


def _noise(line: str) -> bool:
    bare = line.strip()
    return not bare or bare.isdigit() and bare.isascii() or bool(_ENVELOPE.search(bare))


def _title(lines: list[str], following: str | None, cfg: RetrievalConfig) -> str:
    title = " ".join(lines).strip()
    last = title.split()[-1].lower().rstrip(".,:;") if title.split() else ""
    if following is not None and last in T.INCOMPLETE_ENDINGS and following.split() and not _ITEM.match(following.strip()):
        title += " " + " ".join(following.split()[:10])
    title = title.rstrip(" ,;:")
    if len(title.split()) > cfg.title_words:
        title = " ".join(title.split()[: cfg.title_words]) + "..."
    title = title.strip()
    while len(title) >= 2 and title[0] == title[-1] and title[0] in "*_":
        title = title[1:-1]
    return title.strip()


def _is_clause(clause: str, title: str) -> bool:
    if not title:
        return False
    if clause.isdigit():
        several = len(title.split()) > 1
        return not (title[0] == "(" or several and (title[0].islower() or title.lower().startswith("part ")))
    return True


class PageParser:
    """Cuts one page into chunks. A chunk carries the page's own open clauses and the lowest level met so far (floor):
    of the stack that the page opens with, the entries below the floor are its ancestors."""

    def __init__(self, cfg: RetrievalConfig) -> None:
        self.cfg = cfg

    def parse(self, text: str) -> tuple[list[tuple[str, int, list]], int, list]:
        """Chunks (content, floor, stack), and floor and stack at the end of the page."""
        lines = [x for x in text.splitlines() if not _noise(x)]
        blank_after = self._breaks(text)
        chunks: list[tuple[str, int, list]] = []
        stack: list[tuple[str, str, int]] = []
        floor, open_lines, just_split, at = _DEEP, [], False, 0

        def flush() -> None:
            body = "\n".join(open_lines).strip()
            parts = body.splitlines()
            head = _HEADER.match(parts[0].strip()) if len(parts) == 1 else None
            if body and not (head and len(head[2].split()) + 1 <= self.cfg.header_only_words):
                chunks.append((body, floor, list(stack)))

        while at < len(lines):
            head = None if just_split else _HEADER.match(lines[at].strip())
            end = at + 1
            if head:
                while end < len(lines) and not blank_after[end - 1] and not _HEADER.match(lines[end].strip()) and not _ITEM.match(lines[end].strip()):
                    end += 1
                title = _title([head[2], *(x.strip() for x in lines[at + 1 : end])], self._next(lines, blank_after, end), self.cfg)
                if _is_clause(head[1], title):
                    if open_lines:
                        flush()
                    level = head[1].count(".") + head[1].count("(")
                    stack = [x for x in stack if x[2] < level] + [(head[1], title, level)]
                    floor = min(floor, level)
                    open_lines = []
            open_lines = open_lines + lines[at:end]
            at = end
            just_split = False
            if sum(len(x.split()) for x in open_lines) > self.cfg.chunk_words:
                carried = min(max(1, int(len(open_lines) * self.cfg.carried_share)), len(open_lines) - 1)
                kept = open_lines[len(open_lines) - carried :] if carried else []
                open_lines = open_lines[: len(open_lines) - carried]
                flush()
                open_lines, just_split = kept, bool(carried)
        flush()
        return chunks, floor, stack

    @staticmethod
    def _breaks(text: str) -> list[bool]:
        """For every kept line, whether a dropped one follows it, which ends a title."""
        out: list[bool] = []
        for line in text.splitlines():
            if not _noise(line):
                out.append(False)
            elif out:
                out[-1] = True
        return out

    @staticmethod
    def _next(lines: list[str], blank_after: list[bool], end: int) -> str | None:
        return None if end >= len(lines) else "" if blank_after[end - 1] else lines[end]


def parse_pages(pages: DataFrame, cfg: RetrievalConfig, parser_of: Callable[[RetrievalConfig], PageParser] = PageParser) -> DataFrame:
    """(row_id, chunk_seq, content, floor, stack, failed) of pages over the gate; chunk_seq 0 is the state at the page's end.
    A page that the parser fails on is one chunk and leaves the open clauses as they were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = parser_of(cfg)
        pack = lambda stack: [{"id": a, "title": b, "level": c} for a, b, c in stack]
        for batch in batches:
            rows = []
            for row_id, text in zip(batch["row_id"], batch["content"]):
                try:
                    chunks, floor, stack = parser.parse(text)
                    failed = False
                except Exception:  # one bad page must not stop the others
                    chunks, floor, stack, failed = [(text, _DEEP, [])], _DEEP, [], True
                rows += [(row_id, k, c, f, pack(s), failed) for k, (c, f, s) in enumerate(chunks, 1)]
                rows.append((row_id, 0, None, floor, pack(stack), failed))
            yield pd.DataFrame(rows, columns=["row_id", "chunk_seq", "content", "floor", "stack", "failed"])

    return pages.select("row_id", "content").mapInPandas(run, PARSED)


def opening_stacks(order: DataFrame, ends: DataFrame, source: str = "source") -> DataFrame:
    """(row_id, opening): the stack each page opens with. `order` has row_id, source, page_number of all pages, `ends` the
    floor and stack at the end of those that were parsed."""
    depth = ends.agg(F.max(F.aggregate("stack", F.lit(-1), lambda a, x: F.greatest(a, x.level)))).first()[0]
    levels = range((depth if depth is not None else -1) + 1)
    blocks = order.select("row_id", F.col(source).alias("s"), "page_number", F.floor(F.coalesce("page_number", F.lit(0)) / BLOCK_PAGES).alias("block")).join(ends.select("row_id", "floor", "stack"), "row_id", "left")
    if not levels:
        return blocks.select("row_id", F.array().cast(STACK).alias("opening"))
    own = lambda level: F.get(F.filter("stack", lambda x: x.level == level), F.lit(0))
    # a page with a floor at or below a level decides what stands at that level: its own entry, or nothing
    decided = blocks.select("*", *[F.when(F.col("floor") <= level, F.struct(own(level).alias("e"))).alias(f"d{level}") for level in levels])
    inside = Window.partitionBy("s", "block").orderBy("page_number", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    within = decided.select("row_id", "s", "block", *[F.last(f"d{level}", ignorenulls=True).over(inside).alias(f"w{level}") for level in levels])
    last = decided.groupBy("s", "block").agg(*[F.max_by(f"d{level}", F.when(F.col(f"d{level}").isNotNull(), F.struct("page_number", "row_id"))).alias(f"b{level}") for level in levels])
    over = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("s", "block", *[F.last(f"b{level}", ignorenulls=True).over(over).alias(f"p{level}") for level in levels])
    entry = [F.coalesce(f"w{level}", f"p{level}").getField("e") for level in levels]
    joined = within.join(before, (within["s"].eqNullSafe(before["s"])) & (within["block"] == before["block"]))
    return joined.select("row_id", F.filter(F.array(*entry), lambda x: x.isNotNull()).cast(STACK).alias("opening"))


def chunk_pages(pages: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), parser_of: Callable[[RetrievalConfig], PageParser] = PageParser) -> DataFrame:
    """Chunks of pages: row_id, source, page_number, chunk_seq, content, customer, region, clause, clause_title, hierarchy,
    whole_page, then the pages' other columns, but for those with a name of these. Pages are taken in the order of
    page_number, then row_id, within their source; a null or blank page gives no chunk if it is cut, and an empty whole page
    none either. A page that the parser fails on is a whole page."""
    gated = page_gate(pages, cfg)
    parsed = materialize(parse_pages(gated.where(~F.col("whole_page")), cfg, parser_of))
    opening = opening_stacks(pages.select("row_id", "source", "page_number"), parsed.where("chunk_seq = 0"))
    named = ("row_id", "source", "page_number", "chunk_seq", "content", "customer", "region", "clause", "clause_title", "hierarchy", "whole_page", "stack", "n_words")
    others = [F.col(f"`{c}`") for c in pages.columns if c not in named]
    about = gated.select("row_id", "source", "page_number", "customer", "region", *others)
    cut = parsed.where("chunk_seq > 0").join(opening, "row_id")
    full = F.concat(F.filter("opening", lambda x: x.level < F.col("floor")), F.col("stack"))
    cut = cut.select("row_id", "chunk_seq", "content", full.alias("stack"), F.col("failed").alias("whole_page"))
    whole = gated.where(F.col("whole_page") & (T.strip(F.col("content")) != "")).select("row_id", F.lit(1).alias("chunk_seq"), "content").join(opening, "row_id")
    whole = whole.select("row_id", "chunk_seq", "content", F.col("opening").alias("stack"), F.lit(True).alias("whole_page"))
    top = F.try_element_at("stack", F.lit(-1))
    clause = F.coalesce(top.id, F.when(F.col("whole_page"), F.lit("N/A")))
    return cut.unionByName(whole).join(about, "row_id").select("row_id", "source", "page_number", "chunk_seq", "content", "customer", "region", clause.alias("clause"), F.when(~F.col("whole_page"), top.title).alias("clause_title"), F.transform("stack", lambda x: x.id).alias("hierarchy"), "whole_page", *others)


def header_lines(pages: DataFrame) -> DataFrame:
    """(row_id, line_no, clause_id, title, level, valid) of the lines that read like clause headers."""
    lines = pages.select("row_id", F.posexplode(T.split_lines(F.col("content"))).alias("i", "line"))
    head = lines.where(T.strip(F.col("line")).rlike(T.HEADER)).select("row_id", (F.col("i") + 1).alias("line_no"), T.header_id(F.col("line")).alias("clause_id"), T.header_title(F.col("line")).alias("title"))
    return head.withColumn("level", T.clause_level(F.col("clause_id"))).withColumn("valid", T.is_valid_clause(F.col("clause_id"), F.col("title")))


def fold_hierarchy(headers: Column) -> Column:
    """array of stacks: after every header of an ordered array<struct<id, level>>, the ids that are open."""
    empty = F.array().cast("array<struct<id: string, level: int>>")
    step = lambda acc, h: F.concat(F.filter(acc, lambda x: x.level < h.level), F.array(h))
    return F.transform(headers, lambda h, i: F.transform(F.aggregate(F.slice(headers, F.lit(1), i + 1), empty, step), lambda x: x.id))
