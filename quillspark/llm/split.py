"""Problem 1: split oversized texts at natural boundaries.

Everything runs in the JVM: one bounded-quantifier regular expression walks the text, its alternatives ordered by
boundary strength; array functions then add the overlap by looking back over the word units.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, as a character class that Java and RE2 read alike.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


#: Not white space; the ASCII range stands first so that Java decides most characters by one bit test.
WORD = rf"[!-~[^{SPACE}]]"


@dataclass(frozen=True)
class SplitConfig:
    max_words: int = 400  # of a piece, its overlap included
    overlap_words: int = 50
    max_word: int = 200  # characters: a longer run without a blank counts as several words and is cut between characters
    fill: float = 0.5  # a boundary counts as long as this share of a piece is filled; weaker places are tried after that


def over_limit_pattern(max_words: int, max_word: int | None = None) -> str:
    """Matches a text of more than max_words words, with max_word of such units; possessive, so linear in the text."""
    unit = rf"{WORD}++[{SPACE}]++" if max_word is None else rf"{WORD}{{1,{max_word}}}+[{SPACE}]*+"
    return rf"^[{SPACE}]*+(?:{unit}){{{max_words}}}{WORD}"


def unit_pattern(cfg: SplitConfig) -> str:
    """A word with the blanks after it, or as many characters of a longer one as count as a word."""
    return rf"{WORD}{{1,{cfg.max_word}}}+[{SPACE}]*+"


def body_pattern(cfg: SplitConfig) -> str:
    """Alternatives from the strongest to the weakest boundary; every match consumes at most limit - overlap words.

    Each word unit is possessive (a word and its trailing space), so an alternative that fails is walked back unit by
    unit, never character by character. A line of table, list or plain text is bounded by its line break.
    """
    most = cfg.max_words - cfg.overlap_words
    least = max(1, int(most * cfg.fill))
    unit = rf"(?:{unit_pattern(cfg)})"
    lead = rf"(?:\A[{SPACE}]++)?+"
    ends_line, ends_sentence = r"(?<=\n)", rf"(?<=[.!?][\"'”’)\]]?[{SPACE}])"
    clause = r"(?=(?:[Cc]lause\s)?\d+(?:\.\d+)+\S*\s|(?:Schedule|SCHEDULE|Annex|Article|Section)\s)"
    blank, item = r"(?<=\n[ \t]?\n)", r"(?=\(?[A-Za-z0-9]{1,4}[.)]\s|[-*•–]\s|\|)"
    part = rf"(?<=[;:][{SPACE}])"
    places = [ends_line + clause, blank, ends_line + item, ends_line, ends_sentence, part]
    tries = [rf"{unit}{{1,{most}}}\z"]
    tries += [rf"{unit}{{{least},{most}}}{p}" for p in places]
    if least > 1:
        tries += [rf"{unit}{{1,{least - 1}}}{p}" for p in places]
    tries += [rf"{unit}{{1,{most}}}"]  # at any blank, or where a run without one is cut by characters
    return rf"(?s){lead}(?:" + "|".join(tries) + ")"


def pieces_column(text: Column, cfg: SplitConfig) -> Column:
    """array<struct<start_word, n_new, overlap_words, piece>> of one text over the limit.

    The one-element transforms bind the word units and the cut points to lambda variables, so each is computed once a text.
    """
    unit = F.lit(unit_pattern(cfg))
    first_or_unit = F.lit(rf"(?s)\A[{SPACE}]*+{unit_pattern(cfg)}|{unit_pattern(cfg)}")
    sizes = F.transform(F.regexp_extract_all(text, F.lit(body_pattern(cfg)), F.lit(0)), lambda b: F.size(F.regexp_extract_all(b, unit, F.lit(0))))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))

    def cut(s: Column, end: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(s.ends, i - 1))
        overlap = F.least(begin, F.lit(cfg.overlap_words))
        return F.struct(
            (begin - overlap).alias("start_word"),
            (end - begin).alias("n_new"),
            overlap.alias("overlap_words"),
            F.array_join(F.slice(s.units, begin - overlap + 1, end - begin + overlap), "").alias("piece"),
        )

    bound = F.array(F.struct(F.regexp_extract_all(text, first_or_unit, F.lit(0)).alias("units"), ends.alias("ends")))
    return F.get(F.transform(bound, lambda s: F.transform(s.ends, lambda end, i: cut(s, end, i))), F.lit(0))


def split_pieces(df: DataFrame, cfg: SplitConfig = SplitConfig(), text: str = "content") -> DataFrame:
    """One row per piece: all input columns but the text, then piece_no, n_pieces, start_word, overlap_words, n_words, piece.

    A null text gives no piece; an empty or blank text gives one piece, itself. A text of at most max_words words is one
    piece, character for character. Joined without their overlap, the pieces of a text are that text exactly. Words are counted as in SplitConfig.max_word. Repeated
    rows are split each for itself. Input columns that clash with a new column are replaced.
    """
    new = ["_text", "_long", "_all", "_i", "_p", "piece_no", "n_pieces", "start_word", "overlap_words", "n_words", "piece"]
    kept = [c for c in df.columns if c not in new and c != text]
    body = F.col("`" + text.replace("`", "``") + "`")
    is_long = (F.length(body) > 2 * cfg.max_words) & body.rlike(over_limit_pattern(cfg.max_words, cfg.max_word))
    base = df.where(body.isNotNull()).select(*[F.col(f"`{c}`") for c in kept], body.alias("_text"), is_long.alias("_long"))
    short = F.array(F.struct(F.lit(0).alias("start_word"), F.lit(None).cast("int").alias("n_new"), F.lit(0).alias("overlap_words"), F.col("_text").alias("piece")))
    cuts = base.withColumn("_all", F.when(F.col("_long"), pieces_column(F.col("_text"), cfg)).otherwise(short))
    out = cuts.select(*[F.col(f"`{c}`") for c in kept], F.size("_all").alias("n_pieces"), F.posexplode_outer("_all").alias("_i", "_p"))
    count = F.coalesce(F.col("_p.n_new") + F.col("_p.overlap_words"), F.size(F.regexp_extract_all(F.col("_p.piece"), F.lit(rf"{WORD}{{1,{cfg.max_word}}}+"), F.lit(0))))
    return out.select(*[F.col(f"`{c}`") for c in kept], (F.col("_i") + 1).alias("piece_no"), "n_pieces", F.col("_p.start_word").alias("start_word"), F.col("_p.overlap_words").alias("overlap_words"), count.alias("n_words"), F.col("_p.piece").alias("piece"))


def oversized(df: DataFrame, key: str, cfg: SplitConfig = SplitConfig(), text: str = "content") -> DataFrame:
    """Keys of the rows with more than max_words words, each row's own: those that the splitter cut, without those that it
    cut for a long run alone."""
    body = F.col(f"`{text}`")
    rows = df.select(F.col(key).alias("_key"), body.alias("_body"), body.rlike(over_limit_pattern(cfg.max_words)).alias("_over"))
    return split_pieces(rows, cfg, "_body").where((F.col("piece_no") == 2) & F.col("_over")).select(F.col("_key").alias(key))
