"""Problem 5: repair text from scanned pages.

An averaged perceptron decides on edits: of a word that the corpus doesn't know, which characters to keep, replace, delete
or insert; whether a space inside a word goes; whether a word at a line end is joined to the next line; and, by features
of the place on the page and of repetition within the source, whether a line is furniture. It is trained on words of the
corpus' own clean pages, to which scanning noise is added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from quillspark.llm import boilerplate
from quillspark.llm.tokens import cached
from quillspark.plans.lineage import materialize


@dataclass(frozen=True)
class OcrConfig:
    least_count: int = 3  # a word is known if clean pages have it as often, whatever the size of the corpus
    held_words: int = 200_000  # known words that every task holds; pages get the others that they ask for by a join
    train_share: float = 5e-6  # training draws from known words that make up this share of all words of clean pages: at most 200,000
    edge_lines: int = 3  # lines with text, from the top and from the foot, that may be furniture
    least_pages: int = 3  # of a source that carry a running header
    least_page_share: float = 0.15
    train_words: int = 5000  # bound of the sample that the perceptron is trained on
    broadcast_letters: int = 8_000_000


# What scanners make of characters; read in both directions.
CONFUSIONS = [tuple(p.split("=")) for p in "m=rn d=cl u=ii n=ri e=c h=b t=f o=0 l=1 i=1 s=5 a=@ i=! c=( g=9 b=6 i=l y=v I=| l=| I=l l=I S=5 O=0 B=8 z=2 w=vv k=lc n=u a=o g=q li=h ti=fi E=F C=( I=! A=@ A=4 G=6 T=7 q=9 r=n i=j v=y f=t b=h c=e m=nn n=r cl=d rn=m".split()]
STRAY = set("~^·_'`¬|*•°¨´=<>\\")
_SPACES = re.compile(r"[ \t  　  ]+")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_LEAD, _TAIL = "\"“‘([{", ".,;:?\"”’)]}"
_CUT = re.compile(r"([^\W\d_]+(?:[-'’][^\W\d_]+)*)[ ]?([-­¬‐])[ ]*$")
_MARKS = ("-", "\u00ad", "\u00ac", "\u2010")
_HEAD = re.compile(r"^\s*([^\W\d_]+(?:[-'’][^\W\d_]+)*)")
_NUMBER = re.compile(r"^\W*(?:\d{1,4}|[ivxlcIVXLC]{1,7})\W*$")
_MISREAD_NUMBER = re.compile(r"^[^\w|]*([\dOoQlIi|SsBzZgqbGAT]{1,4})[^\w|]*$")
_AS_DIGITS = str.maketrans("OoQlIi|SsBzZgqbGAT", "000111155822996647")
_PAGE_OF = re.compile(r"^\W*(?:p[a@4][gq9][e3cf]?|seite|pagina|strona|sheet|blatt)\W*[\dOlI]{1,4}(?:\W*(?:[o0][ft]|von|van|z|/)\W*[\dOlI]{1,4})?\W*$", re.I)
_LIST = re.compile(r"^\s*(?:\(?[a-zA-Z0-9]{1,4}[.)]\s|[-*•–|]\s|(?:Clause\s)?\d+(?:\.\d+)+\S*\s)")


# ---- statistics of the corpus ------------------------------------------------------------------------------------
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MONTHS = re.compile(r"\b(?:" + boilerplate.MONTHS.replace(" ", "|") + r")\b")


def wording(line: str) -> str:
    """Letters of a line, lower case, without months."""
    return _NOT_LETTERS.sub("", _MONTHS.sub("", line.lower()))


def edge_lines(lines: list[str], most: int) -> list[int]:
    """Indexes of the first and last lines with text."""
    top: list[int] = []
    for i, line in enumerate(lines):
        if len(top) == most:
            break
        if line and not line.isspace():
            top.append(i)
    foot: list[int] = []
    for i in range(len(lines) - 1, top[-1] if top else -1, -1):
        if len(foot) == most:
            break
        if lines[i] and not lines[i].isspace():
            foot.append(i)
    return top + foot[::-1]


def statistics(df: DataFrame, source: str, text: str, ocr: str, cfg: OcrConfig) -> DataFrame:
    """(kind, a, b, n), from one pass over all pages: words (w) of clean pages; of every source its pages (s) and the
    wordings at top or foot with their pages (e)."""
    most = cfg.edge_lines + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        places: Counter[tuple[str, str, str]] = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([("w", w, "", n) for w, n in words.items()] + [(*k, n) for k, n in places.items()], columns=["kind", "a", "b", "n"])
            words.clear()
            places.clear()
            return out

        for batch in batches:
            for name, page, scanned in zip(batch["source"], batch["text"], batch["ocr"]):
                if page is None:
                    continue
                if not scanned:
                    words.update(_WORD.findall(page.lower()))
                if name is not None:
                    places["s", name, ""] += 1
                    lines = page.split("\n")
                    places.update({("e", name, k) for k in (wording(lines[i]) for i in edge_lines(lines, most)) if k})
            if len(words) + len(places) > 200_000:
                yield rows()
        yield rows()

    columns = df.select(F.col(source).alias("source"), F.col(text).alias("text"), F.coalesce(F.col(ocr), F.lit(False)).alias("ocr"))
    return columns.mapInPandas(count, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def known_words(counted: DataFrame, least: float) -> DataFrame:
    """(a, n): words of clean pages with their counts over all of them."""
    return counted.where((F.col("kind") == "w") & (F.col("n") >= least)).select("a", "n")


def _collected(words: DataFrame) -> dict[str, int]:
    return {r["a"]: r["n"] for r in words.collect()}


def most_frequent(words: DataFrame, count: int, most: int) -> dict[str, int]:
    """All words if there are at most so many, else the most frequent, by steps of frequency, that are not more."""
    if count <= most:
        return _collected(words)
    step = F.floor(F.log2("n") * 16)
    kept, least = 0, None
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.col("step").desc()).collect():
        kept += r["words"]
        if kept > most:
            break
        least = r["step"]
    return {} if least is None else _collected(words.where(step >= least))


def training_words(counted: DataFrame, cfg: OcrConfig) -> dict[str, int]:
    """The words that training draws from; rarer ones are known too, but are no examples."""
    total = counted.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0
    return _collected(known_words(counted, max(cfg.least_count, total * cfg.train_share)))


def _bits(key: str, size: int) -> tuple[int, int, int]:
    """Places of a word in a filter of size bits, a power of two."""
    h = zlib.crc32(key.encode("utf-8", "surrogatepass"))
    return h * 0x9E3779B97F4A7C15 >> 20 & size - 1, h * 0xC2B2AE3D27D4EB4F >> 23 & size - 1, h * 0x165667B19E3779F9 >> 26 & size - 1


def word_filter(words: DataFrame, count: int, most: int = 1 << 26) -> np.ndarray:
    """A Bloom filter of words. It only spares the join keys that no word has; its bounded size doesn't change what the join finds."""
    size = min(most, 1 << max(10, (12 * count).bit_length()))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, dtype=bool)
        for batch in batches:
            for word in batch["a"]:
                for at in _bits(word, size):
                    bits[at] = True
        yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(size // 8, dtype=np.uint8)
    for r in words.select("a").coalesce(8).mapInPandas(build, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def edge_support(counted: DataFrame, cfg: OcrConfig) -> DataFrame:
    """(_source, _pages, _nodes): per source the wordings that its pages repeat at top or foot, most frequent first.

    A wording needs half of least_page_share, so their number is bounded whatever the size of the source.
    """
    sizes = counted.where("kind = 's'").select(F.col("a").alias("_source"), F.col("n").alias("_pages"))
    kept = counted.where("kind = 'e' AND n >= 2").select(F.col("a").alias("_source"), "b", "n").join(sizes, "_source").where(F.col("n") >= F.col("_pages") * cfg.least_page_share / 2)
    return kept.groupBy("_source", "_pages").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col("b").alias("key")))).alias("_nodes"))


def _near(a: str, b: str, most: int = 3) -> int:
    """Edit distance, or most + 1 where it is larger; only the band of the table that can hold so few is filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    beyond = most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                row[0] = i
                continue
            row[j] = min(last.get(j, beyond) + 1, row.get(j - 1, beyond) + 1, last.get(j - 1, beyond) + (x != b[j - 1]))
        if min(row.values()) > most:
            return beyond
    return min(beyond, row[len(b)])


def _same(a: str, b: str) -> bool:
    """Python twin of boilerplate.same_wording."""
    end = 4 if len(b) >= 12 else 2
    n = min(len(a), len(b))
    return abs(len(a) - len(b)) <= 3 and (a[:end] == b[:end] or a[-end:] == b[-end:]) and _near(a, b) <= (3 if n >= 20 else 2 if n >= 10 else 1 if n >= 6 else 0)


def page_number_line(line: str, page_number: int | None) -> bool:
    """Whether a line is a bare page number: roman, or the given number, of which letters may be misread digits. Without a
    given number it may be any, but needs a digit."""
    if _NUMBER.match(line) and (page_number is None or re.sub(r"\D", "", line) in (str(page_number), "")):
        return True
    m = _MISREAD_NUMBER.match(line)
    if not m:
        return False
    if page_number is None:
        return bool(re.search(r"\d", m[1])) and not re.search(r"[^\dOlISB|]", m[1])
    return m[1].translate(_AS_DIGITS) == str(page_number)


# ---- averaged perceptron -----------------------------------------------------------------------------------------
class Perceptron:
    """Scores a choice by the sum of its features' weights; weights are averaged over all training steps."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self._total: dict[str, float] = {}
        self._stamp: dict[str, int] = {}
        self._step = 0

    def score(self, features: list[str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features)

    def _add(self, feature: str, by: float) -> None:
        w = self.weights.get(feature, 0.0)
        self._total[feature] = self._total.get(feature, 0.0) + (self._step - self._stamp.get(feature, 0)) * w
        self._stamp[feature] = self._step
        self.weights[feature] = w + by

    def learn(self, choices: list[list[str]], right: int) -> None:
        self._step += 1
        guess = max(range(len(choices)), key=lambda k: self.score(choices[k]))
        if guess != right:
            for f in choices[right]:
                self._add(f, 1.0)
            for f in choices[guess]:
                self._add(f, -1.0)

    def average(self) -> dict[str, float]:
        for f, w in self.weights.items():
            self._total[f] = self._total.get(f, 0.0) + (self._step - self._stamp.get(f, 0)) * w
        return {f: t / max(1, self._step) for f, t in self._total.items() if t}


LONGEST_WORD = 48  # longer runs without a blank are no words: they are only tagged character by character
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
KEEP: list[str] = []


def edits(word: str, known: dict[str, int], least: int = 0, first: bool = True) -> list[tuple[str, list[str]]]:
    """Known words that one edit of the characters, or reading all look-alikes at once, makes of the word, with features.
    Rarer words than any that training saw (least) are taken like the rarest of those. Without first, a first letter
    changes only by a look-alike: names differ by it (Kravridge, Ravridge), and initials stand before names in addresses."""
    low = word.lower()
    out: dict[str, list[str]] = {}

    def propose(new: str, op: str, at: int) -> None:
        new = new.lower()
        if new != low and new in known:
            count = max(known[new], least)
            f = ["edit", op, f"{op.split(':')[0]}|len{min(len(low), 8)}", f"freq{min(6, len(str(count)))}", f"at{'start' if at == 0 else 'end' if at >= len(low) - 1 else 'in'}", f"odd{_odd(word)}", f"case{word[:1].isupper()}{word.isupper()}"]
            if new not in out or len(f) > len(out[new]):
                out[new] = f

    for a, b in CONFUSIONS:
        for good, bad in ((a, b),):
            at = word.find(bad)
            if at < 0 and bad.lower() != bad:
                continue
            while at >= 0:
                propose(word[:at] + good + word[at + len(bad) :], f"replace:{bad}>{good}", at)
                at = word.find(bad, at + 1)
    if not word.isalpha():
        for digits in ("olszbaigc", "oisebaigc", "olsgbaigc"):
            propose(word.translate(str.maketrans("0152" + "6@!9(", digits[:4] + digits[4:])), "replace:all", 1)
    if len(low) >= 4 and low.isalpha():
        for i in range(not first, len(low)):
            propose(low[:i] + low[i + 1 :], f"delete:{low[i]}", i)
        for i in range(not first, len(low) + 1):
            for c in _LETTERS:
                if i < len(low) and c != low[i]:
                    propose(low[:i] + c + low[i + 1 :], "replace:other", i)
                propose(low[:i] + c + low[i:], "insert", i)
    elif len(low) >= 3:
        for i, c in enumerate(low):
            if not c.isalpha():
                propose(low[:i] + low[i + 1 :], f"delete:{c}", i)
                for x in _LETTERS:
                    propose(low[:i] + x + low[i + 1 :], "replace:mark", i)
    return list(out.items())


def _odd(word: str) -> int:
    """How much a word looks unlike one: marks or digits among letters, capitals inside."""
    return min(2, sum(not c.isalpha() and c not in "-'’" for c in word)) + 3 * bool(re.search(r"[a-z][A-Z]", word))


# ---- the character tagger ----------------------------------------------------------------------------------------
_READINGS: dict[str, list[str]] = {}  # a mark or digit -> the letters that scanners make it of
for _good, _bad in CONFUSIONS:
    if len(_bad) == 1 and not _bad.isalpha() and _good.isalpha():
        _READINGS.setdefault(_bad, []).append(_good)
_READINGS["|"] = ["l", "i"]


def trigrams(known: dict[str, int]) -> set[str]:
    """Three letters in a row, with ^ and $ for the ends, of the words that training draws from."""
    return {f"^{w}$"[i : i + 3] for w in known for i in range(len(w)) if w.isalpha()}


def _kind(c: str) -> str:
    return "^" if not c else "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-" if c in "-'’" else "#"


def operations(word: str, at: int, seen: set[str]) -> list[tuple[str | None, list[str]]]:
    """What can be done with the mark or digit at a place of a word: (letters instead of it, features), None for keep.

    The features know the kind of the neighbours and whether the letters read there make three letters in a row that words
    have; no lexicon of whole words is asked.
    """
    c = word[at]
    left, right = word[max(0, at - 2) : at], word[at + 1 : at + 3]
    kinds = f"{_kind(left[-1:])}{_kind(right[:1])}"
    wide = f"{_kind(left[:-1])}{kinds}{_kind(right[1:])}"
    letters = min(4, sum(map(str.isalpha, word)))
    others = min(3, sum(not x.isalpha() and x not in "-'’" for x in word))
    sides = f"{min(4, len(re.search(r'[^\W\d_]*$', word[:at])[0]))}{min(4, len(re.match(r'[^\W\d_]*', word[at + 1 :])[0]))}"
    shape = [f"sides{sides}", f"kinds{kinds}", f"wide{wide}", f"letters{letters}", f"others{others}", f"mark{'9' if c.isdigit() else c}"]
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    for new in [*_READINGS.get(c, []), *([""] if c in STRAY else [])]:
        low = (left[-1:] or "^").lower() + new + (right[:1] or "$").lower()
        parts = [low[i : i + 3] for i in range(len(low) - 2)]
        fit = sum(p in seen for p in parts) == len(parts) if parts else False
        op = "delete" if not new else "replace"
        out.append((new, [f"tag{op}", f"tag{op}:{c}>{new}", f"tag{op}|fit{fit}", *(f"tag{op}|{x}" for x in shape)]))
    return out


def tag(word: str, score, seen: set[str]) -> str | None:
    """The word with every mark and digit inside it replaced or deleted, or None where one of them is kept: then it is a code."""
    out = []
    for at, c in enumerate(word):
        if c.isalpha() or c in "-'’":
            out.append(c)
            continue
        new, _ = max(operations(word, at, seen), key=lambda o: (score(o[1]), o[0] is None))
        if new is None:
            return None
        upper = word[at - 1 : at].isupper() and (word[at + 1 : at + 2].isupper() or at + 1 == len(word)) or at == 0 and word[1:2].isupper()
        out.append(new.upper() if upper else new)
    return "".join(out)


def line_join(first: str, mark: str, second: str, known: dict[str, int]) -> list[str]:
    """Features of joining a cut word; not joining is the choice without features."""
    joined, compound = (first + second).lower(), f"{first}-{second}".lower()
    tail = (first.split("-")[-1] + second).lower()
    return ["join", f"mark{'-' if mark in '-‐' else 'soft'}", f"known{joined in known or tail in known}", f"compound{compound in known}", f"more{known.get(joined, 0) >= known.get(compound, 0)}", f"next{'low' if second[:1].islower() else 'up'}", f"parts{first.split('-')[-1].lower() in known}{second.lower() in known}"]


def furniture(rank_top: int, rank_foot: int, support: int, pages: int, letters: int, digits: int, cfg: OcrConfig) -> list[str]:
    """Features of taking a line for a running header: its place on the page and how often its source repeats it."""
    share = support / max(1, pages)
    near = min(rank_top, rank_foot)
    return ["head", f"near{min(near, 4)}", f"often{min(4, support // cfg.least_pages)}", f"share{min(8, int(share * 20))}", f"seen{min(4, support)}", f"seen{min(4, support)}|share{min(4, int(share * 20))}", f"letters{min(4, letters // 8)}", f"digits{digits > 0}", f"alone{support <= 1}"]


def _noise(word: str, rng: np.random.Generator) -> str:
    for _ in range(20):
        good, bad = CONFUSIONS[rng.integers(0, len(CONFUSIONS))]
        at = word.find(good)
        if at >= 0:
            return word[:at] + bad + word[at + len(good) :]
    return word


def _code(rng: np.random.Generator) -> str:
    """A number of goods, a rate, a unit or the like: marks and digits that are meant."""
    form = str(rng.choice("A9 9kg AB99 A-99 99A AB-9999 a9 9st 9th aa9 A9B 99x99 9.9a a@a a/a aa/aa a&a 99% A99-9 aa_aa a+a aaa9 9aa 9a9 aaa.aa AA/99 A9A aa(a 9m aaaa9 AAA9999 99aa 9-aa aaaa/aaaa aa:aa #9 aa#9 aaaa@aaaa aaaaa@aaaaaa aaa@aaaaa-aaa aaaa-aaaa@aaaa".split()))
    letter = lambda: "abcdefghijklmnoprstuvw"[rng.integers(0, 22)]
    return "".join(letter() if c == "a" else letter().upper() if c == "A" else str(rng.integers(0, 10)) if c == "9" else c for c in form)


def train(known: dict[str, int], cfg: OcrConfig, seed: int = 11) -> dict[str, float]:
    """Weights from words of the corpus: noisy ones to be restored, clean unknown names to be kept, cut words to be joined."""
    rng = np.random.default_rng(seed)
    words = sorted((w for w in known if len(w) > 2 and w.isalpha()), key=lambda w: (-known[w], w))
    model = Perceptron()
    if not words:
        return {}
    p = np.array([known[w] for w in words], dtype=float) ** 0.5
    chosen = rng.choice(len(words), size=cfg.train_words, p=p / p.sum())
    syllables = [c + v for c in "b br c d dr f g gr h k l m n p qu r s st t th tr v w z".split() for v in "a e i o u el or an in".split()]
    compounds = sorted(w for w in known if "-" in w)
    seen = trigrams(known)
    for step, k in enumerate(chosen):
        word = words[k]
        shown = word.capitalize() if rng.random() < 0.2 else word
        bad = _noise(shown, rng)
        if bad.lower() not in known and bad != shown:
            options = edits(bad, known)
            goal = next((i for i, (w, _) in enumerate(options) if w == word), None)
            if goal is not None:
                model.learn([f for _, f in options] + [KEEP], goal)
        # a name, or a rare word, that is right as it is
        name = "".join(syllables[rng.integers(0, len(syllables))] for _ in range(int(rng.integers(2, 5))))
        name = name.capitalize() if rng.random() < 0.9 else name
        if name.lower() not in known:
            options = edits(name, known)
            model.learn([f for _, f in options] + [KEEP], len(options))
        if len(word) > 4:
            at = int(rng.integers(2, len(word) - 1))
            mark = "-" if rng.random() < 0.6 else "­"
            model.learn([line_join(word[:at], mark, word[at:], known), KEEP], 0)
            if len(name) > 4 and rng.random() < 0.5:
                model.learn([line_join(name[:3], mark, name[3:], known), KEEP], 0)
        if compounds and step % 2:
            first, _, second = compounds[rng.integers(0, len(compounds))].partition("-")
            model.learn([line_join(first, "-", second, known), KEEP], 1)
            model.learn([line_join(name, "-", name.capitalize(), known), KEEP], 1)
        # lines of pages: running headers stand near an edge on many pages of a source, with some of them misread beyond
        # recognition; lines of text come back by chance
        pages = int(rng.integers(2, 80)) if rng.random() < 0.7 else int(rng.integers(2, 6))
        header = rng.random() < 0.5 and pages >= cfg.least_pages
        share = cfg.least_page_share + rng.random() * (1 - cfg.least_page_share)
        support = max(cfg.least_pages, int(rng.binomial(pages, share))) if header else 1 + int(rng.poisson(0.3 + 0.02 * pages * rng.random()))  # a page may be delivered twice
        near = int(rng.integers(0, cfg.edge_lines + (not header)))
        f = furniture(near, 20, min(support, pages), pages, int(rng.integers(4, 70)), int(rng.random() < 0.5), cfg)
        model.learn([f, KEEP], 0 if header else 1)
        # a mark or digit inside a word, known or made up, is a misread letter; in a code it is meant
        shown = (word if rng.random() < 0.5 else name.lower()).lower()
        shown = shown.upper() if rng.random() < 0.25 else shown.capitalize() if rng.random() < 0.5 else shown
        places = [(i, bad) for i in range(len(shown)) for bad, goods in _READINGS.items() if shown[i].lower() in goods]
        if places and len(shown) > 3:
            i, bad = places[int(rng.integers(0, len(places)))]
            noisy = shown[:i] + bad + shown[i + 1 :]
            choices = operations(noisy, i, seen)
            goal = next((k for k, (new, _) in enumerate(choices) if new == shown[i].lower()), None)
            if goal is not None:
                model.learn([f for _, f in choices], goal)
        if len(shown) > 3 and rng.random() < 0.3:
            i = int(rng.integers(1, len(shown)))
            noisy = shown[:i] + str(rng.choice(list("~^·`*•°"))) + shown[i:]
            choices = operations(noisy, i, seen)
            model.learn([f for _, f in choices], len(choices) - 1)  # to be deleted
        code = _code(rng)
        for i, c in enumerate(code):
            if not c.isalpha() and c not in "-'’":
                choices = operations(code, i, seen)
                model.learn([f for _, f in choices], 0)
    return model.average()


# ---- the editor --------------------------------------------------------------------------------------------------
class Editor:
    def __init__(self, known: dict[str, int], weights: dict[str, float], cfg: OcrConfig, least: int = 0, grams: set[str] = frozenset()) -> None:
        self.known, self.weights, self.cfg, self.least = known, weights, cfg, least
        self.seen: dict[str, str | None] = {}  # word -> its repair, None if it stays
        self.trigrams = grams

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def word(self, token: str) -> str | None:
        """The repair of a token, or None. Punctuation around it stays."""
        if token in self.seen:
            return self.seen[token]
        if len(self.seen) > 300_000:
            self.seen.clear()
        fixed = self.seen[token] = self._word(token)
        return fixed

    def _word(self, token: str) -> str | None:
        start, end = 0, len(token)
        while start < end and token[start] in _LEAD:
            start += 1
        while end > start and token[end - 1] in _TAIL:
            end -= 1
        core = token[start:end]
        if not core or self._fine(core):
            return None
        fixed = None
        if start and token[start - 1] == "(" and ")" not in token:  # a bracket that was a c
            fixed = self._core("(" + core)
            start -= fixed is not None
        if fixed is None:
            fixed = self._core(core)
        if fixed is None and "-" in core:
            parts = core.split("-")
            new = [p if not p or self._fine(p) else self._core(p) or p for p in parts]
            fixed = "-".join(new) if new != parts else None
        if fixed is None:
            fixed = self._tagged(core)
        if fixed is None:
            return None
        return token[:start] + fixed + token[end:]

    def _fine(self, core: str) -> bool:
        low = core.lower()
        if low in self.known or low.replace("’", "'") in self.known:
            return True
        letters = sum(c.isalpha() for c in core)
        digits = sum(c.isdigit() for c in core)
        if letters < 2 and not (len(core) in (2, 3) and letters and digits) or digits > 2 and digits * 2 > letters or "@" in core and "." in core or re.search(r"\w@\w+\.", core) or re.match(r"^[A-Z]{1,4}[\d/\-]+\w?$", core) or core.startswith(("http", "www.", "mailto:", ".")) or re.fullmatch(r"(?:[A-Z]\.)+[A-Z]?|([a-z])\1*", core):
            return True
        stem = re.sub(r"['’]s?$", "", low)
        return stem in self.known or "-" in low and all(p in self.known or not p for p in low.split("-"))

    def _core(self, core: str) -> str | None:
        if len(core) > LONGEST_WORD:
            return None
        options = edits(core, self.known, self.least, False)
        if not options and not core.isalpha() and len(core) > 3:  # two slips: undo one look-alike, then try again
            for a, b in CONFUSIONS:
                if not b.isalpha() and b in core:
                    options += edits(core.replace(b, a, 1), self.known, self.least, False)
        if not options:
            return None
        best, f = max(options, key=lambda o: (self.score(o[1]), self.known[o[0]], o[0]))
        if self.score(f) <= 0:
            return None
        return best.upper() if core.isupper() and len(core) > 1 else best.capitalize() if core[0].isupper() else best

    def _tagged(self, core: str) -> str | None:
        """A word that no word of the lexicon is near, by its characters alone."""
        if core.isalpha() or sum(map(str.isalpha, core)) < 3:
            return None
        new = tag(core, self.score, self.trigrams)
        return new if new and new != core else None

    def page(self, text: str, page_number: int | None, pages: int = 0, nodes: list[tuple[str, int]] = []) -> tuple[list[tuple[int, str]], str]:
        """(line number, kind) of all that is wrong with a page, and the repaired page."""
        lines = text.split("\n")
        filled = [i for i, line in enumerate(lines) if line and not line.isspace()]
        kinds: dict[int, set[str]] = {}
        n = len(filled)
        edge = edge_lines(lines, self.cfg.edge_lines + 1)
        rank = {i: r for r, i in enumerate(filled)}
        for i in edge:
            top, foot = rank[i], n - 1 - rank[i]
            line = lines[i]
            if _PAGE_OF.match(line) and len(line) < 40:
                kinds[i] = {"page_no"}
            elif (top == 0 or foot == 0) and page_number_line(line, page_number):
                kinds[i] = {"page_no"}
            elif nodes:
                key = wording(line)
                support = sum(c for other, c in nodes if other == key or _same(key, other)) if key else 0
                if support > 1 and self.score(furniture(top, foot, support, pages, sum(map(str.isalpha, line)), sum(map(str.isdigit, line)), self.cfg)) > 0:
                    kinds[i] = {"header"}
        body = [i for i in range(len(lines)) if i not in kinds]
        words: dict[int, list[str]] = {}
        joins: dict[int, int] = {}
        glyphs: set[int] = set()
        open_cut: tuple[int, str] | None = None  # a cut word that waits for the next line of text
        for at, i in enumerate(body):
            line = lines[i]
            if not line or line.isspace():
                continue
            tokens = _SPACES.split(line.strip(" \t  　"))
            if open_cut is not None:
                j, first = open_cut
                open_cut = None
                m = _HEAD.match(line)
                if m and self.score(line_join(first, lines[j].rstrip()[-1], m[1], self.known)) > 0:
                    joins[j] = i
                    whole = first.split("-")[-1] + m[1]
                    kinds.setdefault(j, set()).add("hyphen")
                    fixed = None if self._fine(whole) else self._core(whole) or self._tagged(whole)
                    last, rest = words[j][-1], tokens[0]
                    head = last.rstrip(" -­¬‐")
                    if fixed is not None:
                        (glyphs.add(j) if not any(w.startswith(first.lower()) for w in (fixed.lower(),)) else glyphs.add(i))
                        head = head[: len(head) - len(first.split("-")[-1])]
                        words[j][-1] = head + fixed + rest[len(m[1]) :]
                    else:
                        words[j][-1] = head + rest
                    tokens = tokens[1:]
                elif words[j]:
                    last = words[j][-1]
                    stem = last.rstrip(" -­¬‐")  # the mark at the line end is no misread letter
                    fixed = self.word(stem)
                    if fixed is not None:
                        words[j][-1] = fixed + last[len(stem) :]
                        glyphs.add(j)
            cut = _CUT.search(_last_words(line)) if line.rstrip(" ")[-1:] in _MARKS else None
            stop = len(tokens)
            if cut and at + 1 < len(body):
                open_cut = (i, cut[1])
                if tokens and tokens[-1] in ("-", "­", "¬", "‐") and len(tokens) > 1:
                    tokens = tokens[:-2] + [tokens[-2] + tokens[-1]]
                stop = len(tokens) - 1
            out: list[str] = []
            k = 0
            while k < len(tokens):
                token = tokens[k]
                if k >= stop:
                    out.append(token)
                    k += 1
                    continue
                if token in STRAY and (token != "|" or line.count("|") < 2):
                    glyphs.add(i)
                    k += 1
                    continue
                if token not in self.known:
                    nxt = tokens[k + 1] if k + 1 < stop else None
                    joined = self._broken(token, nxt)
                    if joined is not None:
                        glyphs.add(i)
                        out.append(joined)
                        k += 2
                        continue
                    fixed = self.word(token)
                    if fixed is not None:
                        glyphs.add(i)
                        token = fixed
                elif k + 1 < stop and tokens[k + 1] not in self.known:
                    joined = self._broken(token, tokens[k + 1])
                    if joined is not None:
                        glyphs.add(i)
                        out.append(joined)
                        k += 2
                        continue
                out.append(token)
                k += 1
            words[i] = out
            if open_cut is not None and open_cut[0] == i and not out:
                open_cut = None
        for i in glyphs:
            kinds.setdefault(i, set()).add("glyph")
        found = sorted((i + 1, k) for i, ks in kinds.items() for k in ks)
        return found, self._paragraphs(lines, words, joins, kinds)

    def _halves(self, a: str, b: str | None) -> tuple[str, str] | None:
        """a and b without punctuation around them, if they can be one word."""
        if not b or not a.isalpha():
            if not b or not a.lstrip(_LEAD).isalpha():
                return None
        end = len(b)
        while end and b[end - 1] in _TAIL:
            end -= 1
        core, head = b[:end], a.lstrip(_LEAD)
        if not core.isalpha() or core[0].isupper() and not head.isupper():
            return None
        return head, core

    def _broken(self, a: str, b: str | None) -> str | None:
        """The word that a space cut in two, if a and b are one."""
        halves = self._halves(a, b)
        if halves is None:
            return None
        head, core = halves
        known = self.known
        joined = (head + core).lower()
        if joined not in known or (head.lower() in known and core.lower() in known):
            return None
        return a + b

    def _paragraphs(self, lines: list[str], words: dict[int, list[str]], joins: dict[int, int], kinds: dict[int, set[str]]) -> str:
        """Lines of running text put together; blank lines, list items and headings begin a paragraph."""
        out: list[str] = []
        new = True
        before = ""
        for i, line in enumerate(lines):
            if kinds.get(i) and kinds[i] & {"header", "page_no"}:
                continue
            if i not in words:
                new = True
                continue
            text = " ".join(words[i])
            heading = bool(re.match(r"^\s*(?:Clause\s)?\d+(?:\.\d+)+\S*\s", before)) and len(before) < 90 and not before.rstrip().endswith((".", ","))
            if new or not out or _LIST.match(line) or heading or before.rstrip().endswith(":"):
                if text:
                    out.append(text)
            elif text:  # a compound that keeps its hyphen goes on without a blank
                out[-1] += text if re.search(r"[^\W\d_]-$", out[-1]) else " " + text
            new = False
            before = line
        return "\n\n".join(out)


def _last_words(line: str) -> str:
    """The last two words of a line with the blanks after them."""
    end = len(line.rstrip(" "))
    at = line.rfind(" ", 0, end)
    return line[line.rfind(" ", 0, max(0, at)) + 1 :] if at >= 0 else line


class _Asked:
    """Stands for the known words and notes what is asked for beyond them."""

    def __init__(self, known: dict[str, int]) -> None:
        self.known, self.keys = known, set()

    def __contains__(self, key: str) -> bool:
        if key in self.known:
            return True
        self.keys.add(key)
        return False

    def __getitem__(self, key: str) -> int:
        return self.known[key]

    def get(self, key: str, default: int = 0) -> int:
        return self.known[key] if key in self else default


class Asker:
    """Finds the words beyond the held ones that the editor can ask for on a page, whatever of them is known.

    More known words never make the editor ask for others, except where it joins lines or goes through the parts of a
    compound; these are asked for here in any case.
    """

    def __init__(self, held: dict[str, int], weights: dict[str, float], cfg: OcrConfig, least: int, bits: np.ndarray, grams: set[str] = frozenset()) -> None:
        self.asked = _Asked(held)
        self.editor = Editor(self.asked, weights, cfg, least, grams)
        self.bits, self.most = bits, cfg.edge_lines + 1
        self.seen: dict[str, frozenset[str]] = {}

    def _drain(self) -> set[str]:
        """What was asked for and may be a known word."""
        size, bits = len(self.bits) * 8, self.bits
        out = {k for k in self.asked.keys if all(bits[at >> 3] >> (7 - (at & 7)) & 1 for at in _bits(k, size))}
        self.asked.keys.clear()
        return out

    def _word(self, token: str, whole: bool = False) -> frozenset[str]:
        """whole: a word of two lines, whose punctuation isn't cut off."""
        key = "\n" + token if whole else token
        if key not in self.seen:
            if len(self.seen) > 300_000:
                self.seen.clear()
            self._drain()
            parts = token.lower().split("-")
            for part in [*parts, parts[0].lstrip(_LEAD), parts[-1].rstrip(_TAIL)]:
                part in self.asked  # noqa: B015
            if not whole:
                token in self.asked  # noqa: B015
                self.editor._word(token)
            elif not self.editor._fine(token):
                self.editor._core(token)
            self.seen[key] = frozenset(self._drain())
        return self.seen[key]

    def page(self, text: str) -> set[str]:
        out: set[str] = set()
        lines = text.split("\n")
        filled = [i for i, line in enumerate(lines) if line and not line.isspace()]
        edge = set(edge_lines(lines, self.most))
        for at, i in enumerate(filled):
            line = lines[i]
            tokens = _SPACES.split(line.strip(" \t  　"))
            if len(tokens) > 1 and tokens[-1] in _MARKS:
                tokens.append(tokens[-2] + tokens[-1])
            for token in [*tokens, tokens[-1].rstrip(" -­¬‐")]:
                out |= self._word(token)
            for a, b in zip(tokens, tokens[1:]):
                if a in self.asked.known and b in self.asked.known:
                    continue
                halves = self.editor._halves(a, b)
                if halves is not None:
                    self.asked.keys.update(x.lower() for x in (halves[0] + halves[1], *halves))
            cut = _CUT.search(_last_words(line)) if line.rstrip(" ")[-1:] in _MARKS else None
            for j in filled[at + 1 :] if cut else ():  # past lines that may be furniture
                m = _HEAD.match(lines[j])
                if m:
                    line_join(cut[1], line.rstrip()[-1], m[1], self.asked)
                    self.asked.keys.update(x.lower() for x in (cut[1] + m[1], cut[1].split("-")[-1] + m[1]))
                    out |= self._drain()
                    out |= self._word(cut[1].split("-")[-1] + m[1], True)
                if j not in edge:
                    break
            out |= self._drain()
        return {k for k in out if k not in self.asked.known}


def _digest(held: dict[str, int], weights: dict[str, float], *settings: object) -> str:
    """Tells editors of different lexicons, weights and settings apart."""
    h = hashlib.md5(repr(settings).encode())
    for table in (held, weights):
        for key in sorted(table):
            h.update(f"{key}={table[key]}\n".encode("utf-8", "surrogatepass"))
    return h.hexdigest()


# ---- the operator ------------------------------------------------------------------------------------------------
def further_words(pages: DataFrame, text: str, words: DataFrame, count: int, held: dict[str, int], weights: dict[str, float], least: int, cfg: OcrConfig, grams: set[str] = frozenset()) -> DataFrame:
    """(_text, _more): per distinct text, by its hash, the known words beyond the held ones that the editor can ask for.

    An equality join on the word; a Bloom filter spares keys that no word has.
    """
    shared = pages.sparkSession.sparkContext.broadcast((held, weights, word_filter(words, count), grams))
    token = _digest(held, weights, count, least, cfg)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asker = cached(("ocr-ask", token), lambda: Asker(shared.value[0], shared.value[1], cfg, least, shared.value[2], shared.value[3]))
        for batch in batches:
            rows = [(k, a) for k, t in zip(batch["_text"], batch["t"]) for a in asker.page(t)]
            yield pd.DataFrame(rows, columns=["_text", "a"])

    asked = pages.select(F.sha2(F.col(text), 256).alias("_text"), F.col(text).alias("t")).mapInPandas(ask, "_text string, a string").distinct()
    return asked.join(words, "a").groupBy("_text").agg(F.collect_list(F.struct("a", "n")).alias("_more"))


def inspect(df: DataFrame, source: str = "source", text: str = "content", ocr: str = "ocr", page: str = "page_number", cfg: OcrConfig = OcrConfig()) -> DataFrame:
    """The scanned pages of df with a text, and _found (array<struct<line_no, kind>>) and _repaired. Other rows are left out."""
    columns = [c for c in df.columns if c not in ("_found", "_repaired", "_source", "_pages", "_nodes", "_more", "_text")]
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    counted = materialize(statistics(df, source, text, ocr, cfg))
    words = known_words(counted, cfg.least_count)
    count = words.count()
    if count:
        held = most_frequent(words, count, cfg.held_words)
        examples = training_words(counted, cfg)
    else:  # nothing clean to learn from: the scanned pages themselves, in which right words outnumber wrong ones; at most 50,000 words, as wrong ones too grow in number with the pages
        scanned = statistics(df.withColumn(ocr, F.lit(False)), source, text, ocr, cfg)
        total = scanned.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0
        held = examples = _collected(known_words(scanned, max(20, total * 2e-5)))
    weights, least, grams = train(examples, cfg), min(examples.values(), default=0), trigrams(examples)
    nodes = materialize(edge_support(counted, cfg))
    letters = nodes.agg(F.sum(F.length("_source") + F.aggregate("_nodes", F.lit(0), lambda a, x: a + F.length(x.key)))).first()[0] or 0
    if letters <= cfg.broadcast_letters:  # else a shuffle join by source, whose hot partitions adaptive execution splits
        nodes = F.broadcast(nodes)
    pages = df.where(F.col(ocr) & F.col(text).isNotNull())
    ready = pages.join(nodes, F.col(source) == F.col("_source"), "left").select(*[F.col(f"`{c}`") for c in columns], "_pages", "_nodes")
    if count > len(held):
        ready = ready.withColumn("_text", F.sha2(F.col(text), 256)).join(further_words(pages, text, words, count, held, weights, least, cfg, grams), "_text", "left").drop("_text")
    else:
        ready = ready.withColumn("_more", F.lit(None).cast("array<struct<a: string, n: bigint>>"))
    shared = df.sparkSession.sparkContext.broadcast((held, weights, grams))
    token = _digest(held, weights, count, least, cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = cached(("ocr", token), lambda: Editor(dict(shared.value[0]), shared.value[1], cfg, least, shared.value[2]))
        kinds = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            found, repaired = [], []
            for text_, number, pages, nodes, more in zip(*[batch.column(c).to_pylist() for c in (text, page, "_pages", "_nodes", "_more")]):
                extra = {x["a"]: x["n"] for x in more or () if x["a"] not in editor.known}
                editor.known.update(extra)
                f, r = editor.page(text_, number, pages or 0, [(x["key"], -x["minus"]) for x in nodes or ()])
                found.append([{"line_no": a, "kind": k} for a, k in f])
                repaired.append(r)
                for word in extra:
                    del editor.known[word]
            arrays = [batch.column(c) for c in columns] + [pa.array(found, kinds), pa.array(repaired, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "_found", "_repaired"])

    schema = StructType([df.schema[c] for c in columns]).add("_found", ArrayType(StructType().add("line_no", IntegerType()).add("kind", StringType()))).add("_repaired", StringType())
    return ready.mapInArrow(run, schema)


def found(df: DataFrame, key: str = "row_id", **names: str) -> DataFrame:
    """(key, line_no, kind): one row per finding of scanned pages; empty texts have none, copies have their own."""
    seen = inspect(df, **names).drop("_repaired")
    return seen.select(key, F.explode("_found").alias("f")).select(key, "f.line_no", "f.kind")


def repair(df: DataFrame, text: str = "content", ocr: str = "ocr", **names: str) -> DataFrame:
    """df with the text of scanned pages repaired into paragraphs; other rows stay as they are. The helper columns' names
    (_found, _repaired, _source, _pages, _nodes, _more, _text) are left out of the result."""
    seen = inspect(df, text=text, ocr=ocr, **names)
    columns = [c for c in df.columns if c in seen.columns and c not in ("_found", "_repaired")]
    fixed = seen.select(*[F.col("_repaired").alias(c) if c == text else F.col(f"`{c}`") for c in columns])
    return fixed.unionByName(df.where(~F.coalesce(F.col(ocr) & F.col(text).isNotNull(), F.lit(False))).select(*[F.col(f"`{c}`") for c in columns]))
