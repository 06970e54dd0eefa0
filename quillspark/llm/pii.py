"""Problem 3: find personal information in free text and replace it by typed placeholders.

Generators of high recall propose spans, which may overlap; boosted trees judge every span by its form and its context;
per kind, a threshold on the calibrated probability selects, and of overlapping selected spans the likelier stays. The
trees are fitted on composed sentences in which the personal information is known (see ``labelled``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import boosting
from quillspark.llm.tokens import cached

KINDS = ("email", "phone", "id_number", "address", "person")
TRAIN_TEXTS = 4000  # bound of the labelled sample that the trees are fitted on

# ---- generators -------------------------------------------------------------------------------------------------
# Words by which the generators and features recognise a context.
STREET_TYPES = "Street St Road Rd Avenue Ave Av Lane Ln Drive Dr Court Ct Crescent Cres Way Close Cl Boulevard Blvd Bvd Parade Pde Place Pl Terrace Tce Square Sq Highway Hwy Row Quay Walk Gardens Grove Mews Hill Esplanade Circuit Rise Wharf Wynd Alley"
UNIT_WORDS = "Unit Level Suite Lot Shop Flat Apartment Apt Floor Building Bldg Block Warehouse Factory Ste"
TITLES = "Mr Mrs Ms Miss Dr Prof Professor Sir Dame Hon Rev Mx Herr Frau"
GIVEN = """Adam Adrian Agnes Ahmed Aisha Alan Albert Alena Alex Alexander Alice Amara Amelia Amina Ana Andrea Anne Andrew Anja Anna Anneke Anton Aroha Arthur Austin Barbara Beatriz Ben Bogdan Boris Brian Bruno Bálint Camila Carl Carlos Carmen Caroline Celeste Charles Chen Chloe Christine Clara Claire Daniel David Deepak Diana Diego Dmitri Dorota Edward Elena Elif Elise Elizabeth Elodie Emil Emily Emma Eric Erik Esther Eva Farid Fatima Felix Fergus Fiona Frances Francis Frank Fritz George Georgia Gerald Giulia Grace Greta Gwen Hamish Hannah Hans Harriet Hassan Helen Henry Hiro Hoang Hugo Ian Ibrahim Imogen Ines Ingrid Irina Isabel Ivan Jack James Jan Jane Jean Jean-Luc Jennifer Joan João Joel Johan John Jonas Jorge José Joseph Julia Jurek Kai Karen Karl Kate Katherine Katya Ken Kevin Kiri Kofi Laura Lawrence Leila Leon Leopold Lindiwe Linda Lucas Lucia Luis Magda Marco Margaret Maria Marie Mark Marta Martin Mary Matteo Matthew May Mei Michael Miguel Mirela Mohamed Moira Monika Nadia Natasha Nguyen Niamh Nicholas Nina Noah Nora Olga Oliver Omar Oskar Pablo Patricia Paul Pedro Peter Petra Philip Pierre Piotr Priya Quentin Rachel Rajesh Rebecca Rhys Richard Robert Rosalind Rosa Rose Ottoline Ruth Samuel Sandra Sanjay Saoirse Sarah Sean Sergei Simon Sofia Sonia Stefan Stephen Susan Sven Tamsin Tariq Thabo Theodora Thomas Tomas Ulrike Umar Ursula Valentina Vera Victor Victoria Viktor Wanda Wei William Xavier Yara Yuki Yusuf Zoë Zofia Zara""".split()
NOT_NAMES = """Account Holder Facility Manager Warehouse Keeper Service Provider Supplier Depositor Guarantor Carrier Operator Customer Party Parties Agreement Schedule Clause Section Annex Part Page Form Initials Charges Where Neither Each Any If On In For The This That These Save Unless Despite Having Subject Except Provided Whether According Goods Notices Claim Claims Failure Reference Set To Of And With At By From An As Or Upon Within After Before During Until When While It Its Our Your We They He She You All No Not Only Such
January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec
Foods Food Seafoods Poultry Meats Dairy Ingredients Beverages Packaging Logistics Orchards Confectionery Bakery Products Cream Ice Fresh Produce Frozen Cold Services Group Company Holdings International Manufacturing Distribution Brothers Sons Limited Ltd Pty Inc Llc Plc Gmbh Records Room Canada Australia Zealand Ireland Poland Polska Kingdom States United New
Tel Email Fax Phone Mobile Address Occupation Witness Name Keys Signed Visitor Log Dear Yours Bank National Insurance Passport Please Ring Deliver Forklift Invoice Insurance Storage Service Credits Recall Procedure Term Renewal Dispute Resolution Confidential Information Prepared Retrieved Printed Copy Open Was Tell Share Compiled Hygiene Pest Control Handling Picking Pallet Exchange Data Liability Temperature Weekend Cover Dock Scheduling Yard Access Allergen Separation Cycle Counting Stock Rotation Export Certification Case Labelling Order Waste Removal Battery Charging Container Unloading Licence Transition Review Calculation Adjustment Suspension Definitions Interpretation Subcontractors Energy Surcharge Eur Gbp Usd Pln Aud Sku Sscc Inv Po Tfn Ssn Box""".split()
PERSON_LEFT = "by with see attention attn dear for as names and to of spoke from cc faithfully sincerely contact ask driver log check keys witness name neither nor via is regards".split()
PERSON_RIGHT = "ok pending may must shall of will tel no on in about expired showed arrived before confirmed gives and as occupation has was said email phone tfn ssn passport marked with for from or is at".split()
ID_LABELS = r"passport(?:\s+(?:no|number|nr)\b\.?)?|(?:id|identity)\s+card(?:\s+(?:no|number)\b\.?)?|licen[cs]e(?:\s+(?:no|number)\b\.?)?|tfn|tax\s+(?:file\s+number|id)|ssn|social\s+security\s+(?:number|no\b\.?)|insurance(?:\s+(?:number|no\b\.?))?|ni\s+(?:number|no\b\.?)|medicare(?:\s+(?:no|number|card)\b\.?)?|pesel|nhs\s+(?:number|no\b\.?)"
#: words that stand near a person's number, in more languages; they are features, not conditions
ID_WORDS = r"passport|reisepass|paszport|passeport|id|identity|licen[cs]e|permis|rijbewijs|f[üu]hrerschein|tfn|tax|steuer|social|insurance|ssn|ni|nino|medicare|pesel|nhs|dni|nie|bsn|nip|cpf|fiscale|ausweis|personalausweis|aadhaar|sin|curp|holder|birth|born"
ID_KEYWORDS = ("passport", "id card", "id\ncard", "identity", "licence", "license", "tfn", "tax file", "tax\nfile", "tax id", "ssn", "social", "insurance", "ni n", "ni\nn", "medicare", "pesel", "nhs")
DECOYS = r"(?:po|sku|sscc|inv|container|meter|company number|permit|lot|rate code|order|invoice|abn|acn|vat|serial|batch|ref|reference|pallet|form|ticket|draft|revision|schedule|clause|chamber|bay|gate|sheet|page|no\.|abn)[\s#:]*$"

_STREETS = "|".join(sorted({v for w in STREET_TYPES.split() for v in (w, w.upper())}, key=len, reverse=True))
_UNITS = "|".join(v for w in UNIT_WORDS.split() for v in (w, w.upper(), w.lower()))
_W = r"[ \t  　]*\n?[ \t  　]*"  # within an item, one line end at most
_WS = r"[\s ]{1,4}"
_DIGIT_LIKE = re.compile(r"[0-9OoIlSB]")
_LINE_NUMBERS = re.compile(r"\d{1,4}\n\d{1,4}")
_NATIONAL = re.compile(r"n.{1,2}tion.{1,2}l\s+$")
_AT = re.compile(r"[@(\[{](?:(?<=@)|(?<!@)\s?[aA][tT]\s?[\)\]}])")
DOMAIN = re.compile(rf"{_W}[\w\-]+(?:[ \t]?\.[\w\-]+|{_W}[\(\[{{]\s?[dD][oO][tT]\s?[\)\]}}]{_W}[\w\-]+){{1,4}}")
_GROUP = r"(?:[ .\-\u00a0\u2003\u3000\u2011]{1,2}|[ \-]?\n|(?<=\)))\(?[\dOoIlSB]{1,6}\)?"
# the first character stands first, before what must not precede it, so that the search skips to it
PHONE = re.compile(rf"[+(\dOo](?<![\w@/.,$€£%\-].)(?:(?<=\+)[\s]?\d|(?<=\()\+?[\dOo]|(?<=[\dOo])(?!(?<=[12])[09]\d\d-\d\d-\d\d\b|\d?/\d))[\dOoIlSB()]{{0,16}}(?:(?:{_GROUP}){{1,6}}(?!\w)|(?<=\d{{9}})(?!\w))")
ID = re.compile(rf"(?i:{ID_LABELS})[\s ]*[:#\-]?[\s ]*(?P<v>(?=[A-Z\d][A-Z\d \n\- ]*\d)[A-Z]{{0,4}}[ \-\n]?[\dOIlSB](?:[ \-\n ]?[\dOIlSB]){{3,12}}(?:[ \-]?[A-Z](?![\w]))?)(?![a-z])")
#: any number that could be of a document, without regard to what stands before it
NUMBER = re.compile(r"(?<![\w@/.,$€£%#+\-])(?:[A-Z]{1,4}[\-]?|[A-Z]{2}[ ](?<!NI[ ])(?<!ID[ ])|)\d(?:[ \-]?\d){5,12}(?:[ \-]?[A-Z])?(?![\w/]|[.,]\d)")
#: where a NUMBER can begin: from here it has six digits
_NUMBER_START = re.compile(r"[A-Z\d](?<![\w@/.,$€£%#+\-].)(?=(?:(?<=\d)|[A-Z]{0,3}[\- ]?\d)(?:[ \-]?\d){5})", re.S)
BOX = re.compile(rf"\b(?:G\.?{_W})?(?:P\.?\s?O\.?{_WS}Box|PO{_WS}BOX|P\.O\.{_WS}BOX|GPO{_WS}Box|Locked{_WS}Bag|Private{_WS}Bag|Post{_WS}Office{_WS}Box|Postfach|p\.?o\.?{_WS}box){_WS}[\dOIl]{{1,6}}\b")
HOUSE = re.compile(rf"(?:(?<![\w])(?P<unit>(?:{_UNITS})\.?{_WS}[\dA-Z][\dA-Z]{{0,4}})(?:{_W},{_W}|{_WS}))?(?<![\w.,$/\-])(?P<no>(?:\d{{1,4}}[A-Za-z]?(?:{_W}[/\-–]{_W}\d{{1,5}}[A-Za-z]?)?{_WS}))?(?P<street>(?:[A-Z][\w'’]+{_WS}){{1,3}})(?P<type>{_STREETS})\b")
_NUMBERED = re.compile(r"\d[A-Za-z]?[\s ]{1,4}[A-Z]")
_STREET_AFTER = re.compile(rf"(?:[A-Z][\w'’]+{_WS}){{1,3}}(?:{_STREETS})\b")
# Kinds of streets that stand before the name, and endings of names, in other languages.
_TYPE_FIRST = r"rue|allée|chemin|quai|impasse|via|viale|piazza|corso|calle|avenida|plaza|paseo|rua|praça|travessa|ul\.|ulica|al\.|aleja|os\."
_TYPE_LAST = r"stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|ufer|damm|straat|laan|plein|gracht|kade|singel|gatan|vägen|gade|vej"
_NAME = r"(?:(?:de|du|des|la|le|les|del|della|dei|das|dos|da|do|von|den|der|van|św\.)[ ]){0,3}[A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻ][\w'’.\-]+(?:[ ][A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻ][\w'’\-]+)?"
FOREIGN = re.compile(rf"(?:(?<![\w/.,\-])\d{{1,4}}(?:[ ]?(?:bis|ter|[a-zA-Z]))?,?[ ])(?i:{_TYPE_FIRST})[ ]{_NAME}|\b(?i:{_TYPE_FIRST})[ ]{_NAME},?[ ]\d{{1,4}}[a-zA-Z]?\b|\b[A-ZÄÖÜ][\wäöüß\-]*(?i:{_TYPE_LAST})[ ]\d{{1,4}}[ ]?[a-zA-Z]?\b|\b[A-ZÄÖÜ][\wäöüß\-]+[ ](?i:{_TYPE_LAST})[ ]\d{{1,4}}[a-zA-Z]?\b")
CUE = re.compile(r"\b(?:[Mm]y name is|I am|I'm|[Tt]his is|[Hh]i|[Hh]ello|[Rr]egards,?|[Tt]hanks,?|[Cc]heers,?)[ \n]([A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’\-]+)(?![\w'’\-]|[ ][A-Z])")
_T = r"(?:[A-ZÀ-ÖØ-Þ]\.(?:\s?[A-ZÀ-ÖØ-Þ]\.){0,2}(?![\w])|[A-ZÀ-ÖØ-Þ][\w'’]*(?:[\-‐][A-ZÀ-ÖØ-Þ]?[\w'’]+)*)"
_PART = r"(?:(?:VON|VAN|DE|DER|von|van|de|der|den|da|dos|di|del|la|le|bin|al|ter)[ \n])"
_NICK = r"(?:[“\"'‘(][A-ZÀ-Þ][\w]+[”\"'’)])"
_GAP = r"[ \t  　]{0,3}\n?[ \t  　]{0,2}"
_SEP = r"(?:[ \t  　]{1,3}\n?|\n)"
_OPENING = r"(?!(?:Dear|According|Neither|Yours|Signed|Name|Keys|Witness|Attention|Contact|Email|Tel|Visitor|Notices|Please)\b)"
_NEXT = rf"(?:{_SEP}|(?<=\.){_GAP}){_OPENING}(?:{_PART}){{0,2}}(?:{_NICK}{_SEP})?{_T}"
PERSON = re.compile(rf"(?<![\w@.’'\-°])(?:(?P<title>(?:{'|'.join(TITLES.split())})\.?{_SEP})(?P<t>(?:{_PART}){{0,2}}{_T}(?:,{_SEP}{_T}(?:{_NEXT}){{0,2}}|(?:{_NEXT}){{0,4}}))|(?P<n>{_OPENING}(?:{_PART}){{0,2}}{_T}(?:,{_SEP}{_T}(?:{_NEXT}){{0,2}}|(?:{_NEXT}){{1,4}})))(?!\w)")

#: where a PERSON can begin: at a capital or a particle
_PERSON_START = re.compile(r"[A-ZÀ-ÖØ-Þvdblat](?<![\w@.’'\-°].)(?:(?<=[A-ZÀ-ÖØ-Þ])|(?=(?<=v)[ao]n[ \n]|(?<=d)(?:e|er|en|a|os|i|el)[ \n]|(?<=l)[ae][ \n]|(?<=b)in[ \n]|(?<=a)l[ \n]|(?<=t)er[ \n]))", re.S)

# Patterns of another engine (RE2) that a text has wherever the rarer patterns match; they look at all texts of a batch at once.
_ANY_BLANK = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WIDE_DIGITS = "".join(rf"\x{{{c:x}}}" for c in range(256, 1 << 17) if chr(c).isdecimal())
_ANY_DIGIT = rf"[0-9{_WIDE_DIGITS}]"
_HAS_WIDE_DIGIT = rf"[{_WIDE_DIGITS}]"
_HAS_ID = rf"(?i:{ID_LABELS})[\s]*[:#\-]?[\s]*[A-Z]{{0,4}}[ \-\n]?[\dOIlSB](?:[ \-\n ]?[\dOIlSB]){{3}}".replace(r"\b", "").replace(r"[\s]", r"\s").replace(r"\s", _ANY_BLANK).replace(r"\d", _ANY_DIGIT[1:-1]) + "|[İı]"
_HAS_BOX = rf"(?:[Bb]ox|BOX|Bag|Postfach){_ANY_BLANK}{{1,4}}[0-9OIl{_WIDE_DIGITS}]"
_HAS_FOREIGN = rf"(?:^|[^A-Za-z0-9_])(?i:{_TYPE_FIRST})[ ](?:(?:de|du|des|la|le|les|del|della|dei|das|dos|da|do|von|den|der|van|św\.)[ ]|[A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻ])|(?i:{_TYPE_LAST})[ ]{_ANY_DIGIT}|[İı]"
_HAS_CUE = r"(?:[Mm]y name is|I am|I'm|[Tt]his is|[Hh]i|[Hh]ello|[Rr]egards,?|[Tt]hanks,?|[Cc]heers,?)[ \n][A-ZÀ-ÖØ-Þ]"

# Kinds of characters, of which one has several: by them the places where the more frequent patterns can begin are looked up
# in arrays. A character beyond Latin-1 is looked up as a question mark, which is of every kind that lets a pattern go on.
_DIGIT, _UPPER, _CAPITAL, _PHONE_FIRST, _PHONE_CHAR, _BLANK, _NO_PHONE, _NO_NUMBER, _NO_PERSON, _WORD, _LETTER, _BRACKET, _SMALL = (1 << i for i in range(13))


def _kinds_of_characters() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint16)
    for bit, members in (
        (_DIGIT, r"[0-9]"), (_UPPER, r"[A-Z]"), (_CAPITAL, r"[A-ZÀ-ÖØ-Þ]"), (_PHONE_FIRST, r"[+(0-9Oo]"), (_PHONE_CHAR, r"[0-9OoIlSB()+.\-\s?]"), (_BLANK, r"[\s?]"),
        (_NO_PHONE, r"[\w@/.,$£%\-]"), (_NO_NUMBER, r"[\w@/.,$£%#+\-]"), (_NO_PERSON, r"[\w@.'\-°]"), (_WORD, r"[\w'\-]"), (_LETTER, r"[A-Za-z]"), (_BRACKET, r"[@(\[{]"), (_SMALL, r"[vdblat]"),
    ):
        for c in range(256):
            kinds[c] |= bit * bool(re.match(members, chr(c)))
    return kinds


_KINDS = _kinds_of_characters()
_PARTICLE_PAIR = np.zeros(1 << 16, dtype=bool)
_PARTICLE_PAIR[[ord(a) << 8 | ord(b) for a, b in "va vo de da do di la le bi al te".split()]] = True
_TITLE_FIRST = np.isin(np.arange(256), [ord(w[0]) for w in TITLES.split()])
_GROUP_CHARS = 1 << 20  # texts are looked at in groups of at most so many characters; a longer text is searched without arrays

_STOP = {w.lower() for w in NOT_NAMES}
_GIVEN = {w.lower() for w in GIVEN}
_STREET_SET = {w.lower() for w in STREET_TYPES.split()}
_TITLE_SET = {w.lower() for w in TITLES.split()}
_TOKENS = re.compile(r"[^\s,]+")
_LEFT_WORDS = re.compile(r"([\w'’]+)\W*$")
_RIGHT_WORD = re.compile(r"^\W*?([A-Za-z]+)")


_OCR = str.maketrans("015|!@", "olslia")


def _ocr(word: str) -> str:
    return word.translate(_OCR)


def _stop(token: str) -> bool:
    return token.strip(".,;:'’“”\"()").lower() in _STOP


def _is_name_may(text: str, start: int, end: int, run: list) -> bool:
    """May is a given name after a surname and comma, or before another name, unless a day or a year stands beside it."""
    if re.search(r"\d\W*$", text[max(0, start - 3) : start]):
        return False
    return bool(run) and text[:start].rstrip().endswith(",") or bool(re.match(r"\s+(?:[a-z]+\s|[“\"])?[A-Z]", text[end : end + 12]))


def _matches(pattern: re.Pattern, start: re.Pattern | list[int] | None, text: str) -> Iterator[re.Match]:
    """pattern.finditer(text), tried only at the starts, which ascend, or where start, which is one character, matches."""
    if start is None:
        return pattern.finditer(text)
    return _matches_at(pattern, start if isinstance(start, list) else (at.start() for at in start.finditer(text)), text)


def _matches_at(pattern: re.Pattern, starts: Iterable[int], text: str) -> Iterator[re.Match]:
    done = 0
    for at in starts:
        if at >= done and (m := pattern.match(text, at)):
            yield m
            done = m.end()


def _persons(text: str, matches: Iterator[re.Match], skip: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, after a title): runs of capitalised words, without the words that aren't parts of names at their ends."""
    for m in matches:
        titled = m["title"] is not None
        start, words = (m.start("t"), m["t"]) if titled else (m.start("n"), m["n"])
        names = _names(words, titled)
        for s, e, title, later in _names_at(words, titled, text, start) if names is None else names:
            s, e = s + start, e + start
            if any(a < e and s < b for a, b in skip):
                continue
            yield s, e, title
            if later is not None:
                yield later + start, e, title


_SEEN: dict[tuple[str, bool], tuple[tuple[int, int, bool, int | None], ...] | None] = {}  # a dict travels with the job, a decorated function doesn't


def _names(words: str, titled: bool) -> tuple[tuple[int, int, bool, int | None], ...] | None:
    """_names_at, if it is the same wherever the words stand, else None."""
    if (words, titled) not in _SEEN:
        if len(_SEEN) >= 1 << 14:
            _SEEN.clear()
        plain = [t.strip(".,;:'’“”\"()") for t in _TOKENS.findall(words)]
        _SEEN[words, titled] = None if any(len(w) == 1 or w in ("May", "MAY") for w in plain) else tuple(_names_at(words, titled, words, 0))
    return _SEEN[words, titled]


def _names_at(words: str, titled: bool, text: str, start: int) -> Iterator[tuple[int, int, bool, int | None]]:
    """(start, end, after a title, where a second one begins) of the names in words, which stand in text from start."""
    parts = [(t.start(), t.end(), t[0]) for t in _TOKENS.finditer(words)]
    # a run is cut at titles and at words of contracts
    run: list[tuple[int, int, str]] = []
    runs: list[tuple[list[tuple[int, int, str]], bool]] = []
    after = titled
    for p in parts:
        word = p[2].strip(".,;:'’“”\"()")
        if word.lower() in _TITLE_SET and len(word) > 1:
            if run:
                runs.append((run, after))
            run, after = [], True
        elif word.lower() in _STOP and not (word in ("May", "MAY") and _is_name_may(text, start + p[0], start + p[1], run)):
            if run:
                runs.append((run, after))
            run, after = [], False
        elif len(word) == 1 and not run and re.search(r"[\d°]\s?$", text[max(0, start + p[0] - 2) : start + p[0]]):
            pass  # degrees
        else:
            run.append(p)
    if run:
        runs.append((run, after))
    # a name may have a word of contracts in it (Helen Page, Jan Bell): the uncut run is proposed too
    plain_words = [p[2].strip(".,;:'’“”\"()").lower() for p in parts] if 2 <= len(parts) <= 3 else []
    if plain_words and sum(w in _STOP for w in plain_words) == 1 and any(_near_given(w) for w in plain_words) and not any(w in _TITLE_SET for w in plain_words):
        runs.append((parts, titled))
    for run, title in runs:
        plain = [w for w in run if len(w[2].strip(".,'’")) > 1 and not re.fullmatch(r"(?:[A-Z]\.)+", w[2])]
        if not plain:
            continue
        if len(run) == 1 and not title:
            continue
        s, e = run[0][0], run[-1][1]
        while e > s and words[e - 1] in ",;:.'’ \n":
            e -= 1
        # an unknown word before a given name may be the end of the sentence before, misread
        later = next((w for w in run[1:-1] if _near_given(w[2].lower())), None)
        if later and (_near_given(run[0][2].strip(",.").lower().split("-")[0]) or "," in words[s:e]):
            later = None
        yield s, e, title, later[0] if later else None


def _local_start(text: str, at: int) -> int | None:
    """Where the part before an @ begins; None if there is none. A blank or one line end may stand between."""
    end, line = at, False
    while end and (text[end - 1] in " \t\u00a0\u2003\u3000" or text[end - 1] == "\n" and not line):
        line |= text[end - 1] == "\n"
        end -= 1
    begin = end
    while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.+'’-"):
        begin -= 1
    while begin < end and not (text[begin].isascii() and text[begin].isalnum() or "À" <= text[begin] <= "ÿ"):
        begin += 1
    return begin if begin < end else None


def _starts(texts: list[str]) -> list[tuple[list[int], ...]]:
    """By text, where _AT, PHONE, NUMBER, _NUMBERED and PERSON can begin, ascending; there may be more places than matches.
    Digits are those of Latin-1."""
    parts = [t.encode("latin-1", "replace") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n" * 8, dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    kinds = _KINDS.take(data)
    n = len(data) - 7
    # a start is a position in data from 1, so that what stands before it and after it is there
    brackets = np.flatnonzero(kinds[:n] & _BRACKET > 0)
    one, two, three = (data[brackets + i] | 32 for i in (1, 2, 3))
    ats = brackets[(data[brackets] == ord("@")) | (one == ord("a")) & (two == ord("t")) | (kinds[brackets + 1] & _BLANK > 0) & (two == ord("a")) & (three == ord("t"))]

    phones = np.flatnonzero((kinds[1:n] & _PHONE_FIRST > 0) & (kinds[: n - 1] & _NO_PHONE == 0) & (kinds[2 : n + 1] & kinds[3 : n + 2] & _PHONE_CHAR > 0)) + 1
    phones = phones[(data[phones] != ord("(")) | (kinds[phones + 1] & _PHONE_FIRST > 0) & (data[phones + 1] != ord("("))]

    # six digits with one blank or dash at most between two of them, and the letters before
    digits = np.flatnonzero(kinds[:n] & _DIGIT > 0)
    between = data[digits + 1]
    linked = np.append(np.diff(digits), 9)
    linked = (linked == 1) | (linked == 2) & ((between == ord(" ")) | (between == ord("-")))
    six = linked.copy()
    for i in range(1, 5):
        six[:-i] &= linked[i:]
        six[-i:] = False
    first = digits[six]
    before = data[first - 1]
    mark = (before == ord(" ")) | (before == ord("-"))
    free = kinds[first - 1] & _NO_NUMBER == 0
    prefixed = (kinds[first - 1] & _UPPER > 0) | mark & (kinds[first - 2] & _UPPER > 0)
    numbers = first[free].tolist()
    for at in first[prefixed].tolist():
        at -= 1 + (data[at - 1] in b" -")
        least = at - 4
        while at > least and kinds[at] & _UPPER:
            at -= 1
        numbers.append(at + 1)
    numbers = np.array(sorted(set(numbers)), dtype=np.int64)

    # a number, and a capital after one to four blanks
    at = digits + 1 + (kinds[digits + 1] & _LETTER > 0)
    blank, upper = kinds & _BLANK > 0, kinds & _UPPER > 0
    numbered = digits[blank[at] & (upper[at + 1] | blank[at + 1] & (upper[at + 2] | blank[at + 2] & (upper[at + 3] | blank[at + 3] & upper[at + 4])))]

    def particle(at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, len(data) - 4)
        return _PARTICLE_PAIR[data[at].astype(np.uint16) << 8 | data[at + 1]] & (blank[at + 2] | blank[at + 3])

    small = np.flatnonzero((kinds[1:n] & _SMALL > 0) & (kinds[: n - 1] & _NO_PERSON == 0)) + 1
    small = small[particle(small)]
    capitals = np.flatnonzero((kinds[1:n] & _CAPITAL > 0) & (kinds[: n - 1] & _NO_PERSON == 0)) + 1
    # what follows the first word: its full stop, or the word in which a name goes on
    outside = np.flatnonzero(kinds & _WORD == 0)
    end = outside[np.searchsorted(outside, capitals + 1)]
    mark = data[end]
    following = np.minimum(end + (mark == ord(",")), len(data) - 2)
    apart = blank[following]
    for _ in range(4):
        following = np.minimum(following + (blank[following] & (data[following] != ord("?"))), len(data) - 2)
    char = data[following]
    bracket = (char == ord("(")) & ((kinds[following + 1] & _CAPITAL > 0) | (data[following + 1] == ord("?")))
    goes_on = (kinds[following] & _CAPITAL > 0) | (char == ord("?")) | (char == ord('"')) | (char == ord("'")) | bracket | particle(following)
    stopped = (mark == ord(".")) & ((end == capitals + 1) | _TITLE_FIRST[data[capitals]])
    persons = np.sort(np.concatenate([small, capitals[(mark == ord("?")) | stopped | apart & goes_on]]))

    begins = np.append(1, 1 + ends[:-1])
    cut = [(x, np.searchsorted(x, begins).tolist() + [len(x)]) for x in (ats, phones, numbers, numbered, persons)]
    return [tuple((x[c[k] : c[k + 1]] - begin).tolist() for x, c in cut) for k, begin in enumerate(begins.tolist())]


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, hint) of every proposed span; spans of different kinds may overlap."""
    return proposals([text])[0]


def proposals(texts: list[str]) -> list[list[tuple[str, int, int, int]]]:
    """The candidates of every text."""
    has = pa.array(texts, pa.string())
    has = [pc.match_substring_regex(has, pattern).to_pylist() for pattern in (_HAS_WIDE_DIGIT, _HAS_ID, _HAS_BOX, _HAS_FOREIGN, _HAS_CUE)]
    plain = [wide or len(text) > _GROUP_CHARS for wide, text in zip(has[0], texts)]
    starts = _starts(["" if p else text for p, text in zip(plain, texts)])
    return [*map(_proposed, texts, [(None,) * 5 if p else s for p, s in zip(plain, starts)], *has[1:])]


def _proposed(text: str, starts: tuple[list[int] | None, ...], has_id: bool, has_box: bool, has_foreign: bool, has_cue: bool) -> list[tuple[str, int, int, int]]:
    """The candidates of a text, whose patterns are tried at the starts, or everywhere for None."""
    ats, phones, numbers, numbered, persons = starts
    out: list[tuple[str, int, int, int]] = []
    for at in _matches(_AT, ats, text):
        after = DOMAIN.match(text, at.end())
        begin = _local_start(text, at.start()) if after else None
        if begin is not None:
            out.append(("email", begin, after.end(), 0))
    for m in _matches(PHONE, phones, text):
        phone = m[0]
        if len(phone) >= 7 and 7 <= len(_DIGIT_LIKE.findall(phone)) <= 15 and phone.count("\n") < 2 and not _LINE_NUMBERS.fullmatch(phone):
            around = phone[0] == "(" and phone.find(")") in (-1, len(phone) - 1)  # a bracket around the whole number isn't part of it
            out.append(("phone", m.start() + around, m.end() - (around and phone[-1] == ")"), 0))
    if has_id:
        lower = text.lower()
        if len(lower) == len(text):
            for word in ID_KEYWORDS:
                at = lower.find(word)
                while at >= 0:
                    m = ID.match(text, at) if at == 0 or not lower[at - 1].isalnum() else None
                    if m and m["v"].count("\n") < 2 and (word != "insurance" or _NATIONAL.search(lower, max(0, at - 12), at)):
                        out.append(("id_number", m.start("v"), m.end("v"), 0))
                    at = lower.find(word, at + len(word))
        else:  # a letter whose lower case is longer moves the positions
            out += [("id_number", m.start("v"), m.end("v"), 0) for m in ID.finditer(text)]
    labelled_at = [(a, b) for k, a, b, _ in out if k == "id_number"]
    out += [("id_number", m.start(), m.end(), 1) for m in _matches(NUMBER, _NUMBER_START if numbers is None else numbers, text) if not any(a < m.end() and m.start() < b for a, b in labelled_at)]
    if has_box:
        out += [("address", m.start(), m.end(), 1) for m in BOX.finditer(text)]
    done = 0
    for number in _matches(_NUMBERED, numbered, text):
        if number.start() >= done and (street := _STREET_AFTER.match(text, number.end() - 1)):
            for m in HOUSE.finditer(text, max(done, number.start() - 45), street.end()):  # a unit and its number are at most so long
                if (m["no"] or m["unit"]) and m.start() <= street.start():
                    out.append(("address", m.start("unit") if m["unit"] else m.start("no"), m.end(), 2))
                    done = m.end()
    if has_foreign:
        out += [("address", m.start(), m.end(), 3) for m in FOREIGN.finditer(text)]
    taken = [(s, e) for k, s, e, _ in out if k in ("address", "email")]
    for s, e, titled in _persons(text, _matches(PERSON, _PERSON_START if persons is None else persons, text), taken):
        out.append(("person", s, e, int(titled)))
    if has_cue:
        out += [("person", m.start(1), m.end(1), 2) for m in CUE.finditer(text) if not _stop(m[1])]
    return out


# ---- features ----------------------------------------------------------------------------------------------------
FEATURES = """email phone id address person length tokens digits letters upper groups group_first group_last group_most plus paren zero dots dashes spaces lines at_sign at_word tld
label_phone label_id label_decoy money date_like left_person left_address right_person right_address titled given given_first given_fuzzy initials stops streets comma caps particles hyphen quote
sentence_start next_open next_comma next_digit prev_digit prev_slash next_slash street_after line_alone unit box house_no ocr_digits foreign id_word decoy_word bare single""".split()
_COLUMN = {name: i for i, name in enumerate(FEATURES)}
_PHONE_LABEL = re.compile(r"(?:tel|phone|call|ring|fax|mobile|mob|cell|number is|telephone from|contact|on|dial|sms|left|at|hours access call|\(|/|email|and|:|,)[\s:.]*$", re.I)
_PHONE_WORD = re.compile(r"\b(?:tel|phone|call|ring|fax|mobile|mob|telephone|callback|dial|keys|contact|ext)\b", re.I)
_ID_LABEL = re.compile(rf"\b(?:{ID_LABELS})[\s:#]*$", re.I)
_DECOY = re.compile(DECOYS, re.I)
_ID_WORD = re.compile(rf"\b(?:{ID_WORDS})\b", re.I)
_DECOY_WORD = re.compile(r"\b(?:po|sku|sscc|inv|invoice|container|meter|company|permit|lot|rate|order|vat|abn|acn|serial|batch|pallet|ticket|under|form|account|iban|total|cartons?|kg|eur|gbp|usd|aud|pln)\b", re.I)
_MONEY = ("EUR", "USD", "GBP", "PLN", "AUD", "$", "€", "£")
# The words of these patterns as sets, for text of ASCII letters, where looking words up is cheaper than the patterns.
_RUN = re.compile(r"\w+")
_ID_WORDS = frozenset(ID_WORDS.replace("licen[cs]e", "licence|license").replace("[üu]", "u").split("|"))
_DECOY_WORDS = frozenset(_DECOY_WORD.pattern[5:-3].replace("cartons?", "carton|cartons").split("|"))
_PHONE_WORDS = frozenset(_PHONE_WORD.pattern[5:-3].split("|"))
_ID_FIRST = frozenset("passport id identity licence license tfn tax ssn social insurance ni medicare pesel nhs".split())
_DECOY_ENDS = tuple(DECOYS[3 : DECOYS.index(")")].replace("\\", "").split("|"))
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f#:"
_PHONE_ENDS = tuple(_PHONE_LABEL.pattern[3 : _PHONE_LABEL.pattern.index(")")].replace("\\", "").split("|"))
_PHONE_BLANKS = _BLANKS.replace("#", "") + "."
_DIGITS = re.compile(r"\d+")
_INITIALS = re.compile(r"(?:\w\.?){1,3}")
_OPEN_AFTER = re.compile(r"[A-Za-z]\s?\(\(?$")
_PERSON_LEFT, _PERSON_RIGHT = frozenset(PERSON_LEFT), frozenset(PERSON_RIGHT)
_ADDRESS_LEFT = re.compile(r"(?:\bat|\bto|\bof|\bfrom|lives at|sent to|samples to|back to|address:?|,|\bnear|\bin|\bis)\s*$", re.I)
_ADDRESS_RIGHT = re.compile(r"^\s*,?\s*(?:[A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+)?,?\s)?(?:[A-Z]{2,3}\s)?\d{4,5}\b|^\s*,\s*[A-Z]|^\s*(?:were|gives|marked|-|for)\b")
_AFTER_STREET = re.compile(rf"(?:\b(?:{_STREETS})\.?|\bBox\s\d+)\s?[,;]\s*$", re.I)
_DATE = re.compile(r"^(?:\d{4}-\d\d-\d\d|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})$")


def _near_given(word: str) -> bool:
    w = _ocr(word.lower())
    return w in _GIVEN


def features(text: str, kind: str, start: int, end: int, hint: int) -> list[float]:
    return features_of([(text, kind, start, end, hint)])[0].tolist()


def features_of(rows: list[tuple[str, str, int, int, int]]) -> np.ndarray:
    """The features of spans, a row each: (text, kind, start, end, hint). Computed by kind, a column at a time."""
    out = np.zeros((len(rows), len(FEATURES)))
    by_kind: dict[str, list[int]] = {}
    for i, row in enumerate(rows):
        by_kind.setdefault(row[1], []).append(i)
    for kind, at in by_kind.items():
        block = np.zeros((len(at), len(FEATURES)))
        for name, values in _columns(kind, [rows[i] for i in at]).items():
            block[:, _COLUMN[name]] = values
        out[at] = block
    return out


def _columns(kind: str, rows: list[tuple[str, str, int, int, int]]) -> dict[str, list | int]:
    spans = [text[s:e] for text, _, s, e, _ in rows]
    lefts = [text[max(0, s - 40) : s] for text, _, s, _, _ in rows]
    rights = [text[e : e + 40] for text, _, _, e, _ in rows]
    hints = [row[4] for row in rows]
    groups = [[*map(len, _DIGITS.findall(x))] for x in spans]
    letters = [sum(map(str.isalpha, x)) for x in spans]
    befores = [x[-2:].strip()[-1:] for x in lefts]
    afters = [x[:2].strip()[:1] for x in rights]
    f = {
        {"id_number": "id"}.get(kind, kind): 1,
        "length": [*map(len, spans)], "tokens": [len(x.split()) for x in spans], "digits": [*map(sum, groups)], "letters": letters, "upper": [sum(map(str.isupper, x)) / max(1, n) for x, n in zip(spans, letters)],
        "groups": [*map(len, groups)], "group_first": [g[0] if g else 0 for g in groups], "group_last": [g[-1] if g else 0 for g in groups], "group_most": [max(g, default=0) for g in groups],
        "dots": [x.count(".") for x in spans], "dashes": [x.count("-") for x in spans], "spaces": [x.count(" ") for x in spans], "lines": [x.count("\n") for x in spans],
        "next_digit": [x.isdigit() for x in afters], "prev_digit": [x.isdigit() for x in befores], "prev_slash": [x == "/" for x in befores], "next_slash": [x == "/" for x in afters],
    }
    if kind in ("phone", "id_number"):
        lows = [x.lower() if x.isascii() else None for x in lefts]
        words = [_RUN.findall(x) if x is not None else () for x in lows]
        has = lambda known, pattern: [not known.isdisjoint(w) if low is not None else bool(pattern.search(x)) for x, low, w in zip(lefts, lows, words)]
        f |= {
            "plus": [x[:1] == "+" for x in spans], "paren": [x[:1] == "(" for x in spans], "zero": [x[:1] in "0O" for x in spans],
            "money": [x.rstrip().endswith(_MONEY) for x in lefts], "label_decoy": [low.rstrip(_BLANKS).endswith(_DECOY_ENDS) if low is not None else bool(_DECOY.search(x)) for x, low in zip(lefts, lows)],
            "label_id": [(low is None or not _ID_FIRST.isdisjoint(w)) and bool(_ID_LABEL.search(x)) for x, low, w in zip(lefts, lows, words)], "sentence_start": [not x or x.rstrip(" ")[-1:] in ".\n" for x in lefts],
            "date_like": [bool(_DATE.match(x.strip())) for x in spans],
        }
        phone_word = has(_PHONE_WORDS, _PHONE_WORD)
    else:
        ends = [x.rstrip() for x in lefts]
        tokens = [_TOKENS.findall(x) for x in spans]
        bares = [[t.strip(".,;:'’“”\"()").lower() for t in ts] for ts in tokens]
        f |= {"next_open": [x[:3].lstrip()[:1] == "(" for x in rights], "next_comma": [x[:1] == "," for x in rights], "sentence_start": [not end or end[-1] == "." or "\n" in x[len(end) :] for x, end in zip(lefts, ends)]}
    if kind == "id_number":
        f |= {"bare": [h == 1 for h in hints], "id_word": has(_ID_WORDS, _ID_WORD), "decoy_word": has(_DECOY_WORDS, _DECOY_WORD), "label_phone": [2 * x for x in phone_word]}
    elif kind == "email":
        f |= {"at_sign": [x.count("@") for x in spans], "at_word": [len(re.findall(r"[\(\[{]\s?at", x, re.I)) for x in spans], "tld": [bool(re.search(r"(?:example|invalid|test|com|org|net|edu|gov|io|au|uk|pl|de|us)$", x, re.I)) for x in spans]}
    elif kind == "phone":
        f |= {"label_phone": [_phone_label(x, low) + 2 * w for x, low, w in zip(lefts, lows, phone_word)], "ocr_digits": [sum(map(x.count, "OoIlSB")) for x in spans], "left_person": ["(" in x[-2:] and bool(_OPEN_AFTER.search(x)) for x in lefts]}
    elif kind == "address":
        f |= {
            "foreign": [h == 3 for h in hints], "left_address": [bool(_ADDRESS_LEFT.search(x)) for x in lefts], "right_address": [bool(_ADDRESS_RIGHT.search(x)) for x in rights], "unit": [bool(re.match(rf"(?:{_UNITS})\b", x)) for x in spans],
            "box": [h == 1 for h in hints], "house_no": [bool(re.match(r"\d", x)) for x in spans], "stops": [sum(b in _STOP for b in bare) for bare in bares],
        }
    elif kind == "person":
        left_words = [m[1].lower() if (m := _LEFT_WORDS.search(x)) else "" for x in lefts]
        right_words = [m[1].lower() if (m := _RIGHT_WORD.search(x)) else "" for x in rights]
        f |= {
            "left_person": [w in _PERSON_LEFT for w in left_words], "right_person": [w in _PERSON_RIGHT for w in right_words], "titled": [h == 1 for h in hints], "single": [h == 2 for h in hints],
            "given": [sum(_near_given(b.split("-")[0]) or _near_given(b) for b in bare) for bare in bares], "given_first": [bool(bare) and _near_given(bare[0]) for bare in bares], "given_fuzzy": [bool(bare) and _near_given(bare[-1]) for bare in bares],
            "initials": [sum("." in t and len(b) <= 4 and bool(_INITIALS.fullmatch(b)) for b, t in zip(bare, ts)) for bare, ts in zip(bares, tokens)], "stops": [sum(b in _STOP for b in bare) for bare in bares],
            "streets": [sum(b in _STREET_SET for b in bare) for bare in bares], "comma": ["," in x for x in spans], "caps": [x.isupper() for x in spans], "particles": [sum(t in ("von", "van", "de", "der", "da", "di") for t in ts) for ts in tokens],
            "hyphen": ["-" in x for x in spans], "quote": ["“" in x or "”" in x or '"' in x for x in spans], "street_after": [w in _STREET_SET for w in right_words],
            "line_alone": [(not a or a[-1] == "\n") and (not b or b[0] == "\n") for a, b in zip(lefts, rights)], "left_address": [w in ("the", "for", "prepared", "a", "this") for w in left_words], "right_address": [w in _STOP for w in right_words],
            "unit": [end[-1:] in (",", ";") and bool(_AFTER_STREET.search(x)) for x, end in zip(lefts, ends)], "box": [len(ts) == 2 and ts[1].isupper() and len(ts[1]) <= 3 for ts in tokens],
        }
    return f


def _phone_label(left: str, low: str | None) -> bool:
    """Whether _PHONE_LABEL is found in left, of which low is the lower case, if of ASCII letters."""
    if low is None:
        return bool(_PHONE_LABEL.search(left))
    end = low.rstrip(_PHONE_BLANKS)
    return ":" in low[len(end) :] or end.endswith(_PHONE_ENDS)


# ---- the labelled sample ---------------------------------------------------------------------------------------------
_SUR_A = "Ash Bel Bur Cal Cor Dal Der Els Fen Gar Har Hol Jar Kel Lan Mar Mor Nor Ox Pem Ros Sel Tam Ul Ven Wal Wex Yar Zel Brod Dun Grim Quar Thorn".split()
_SUR_B = "ridge worth stead ford man ton ley well bury gate mont strand sund ski ovic idze uchi ette aker oyle grave mere hollow elli sen son berg sansah telm revane by".split()
_PLACES = "Ashford Millbrook Port Hadley|East Barrow|Kelston|Norbury|Harlow Junction|Tillham|Stonebridge|Osgate|Marlow|Quillham|Brackley".split("|")
_STREET_NAMES = "Bell Tannery Mill Ferry Old Dairy|Lark|Orchard|Harbour|Station|Glass House|Quarry|Saddler|King|Queen|Church|Victoria|Slip|Cooper|Osier|Kestrel".replace(" ", "|").split("|")
_DOMAINS = "mail.test harbour.example cold-hub.example staff.ice.example post.example north.invalid firm.com depot.org".split()
_FIRMS = "Foods|Seafoods Brothers|Cold Logistics|Packaging Group|Meats Manufacturing|Fresh Produce|Poultry|Bakery Products International|Beverages Distribution|Ice Cream".split("|")
_ROLES = "Service Provider|Account Holder|Facility Manager|Warehouse Keeper|Supplier|Depositor|Guarantor|Carrier|Operator|Customer".split("|")
TEMPLATES = """{P} asked for an offer on {D}.|As {P} wrote, the load was short.|The van was driven by {P} of {C}.|Please speak to {P} or {P}.|{P}, {P} and {P} were on duty.|On duty: {P} ok, {P} absent|Approved by {P} on {D}|Dear {P},|Dear {P}, we thank you.|Kind regards, {P}|Yours truly, {P}|Signed: {P}|Attn {P}|attention: {P}, {C}|My name is {G} and I run the depot.|Hi {G}|Regards, {G}
Ask for {P} at the desk.|Mail {P} at {E}.|{P} ({E})|{P} <{E}>|{P}, {F}|{P} on {F}|{P} ({F}) has the keys.|Key holder {P}, second key holder {P}, tel {F}|Badge: {P} / {P}|Driver {P} showed {i} at the gate.|{P} showed {I} and signed.|{P} gave {i} as proof.|Holder {P}, {I}|{I} belongs to {P}.|The guest {P} of {A} left at noon.|{P} lives at {A} and can be reached on {F}.|Guarantee by {P}, {A}, {F}, {I}
Occupation: clerk Witness: {P}|Name {P} Phone {F} Mail {E}|name: {P}|According to the log {P} closed the door.|Neither {P} nor {P} saw it.|It was decided by {P} with the {R}.|We met {P} about the roof.|Copy to {P}, {E}|cc: {E}, {E}|{P} was promoted.|{P} has left the firm; write to {E} instead.|From: {P} To: {P}|{P} confirmed by phone from {F}|For the {R}: {P}|signed by {P} for {C}|Mr and Mrs are polite forms.
Write to {E}.|Questions go to {E}, please.|{E}|Send the file to {E}; not to the desk.|E-mail: {E}|Mail {E} or call {F}.|Our fax is {F}.|Fax {F}|Tel. {F}|tel: {F} / fax: {F}|Telephone {F}|Call {F} after six.|Dial {F} and wait.|Please ring {F} first.|Mobile {F}|Hotline ({F})|{F}|{F} (office) {F} (home)|Reach the guard on {F} at night.|The number is {F}.|Call us: {F}. Quote {X}.
The depot is at {A}.|{A}|Visit us at {A}.|Deliver to {A}.|bring two boxes to {A}, gate {n}|Goods from {A} were sent to {A}.|Address: {A}|Post to {A} and mail {E}.|The seat of the {R} is {A}; fax {F}.|Notices go to {A}, attention {P}.|He moved from {A} to {A}.|The lease of {A} ends on {D}.|Return to {A}, marked for {P}|our site, {A}, is closed|Bring it back to {A} before {D}.
{I}|her {i}|{I} was copied.|{I} and {I}|We hold {I} with {D} as day of birth.|Proof of identity: {i}|The card shows {I}.|{P}: {I}|ID checked ({I})|Visitor {P}, {i}, came at {n}:15, dock {n}
The {R} shall pay within {n} days.|The {R} and the {R} agree on Schedule {n}.|See Clause {n}.{n} of the Storage Agreement.|{X} was paid late.|The invoice under {X} is open.|Quote {X} in all letters.|{X}, {X} and {X} were moved.|The order ({X}) is open.|as the note ({X}) says|a loss under {X} is reported|Lot {n} with {X} stands at Gate {n}.|On {D} the {R} may end this Agreement.|Pallets cost EUR {m} a week.|We paid ${m} for {X}.|GBP {m} and USD {m} are due on {D}|The tank holds {n}{n}{n} {n}{n} litres.|{n} {n}{n} {n}{n} cartons|Meter {n}{n}{n} {n}{n} {n}{n}
Cold Chain Services and Quality Assurance are listed.|The Annual Tender is open.|Fire Safety Plan {n}|PEST CONTROL AND HYGIENE {n}|Master Supply Agreement between {C} and {C}|{C} ({L}) Limited|The {C} team|Published by {C} on {D}|All rights reserved, {C}|Page {n} of {n}|Section {n} Part {n}|Schedule {n} - Rates and Charges|{L} and {L} have one gate.|The {L} Terminal and the East Yard are closed.|In {L} the {R} runs two halls.|Bay {n} Cross Dock Way is wet.|Court Order {n} was served.|Forklift Training, Level {n}, is due in March {n}.
Frozen Goods, Dairy Goods and Dry Goods|Chamber {n} is at minus {n} degrees.|Company number {n}{n}7 {n}{n}1 {n}{n}4 of {C}|Bank Holiday Monday|New Zealand Lamb and Irish Butter|Packing List {n}|Revision {n}{n} of {D}|Ticket {n}{n}{n} is closed.|Handling Charges, Peak Season|{R} and {R}|the {R}, the {R} or the {C} desk|Form {n}-{n} Rev {n}|Stock Take on {D}|Insurance of Goods at {L}|Customs Entry {X}|Quarter Two Review|Energy Surcharge Index|Data Exchange via Portal|Hygiene Officer on call|seen on {D}{N}{n}.{n}.{n} Scope of Works|kept until {D}{N}{n}.{n} Rates and Fees|checked {D}{N}{n}.{n}.{n} Term|counted on {D}{N}{n} pallets"""


def _digits(rng: np.random.Generator, pattern: str) -> str:
    return "".join(str(rng.integers(0, 10)) if c == "#" else str(rng.integers(1, 10)) if c == "%" else "ABCDEFGHJKLMNPQRSTUVWXZ"[rng.integers(0, 23)] if c == "&" else c for c in pattern)


def _compose(rng: np.random.Generator, template: str) -> tuple[str, list[tuple[str, int]]]:
    """A text and the (kind, start) of the personal information in it."""
    pick = lambda words: str(words[rng.integers(0, len(words))])
    surname = lambda: pick(_SUR_A) + pick(_SUR_B)

    def person() -> tuple[str, str]:
        given, last = pick(GIVEN), surname()
        if rng.random() < 0.08:
            given = surname()  # a name that no list has
        elif rng.random() < 0.05:
            given = f"{given}-{pick(GIVEN)}"
        last = f"O'{last}" if rng.random() < 0.05 else f"{last}-{surname()}" if rng.random() < 0.06 else f"von {last}" if rng.random() < 0.04 else last
        way = rng.random()
        name = f"{given} {last}" if way < 0.45 else f"{given[0]}. {last}" if way < 0.55 else f"{given[0]}.{pick('ABCDEFGJKLM')}. {last}" if way < 0.6 else f"{given} {pick('ABCDEFGJKLM')}. {last}" if way < 0.7 else f"{given} {pick(GIVEN)} {last}" if way < 0.8 else f"{last}, {given}" if way < 0.9 else f"{given} “{pick(GIVEN)[:3]}” {last}" if way < 0.93 else last.upper() + ", " + given if way < 0.96 else f"{given} {last}".upper()
        title = pick(["Mr ", "Mrs ", "Ms ", "Dr ", "Prof. ", "Mr. "]) if rng.random() < 0.25 else ""
        return title, name

    def email() -> str:
        local = pick([pick(GIVEN).lower() + "." + surname().lower(), pick(GIVEN)[0].lower() + surname().lower(), surname().lower() + "+claims", "dock.office", "accounts", pick(GIVEN).lower() + "_" + surname().lower() + _digits(rng, "##")])
        at = pick(["@"] * 8 + [" @ ", " (at) ", "[at]", " @\n"])
        domain = pick(_DOMAINS)
        whole = local + at + (domain.replace(".", " (dot) ") if "(at)" in at else domain.replace(".", " .", 1) if rng.random() < 0.03 else domain)
        return whole.upper() if rng.random() < 0.1 else whole

    phone = lambda: _digits(rng, pick(["(0%) #### ####", "+1 ### 555 ####", "+1 (###) 555-####", "0044 7700 900 ###", "020 7946 0###", "+614########", "1.###.555.####", "04##-###-###", "04## ### ###", "07700 900###", "(###) 555 ####", "###-555-####", "+44 20 7946 0###", "+44 (0)20 7946 0###", "O% #### ####", "(0%) 7O## ####", "+48 ## ### ## ##", "+49 30 #######", "139########", "0# ## ## ## ##", "06-########"]))
    label, form = [("Passport: ", "&%######"), ("ID card ", "&&& ######"), ("driver's licence ", "&### ### ###"), ("licence number ", "####-####-&"), ("NI number ", "QQ ## ## ## &"), ("PESEL ", "###########"), ("tax file number ", "#########"), ("TFN ", "### ### ###"), ("SSN ", "9##-##-####"), ("National Insurance ", "QQ######&"), ("social security number ", "000 ## ####"), ("passport no. ", "&&#######"), ("Medicare ", "#### ##### #"), ("DNI ", "########&"), ("Steuer-ID ", "## ### ### ###"), ("her ID is ", "#### #### ####"), ("BSN ", "#########"), ("CPF ", "### ### ### ##")][rng.integers(0, 18)]

    def address() -> str:
        street = f"{pick(_STREET_NAMES)} {pick(STREET_TYPES.split()[:22])}"
        number = _digits(rng, pick(["%", "%#", "%##", "%#/%##", "%##-%##", "%#A", "%/%#"]))
        way = rng.random()
        if rng.random() < 0.12:
            last, no = surname(), _digits(rng, pick(["%", "%#", "%##"]))
            foreign = [f"{last}straße {no}", f"{last}weg {no}", f"{last}straat {no}", f"{no} rue {pick(['de ', 'du ', ''])}{last}", f"Rua {pick(['das ', 'da ', ''])}{last} {no}", f"via {last} {no}", f"Calle {last} {no}", f"ul. {last} {no}", f"{last} Straße {no}"]
            return pick(foreign) + pick([", ", ", 10115 ", ""]) + pick(_PLACES)
        head = f"PO Box {_digits(rng, '%###')}" if way < 0.2 else f"Lot {_digits(rng, '%##')} {street}" if way < 0.28 else f"{pick(['Unit', 'Level', 'Suite', 'Shop'])} {_digits(rng, '%#')}, {number} {street}" if way < 0.5 else f"{number} {street}"
        state = pick(["", "", " NSW", " VIC", " TX", ", OH", ", QLD", ", NSW", " WA", "; ID"])
        tail = pick([", ", ", ", "; "]) + pick(_PLACES) + state + (_digits(rng, " ####") if rng.random() < 0.5 else "") if rng.random() < 0.8 else ""
        return (head + tail).upper() if rng.random() < 0.1 and way >= 0.2 else head + tail

    decoy = lambda: _digits(rng, pick(["PO 45## ### ###", "SKU #####-##", "SSCC 00398#############", "INV-20##-#####", "container &&&U ###### #", "meter ####-####", "company number ### ### ###", "permit &###/##", "lot &#####", "rate code #.#.##.#", "container ######## ###", "ABN ## ### ### ###"]))
    date = lambda: pick([_digits(rng, "202#-0%-1#"), _digits(rng, "1#/0%/202#"), _digits(rng, "% March 202#"), _digits(rng, "2% October 202#")])
    text, found = "", []
    for piece in re.split(r"(\{\w\})", template):
        if piece == "{G}":
            found.append(("person", len(text)))
            text += pick([g for g in GIVEN if g.isalpha()] + [surname() for _ in range(60)])
        elif piece == "{P}":
            title, name = person()
            text += title
            found.append(("person", len(text)))
            text += name
        elif piece in ("{E}", "{F}", "{A}"):
            found.append(({"{E}": "email", "{F}": "phone", "{A}": "address"}[piece], len(text)))
            text += {"{E}": email, "{F}": phone, "{A}": address}[piece]()
        elif piece in ("{I}", "{i}"):
            text += label
            found.append(("id_number", len(text)))
            text += _digits(rng, form)
        else:
            text += {"{X}": decoy, "{D}": date, "{R}": lambda: pick(_ROLES), "{r}": lambda: pick(["storage rate", "liability cap", "overtime rate"]), "{N}": lambda: "\n", "{n}": lambda: str(rng.integers(1, 60)), "{m}": lambda: _digits(rng, "%##,###.50"), "{C}": lambda: f"{surname()}{pick(['ax', 'il', 'or'])} {pick(_FIRMS)}", "{L}": lambda: pick(_PLACES)}.get(piece, lambda: piece)()
    return text, found


def labelled(n: int = TRAIN_TEXTS, seed: int = 3, templates: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of the spans proposed in n composed texts of a few sentences each, some with wrapped lines,
    and whether a text is of the templates that are held out for the thresholds (every fifth)."""
    rng = np.random.default_rng(seed)
    templates = templates or [t for line in TEMPLATES.split("\n") for t in line.split("|") if t]
    parts = [[t for i, t in enumerate(templates) if i % 5 != 2], [t for i, t in enumerate(templates) if i % 5 == 2]]
    composed, trues, holds = [], [], []
    rows, y, kinds, held = [], [], [], []
    for k in range(n):
        text, true = "", set()
        hold = k % 4 == 3
        for _ in range(int(rng.integers(1, 4))):
            template = str(parts[hold][rng.integers(0, len(parts[hold]))])
            part, found = _compose(rng, template)
            if not found and rng.random() < 0.2:
                part = part.upper()
            true |= {(k, s + len(text)) for k, s in found}
            text += part + str(rng.choice([" ", "\n"]))
        if rng.random() < 0.4:  # lines wrap at spaces: same length, so positions stay
            chars = list(text)
            for i in range(int(rng.integers(20, 60)), len(chars), int(rng.integers(40, 80))):
                at = text.find(" ", i)
                if at > 0:
                    chars[at] = "\n"
            text = "".join(chars)
        composed.append(text)
        trues.append(true)
        holds.append(hold)
    for text, true, hold, proposed in zip(composed, trues, holds, proposals(composed)):
        for kind, s, e, hint in proposed:
            rows.append((text, kind, s, e, hint))
            y.append((kind, s) in true)
            kinds.append(KINDS.index(kind))
            held.append(hold)
    return features_of(rows), np.array(y, dtype=float), np.array(kinds), np.array(held)


def fitted() -> tuple[boosting.Boosted, list[float]]:
    """The trees and, by kind, the probability from which a span is taken: the best F1 on texts of the held-out templates,
    on which the probabilities are calibrated too."""

    def build():
        x, y, kinds, held = labelled()
        model = boosting.train(x, y, trees=80, depth=5, hold=held)
        p = model.probability(x)
        cuts = []
        for k in range(len(KINDS)):
            pk, yk = p[held & (kinds == k)], y[held & (kinds == k)]
            f1 = lambda t: 2 * (yk * (pk >= t)).sum() / max(1, yk.sum() + (pk >= t).sum())
            tried = np.linspace(0.3, 0.7, 9)
            best = [t for t in tried if f1(t) >= max(map(f1, tried)) - 1e-3] if len(pk) else [0.5]
            cuts.append(float(best[len(best) // 2]))  # the middle of the best stretch
        return model, cuts

    return cached("pii", build)


def find(texts: list[str | None], model: boosting.Boosted, cuts: list[float]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end), from 0, of the personal information of each text, in order and without overlaps."""
    out: list[list[tuple[str, int, int]]] = []
    while len(out) < len(texts):
        first = last = len(out)
        size = 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= _GROUP_CHARS):
            size += len(texts[last] or "")
            last += 1
        out += _find([text or "" for text in texts[first:last]], model, cuts)
    return out


def _find(texts: list[str], model: boosting.Boosted, cuts: list[float]) -> list[list[tuple[str, int, int]]]:
    rows, owner = [], []
    for k, (text, proposed) in enumerate(zip(texts, proposals(texts))):
        rows += [(text, *span) for span in proposed]
        owner += [k] * len(proposed)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not rows:
        return out
    p = model.probability(features_of(rows))
    order = np.argsort(-p, kind="stable")
    for i in order:
        _, kind, s, e, _ = rows[i]
        if p[i] >= cuts[KINDS.index(kind)] and not any(a < e and s < b for _, a, b in out[owner[i]]):
            out[owner[i]].append((kind, s, e))
    return [sorted(found, key=lambda x: x[1]) for found in out]


def spans(text: Column) -> Column:
    """array<struct<kind, start_pos, end_pos>>: positions in characters from 1, the end included; null for a null text."""
    model, cuts = fitted()
    _SEEN.clear()

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found = find(list(part), model, cuts)
            yield pd.Series([None if t is None else [{"kind": k, "start_pos": s + 1, "end_pos": e} for k, s, e in f] for t, f in zip(part, found)])

    return F.pandas_udf(batches, "array<struct<kind string, start_pos int, end_pos int>>")(text)


def found(df: DataFrame, key: str = "row_id", text: str = "content") -> DataFrame:
    """(key, kind, start_pos, end_pos): one row per item; null and empty texts have none, copies have their own."""
    return df.select(key, F.explode(spans(F.col(text))).alias("s")).select(key, "s.*")


def redact(df: DataFrame, text: str = "content") -> DataFrame:
    """df with every item of its text replaced by [KIND], the rest character for character as it was, and n_redacted."""
    columns = [c for c in df.columns if c not in ("_spans", "n_redacted")]
    marked = df.select(*columns).withColumn("_spans", spans(F.col(text)))
    body = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, s: F.struct(F.concat(acc.out, F.substring(F.col(text), acc.at, s.start_pos - acc.at), F.lit("["), F.upper(s.kind), F.lit("]")).alias("out"), (s.end_pos + 1).alias("at")),
        lambda acc: F.concat(acc.out, F.substring(F.col(text), acc.at, F.length(F.col(text)))),
    )
    return marked.select(*[F.when(F.size("_spans") > 0, body).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in columns], F.when(F.col("_spans").isNull(), 0).otherwise(F.size("_spans")).alias("n_redacted"))
