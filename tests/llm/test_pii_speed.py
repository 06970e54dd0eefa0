"""Shortcuts of the search for personal information give what the plain patterns give, without trying them everywhere."""

import random
import re

from quillspark.llm import pii

PARTS = "von |de |Van |VAN |la\n|al |A|Dr. |Mr |É|ß| |\n|-|'|.|@|(at)|[ at ]|°|12|345-|6 7|89|AB |ABC-|X|/|ter |Jan |Ruth|€|O|o|passport |po #|INV-|licence: |tel. |carton |EUR |ni number ".split("|")


def texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(30)) for _ in range(n)]


def test_matches_are_those_of_the_whole_text():
    for text in texts(4000):
        for pattern, start in ((pii.PERSON, pii._PERSON_START), (pii.NUMBER, pii._NUMBER_START)):
            assert [m.span() for m in pii._matches(pattern, start, text)] == [m.span() for m in pattern.finditer(text)], text


def test_words_of_ascii_contexts_are_looked_up(monkeypatch):
    names = ("id_word", "decoy_word", "label_decoy", "money")
    money = re.compile(r"(?:EUR|USD|GBP|PLN|AUD|\$|€|£)\s*$")
    cases = [(left + "123 456 789", len(left), [float(bool(p.search(left[-40:]))) for p in (pii._ID_WORD, pii._DECOY_WORD, pii._DECOY, money)]) for left in texts(1500)]

    class Never:
        def search(self, text):
            assert not text.isascii()
            return re.search("(?!)", text)

    for name in ("_ID_WORD", "_DECOY_WORD", "_DECOY"):
        monkeypatch.setattr(pii, name, Never())
    cases = [c for c in cases if c[0][max(0, c[1] - 40) : c[1]].isascii()]
    assert len(cases) > 50
    for text, at, want in cases:
        got = dict(zip(pii.FEATURES, pii.features(text, "id_number", at, len(text), 1)))
        assert [got[n] for n in names] == want, text
