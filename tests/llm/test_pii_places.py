"""Looking up where the patterns of personal information can begin, for a batch of texts, finds what searching every text finds."""

import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from quillspark.llm import boosting
from quillspark.llm import pii

PARTS = "von |de |Van |VAN |la\n|al |A|Dr. |Mr |Prof|É|ß| |\n|-|'|.|@|(at)|[ at ]|°|12|345-|6 7|89|AB |ABC-|X|/|ter |Jan |Ruth|€|O|o|passport |po #|INV-|licence: |tel. |ni number | |　|‑|“|”|’|‘|(|)|+|,|Ł|٣|İ|1 Bell |Street|Unit 4, | rue de | via | Lyon|straße 4|PO Box |hi |Hi\n|I'm |May |Page |Smith |O'Neil |, |J.|\t|\xa0|?|Box 7; |$|B|S|l|mail.test |020 7946 0333|number is |: |Ruth Smith".split("|")
GATES = ("_HAS_ID", "_HAS_BOX", "_HAS_FOREIGN", "_HAS_CUE")


def texts(n, parts):
    rng = random.Random(parts)
    return ["", "x"] + ["".join(rng.choice(PARTS) for _ in range(parts)) for _ in range(n)]


@pytest.mark.parametrize("parts", [3, 8, 30])
def test_same_candidates_as_a_search_of_every_text(monkeypatch, parts):
    some = texts(2500, parts)
    got = pii.proposals(some)
    monkeypatch.setattr(pii, "_GROUP_CHARS", -1)
    for name in GATES:
        monkeypatch.setattr(pii, name, "")
    for text, mine, searched in zip(some, got, pii.proposals(some)):
        assert mine == searched, text


def test_usual_texts_are_not_searched(monkeypatch):
    text = "The Operator stores 31 pallets. Ask Jan Smith of 4 Bell Street on 020 7946 0333, jan@mail.test; ID card AB 123456."
    want = pii.candidates(text)
    assert {k for k, *_ in want} == set(pii.KINDS)

    class Tried:
        def __init__(self, pattern):
            self.match = pattern.match

    for name in ("_AT", "PHONE", "NUMBER", "_NUMBER_START", "_NUMBERED", "PERSON", "_PERSON_START", "BOX", "FOREIGN", "CUE"):
        monkeypatch.setattr(pii, name, Tried(getattr(pii, name)))
    assert pii.candidates(text) == want


def test_a_name_after_a_greeting_does_not_depend_on_other_words():
    for text in ("(Hi Anna) and the rest", "“Hello Anna!” and hi", "x-hi Anna"):
        assert ("person", text.index("Anna"), text.index("Anna") + 4, 2) in pii.candidates(text)


def test_texts_are_found_alike_in_any_group(monkeypatch):
    some = [*texts(300, 12), None, "", "plain words " * 2000 + "Call 020 7946 0333."]
    got = pii.find(some, *pii.fitted())
    assert got == [pii.find([text], *pii.fitted())[0] for text in some] and len(got[-1]) == 1
    monkeypatch.setattr(pii, "_GROUP_CHARS", 500)
    assert pii.find(some, *pii.fitted()) == got


def test_features_of_many_are_those_of_each():
    rows = [(text, *span) for text in texts(400, 20) for span in pii.candidates(text)]
    assert {r[1] for r in rows} == set(pii.KINDS)
    assert np.array_equal(pii.features_of(rows), np.array([pii.features(*row) for row in rows]))
    assert pii.features_of([]).shape == (0, len(pii.FEATURES))


def test_a_bracket_before_the_end_of_a_line():
    text = "Jan (\n020 7946 0333"
    assert dict(zip(pii.FEATURES, pii.features(text, "phone", 6, len(text), 0)))["left_person"] == 1


def test_margins_do_not_depend_on_the_parts():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6))
    model = boosting.train(x, (x[:, 0] > 0.2).astype(float), trees=12, depth=3)
    assert np.array_equal(model.margin(x), model.margin(x, 7)) and np.array_equal(model.margin(x[:, ::-1][:, ::-1]), model.margin(x)) and len(model.margin(x[:0])) == 0


def test_the_search_travels_with_the_job(tmp_path):
    (tmp_path / "find").write_bytes(cloudpickle.dumps(pii.find))
    subprocess.run([sys.executable, "-c", "import pickle; pickle.load(open('find', 'rb'))"], cwd=tmp_path, env={}, check=True)
