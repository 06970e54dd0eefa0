import re

import numpy as np

from quillspark.llm import boosting
from quillspark.llm import pii as P

TEXT = (
    "Keys: Mr Imogen Dunstead / Rhys Hesbury / +1 208 555 0139\nNotices to the Customer must be sent to Unit 4, 16/3 Lloyd Lane, Norhaven 7803, attention Inés Fenansah, with a copy to\n"
    "ines (at) post (dot) example. The driver, THORNSTRAND, Imogen, showed passport no. XZ9838390 at the gate. Ring ((03) 7010 9563) before noon.\n"
    "The reference on the stock ledger (PO 4546 396 832) prevails; company number 933 900 288. PO Box 3593, Osmere 6433. The Service Provider may call on 2024-05-06."
)


def items(text):
    return {(k, text[s : s + 5]) for k, s, _ in P.find([text], *P.fitted())[0]}


def test_kinds():
    got = items(TEXT)
    assert {("person", "Imoge"), ("person", "Rhys "), ("phone", "+1 20"), ("address", "Unit "), ("email", "ines "), ("person", "THORN"), ("id_number", "XZ983"), ("phone", "(03) "), ("address", "PO Bo")} <= got
    assert not any(x[1] in ("4546 ", "933 9", "2024-", "Servi") for x in got)


# written apart from the templates of the module; {kind:item} marks what is to be found
UNSEEN = """Yesterday {person:Tamsin Redfern} slipped on the ramp and phoned {phone:0113 496 0999} for help.
Should the alarm ring, wake {person:Oskar Lindqvist} ({phone:+46 70 174 06 12}).
Forward every complaint to {email:quality.team@northshed.example}, thanks.
The parcel for {person:Ms} waits.|The parcel for Ms {person:Harriet Quill} waits at {address:17 Chandler Street}, Osgate.
We could not find SKU 88213-04 or order 4500 771 230 in the cage.
Her new home is {address:Flat 9, 22 Linden Grove}, Marlow 3055.
Post office mail arrives at {address:PO Box 771}, Brackley.
The tenant produced passport {id_number:K8812345} and a gas bill.
Tax file number {id_number:482 115 903} was blacked out.
His DNI is {id_number:48211590K}, issued in Madrid.
Her ID is {id_number:4432 9981 7712}.
The Steuer-ID {id_number:12 345 678 901} is on the pay slip.
Find us in the {address:Gartenstraße 41}, 50667 Köln.
The bakery at {address:8 rue du Moulin}, Lille, opens at six.
Our agent keeps a desk at {address:Rua do Carmo 31}, Porto.
Text me on {phone:13912345678} when the ship docks.
My name is {person:Siobhan} and I clean the silo.
{person:Helen Page} and {person:Jan Kowalski} share an office.
Chamber 14 holds 2,300 crates; invoice INV-2023-88121 covers EUR 14,200.00.
On 12 March 2024 the Parties signed Schedule 3 of the Lease Agreement.
Reply to {email:j.o'brien (at) pier (dot) example} or {email:ANNA.WEI@COLD.EXAMPLE}.
Night desk: {phone:(020) 7946 0333}, day desk: {phone:020-7946-0334}.
Insurance no. {id_number:AB 12 34 56 C} belongs to {person:Piotr von Asch}.
Container MSKU 481920 3 was weighed at 24,100 kg.
The General Manager and the Finance Director met in East Harbour.
{person:DUNMORE, Patricia} refused; {person:P. Dunmore} had agreed before.
The shop moved to {address:Suite 12, 140 Victoria Parade}, Kelston NSW 2100.
Please thank {person:Anneke de Groot} for the tour.
Licence {id_number:DUNMO 712034} expired." he said.
The inspection by {person:Dr Yusuf} took place.|Doctor {person:Yusuf Aydin} came."""


def marked(line):
    text, found = "", []
    for piece in re.split(r"(\{\w+:[^}]*\})", line):
        m = re.fullmatch(r"\{(\w+):([^}]*)\}", piece)
        if m:
            found.append((m[1], len(text)))
        text += m[2] if m else piece
    return text, found


def test_unseen_contexts():
    texts, wanted = zip(*[marked(line.split("|")[-1]) for line in UNSEEN.split("\n")])
    assert not any(t in P.TEMPLATES for t in texts)
    true = {(i, k, s) for i, w in enumerate(wanted) for k, s in w}
    got = {(i, k, s) for i, f in enumerate(P.find(list(texts), *P.fitted())) for k, s, _ in f}
    print("missed", [(texts[i][s : s + 20], k) for i, k, s in sorted(true - got)], "wrong", [(texts[i][s : s + 20], k) for i, k, s in sorted(got - true)])
    assert len(true & got) >= 0.9 * len(true) and len(true & got) >= 0.9 * len(got)


def test_held_out_templates():
    model, cuts = P.fitted()
    x, y, kinds, held = P.labelled(3000, seed=77)
    assert 0.15 < held.mean() < 0.35
    x, y, kinds = x[held], y[held], kinds[held]
    taken = model.probability(x) >= np.array(cuts)[kinds]
    for k in range(len(P.KINDS)):
        true, found = y[kinds == k] > 0, taken[kinds == k]
        assert (true & found).sum() / max(1, found.sum()) > 0.93 and (true & found).sum() / max(1, true.sum()) > 0.93


def test_an_address_may_have_a_local_part_of_any_length():
    local = "a" * 300 + ".b"
    assert P.find([f"write to {local}@mail.example now"], *P.fitted())[0] == [("email", 9, 9 + len(local) + 13)]
    assert P.candidates("@mail.example") == [] and P.candidates("x " * 5 + "\n\n@mail.example") == []


def test_found_and_redact(spark):
    rows = [(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, TEXT, "x"), (5, "plain words " * 20000, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, content string, n_redacted string")
    found = P.found(df).collect()
    assert {r.row_id for r in found} == {1, 4} and all(TEXT[r.start_pos - 1 : r.end_pos].strip() for r in found)
    clean = {r.row_id: r for r in P.redact(df).collect()}
    assert clean[2].content is None and clean[3].content == "" and clean[5].content == rows[4][1]
    mine = sorted(((r.start_pos - 1, r.end_pos, r.kind) for r in found if r.row_id == 1), reverse=True)
    expected = TEXT
    for s, e, k in mine:
        expected = expected[:s] + f"[{k.upper()}]" + expected[e:]
    assert clean[1].content == expected and clean[1].n_redacted == len(mine)
    assert P.found(df.limit(0)).count() == 0 and P.redact(df.limit(0)).count() == 0


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.train(x[:3000], y[:3000])
    p = model.probability(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.93
    assert (np.diff(model.steps_y) >= 0).all() and p.min() >= 0 and p.max() <= 1
    bx, by = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(by) > 0).all() and len(bx) == 3
