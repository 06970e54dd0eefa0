"""The scorer on sentences of other forms than it was fitted on, disguise, and whole tables with odd rows."""

import numpy as np

from quillspark.llm import toxicity as T

# written apart from the forms of the module, none of which these repeat
UNSEEN_ABUSE = """Those northerners deserve every beating they get
You disgust me and I hope your family suffers
Whoever trained you must have been a complete moron too
Honestly, you are as useless as you are ugly
Take your whining and your ugly face somewhere else, you coward
I'd rather talk to a wall than to a brainless pig like you
Hey dickhead, the bin is over there, climb in
What an absolute bastard you turned out to be
He is a filthy liar and his brother is a worthless thief
Don't you dare come back, or I'll smash your skull with a hammer
If I see you at the gate again I will stab you
They ought to hang you from the crane, you rat
Hope you crash tonight and burn
I am going to hurt you so badly that your mother won't know your face
Tell your son I will be waiting behind the school with a knife
Refugees are nothing but parasites, ship them back
Why do we let muslims in here, they are all thieves
I would burn the camp where those animals sleep
Women are too stupid for this trade and should stay home
Gays are a disease and must be wiped out
The jews are behind it, those greedy rats
Never trust gypsies, stealing is in their blood
Show me those sweet tits again, baby
I lie awake and imagine you naked on my desk
She climbed on his cock and moaned until he came
Let me lick your thighs until you beg
Fancy a quick shag, darling? I am so horny
Free porn and live nude cams, click this link
He tore off her panties and pushed her against the wall, panting, naked
Your ass looks incredible, I want to grab it
F*ck off, you s t u p i d cow
You are an id1ot and a l0ser
SHUT YOUR FILTHY MOUTH
Du bist so dumm, du hässliches Schwein
Ces immigrés sont de la vermine, qu'ils crèvent
Ty brudna świnio, zabiję cię
Eres un idiota y un cobarde asqueroso
Jullie zijn allemaal idioten en parasieten""".split("\n")
UNSEEN_CLEAN = """The meeting starts at nine in room four
Please find attached the signed lease and the price list
You forgot the keys, can you come back for them
The killer whale is the largest of the dolphins
A dead line on the phone exchange was repaired
Guards may not insult, threaten or touch visitors
She filed a complaint because a colleague sent her sexual messages
The vet examined bulls, cows and one bitch for ticks
Put duck breast, cock and hen on the list of poultry
Strip the cable, then screw the clamp to the wall
Rats chewed the hose, so we set more traps
The beast of a compressor shook the floor
Shoot me an email when the oven is free
He was beaten in the chess final and took it well
The handbook bans hateful remarks about women, migrants and believers
Our new driver came as a refugee and is the best we have
Coloured folders go to accounts, black ones to legal
My knees hurt after carrying boxes all day
I love your garden, the roses are beautiful
What a stupid printer, it ate the form again
Damn traffic, I will be late
Dirty plates stay in the sink until Friday
The naked eye cannot see the crack
Hot and wet weather is expected tonight
Touch the screen with bare fingers
The bed of the lorry is eight metres long
The girls of the volleyball team won again
Old people and children travel free
Disabled drivers park near the entrance
Sex of the chicks is found on day two
We want to hire ten people, women and men
THE GATE WILL BE CLOSED ON SUNDAY!
Die Schweine werden am Montag gewogen
Les femmes de l'équipe partent à midi
Te envío la lista mañana
Prosimy o odbiór brudnych skrzyń
De vluchtelingen wonen naast het kantoor""".split("\n")


def test_unseen_forms():
    model = T.fitted()
    forms = set(T.ABUSIVE.replace("\n", "|").split("|")) | set(T.CLEAN.replace("\n", "|").split("|"))
    assert not forms & {s for s in (*UNSEEN_ABUSE, *UNSEEN_CLEAN)}
    bad, good = T.score_texts(UNSEEN_ABUSE, model), T.score_texts(UNSEEN_CLEAN, model)
    print("missed", [(s, round(p, 2)) for s, p in zip(UNSEEN_ABUSE, bad) if p < T.THRESHOLD], "wrong", [(s, round(p, 2)) for s, p in zip(UNSEEN_CLEAN, good) if p >= T.THRESHOLD])
    assert (bad >= T.THRESHOLD).mean() >= 0.9
    assert (good >= T.THRESHOLD).mean() <= 0.1


def test_held_out_forms_are_calibrated():
    x, y, held = T.labelled(4000, seed=77)
    p = T.fitted().probability(x[held])
    assert (p[y[held] == 1] >= T.THRESHOLD).mean() > 0.8 and abs(p.mean() - y[held].mean()) < 0.1


def test_every_sentence_has_features():
    x, owner = T.window_features(["Nothing of the lexicon stands here. At all? " + "word " * 30, None, "", "..!", "A."])
    assert x.shape[1] == len(T.FEATURES) and set(owner) == {0, 4}
    assert (owner == 0).sum() == 1 + 1 + 2  # two sentences, and one of three halves in two windows


def test_disguise():
    model = T.fitted()
    plain = "you are a complete idiot"
    for form in ("you are a complete i d i o t", "you are a complete i.d.i.o.t", "you are a complete id!ot", "you are a complete idi0t", "you are a complete i***t", "you are a complete idiiiiot", "you are a complete id​iot", "you are a complete <b>idiot</b>", "you are a complete idіot"):
        assert T.score_texts([form], model)[0] >= T.THRESHOLD, form
    assert T.score_texts([plain], model)[0] >= T.THRESHOLD > T.score_texts(["a b c d e and f"], model)[0]


def test_window_rule_is_the_same_at_every_length():
    model = T.fitted()
    abuse = "you are a stupid worthless bastard and I will kill you"
    for n in (0, 5, 13, 40, 3000):
        assert T.score_texts(["the goods are counted " * n + abuse + " and the truck has left" * n], model)[0] >= T.THRESHOLD, n


def test_table(spark):
    rows = [(1, "a", "You stupid bastard, I will kill you!", 9), (2, "a", None, 9), (3, None, "", 9), (4, "b", "The goods are in chamber 4. " * 3000, 9), (5, "b", "You stupid bastard, I will kill you!", 9), (5, "b", "You stupid bastard, I will kill you!", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, toxic int")
    got = T.score(df)
    assert got.columns == ["doc_id", "source", "toxicity", "toxic"]
    by = sorted((r.doc_id, r.toxic) for r in got.collect())
    assert by == [(1, True), (2, False), (3, False), (4, False), (5, True), (5, True)]
    rate = {r.source: (r.documents, r.toxic_documents) for r in T.rates(got).collect()}
    assert rate == {"a": (2, 1), "b": (3, 2), None: (1, 0)}
    assert T.score(df.limit(0)).count() == 0 and not np.isnan(T.rates(got).first().mean_toxicity)
