"""Problem 9: score documents for abusive, hateful or sexually explicit language.

Every sentence of every document is measured on dense features: densities of lexicon families, closeness of families to
the second person and to each other, capitals, punctuation and disguise. Boosted trees score it, isotonic calibration makes
the score a probability, and a document has the score of its worst sentence. The trees are fitted on sentences composed
from the phrase tables below, of which some forms are held out for the calibration.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import boosting
from quillspark.llm.tokens import cached

THRESHOLD = 0.5  # of the calibrated probability
HALF = 12  # words: a sentence is measured in windows of two halves, each half but the first and last in two windows
TRAIN_SENTENCES = 12_000  # bound of the labelled sample that the trees are fitted on
FAR = 30  # words: no closeness beyond

# The lexicon by families, in English, German, Dutch, French, Polish, Spanish and Italian, without accents.
FAMILIES = {
    "insult": """idiot moron imbecile retard retarded cretin subhuman subhumans untermensch untermenschen bastard bitch dickhead dipshit dumbass arsehole asshole scumbag wanker tosser twat prick cunt slut whore bellend halfwit scum jerk loser
        numbskull nitwit dunce git weasel pig swine rat toad cow slob creep pervert coward liar trash garbage filth
        vollidiot depp trottel arschloch wichser hurensohn schlampe missgeburt dummkopf spinner klootzak eikel hoer mongool sukkel mietje connard connasse salope encule abruti cretine debile ordure
        idioto kretyn kretynie kretynem debil debilu kurwo dupku palancie frajerze suko pendejo cabron gilipollas puta imbecil zorra stronzo coglione troia cretino deficiente""",
    "profane": """fuck fucking fucked fucker fucks shit shitty shite bullshit arse ass bloody bollocks crap piss pissed damn sod bugger wank scheisse fresse maul verpiss verdammt kut godverdomme tering merde putain foutre
        gueule kurwa ryj cholera pierdol spierdalaj pierdolony mierda joder hostia cazzo vaffanculo merda""",
    "contempt": """stupid filthy worthless useless pathetic thieving lying dumb thick ugly disgusting disgust disgusts brainless spineless gutless lazy dirty hopeless miserable rotten stinking vile clueless moronic idiotic
        dumme dummes dummer dumm dreckig dreckige faul achterlijke achterlijk domme lelijke stomme glupi glupia glupie glupim brudny brudna leniwy espece sale stupide idiota idiote bete schwein schweine tonto asqueroso schifoso stupido""",
    "shame": """smell smells stink stinks stutter stutters drool drools brain brains oxygen embarrassment ashamed shame regret regrets mother parents kids born pathetic excuse joke disgrace nobody human worth dirt wipe hole crawl rot
        breathing breathe miss existence creature failure laughing clown manners""",
    "act": """fuck fucking lick licking licked suck sucking sucked moan moaning moaned swallow thrust penetrate horny kiss kissing caress grope stroke undress undressed undressing unzipped strip naked nude swallow orgasm climax cum blowjob erection masturbate seduce
        neuken geil ficken lecken nackt nackte baiser sucer nique nue nus ruchac pieprzyc nagie naga nago nagich follar chupar desnuda desnudas desnudo scopare leccare nuda nudo""",
    "body": """cock dick pussy tits boobs breasts nipples legs thighs crotch groin buttocks butt skirt panties knickers bra underwear blouse trousers lips tongue hips knees neck nackt titten schwanz muschi brust borsten kont lul seins cul bite cycki dupa dupe pizde tetas culo polla tette""",
    "porn": "porn porno pornography sex sexy erotic xxx cams webcam escort escorts nudes naaktfoto nacktbilder nacktfotos sexcam hooker milf fetish",
    "intimate": "bed darling babe baby sweetheart honey slowly wet soaking dreamt dreamed dreaming fantasise wearing underneath beneath bare touch touching touched rough tonight alone strings body pics photo photos picture pictures cheri schatz lief kochanie guapa bella",
    "violent": """kill killed kills stab stabbed shoot shot strangle beat beaten beating smash crush hang hanged hurt hit punch slap kick bleed choke drown burn burned bury drag break cut gut throat verprugelt verprugeln umbringen totschlagen erschlagen
        kapot doodmaken vermoorden slaan tuer tabasser crever frapper zabic zabije pobic udusic matar matare golpear ammazzare uccidere picchiare""",
    "death": "dead die dies died death grave corpse coffin hospital ambulance petrol matches fire gun knife bullet bat rope tot dood mort trup muerto morto cage gallows bomb",
    "threat": "find watch catch regret sorry park live lives address teeth legs bones face skull jaw floor again talking coming waiting outside careful warned warning pay follow corner alley behind wife family children zeby knie nogi dents jambes zahne beine tanden benen",
    "group": """foreigners foreigner immigrants immigrant migrants migrant refugees refugee gays gay lesbians lesbian queers women girls men disabled cripples gypsies jews jewish muslims muslim christians blacks coloured religion folk people trans asylum tribe
        race nationality southerners northerners easterners westerners villagers auslander fluchtlinge juden frauen zigeuner buitenlanders vluchtelingen joden vrouwen etrangers immigres juifs femmes arabes imigranci imigrantow uchodzcy cudzoziemcy zydzi kobiety obcy
        extranjeros inmigrantes judios mujeres stranieri immigrati ebrei donne""",
    "dehuman": """vermin subhuman subhumans parasites parasite disease plague animals beasts breed breeding infest infestation cockroaches cockroach inferior rats pigs leeches maggots cancer scum savages apes ungeziefer abschaum untermenschen ratten parasiten ongedierte uitschot
        robactwo szczury pasozyty vermine racaille parasites rats plaga ratas escoria parassiti feccia""",
    "exclude": """rid deport deported expel expelled cleanse clean gassed camps raus weg wyrzucic wyrzuc wywiezc precz dehors degager fuera expulsar fuori keep away hire trust trusted wanted belong allowed let stop send throw thrown kick back home country oprotten""",
    "trait": "dirty lazy steal steals stealing thieves criminals theft crime blood nature daughters fit unfit read stupid cannot greedy cheat cheats liars violent dangerous primitive uncivilised unable lie smell orders rape multiply",
    "second": "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch halt jij je jou jouw jullie ty ci cie twoj twoja twoje jestes tu te ta toi ton tes vous votre tus eres ti tuo tua sei",
    "first": "i me my mine im ill we us our ich mich mir mein ik mij mijn ja mnie chce moj moi mon ma je yo mi quiero io mio voglio veux want",
    "third": "he she her him his they them their theirs hers those whoever sie ihn zij hen oni ich ils elles leur ellos ellas loro",
    "all": "all every each everyone everybody always never whole lot alle wszyscy wszystkie tous toutes todos todas tutti tutte only just most",
    "be": "are is am was were be been being sind ist bist zijn bent sont est es sa son jest sono e should ought must deserve deserves better",
    "report": """policy policies procedure procedures prohibits prohibited prohibit forbidden forbid training harassment complaint complaints complained recorded reported reports report investigated alleged alleges allegation statement incident tribunal hearing upheld dismissed disciplinary
        zero tolerance guidance discrimination applicants applications encouraged equal opportunity respect witness apologised apology banned conduct code unacceptable quoted according unlawful law leaflet leaflets study""",
    "trade": """soup pudding puddings gravy oil seed file flame terminal floor carcass carcasses livestock animal tag heater cattle pork chicken meat fish feed switch screw nut nuts bolt bolts hinge grease battery battery species poultry beef dairy birds bird bull bulls trap traps bait vet
        shaft lathe valve pump hose cable drill hammer egg eggs flour cream menu bakery recipe crate crates pallet pallets shelf aisle kennel farm hen hens cat cats dog dogs gun glue spray tool tools weather vane software server printer drive laptop machine curtain cheese stew puppies herd flock seeds paint""",
}
NAMES = list(FAMILIES)
HARD = ("insult", "profane", "contempt", "act", "body", "porn", "violent", "dehuman")  # found in disguise too
MARKS = ("caps", "disguised", "end", "exclaim", "ask", "word")
PAIRS = [("insult", "second"), ("profane", "second"), ("contempt", "second"), ("shame", "second"), ("violent", "second"), ("threat", "second"), ("death", "second"), ("act", "second"), ("act", "third"), ("body", "second"), ("body", "third"), ("intimate", "second"), ("intimate", "body"), ("intimate", "act"),
         ("group", "dehuman"), ("group", "contempt"), ("group", "exclude"), ("group", "trait"), ("group", "violent"), ("group", "death"), ("third", "dehuman"), ("contempt", "insult"), ("threat", "violent"), ("trait", "exclude"), ("insult", "be"), ("first", "act"), ("first", "threat")]
FEATURES = [*NAMES, "disguised", *(f"{a}~{b}" for a, b in PAIRS), "hard_density", "soft_density", "capitals", "exclaims", "asks", "words", "families"]
# Characters that look like Latin letters or stand for them.
LOOKALIKE = str.maketrans("аеорсухіѕԁ", "aeopcyxisd")
LEET = str.maketrans("@4130$5!78", "aaieossitb")

_FAMILY: dict[str, set[int]] = {}
for _k, _words in enumerate(FAMILIES.values()):
    for _w in _words.split():
        _FAMILY.setdefault(_w, set()).add(_k)
_HARD_WORDS = sorted({w for f in HARD for w in FAMILIES[f].split() if len(w) >= 4})
_squeeze = re.compile(r"(.)\1+").sub
_SQUEEZED = {_squeeze(r"\1", w): w for w in _HARD_WORDS}
_SHAPES: dict[tuple[str, int], list[str]] = {}
for _w in _HARD_WORDS:
    _SHAPES.setdefault((_w[0], len(_w)), []).append(_w)
_HARD_SET = set(_HARD_WORDS)
_LOOKALIKES = re.compile("[" + "".join(map(chr, LOOKALIKE)) + "]")
_INVISIBLE = re.compile("[̀-ͯ­​-‏‪-‮⁠-⁤﻿]")  # accents and characters without width
_HIDDEN = re.compile("(?<=[a-zA-Z])[­​-‏⁠-⁤﻿](?=[a-zA-Z])")
_TAG = re.compile(r"<[^<>]{1,40}>")
_TOKEN = re.compile(r"[^\W_](?:[\w@$*!'’]*[\w@$*])?|[\n.!?;]+")
_SPELLED = re.compile(r"(?<![\w.*])[^\W\d_](?:[ .\-_][^\W\d_])+[ .\-_]?\w*")
_ENDING = re.compile(r"(?:s|ed|es|er|ers|ing)$")
_MARK = "ǂ"  # a letter that no text here has: the word after it was written in disguise


def _plain(text: str) -> str:
    if not text.isascii():
        if _HIDDEN.search(text):
            text = re.sub(rf"\w*{_HIDDEN.pattern}\w*(?:{_HIDDEN.pattern}\w*)*", lambda m: _MARK + _INVISIBLE.sub("", m[0]), text)
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ł", "l").replace("Ł", "L")))
        if _LOOKALIKES.search(text):
            text = text.translate(LOOKALIKE)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _SPELLED.sub(_together, text)


def _together(m: re.Match) -> str:
    """A hard word whose letters are spelled apart, with what stands before and after it; anything else stays."""
    parts = re.split(r"[ .\-_]", m[0])
    for first in (0, 1):
        for last in (len(parts), len(parts) - 1):
            if last - first >= 3 and all(len(p) == 1 for p in parts[first : last - 1]):
                word = "".join(parts[first:last])
                if word.lower() in _HARD_SET:
                    return " ".join([*parts[:first], _MARK + word, *parts[last:]])
    return m[0]


def _look(token: str) -> tuple[set[int], bool]:
    """Families of a lower-case token, and whether it is a word of the lexicon in disguise."""
    if token in _FAMILY:
        return _FAMILY[token], False
    bare = re.sub(r"['’](?:s|re|ll|d|ve|m|t)$", "", token)
    if bare != token and bare in _FAMILY:
        return _FAMILY[bare], False
    stem = _ENDING.sub("", token)
    for form in (stem, stem + "e"):
        if form in _HARD_SET:
            return _FAMILY[form], False
    if len(token) < 4:
        return set(), False
    if "*" in token:
        for end in ("", "s", "ed"):
            core = token[: len(token) - len(end)] if end and token.endswith(end) else token
            for w in _SHAPES.get((core[0], len(core)), ()):
                if all(a == b or a == "*" for a, b in zip(core, w)):
                    return _FAMILY[w], True
        return set(), False
    clear = token.translate(LEET) if re.search(r"[@\d$!]", token) and 2 * sum(c.isalpha() for c in token) > len(token) else token
    for form in (clear, _ENDING.sub("", clear)):
        if form in _HARD_SET and form != token:
            return _FAMILY[form], clear != token
    squeezed = _squeeze(r"\1", clear)
    if squeezed != clear and squeezed in _SQUEEZED and (clear != token or re.search(r"(.)\1\1", clear) or len(clear) - len(squeezed) == 1 + len(_SQUEEZED[squeezed]) - len(squeezed)):
        return _FAMILY[_SQUEEZED[squeezed]], True
    return set(), False


class _Rows(dict):
    """token -> row of the table of token features, made when a token is first seen. There are few different rows."""

    def __init__(self) -> None:
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((0, len(NAMES) + len(MARKS)), dtype=np.float32)

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        row = [0] * (len(NAMES) + len(MARKS))
        if token[0] in "\n.!?;":
            row[len(NAMES) + 2 :] = [1, token.count("!"), min(1, token.count("?")), 0]
        else:
            hidden = token[0] == _MARK
            found, disguised = _look(token.lower().lstrip(_MARK))
            for k in found:
                row[k] = 1
            row[len(NAMES) :] = [len(token) > 1 and token.isupper(), bool(found) and (hidden or disguised), 0, 0, 0, 1]
        key = tuple(row)
        if key not in self.rows:
            self.rows[key] = len(self.rows)
            self.table = np.vstack([self.table, np.array([row], dtype=np.float32)])
        self[token] = self.rows[key]
        return self.rows[key]


def window_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every window of every sentence, and the number of the text it is of. Texts without a word have none."""
    rows = cached("toxicity rows", _Rows)
    ids: list[int] = []
    stops = []
    end = rows["."]
    for text in texts:
        if text:
            ids += map(rows.__getitem__, _TOKEN.findall(_plain(text)))
        ids.append(end)
        stops.append(len(ids))
    if not ids:
        return np.zeros((0, len(FEATURES))), np.zeros(0, dtype=np.int64)
    t = rows.table[np.array(ids)]
    f, n = len(NAMES), len(ids)
    at = np.arange(n)
    ends = t[:, f + 2] > 0
    sentence = np.concatenate([[0], np.cumsum(ends)[:-1]])
    begin = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if ends.any() else np.array([0])
    place = at - begin[sentence]
    new = (place % HALF == 0) | (place == 0)
    # a stop that alone would open a half belongs to the half before
    new &= ~(ends & (place > 0))
    first = np.flatnonzero(new)
    half = np.cumsum(new) - 1
    sums = np.add.reduceat(t, first, axis=0)
    near = np.full((len(first), len(PAIRS)), FAR, dtype=np.float32)
    where = {name: np.flatnonzero(t[:, k]) for k, name in enumerate(NAMES)}
    for j, (a, b) in enumerate(PAIRS):
        pa, pb = where[a], where[b]
        if len(pa) and len(pb):
            k = np.searchsorted(pb, pa)
            best = np.full(len(pa), FAR)
            for other in (pb[np.maximum(k - 1, 0)], pb[np.minimum(k, len(pb) - 1)], pb[np.minimum(k + 1, len(pb) - 1)]):
                d = np.abs(other - pa)
                d[(d == 0) | (sentence[other] != sentence[pa])] = FAR
                best = np.minimum(best, d)
            np.minimum.at(near[:, j], half[pa], np.minimum(best, FAR))
    owner_sentence = sentence[first]
    same = np.concatenate([owner_sentence[1:] == owner_sentence[:-1], [False]])
    alone = ~same & ~np.concatenate([[False], same[:-1]])
    pick = np.flatnonzero(same | alone)
    nxt = np.where(same[pick], np.minimum(pick + 1, len(first) - 1), pick)
    paired = same[pick][:, None]
    s = sums[pick] + np.where(paired, sums[nxt], 0)
    closest = np.minimum(near[pick], np.where(paired, near[nxt], FAR))
    words = s[:, f + 5]
    per = np.maximum(words, 1)
    hard = s[:, [NAMES.index(x) for x in HARD]].sum(1)
    soft = s[:, [NAMES.index(x) for x in ("shame", "intimate", "threat", "death", "exclude", "trait")]].sum(1)
    seen = (s[:, [NAMES.index(x) for x in (*HARD, "shame", "intimate", "threat", "death", "exclude", "trait", "group")]] > 0).sum(1)
    out = np.column_stack([s[:, :f], s[:, f + 1], closest, hard / per, soft / per, s[:, f] / per, np.minimum(s[:, f + 3], 3), s[:, f + 4], words, seen])
    kept = words > 0
    owner = np.searchsorted(np.array(stops), first[pick], side="right")
    return out[kept], owner[kept]


# ---- the labelled sample: forms of abuse and of innocent speech -----------------------------------------------------
# {insult} {contempt} {act} {body} ... take words of the families; {group} {thing} {role} {place} {n} others.
_FILL = {
    "insult": "idiot moron imbecile bastard bitch dickhead arsehole scumbag wanker twat prick loser jerk halfwit cretin retard coward liar pig",
    "contempt": "stupid filthy worthless useless pathetic brainless spineless ugly disgusting lazy hopeless rotten vile",
    "profane": "fucking bloody damn shitty",
    "act": "fuck lick suck kiss undress caress grope",
    "body": "cock pussy tits boobs thighs nipples lips neck breasts",
    "violent": "kill stab strangle smash beat punch drown shoot crush",
    "bone": "teeth legs jaw skull bones face",
    "group": "foreigners|immigrants|refugees|gays|lesbians|women|disabled people|gypsies|jews|muslims|blacks|people of that faith|the migrants|Harvalians|Tobrinian folk|southerners|trans people|that tribe",
    "dehuman": "vermin parasites animals cockroaches leeches subhumans rats maggots savages",
    "trait": "dirty|lazy|thieves|criminals|stupid|dangerous|primitive|born liars|too greedy|violent",
    "thing": "timesheet|parcel|quotation|spreadsheet|email|roster|contract|order form|sample|van|stock list|roof lease|training plan",
    "role": "boss|supervisor|manager|clerk|driver|foreman|receptionist|director|assistant|colleague",
    "place": "village|street|office|canteen|town|team|building",
}
ABUSIVE = """you {contempt} {insult}|you are nothing but a {insult}|only a {insult} like you could ruin the {thing}|my {role} is a {contempt} {insult}|your {role} is a {insult} and so are you|which {insult} wrote the {thing}|get out of my sight, {insult}|{profane} {insult}s, every one of you|fuck the whole {place} and fuck your {thing}
tell that {insult} of a {role} to choke on the {thing}|stop whining, you {contempt} {insult}|are you brain dead or simply a {insult}|you stink, you drool and your own parents regret you|even your children are embarrassed to have such a {contempt} father|you disgust everyone in this {place}, {contempt} creature|the {place} would be happier if you stopped breathing|nobody would cry at your funeral, you {insult}
you are a disgrace and a joke, nobody wants you|how can one human be so {contempt}|what a {contempt} excuse of a {role} you are|your brain must be full of shit|a trained ape has more brains than the {insult} who made this {thing}|she is a {contempt} {insult} and should crawl away|he was born a {insult} and he will rot as one|the answer of that {insult} is not worth the paper, wipe your arse with it|kiss my arse, {insult}|stick the {thing} up your arse|piss off, all of you|shut your mouth, {insult}|so much shit from one {insult}|your mother should be ashamed to have raised a {insult}|this {thing} was done by a {insult}
I will {violent} you|one day somebody will {violent} you behind the {place}|I am going to {violent} that {insult}|say it again and you lose your {bone}|come near me once more and I break your {bone}|we have your address and we are coming for you|I know which car you drive and where your children go to school|you had better look behind you tonight|you will regret this when I catch you alone outside|you are a dead man, {insult}|I hope you die|go and hang yourself|I will be waiting for you with a knife|your family will find you in hospital|watch your step or you will bleed|we are going to {violent} you and your {role}|do not sleep tonight, we will burn your house
someone ought to {violent} you|open your mouth again and I will {violent} your {bone}|I will follow you home and {violent} you|you will be sorry, I know the street where you live
{group} are {dehuman}|{group} are {dehuman} and must be thrown out|all {group} are {trait}|everyone knows that {group} are {trait}|{group} are {trait} by blood|you cannot trust {group}|never hire {group}, they steal|we do not want {group} in this {place}|throw all {group} out of the country|send {group} back where they belong|{group} should be gassed|somebody should {violent} {group}|{group} multiply like {dehuman}|they are {dehuman}, all of them|such {dehuman} do not belong in our {place}|since {group} moved into the {place} there is nothing but theft, throw out every one of them
{group} are unfit for work like ours, they are {trait}|I will not take orders from {group}|keep {group} away from our children, it is in their nature|{group} deserve to be beaten|burn down the house where {group} live|I hate {group}, they are {trait} and they smell|no {group} allowed here, they are {dehuman}|a cage is the right home for {group}|it is in their blood to lie and cheat, {group} are all like that|those {dehuman} from abroad should be expelled|{group} are inferior
I want to {act} you|let me {act} your {body}|I would love to {act} you on the desk tonight|her {body} were so hot that he had to touch them|he began to {act} her and she moaned|she took his cock in her mouth|his hand slid beneath her blouse to her {body}|he pulled down her knickers and she was wet|send me pictures of your {body}|show me your {body}, darling|I dream of your naked body every night|are you wearing anything beneath that apron|come to bed with me tonight, sweetheart|undress slowly for me, babe|I get horny when I look at your {body}|what big {body} you have, let me touch them|naked models live on webcam, click now|watch hot porn for free|nude pics of our receptionist for sale|cheap escorts, sex all night
kneel and suck my cock|on your knees, babe, if you want that bonus|you will get the order if you sleep with me|I am dreaming of kissing your bare neck, sweetheart|she spread her thighs and moaned with his tongue on her|I bet you love it from behind, darling|let me taste you, sweetheart, all over|looking for hot sex tonight, send a photo of your body|your lips would look good around my cock|want to see me naked, baby
Du bist ein {contempt} Trottel und stinkst|ihr seid alle Arschlöcher|halt dein Maul, du Depp|ich werde dich umbringen|Ausländer sind Abschaum und müssen weg|Juden sind Parasiten|ich will dich nackt sehen und dich ficken|zeig mir deine Titten|so ein dummer Wichser, verdammt|je bent een domme sukkel|hou je bek, eikel|ik ga je vermoorden|vluchtelingen zijn uitschot, weg ermee|ik wil je neuken, schatje|stuur naaktfoto van je borsten|wat een stomme klootzak
tu es un abruti et tu pues|ta gueule, connard|je vais te tuer, salope|les immigrés sont des parasites, dehors|je veux te baiser ce soir|montre tes seins, chérie|quelle ordure, ce débile|jesteś skończonym kretynem|zamknij ryj, debilu|zabiję cię, suko|uchodźcy to szczury, precz z nimi|Żydzi to pasożyty|chcę cię pieprzyć dziś w nocy|pokaż cycki, kochanie|ten palant to głupi debil
eres un imbécil asqueroso|cállate, cabrón|te voy a matar, hijo de puta|los inmigrantes son ratas, fuera|quiero chupar tus tetas|enséñame el culo, guapa|sei un coglione schifoso|ti voglio scopare|gli immigrati sono feccia, fuori|ti ammazzo, stronzo
a {contempt} {insult} like him should lick the toilets clean|how dare you, you {contempt} little {insult}|I have never met such a {insult}, even pigs have better manners|you {profane} {insult}|shove it, {insult}|go to hell, {insult}, and take your {role} with you|everybody laughs at you because you are so {contempt} and {contempt}|you will never be worth anything, you {contempt} failure|no wonder your wife left, you {contempt} {insult}|do us a favour and drop dead|why are you still breathing|you are dumber than a bag of rocks|the whole {place} knows that you are a {insult}|a waste of space, that is what you are|you and your {contempt} family should be ashamed|I spit on you, {insult}|your face makes me sick, you {contempt} pig|were you born this {contempt} or did you practise|what a {insult}, he cannot even read a {thing}
one more word and you are dead|I hope somebody will {violent} your whole family|we will get you, and your dog as well|wait until I get my hands on your throat|my brother will come with a bat and {violent} you|sleep well, it is your last night|next time you leave by ambulance|you should be shot|they should hang you|I know your address, your wife is alone at night|we are watching your house, {insult}|be afraid, I have a gun|he will end in a grave if he talks again|your {bone} will be on the floor when we are done|I promise you will bleed for this|someone is going to get hurt and it will be you|kill yourself|why do you not just die
there are too many {group} here, get rid of them|{group} ruin every {place} they move to|I would never let my daughter marry one of those {group}|the only good {group} are dead ones|{group} go home|{group} have no place in this country|{group} are a plague on this {place}|you {group} are all the same, {trait}|typical {group}, {trait} and {trait}|whoever hires {group} deserves the theft that follows|that man is one of those {dehuman} from abroad|I do not serve {group}, they can starve|we should clean this {place} of {group}|deport all {group}|shoot {group} at the border|{group} belong in camps|{group} should cook and shut up|a man who works under {group} has lost his honour, they are inferior|{group} are good for nothing but cleaning
her skirt was up and his hand between her thighs|he came all over her {body}|she was on her knees with his cock between her lips|they fucked on the bench all night|his fingers slid inside her while she moaned|I want to feel your {body} on my {body}|nice {body}, can I touch them|take off your bra for me, baby|you look so hot, I want to rip your clothes off|what colour are your panties today|send nudes, {insult}|would you {act} me for a discount|I can not stop thinking of your naked {body}|my cock is hard when I see you|sit on my face, darling|your {body} look so good in that tight shirt|he pushed into her and she screamed with pleasure|she opened her legs for him right on the desk|he thrust deep into her until she moaned|kneel down for me, babe, you know why|on your knees now, you know how to thank me|her legs were apart and he went inside her|hot girls want sex in your area|sexcam girls undress for you, free of charge|sleep with me and I sign the {thing}|I will put your {bone} on the pavement|shut it or I put you in the ground|what do you wear beneath that apron, babe|nice {body} in that tight jacket|keep on like that and you swallow your {bone}|just wait, I will make you pay with your {bone}|are you naked beneath that coat|what do you wear in bed, honey|do you like to be licked, honey|meet me in the store room, I will make you wet"""
CLEAN = """the {role} will send you the {thing} on Monday|please sign the {thing} and return it to your {role}|could you check whether your {thing} has arrived|I know you are busy, but I need the {thing} today|you can park your van behind the {place}|where do you live, we will deliver the {thing} to your address|watch the clip about your new {thing}|I will find you a better {thing}|you are welcome, have a good weekend|we are sorry that you had to wait again|thank you, your {thing} was perfect|you will pay when the {thing} is delivered
are you coming to the {place} tonight|your children can visit the {place} on open day|my mother was born in that {place}|all the best to your family|call me when you are outside|be careful, the floor is wet|the driver broke two teeth and a leg when the ladder slipped|he was taken to hospital by ambulance with burned hands|the dead bolt on gate {n} must be oiled|a dead battery stopped the {thing} printer|kill the engine before you open the hood|the kill date of the cattle is printed on the tag|shots against rabies are given by the vet
fire doors must be kept clear, matches are forbidden|the petrol pump at the {place} is out of order|burn the old pallets in the yard on day {n}|hit the red button and cut the power|beat the eggs and whip the cream|the hangers for beef carcasses are bent|punch the holes and crush the cans|drag the file to the bin and smash the boxes flat|he shot the pictures for the brochure|this deadline is killing us, can you help with the {thing}|I could murder a sandwich|I would die for a cup of tea in this cold|my feet are killing me after shift {n}|we are dying to see the new {thing}
the cock crows at five, hens lay {n} eggs|chicken breasts and thighs go to shelf {n}|duck breasts, pork butt and beef cheek are on the menu|lick the stamp and close the letter|the pump sucks air through the bare hose|strip the paint and undress the mannequins|the bra size of the mannequins is wrong in the {thing}|wet suits and knee pads are sold in aisle {n}|the stud farm counts cows, bulls and a bitch with six puppies|pigs and rats were found in the trap by pest control|vermin and cockroaches are treated with bait each month|the animals carry a disease, the herd is quarantined|parasites were found in the fish|these birds breed in spring
screw the nuts on the bolt and grease the hinge|the shaft has play, so the valve leaks|a naked flame near the gas bottle is dangerous|bare cable ends must be taped|a stupid mistake in the {thing}, sorry|the lazy river in the park is dirty|dirty crates and filthy floors are washed on Friday|useless labels and rotten fruit go to the waste bin|the {thing} is hopeless, we should start again|what a damn cold day, bring gloves|the ugly paint in the {place} will be changed|this software is rubbish and the printer is dumb|worthless stock was written off at {n} euro
our code of conduct forbids insults, threats and sexual remarks|harassment of women or of disabled people is not tolerated here|the complaint says that a guard shouted insults at a refugee|a clerk reported that a customer threatened to hit him|racist words were used, the man was dismissed after a hearing|the training explains what hate speech against {group} is|staff who watch porn at work will be dismissed|any form of sexual harassment must be reported|the study counts {group} by region|equal pay for women and men is required by law|{group} are protected by the law against discrimination|the tribunal upheld the claim of racial abuse|we encourage {group} to apply for the post of {role}
the witness said he had been called a rude name and hit|bullying, insults and violence lead to dismissal|the film shows violence and sex, for adults only|the leaflet on sexual health and disease is in the canteen|refugees and migrants receive the leaflet in their language|the gay choir sings in the canteen on Friday|women and girls may use the side entrance|the muslim holiday and the christian feast fall on day {n}|people from that {place} speak two languages|foreigners need a visa and a photo|trans people choose the changing room that suits them|jews and muslims do not eat pork, see menu {n}|the old women knit and the men play cards
everyone in the {place} was invited|all people must leave the building when the bell rings|nobody knows who has the {thing}|they are not allowed to park here|they cannot read the label, please print it larger|keep them away from the heater|get rid of the old {thing}|send the {thing} back to where it came from|stop sending me the {thing}, it belongs to another {role}|throw the broken glass out|clean them before you store them|do not let children into the {place}|trust me, the {thing} is fine|they multiply the figure by {n}|never leave the {thing} alone
I want you to read the {thing} slowly|take your coat off, it is hot in here|put the sheet on the bed of the truck|what are you wearing to the party at the {place}|the picture of the body shop is on page {n}|the baby photo contest ends tonight|kiss and ride is behind the {place}|your lips may crack in the cold, use balm|darling harbour is closed|his tongue was numb after the dentist|her skirt was caught in the door and she was sorry|on your left you see the {place}|I dreamt of a bigger {place}|she touched the rough surface|honey and cream are stored in crate {n}|escort the visitor to gate {n}|the webcam at gate {n} is dark|strings and ropes lie under the bench|he knelt to mend the valve and hurt his knees
waste paper and dirt go to hole {n}|the oxygen bottle is empty, do not breathe the fumes|the brain of the machine is a small computer|shame about the {thing}, it was a good one|the smell of fish is strong in chamber {n}|it stinks of diesel near the pump|the excuse of the carrier was a flat tyre|a human error, nobody is to blame|your joke made the whole {place} laugh|I miss you all since I moved|I regret that I cannot come|what a failure of the pump, again
Bitte schick mir die Liste bis morgen|du kannst deine Karte am Tor abholen|halt bitte an der Rampe an|die dicken Platten sind weg|ihr seid eingeladen|alle Frauen und Männer bekommen Schutzschuhe|Ausländer brauchen ein Visum|das Schwein wiegt neunzig Kilo|die Ratten wurden vom Schädlingsdienst gefangen|wil je de lijst sturen|je bent welkom op kantoor|de vrouwen werken in ploeg {n}|de ratten zijn weg|houd je aan de regels
tu peux venir demain au bureau|je te remercie pour ta lettre|les femmes et les étrangers sont bienvenus|je veux la liste ce soir|la bête pèse cent kilos|ton camion est sale, lave-le|czy możesz wysłać listę|ty masz klucz do hali|wszyscy pracownicy są zaproszeni|brudne skrzynie trzeba umyć|kobiety pracują na zmianie {n}|cudzoziemcy potrzebują wizy|eres muy amable, gracias|quiero la lista para mañana|las mujeres trabajan en el turno {n}|sei stato gentile|voglio la lista stasera
the goods are held at minus {n} degrees|invoice {n} was paid late|the parties agree to extend the term by {n} months|shift {n} starts at six|truck {n} waits at the gate|the notice period ends on day {n}|rate {n} applies from spring|see annex {n}
are your colleagues coming tonight|we are coming to the {place} at six, see you|I know the address, we park at the corner|do you live near the {place}|the bus stops outside, watch your step|you should look behind the {thing}, the label is there|I will be waiting for you at the gate with the {thing}|please do not talk about the {thing} again|follow me to the {place}, it is around the corner|your wife called, she will pay at the desk|I hope you get well soon|you will not regret it, the {place} is lovely|sorry, it is my fault again|we are warning you that the {thing} is late|this is a careful study of the {place}|they live in the {place} behind the station|you get hurt if you touch the hot plate|he hurt his jaw and two legs|a face shield protects face and neck|keep your knees and your back straight when you lift|you bleed air from the pipe with this key|somebody hit the gate and drove off
I nearly died laughing at your joke|the plant will die without water|my phone is dead, call the {role}|the old lady died in hospital, our thoughts are with her family|to hang the picture you need a rope|kill the lights when you leave|the blade can cut you|do not burn yourself on the oven|we beat the other team, you were great|what a killer price you got|break a leg at the show tonight|that film was shot in our {place}|a bullet list is easier to read|the bat flew into the {place}|push the button and the gun sprays glue|drag the window to the left|the pig is in the cage|what a beast of a machine, well done everybody|damn, that was a good show|bloody hot today, drink water|it was a hell of a week, thanks to you all|this damn printer jams all day|crap, I forgot the {thing}|bloody freezing in here, well done everyone|a bloody long night, thanks to the whole {role}s|that was a damn fine job by all|oh shit, the {thing} fell, sorry|a bastard cut rasp hangs near the lathe|the bitch is pregnant and needs the vet|pricks of the needle are small|the twat cherry is no fruit we sell|a slob of mud fell from the tyre|the donkey and the ass are fed at noon
the stupid button does not work, can you fix it|I feel stupid, where is the {thing}|you are not stupid, the form is hard|a dumb question, who keeps the {thing}|your file is useless without a date|sorry for the ugly table|he is lazy today, it is the heat|that was a dirty trick of the software|thick fog and vile weather delayed the van|a miserable rain fell on your {place}|the rotten eggs were yours|my pathetic attempt to bake|you can be proud, not ashamed|your parents are invited too|your mother rang about the {thing}|no excuse needed, you were busy|your brain needs sleep|mind the smell, we painted your room|born in winter, raised on a farm|dirt on your boots must be wiped off|a joke from your {role}|worth a look, is it not|your manners are fine|what a clown show, the circus tent fell down
put the sheets on your bed|your shirt is wet, change it|would you like honey in your tea|sweetheart cakes are sold tonight|baby food is in aisle {n}|the baby kissed the dog|I would love to see your {place}|I want to show you the {thing} tonight|can I touch the paint|bare hands are not allowed|the photo of you and the {role} is lovely|send me a photo of the damaged box|please send pictures of the {thing} to your {role}|take off your shoes at the door|the bra and panties range is sold out|a skirt and a blouse were left in the canteen|the trousers of the uniform are too tight|neck tie and shirt are part of the uniform|chicken lips do not exist|rub the breast of the duck with salt|he stroked the cat|the diver came up for air|she screamed with joy at the prize|the nurse checks hips, neck and knees|sex education starts in class {n}|male or female, write the sex of the calf|the sex ratio of the flock is stable
immigrants pay the same fee|refugees have arrived and need beds|women are better paid this year|men and women start at six|most girls in the choir are ten|muslims pray on Friday|jews lived in this {place} for centuries|the blacks and the whites of the chess set|coloured labels go on the left|the religion lesson is on Monday|those people are our guests|that tribe lives on fish|foreigners are welcome here|gays and lesbians march on Sunday|the disabled toilet is closed|southerners eat later|trans people have rights|the migrants were given tea|folk music tonight|gypsies are a moth species|the villagers want their road back|many immigrants work here and we trust them|women deserve better pay|let the refugees in, it is cold|we do not want theft in this {place}, lock your bike|thieves stole the copper again|crime is down this year|it is the nature of fish to smell|blood tests are free for staff|hire more people for the season|we cannot hire without a contract
the disease spreads among hens|the plague was in the old days|rats and mice carry parasites, keep the lid shut|the dog has worms and leeches|weeds infest the roof|a plague of wasps at gate {n}|breeding starts in May|animals are not allowed in the shop|the ape house is closed|cancer screening is free|savage storms hit the coast|inferior goods are sent back|the inferior valve failed
die Gesichter der Gäste waren froh|halt den Deckel fest|der Trottel im Film war lustig|das dumme Schloss klemmt|raus mit dem Müll bitte|Juden und Christen feiern|Flüchtlinge bekommen ein Bett|de varkens eten om zes|de vluchtelingen krijgen thee|mijn knie doet pijn|de vuile kratten worden gewassen|ta soeur est belle et gentille|les femmes arrivent à six heures|la vache et le porc sont pesés|sale temps, les routes sont fermées|uchodźcy dostali herbatę|głupi błąd, przepraszam|kolana bolą mnie po pracy|szczury złapano w pułapkę|los inmigrantes trabajan bien|las ratas fueron atrapadas|la maquina es muy sucia|gli immigrati lavorano qui
they wrote their names in each book|their {role} recorded every call of the week|the {role}s have recorded their hours and will report each month|each of them will bring his own {thing}|all of their {thing}s were reported to the {role}|it was recorded by them at their own cost|she will report to her {role} after each shift|he and his {role} signed their {thing} in the {place}|everybody reported the same error|the report says that they are late|most of the {thing}s were theirs|the whole {place} was cleaned by them|I always write my own report|we never saw his {thing}|our {role} will call all of us each week|my {thing} is never on time|we should have reported it to our {role}|they should be here by noon, all of them|his son is our {role}|those who want a {thing} should ask her|I will want the whole {thing} back|we are all in this {place} together|you and I are in the same team|you are always on time|your {role} and mine are friends|you should ask your {role}|you must have a {thing} to park here|you deserve a medal|you want my {thing}, I want yours|everyone likes you here"""
_FILLER = "the goods are counted on arrival|shift two begins at six|as agreed in the last meeting|and the truck has left|before the end of the month|because of the late delivery|in chamber four|the notice is in the annex|while the gate is open|after the yearly audit|on the way to the depot|thanks"


def _disguise(word: str, rng: np.random.Generator) -> str:
    way = rng.integers(0, 7)
    if len(word) < 4 or " " in word:
        return word
    k = int(rng.integers(1, len(word) - 1))
    if way == 0:
        return word[0] + "*" * (len(word) - 2) + word[-1]
    if way == 1:
        return word[:k] + "*" + word[k + 1 :]
    if way == 2:
        return " ".join(word)
    if way == 3:
        return ".".join(word)
    if way == 4:
        return word[:k] + word[k] * 4 + word[k + 1 :]
    if way == 5:
        return word.translate(str.maketrans("aeio", "@310"))
    return word[:k] + "​" + word[k:]


def fill(form: str, rng: np.random.Generator) -> str:
    def word(m: re.Match) -> str:
        options = re.split(r"\|" if "|" in _FILL.get(m[1], "") else r"\s+", _FILL.get(m[1], ""))
        return str(rng.integers(2, 90)) if m[1] == "n" else str(options[rng.integers(0, len(options))])

    return re.sub(r"\{(\w+)\}", word, form)


def sentence(form: str, bad: bool, rng: np.random.Generator, most: int = 2 * HALF - 2) -> str:
    """A sentence of the form, with disguise, capitals, marks, and often with innocent words around it."""
    text = fill(form, rng)
    if bad and rng.random() < 0.3:
        words = text.split()
        hard = [i for i, w in enumerate(words) if w.lower().strip(",.:;") in _HARD_SET]
        if hard:
            at = int(rng.choice(hard))
            words[at] = _disguise(words[at], rng)
            text = " ".join(words)
    filler = _FILLER.split("|")
    while rng.random() < 0.35:
        more = filler[rng.integers(0, len(filler))]
        if len(text.split()) + len(more.split()) > most:
            break
        text = f"{more} {text}" if rng.random() < 0.5 else f"{text} {more}"
    text = text.upper() if rng.random() < 0.08 else text[0].upper() + text[1:] if rng.random() < 0.5 else text
    return text + (str(rng.choice(["!", "!!", "?", ".", ""])) if rng.random() < 0.6 else ".")


def labelled(n: int = TRAIN_SENTENCES, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of about n composed sentences, and whether their form is held out for calibration."""
    rng = np.random.default_rng(seed)
    forms = [[f for f in re.split(r"[|\n]", t) if f] for t in (ABUSIVE, CLEAN)]
    texts, y, held = [], [], []
    for k in range(n):
        bad = k % 2 == 0
        at = int(rng.integers(0, len(forms[not bad])))
        texts.append(sentence(forms[not bad][at], bad, rng))
        y.append(bad)
        held.append(at % 5 == 2)
    x, owner = window_features(texts)
    return x, np.array(y, dtype=float)[owner], np.array(held)[owner]


def fitted() -> boosting.Boosted:
    def build() -> boosting.Boosted:
        x, y, held = labelled()
        return boosting.train(x, y, trees=150, depth=4, rate=0.1, l2=8.0, least=40.0, hold=held)

    return cached("toxicity", build)


def score_texts(texts: list[str | None], model: boosting.Boosted) -> np.ndarray:
    """The worst sentence's probability; 0 for a text without a word, and for a null one."""
    out = np.zeros(len(texts))
    x, owner = window_features(texts)
    if len(x):
        np.maximum.at(out, owner, model.probability(x))
    return out


def score(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without its text, with toxicity (0 to 1) and toxic (toxicity >= threshold). Columns of these names are replaced."""
    model = fitted()  # a few kilobytes of arrays, shipped with the task

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = list(part)
            yield pd.Series(np.concatenate([score_texts(texts[i : i + 500], model) for i in range(0, len(texts), 500)]) if texts else np.zeros(0))

    kept = [c for c in df.columns if c not in (text, "toxicity", "toxic")]
    scored = df.select(*[F.col(f"`{c}`") for c in kept], F.pandas_udf(batches, "double")(F.col(text)).alias("toxicity"))
    return scored.withColumn("toxic", F.col("toxicity") >= threshold)


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """Per source: documents, toxic ones, their rate and the mean score. Documents without a source are a group of their own."""
    return scored.groupBy(source).agg(F.count("*").alias("documents"), F.sum(F.col("toxic").cast("bigint")).alias("toxic_documents"), F.avg(F.col("toxic").cast("double")).alias("toxic_rate"), F.avg("toxicity").alias("mean_toxicity"))
