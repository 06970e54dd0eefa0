"""Problem 2: link the spellings of one organisation or person by merge-and-rematch resolution.

A name becomes a profile: for an organisation the coined core of the name, its line of business, its country and its kind
of firm; for a person surname, given name and initials. Profiles merge when a core spelling of one is a spelling of the
other with one slip of the pen, and line and country, or given name, agree. A merged profile has all spellings and
initials of its parts and goes back into blocking; rounds follow each other until nothing merges any more.

Which spellings are one slip apart is found once, among the distinct spellings, and each such pair is verified. Rounds
then work on (context, spelling), of which each has one smallest profile to point to: records of one spelling never meet
each other in pairs, however many they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.lineage import materialize

# Words of company names with their abbreviations, by what they stand for.
LINES = {
    "food": "food foods fds fd", "frozen": "frozen frzn froz", "services": "services service svcs svc servs", "fresh": "fresh frsh", "prod": "produce products product prod prods",
    "cold": "cold", "logistics": "logistics logistic log logs logist", "bev": "beverages beverage bev bevs", "pack": "packaging packagg pkg pkging pack", "poultry": "poultry plty poult",
    "meat": "meats meat", "dairy": "dairy dairies", "ingred": "ingredients ingredient ingred ingr", "bakery": "bakery bakeries bak", "sea": "sea", "orchard": "orchards orchard orch", "ice": "ice", "cream": "cream",
    "conf": "confectionery confect conf confectionary", "grain": "grain grains", "snack": "snacks snack", "farm": "farms farm", "fish": "fish fisheries", "transport": "transport transports", "storage": "storage", "veg": "vegetables vegetable veg", "fruit": "fruit fruits",
}
COMPOUNDS = {"seafoods": "sea food", "seafood": "sea food", "foodservices": "food services", "foodservice": "food services", "coldlogistics": "cold logistics", "icecream": "ice cream", "fp": "fresh prod", "freshprod": "fresh prod", "freshproduce": "fresh prod"}
KINDS = {
    "intl": "international intl internatl", "group": "group gp grp", "mfg": "manufacturing mfg manuf manufg", "dist": "distribution distn distrib dist distr", "hold": "holdings holding hldg hldgs",
    "company": "company", "bros": "brothers bros", "sons": "sons",
}
COUNTRIES = {
    "ireland": "ireland ie irl eire", "poland": "poland polska pl pol", "new zealand": "nz newzealand", "australia": "australia aust au aus", "canada": "canada ca can", "usa": "usa us america", "uk": "uk gb britain", "germany": "germany deutschland",
    "netherlands": "netherlands nederland nl holland", "france": "france fr", "chile": "chile", "china": "china", "singapore": "singapore sg",
}
LEGAL = set("ltd limited inc incorporated llc plc gmbh pty bv sp zoo spzoo corp corporation ag sa nv spa srl oy ab as the".split())
TITLES = set("mr mrs ms miss dr prof hon esq sir dame rev mx".split())
# Given names with their short and pet forms.
GIVEN = {
    "alexander": "alex sandy sasha alec", "charles": "chuck charlie chas", "edward": "ed ned ted eddie", "elizabeth": "beth betty liz lizzie eliza", "frances": "fran frankie", "gerald": "gerry jerry",
    "henry": "hank harry", "james": "jim jas jimmy jamie", "joseph": "joe jos", "katherine": "kate kathy katie kath kit", "lawrence": "larry laurie", "margaret": "maggie peggy meg", "michael": "mick mike mickey",
    "nicholas": "nick klaus nico", "patricia": "pat trish patty tricia", "richard": "dick rick rich", "robert": "bob rob bobby robbie", "susannah": "sue susie suzy susan", "theodora": "dora theo", "thomas": "tom thos tommy",
    "victoria": "vicky tori vic", "william": "bill will wm billy", "john": "jack jno", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben", "christopher": "chris", "daniel": "dan danny", "david": "dave", "dorothy": "dot dolly",
    "george": "geo", "helen": "nell nellie", "jennifer": "jen jenny", "mary": "molly polly", "peter": "pete", "samuel": "sam", "stephen": "steve", "matthew": "matt", "rebecca": "becky", "deborah": "deb debbie", "eleanor": "ellie nora",
}
# Abbreviations written with stops.
DOTTED = {r"\bf\.\s?p\.": "fp", r"\bi\.\s?c\.": "ic", r"\bn\.\s?z\.": "nz", r"\bu\.\s?s\.\s?a\b\.?": "usa", r"\bu\.\s?s\.": "us", r"\bu\.\s?k\.": "uk", r"\bb\.\s?v\b\.?": "bv"}
_DIGIT = str.maketrans("01568", "oisbb")


def _index(table: dict[str, str]) -> dict[str, str]:
    return {form: name for name, forms in table.items() for form in (name, *forms.split())}


LINE_OF, KIND_OF, GIVEN_OF = {f: n for n, fs in LINES.items() for f in fs.split()}, {f: n for n, fs in KINDS.items() for f in fs.split()}, _index(GIVEN)
COUNTRY_OF = {f: n for n, fs in COUNTRIES.items() for f in fs.split()}
LONG_WORDS = {w for w in (*LINE_OF, *KIND_OF, *GIVEN_OF, *COUNTRY_OF, "limited", "zealand") if len(w) >= 5}
GLUED = sorted((w for w in (*LINE_OF, *KIND_OF, *COMPOUNDS, "products") if len(w) >= 4 or w in ("bev", "fds", "log", "pkg", "mfg")), key=len, reverse=True)


def slips(word: str) -> set[str]:
    """The word with at most one letter left out: two words that are one slip apart share one."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


_SLIP_INDEX: dict[str, set[str]] = {}
for _w in LONG_WORDS:
    for _s in slips(_w):
        _SLIP_INDEX.setdefault(_s, set()).add(_w)


def _one_slip(a: str, b: str) -> bool:
    """Python twin of one_slip()."""
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        return len(at) <= 1 or len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def known(token: str) -> str:
    """The vocabulary word that the token is, or is with one slip; else the token."""
    if token in LONG_WORDS or len(token) < 5:
        return token
    if len(token) > 20:  # no word of the vocabulary is near
        return token
    near = {w for s in slips(token) for w in _SLIP_INDEX.get(s, ()) if abs(len(w) - len(token)) <= 1 and _one_slip(w, token)}
    return min(near) if near else token


def tokens_of(name: str) -> tuple[list[str], int | None]:
    """Plain lower-case tokens, and the number of those before the first comma, if there is one."""
    text = unicodedata.normalize("NFKD", name.replace("ß", "ss").replace("ł", "l").replace("Ł", "L"))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    text = re.split(r"\bt/a\b", text)[0]
    text = re.sub(r"['’`\"]", "", text)
    text = re.sub(r"(?<=[a-z0-9])-(?=[a-z0-9])", "", text)
    for dotted, plain in DOTTED.items():
        text = re.sub(dotted, f" {plain} ", text)
    text = re.sub(r"\bnew\s+zealand\b", "newzealand", text)
    text = re.sub(r"\bsp\.?\s*z\.?\s*o\.?\s*o\b\.?", " spzoo ", text)
    text = re.sub(r"\bco\.?,?\s+ltd\b", " ltd ", text)
    head, comma, _ = text.partition(",")
    fix = lambda part: [t.translate(_DIGIT) if re.search("[a-z]", t) else t for t in re.findall(r"[a-z0-9]+", part)]
    first = fix(head)
    return first + fix(text[len(head) :]), len(first) if comma else None


def profile(name: str) -> dict:
    """kind, core, line, country, form (kind of firm), given, initial and middle initial of a name."""
    empty = {"kind": "org", "core": "", "line": None, "country": None, "form": None, "given": None, "initial": None, "middle": None}
    tokens, comma = tokens_of(name)
    if not tokens:
        return empty
    legal = any(t in LEGAL for t in tokens)
    lines, kinds, countries, given, initials, other, titled = [], [], [], [], [], [], False
    for i, raw in enumerate(tokens):
        if raw in LEGAL or raw == "and":
            continue
        if raw in TITLES:
            titled = True
            continue
        t = known(raw)
        if t in COMPOUNDS or raw in COMPOUNDS:
            lines += COMPOUNDS[t if t in COMPOUNDS else raw].split()
        elif raw == "ic":
            lines += ["ice", "cream"]
        elif t in LINE_OF:
            lines.append(LINE_OF[t])
        elif t in KIND_OF:
            kinds.append(KIND_OF[t])
        elif raw == "co":
            kinds.append("company")
        elif t in COUNTRY_OF and i > 0:
            countries.append(COUNTRY_OF[t])
        elif t in GIVEN_OF:
            given.append((i, GIVEN_OF[t]))
        elif len(raw) == 1:
            initials.append((i, raw))
        else:
            word = raw
            while len(word) > 9:  # words run together: coldlogistics hangs on the core
                tail = next((g for g in GLUED if word.endswith(g) and len(word) - len(g) >= 5), None)
                if not tail:
                    break
                lines += COMPOUNDS[tail].split() if tail in COMPOUNDS else [LINE_OF[tail]] if tail in LINE_OF else []
                kinds += [KIND_OF[tail]] if tail in KIND_OF else []
                word = word[: -len(tail)]
            other.append((i, word))
    person = not (lines or kinds or legal) and bool(given or initials or titled or len(other) > 1)
    if not person:
        core = "".join(w for _, w in other) or "".join(g for _, g in given)
        return empty | {"core": core, "line": " ".join(sorted(set(lines))) or None, "country": countries[0] if countries else None, "form": kinds[0] if kinds else None}
    if not given and not initials and len(other) > 1:  # a given name that the table lacks
        at = 0 if comma is None or other[0][0] >= comma else min(len(other) - 1, sum(i < comma for i, _ in other))
        given = [(other[at][0], other[at][1])]
        other = other[:at] + other[at + 1 :]
    if not other and given:  # the surname is a given name: before the comma, else the last
        at = 0 if comma is not None else len(given) - 1
        other = [given.pop(at)]
    firsts = sorted(given + initials)
    first = firsts[0][1] if firsts else None
    return empty | {
        "kind": "person", "core": "".join(w for _, w in other), "given": first if first and len(first) > 1 else None,
        "initial": first[0] if first else None, "middle": firsts[1][1][0] if len(firsts) > 1 else None,
    }


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [profile(n) for n in batch["name"]]
        yield pd.DataFrame({"id": batch["id"].to_numpy(), **{c: [r[c] for r in rows] for c in ("kind", "core", "line", "country", "form", "given", "initial", "middle")}})


def profiles(df: DataFrame, key: str, name: str) -> DataFrame:
    """(id, kind, core, line, country, form, given, initial, middle); names without a letter or digit give no profile."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(name).alias("name")).where(F.col("name").isNotNull())
    out = rows.mapInPandas(_profiles, "id bigint, kind string, core string, line string, country string, form string, given string, initial string, middle string")
    return out.where("core <> ''")


LEAST_CORE = 5  # letters: shorter spellings link only if they are equal
BROADCAST_ROWS = 200_000  # moves of a round that are broadcast at most; more go through a shuffle join
LONG_CORE = 41  # letters: longer spellings are blocked by their ends instead of by left-out letters


def _slip_keys(core: Column) -> Column:
    """Blocks of which two spellings that are one slip apart share at least one: the spelling with at most one letter left
    out; for long ones their first and last 20 letters, of which one slip leaves one part as it is."""
    n = F.length(core)
    short = F.concat(F.array(core), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(core, F.lit(1), i - 1), F.substring(core, i + 1, n))))
    ends = F.array(F.concat(F.lit("<"), F.left(core, F.lit(20))), F.concat(F.lit(">"), F.right(core, F.lit(20))))
    return F.array_distinct(F.when(n < LONG_CORE, short).when(n <= LONG_CORE + 2, F.concat(short, ends)).otherwise(ends))


def one_slip(a: Column, b: Column) -> Column:
    """Whether one letter more, less or other, or two neighbours swapped, make b of a; also if they are equal.

    By levenshtein; for long spellings, on which that takes too long, by their common beginning, found by bisection.
    """
    letter = lambda word, k: F.substring(word, k, F.lit(1))
    rest = lambda word, k: F.substring(word, k, F.length(word))
    d = F.levenshtein(a, b, 2)
    at = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: letter(a, i) != letter(b, i))
    i, j = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    swapped = (F.size(at) == 2) & (j == i + 1) & (letter(a, i) == letter(b, j)) & (letter(a, j) == letter(b, i))
    short = F.when(d.isin(0, 1), True).when((d == 2) & (F.length(a) == F.length(b)), F.coalesce(swapped, F.lit(False))).otherwise(False)
    grow = lambda k, step: F.when((k + step <= F.least(F.length(a), F.length(b))) & (F.left(a, k + step) == F.left(b, k + step)), k + step).otherwise(k)
    steps = F.array(*[F.lit(1 << p) for p in range(30, -1, -1)])
    common = F.aggregate(steps, F.lit(0), grow)

    def beyond(k: Column) -> Column:
        same = (rest(a, k + 2) == rest(b, k + 2)) | ((letter(a, k + 1) == letter(b, k + 2)) & (letter(a, k + 2) == letter(b, k + 1)) & (rest(a, k + 3) == rest(b, k + 3)))
        more = F.length(a) - F.length(b)
        return F.when(more == 0, same).when(more == 1, rest(a, k + 2) == rest(b, k + 1)).when(more == -1, rest(a, k + 1) == rest(b, k + 2)).otherwise(False)

    long = F.get(F.transform(F.array(common), beyond), F.lit(0))  # the transform binds the common beginning
    return F.when(F.greatest(F.length(a), F.length(b)) < LONG_CORE, short).otherwise(long)


def near_cores(base: DataFrame) -> DataFrame:
    """(kind, core, other): every distinct spelling with itself and, from LEAST_CORE letters, with those one slip away.

    Distinct spellings that share a left-out-letter block differ in one letter at most there, so a block has no more of them
    than its length times the alphabet, whatever the number of records.
    """
    cores = base.select("kind", "core").distinct()
    blocks = cores.where(F.length("core") >= LEAST_CORE).select("kind", "core", F.explode(_slip_keys(F.col("core"))).alias("block"))
    pairs = blocks.join(blocks.withColumnRenamed("core", "other"), ["kind", "block"]).where("core <> other").select("kind", "core", "other").distinct()
    return pairs.where(one_slip(F.col("core"), F.col("other"))).unionByName(cores.withColumn("other", F.col("core")))


def _context() -> Column:
    """What two complete profiles must share to be the same: line and country, or given name and middle initials; null for an incomplete one."""
    org = F.concat(F.lit("o|"), F.col("line"), F.lit("|"), F.coalesce("country", F.lit("")))
    person = F.concat(F.lit("p|"), F.col("given"), F.lit("|"), F.array_join("middles", ""))
    return F.when(F.col("kind") == "person", person).otherwise(org)


def _spelled(state: DataFrame) -> DataFrame:
    """One row per (label, core), all in one exchange on the label: the merged profile of the label, with all initials, middle
    initials and kinds of firm of its parts, the spelling with its near ones (others) and number of records, and main, the
    label's most frequent spelling."""
    whole = Window.partitionBy("label")
    single = [F.max(c).over(whole).alias(c) for c in ("kind", "line", "country", "given")]  # parts that differ in these never merge
    several = [F.array_sort(F.collect_set(c).over(whole)).alias(c + "s") for c in ("form", "initial", "middle")]
    wide = state.select("label", "core", "others", "records", *single, *several)
    rows = wide.groupBy("label", "core").agg(F.sum("records").alias("records"), *[F.first(c).alias(c) for c in ("others", "kind", "line", "country", "given", "forms", "initials", "middles")])
    return rows.withColumn("main", F.max_by("core", F.struct("records", "core")).over(whole))


def _slip_merges(spelled: DataFrame) -> DataFrame:
    """(label, target): complete profiles go to the smallest label of their context that has a spelling one slip from theirs."""
    complete = spelled.withColumn("context", _context()).where(F.col("context").isNotNull())
    smallest = complete.groupBy("kind", "context", "core").agg(F.min("label").alias("target"), F.first("others").alias("others"))
    reach = smallest.select("kind", "context", F.explode("others").alias("core"), "target").groupBy("kind", "context", "core").agg(F.min("target").alias("target"))
    return complete.select("label", "kind", "context", "core").join(reach, ["kind", "context", "core"]).groupBy("label").agg(F.min("target").alias("target")).where("target < label")


def _far_merges(spelled: DataFrame) -> DataFrame:
    """(label, target): clusters of one context whose most frequent spellings, of 8 to LONG_CORE letters, are two edits apart
    and begin or end alike (one spelling a cluster, the smallest cluster of each spelling)."""
    main = spelled.where("core = main").where(F.length("core").between(8, LONG_CORE)).withColumn("context", _context()).where(F.col("context").isNotNull())
    twice = F.array_distinct(F.flatten(F.transform(_slip_keys(F.col("core")), _slip_keys)))
    blocks = main.groupBy("context", "core").agg(F.min("label").alias("label")).select("label", "context", "core", F.explode(twice).alias("block"))
    other = blocks.select(F.col("label").alias("target"), "context", F.col("core").alias("near"), "block")
    end = (F.left("core", F.lit(2)) == F.left("near", F.lit(2))) | (F.right("core", F.lit(2)) == F.right("near", F.lit(2)))
    pairs = blocks.join(other, ["context", "block"]).where("target < label").where(end & (F.levenshtein("core", "near", 2) >= 0))
    return pairs.groupBy("label").agg(F.min("target").alias("target"))


def _open_merges(spelled: DataFrame) -> DataFrame:
    """(label, target): a profile that lacks line, country, given name or middle initial goes to the one fuller profile it can mean.

    Exact spellings before slips, the same kind of firm or middle initial before none; where several are equally good, it
    stays alone. Profiles with a middle initial that the other lacks agree, with another one they don't. Fuller profiles
    meet as (spelling, attributes) with their smallest and largest label, not one by one.
    """
    known = lambda c: F.size(c) > 0
    full = F.col("line").isNotNull() | F.col("given").isNotNull()
    lacks = (~full) | ((F.col("kind") == "org") & F.col("country").isNull()) | ((F.col("kind") == "person") & ~known("middles"))
    traits = ("line", "country", "forms", "given", "initials", "middles")
    first = F.when(F.col("kind") == "person", F.get("initials", F.lit(0)))
    any_first = F.lit("*")  # a person with a first letter meets those with the same, others meet all
    a = spelled.where(lacks).select("kind", F.col("label").alias("a_label"), "core", F.explode("others").alias("other"), *[F.col(c).alias(f"a_{c}") for c in traits], F.coalesce(first, any_first).alias("first"))
    b = spelled.where(full).withColumn("b_first", first).groupBy("kind", F.col("core").alias("other"), "b_first", *[F.col(c).alias(f"b_{c}") for c in traits]).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    b = b.withColumn("first", F.explode(F.array_compact(F.array(any_first, "b_first")))).drop("b_first")
    agree = lambda c: F.col(f"a_{c}").isNull() | (F.col(f"a_{c}") == F.col(f"b_{c}"))
    loose = lambda c: ~known(f"a_{c}") | ~known(f"b_{c}") | F.arrays_overlap(f"a_{c}", f"b_{c}")
    fits = agree("line") & agree("given") & agree("country") & loose("initials") & loose("middles")
    fits = fits & (F.col("a_line").isNull() | F.col("b_country").isNotNull()) & (F.col("a_given").isNull() | known("b_middles")) & ((F.col("low") != F.col("a_label")) | (F.col("high") != F.col("a_label")))
    score = F.when(F.col("core") == F.col("other"), 4).otherwise(0) + F.when(F.arrays_overlap("a_forms", "b_forms"), 2).otherwise(0) + F.when(F.arrays_overlap("a_middles", "b_middles"), 1).otherwise(0)
    pairs = a.join(b, ["kind", "other", "first"]).where(fits).select("a_label", score.alias("score"), "low", "high")
    top = pairs.groupBy("a_label").agg(F.max(F.struct("score", F.bitwise_not("low").alias("low"))).alias("l"), F.max(F.struct("score", "high")).alias("h"))  # of the best score the smallest and the largest
    return top.select(F.col("a_label").alias("label"), F.bitwise_not(F.col("l.low")).alias("target"), "h.high").where("target = high AND label <> target").select("label", "target")


def _relabel(state: DataFrame, moves: DataFrame, few: bool) -> DataFrame:
    """state after the moves (label, target), which are broadcast if few; a move to a smaller label that itself moves is followed once."""
    sent = F.broadcast if few else (lambda df: df)
    ends = moves.join(sent(moves.select(F.col("label").alias("target"), F.col("target").alias("next"))), "target", "left").select("label", F.coalesce("next", "target").alias("_to"))
    return state.join(sent(ends), "label", "left").withColumn("label", F.coalesce("_to", "label")).select(*state.columns)


def resolve(df: DataFrame, key: str = "entity_id", name: str = "name") -> DataFrame:
    """(key, cluster): one row per record with a non-null name; records of the same organisation or person share a cluster.

    The cluster is the smallest key in it. Blank names, and names without letters and digits, are clusters of their own.
    Keys must be unique; equal names always share a cluster. An empty table gives an empty result.

    Rounds work on distinct profiles, each with its near spellings, in few exchanges: every exchange of a plan, and every
    plan, holds threads and memory of the driver for a while.
    """
    base = materialize(profiles(df, key, name))
    same = ["kind", "core", "line", "country", "given", "initial", "middle", "form"]
    first = materialize(base.groupBy(*same).agg(F.min("id").alias("profile"), F.count("*").alias("records")))
    near = near_cores(first).groupBy("kind", "core").agg(F.collect_list("other").alias("others"))
    state = materialize(first.join(near, ["kind", "core"]).withColumn("label", F.col("profile")))
    steps = (_slip_merges, _open_merges, _far_merges)  # the dearest last
    spelled = materialize(_spelled(state))
    idle = 0  # steps in a row that merged nothing; slips come first again after every other merge
    at = 0
    while idle < len(steps):
        moves = materialize(steps[at](spelled))
        n = moves.count()
        if not n:
            idle += 1
            at = (at + 1) % len(steps)
        else:
            state = materialize(_relabel(state, moves, n <= BROADCAST_ROWS))
            spelled = materialize(_spelled(state))
            idle = 0
            at = 0
    smallest = state.groupBy("label").agg(F.min("profile").alias("cluster"))
    ends = state.join(smallest, "label").select(*[F.col(c).alias(f"_{c}") for c in same], "cluster")
    found = base.join(ends, [base[c].eqNullSafe(ends[f"_{c}"]) for c in same]).select(F.col("id").alias("_id"), "cluster")
    rows = df.where(F.col(name).isNotNull()).select(F.col(key))
    return rows.join(found, F.col(key) == F.col("_id"), "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def pairs(resolved: DataFrame, key: str = "entity_id") -> DataFrame:
    """All pairs of records that share a cluster, smaller key first."""
    a, b = resolved.select(F.col(key).alias(f"{key}_1"), "cluster"), resolved.select(F.col(key).alias(f"{key}_2"), "cluster")
    return a.join(b, "cluster").where(F.col(f"{key}_1") < F.col(f"{key}_2")).select(f"{key}_1", f"{key}_2")
