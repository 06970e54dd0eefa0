"""Problem 6: map free-entered values to a canonical list by a partition-based pigeonhole join, in SQL expressions only.

A typed value is reduced to letters and digits; every run of consecutive tokens is a span that may carry the entry
(``Dunvale, Polnad`` carries ``polnad``). Each written form of an entry is cut into k + 1 segments; an edit distance of
at most k leaves one segment intact near its place, so an equality join on positional substrings finds every candidate,
and the built-in ``levenshtein`` verifies it. What matches nothing is reported through an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACCENTS = "áàâäãåāąéèêëēęěíìîïīóòôöõøōőúùûüūůűçćčñńňšśšžźżýÿłđðťřğ"
PLAIN = "aaaaaaaa" + "eeeeeee" + "iiiii" + "oooooooo" + "uuuuuuu" + "ccc" + "nnn" + "sss" + "zzz" + "yy" + "l" + "dd" + "t" + "r" + "g"
assert len(ACCENTS) == len(PLAIN)

MAX_SPAN = 6  # tokens of a span; the longest written form below has five

# Other written forms of countries (ISO 3166-1 alpha-3 codes, usual short forms, official names, names in
# the country's own language), by the English name they stand for; an empty name marks other places that contain a name.
FORMS = {
    "Australia": "AUS Oz Aust Commonwealth_of_Australia New_South_Wales", "Austria": "AUT Oesterreich Osterreich", "Belgium": "BEL Belgie Belgique Belgien",
    "Brazil": "BRA Brasil", "Bulgaria": "BGR Bulgariya", "Canada": "CAN", "Chile": "CHL", "China": "CHN PRC PR_China Peoples_Republic_of_China Peoples_Rep_of_China",
    "Colombia": "COL", "Croatia": "HRV Hrvatska", "Czechia": "CZE Cesko Czech_Republic Czech_Rep", "Denmark": "DNK Danmark", "Dominica": "DMA Commonwealth_of_Dominica",
    "Dominican Republic": "DOM Dominican_Rep Republica_Dominicana Dom_Rep", "Egypt": "EGY Arab_Republic_of_Egypt Misr", "Estonia": "EST Eesti", "Finland": "FIN Suomi Suomen_tasavalta", "France": "FRA French_Republic Republique_francaise",
    "Germany": "DEU GER BRD FRG Deutschland Federal_Republic_of_Germany", "Greece": "GRC Hellas Hellenic_Republic", "Guinea": "GIN Guinee", "Guinea-Bissau": "GNB Guine_Bissau",
    "Hungary": "HUN Magyarorszag", "Iceland": "ISL Island", "India": "IND Bharat", "Indonesia": "IDN", "Iran": "IRN Persia", "Iraq": "IRQ", "Ireland": "IRL Eire",
    "Israel": "ISR", "Italy": "ITA Italia Italian_Republic Repubblica_Italiana", "Japan": "JPN Nippon Nihon", "Kenya": "KEN", "Latvia": "LVA Latvija", "Lithuania": "LTU Lietuva", "Luxembourg": "LUX Luxemburg Letzebuerg",
    "Malaysia": "MYS", "Mexico": "MEX United_Mexican_States Estados_Unidos_Mexicanos", "Morocco": "MAR Maroc", "Netherlands": "NLD Holland Nederland The_Netherlands Kingdom_of_the_Netherlands Niederlande Pays_Bas", "New Zealand": "NZL Aotearoa N_Zealand NZ",
    "Niger": "NER", "Nigeria": "NGA", "Norway": "NOR Norge", "Peru": "PER", "Philippines": "PHL Pilipinas Filipinas", "Poland": "POL Polska Rzeczpospolita_Polska",
    "Portugal": "PRT Portuguese_Republic Republica_Portuguesa", "Romania": "ROU Rumania", "Singapore": "SGP Spore Singapura", "Slovakia": "SVK Slovensko Slovak_Republic Slovak_Rep", "Slovenia": "SVN Slovenija",
    "South Africa": "ZAF RSA S_Africa Suid_Afrika Sth_Africa", "South Korea": "KOR ROK S_Korea Republic_of_Korea Rep_of_Korea Korea Hanguk", "Spain": "ESP Espana", "Sweden": "SWE Sverige",
    "Switzerland": "CHE Schweiz Suisse Svizzera Swiss_Confederation Schweizerische_Eidgenossenschaft Helvetia", "Thailand": "THA", "Turkey": "TUR Turkiye", "Ukraine": "UKR Ukraina", "United Arab Emirates": "ARE UAE Emirates",
    "United Kingdom": "GBR UK GB Britain Great_Britain Gt_Britain England Scotland Wales Northern_Ireland United_Kingdom_of_Great_Britain Utd_Kingdom Royaume_Uni Reino_Unido Vereinigtes_Konigreich", "United States": "USA US U_S_of_A US_of_A America United_States_of_America Utd_States Estados_Unidos Etats_Unis Vereinigte_Staaten",
    "Uruguay": "URY", "Vietnam": "VNM Viet_Nam", "": "Papua_New_Guinea Equatorial_Guinea North_Korea Latin_America South_America North_America Central_America South_Sudan New_Mexico New_England",
}


def plain(value: Column) -> Column:
    """Lower case, accents removed."""
    return F.translate(F.translate(F.lower(value), ACCENTS, PLAIN), "ß'’`", "s")


def written_forms(spark: SparkSession, reference: DataFrame, key: str = "region_id", name: str = "name", code: str | None = "code", others: dict[str, str] = FORMS) -> DataFrame:
    """(entry_id, form, n): every written form of the reference entries, `others` by entry name included; forms of up to three characters match only exactly."""
    rows = [(entry, form.replace("_", "")) for entry, forms in others.items() for form in forms.split()]
    extra = spark.createDataFrame(rows, "entry string, form string")
    base = reference.select(F.col(key).cast("int").alias("entry_id"), F.col(name).alias("name"), F.col(code).alias("code") if code else F.lit(None).cast("string").alias("code")).where(F.col("entry_id").isNotNull())
    squeeze = lambda c: F.regexp_replace(plain(c), "[^a-z0-9]+", "")
    own = base.select("entry_id", F.explode(F.array("name", "code")).alias("form"))
    more = extra.join(base.select("entry_id", F.col("name").alias("entry")), "entry").select("entry_id", "form").unionByName(extra.where("entry = ''").select(F.lit(0).alias("entry_id"), "form"))
    forms = own.unionByName(more).select("entry_id", squeeze(F.col("form")).alias("form")).where("form <> ''")
    return forms.groupBy("form").agg(F.min("entry_id").alias("entry_id")).withColumn("n", F.length("form"))


def tolerance(n: Column) -> Column:
    """Edit distance up to which a form of n characters is searched."""
    return F.when(n >= 9, 4).when(n >= 4, 2).otherwise(0)


def spans(values: DataFrame, value: str) -> DataFrame:
    """(v, span, whole, code_ok): runs of up to MAX_SPAN tokens of each distinct value.

    code_ok says whether a short code may be read there: it must be the whole value, a capitalised token of a value that is
    in mixed case or has at most two words, or a run of single letters (``U.K.``).
    """
    raw = F.regexp_extract_all(F.translate(F.col("v"), "'’`", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    d = values.select(F.col(value).alias("v")).where(F.trim(F.col("v")) != "").distinct()
    d = d.select("v", raw.alias("raw")).where(F.size("raw") > 0).withColumn("words", F.size(F.filter("raw", lambda t: ~t.rlike(r"^\d+$"))))
    starts = d.select("v", "raw", "words", F.size("raw").alias("m"), F.posexplode("raw").alias("i", "_t"))
    runs = starts.select("v", "raw", "words", "m", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_SPAN), F.col("m") - F.col("i")))).alias("len"))
    part = F.slice("raw", F.col("i") + 1, F.col("len"))
    runs = runs.select("v", "words", (F.col("len") == F.col("m")).alias("whole"), "len", part.alias("part"))
    whole, one = F.col("whole"), F.col("part")[0]
    code_ok = whole | ((F.col("len") == 1) & one.rlike("^[A-Z]{2,3}$") & ((F.col("v") != F.upper("v")) | (F.col("words") <= 2))) | ((F.col("len") > 1) & F.forall("part", lambda t: F.length(t) == 1))
    return runs.select("v", F.regexp_replace(plain(F.array_join("part", "")), "[^a-z0-9]+", "").alias("span"), "whole", code_ok.alias("code_ok")).where("span <> ''")


def fuzzy_pairs(probes: DataFrame, forms: DataFrame) -> DataFrame:
    """(span, entry_id, n, d) for every span and form within the form's tolerance, found by the pigeonhole join."""
    cut = forms.where("n >= 4").withColumn("k", tolerance(F.col("n")))
    seg = F.transform(
        F.sequence(F.lit(0), F.col("k")),
        lambda i: F.struct(
            i.alias("i"),
            (F.floor(i * F.col("n") / (F.col("k") + 1)) + 1).cast("int").alias("at"),
            (F.floor((i + 1) * F.col("n") / (F.col("k") + 1)) - F.floor(i * F.col("n") / (F.col("k") + 1))).cast("int").alias("len"),
        ),
    )
    segments = cut.select("entry_id", "form", "n", "k", F.explode(seg).alias("s")).select("entry_id", "form", "n", "k", "s.*").withColumn("piece", F.expr("substring(form, at, len)"))
    # shapes: where the segment i of a form of n characters can stand in a string of l characters
    shapes = segments.select("n", "k", "i", "at", "len").distinct().select("*", F.explode(F.sequence(F.col("n") - F.col("k"), F.col("n") + F.col("k"))).alias("l"))
    low = F.greatest(F.col("at") - F.col("i"), F.col("at") + F.col("l") - F.col("n") - (F.col("k") - F.col("i")), F.lit(1))
    high = F.least(F.col("at") + F.col("i"), F.col("at") + F.col("l") - F.col("n") + (F.col("k") - F.col("i")), F.col("l") - F.col("len") + 1)
    shapes = shapes.withColumn("low", low).withColumn("high", high).where("low <= high").select("n", "i", "len", "l", F.explode(F.sequence("low", "high")).alias("pos"))
    tried = probes.join(shapes, F.length("span") == F.col("l")).select("span", "n", "i", F.expr("substring(span, pos, len)").alias("piece"))
    found = tried.join(segments.select("entry_id", "form", "n", "i", "piece", "k"), ["n", "i", "piece"]).select("span", "entry_id", "form", "n", "k").distinct()
    return found.withColumn("d", F.levenshtein("span", "form")).where("d <= k")


def canonical_mapping(values: DataFrame, value: str, forms: DataFrame) -> DataFrame:
    """(value, entry_id, distance): one row per distinct matched value; values that match nothing are absent.

    A string of the same letters with d >= 2 counts as transpositions, one error for two edits. The best form wins: most characters matched less 2.5 per error, then the whole
    value before a part, then the smallest id. Null and blank values are ignored.
    """
    s = spans(values, value)
    probes = s.where(F.length("span") >= 3).select("span").distinct()
    letters = lambda c: F.array_sort(F.split(c, ""))
    fuzzy = fuzzy_pairs(probes, forms).withColumn("e", F.when((F.col("d") >= 2) & (letters(F.col("span")) == letters(F.col("form"))), F.ceil(F.col("d") / 2)).otherwise(F.col("d")))
    fuzzy = fuzzy.where("e <= CASE WHEN n >= 9 THEN 3 WHEN n >= 7 THEN 2 ELSE 1 END").select("span", "entry_id", "n", "e", "d")
    codes = forms.where("n < 4").select(F.col("form").alias("span"), "entry_id", "n", F.lit(0).alias("e"), F.lit(0).alias("d"))
    hits = s.join(fuzzy, "span").where("e = 0 OR whole OR n >= 5").unionByName(s.where("code_ok").join(codes, "span"))
    order = F.struct((F.col("n") - 2.5 * F.col("e")).alias("score"), F.col("whole").cast("int"), (-F.col("entry_id")).alias("tie"))
    best = hits.groupBy("v").agg(F.max_by(F.struct("entry_id", F.col("d").alias("distance")), order).alias("b"))
    return best.select(F.col("v").alias(value), "b.entry_id", "b.distance")


def map_values(df: DataFrame, value: str, forms: DataFrame) -> DataFrame:
    """df with entry_id and distance; entry_id is 0 where a non-blank value means no entry, null where it is null or blank.

    Typed values are reduced to distinct ones before any matching, so a value that fills a third of the rows is matched
    once; the way back is a left join on the value, whose hot partitions adaptive execution splits.
    """
    clean = df.drop("entry_id", "distance")
    mapping = canonical_mapping(clean, value, forms)
    blank = F.col(value).isNull() | (F.trim(F.col(value)) == "")
    return clean.join(mapping, value, "left").withColumn("entry_id", F.when(~blank, F.coalesce("entry_id", F.lit(0)))).select(*clean.columns, "entry_id", "distance")


def unmatched(values: DataFrame, value: str, forms: DataFrame) -> DataFrame:
    """(value, rows): distinct non-blank values that match no entry, by anti-join, with their number of rows."""
    counts = values.where(F.trim(F.col(value)) != "").groupBy(value).agg(F.count("*").alias("rows"))
    return counts.join(canonical_mapping(values, value, forms).where("entry_id > 0"), value, "left_anti")
