import random

from pyspark.sql import functions as F

from quillspark.llm import canonical as C

REFERENCE = [(1, "Australia", "AU"), (2, "Austria", "AT"), (3, "Canada", "CA"), (4, "Guinea", "GN"), (5, "Guinea-Bissau", "GW"), (6, "Niger", "NE"), (7, "Nigeria", "NG"), (8, "United Kingdom", "GB"), (9, "Peru", "PE"), (10, "India", "IN"), (11, "Poland", "PL")]
CASES = {"AUSTRALIA": 1, "Austrlia": 1, "Asutralia.": 1, "Autsria": 2, "registered in Cansda": 3, "CAN": 3, "can / tbc": 0, "CAN / TBC": 3, "Guinea Bissau": 5, "Giunea-iBssau": 5, "Guinea": 4, "niger": 6, "Nigera": 7, "UnitedK ingodm": 8, "U.K.": 8, "Great Britain": 8, "as PER schedule 2": 9, "AS PER SCHEDULE 2": 0, "Zembrule": 0, "EMEA": 0, "??": 0, "3004": 0, "Poland 3178": 11, "Polska": 11, "Pólánd": 11, "the State of Norhaven, Po1and": 11, "Papua New Guinea": 0}


def forms(spark):
    return C.written_forms(spark, spark.createDataFrame(REFERENCE, "region_id int, name string, code string"))


def test_cases(spark):
    rows = [(i, v) for i, v in enumerate(CASES)] + [(900, None), (901, ""), (902, "   "), (903, "x" * 5000), (904, "Poland " * 300)]
    df = spark.createDataFrame(rows, "intake_id bigint, region string")
    got = {r.region: r.entry_id for r in C.map_values(df, "region", forms(spark)).collect()}
    assert {v: got[v] for v in CASES if v != "can / tbc"} == {v: e for v, e in CASES.items() if v != "can / tbc"}
    assert got[None] is None and got[""] is None and got["   "] is None and got["x" * 5000] == 0 and got["Poland " * 300] == 11


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_pigeonhole_finds_every_pair(spark):
    rng = random.Random(3)
    entries = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 14))) for _ in range(30)]
    probes = set(entries)
    for e in entries:
        for _ in range(12):
            s = list(e)
            for _ in range(rng.randint(1, 5)):
                k = rng.randrange(len(s) + 1)
                op = rng.randrange(3)
                s[k : k + (op != 0)] = [] if op == 1 else [rng.choice("abcde")]
            probes.add("".join(s) or "a")
    f = spark.createDataFrame([(i, e, len(e)) for i, e in enumerate(dict.fromkeys(entries))], "entry_id int, form string, n int")
    got = {(r.span, r.form) for r in C.fuzzy_pairs(spark.createDataFrame([(p,) for p in probes], "span string"), f).collect()}
    limit = lambda e: 4 if len(e) >= 9 else 2
    assert got == {(p, e) for p in probes for e in entries if levenshtein(p, e) <= limit(e)}


def test_clashing_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([("Polnad", 5, 6.0), ("Polnad", 5, 6.0)], "region string, entry_id int, distance double")
    assert [(r.region, r.entry_id) for r in C.map_values(df, "region", forms(spark)).collect()] == [("Polnad", 11)] * 2
    assert C.map_values(df.limit(0), "region", forms(spark)).count() == 0
    report = C.unmatched(spark.createDataFrame([("Nowhere",), ("Nowhere",), ("Peru",), (None,)], "region string"), "region", forms(spark)).collect()
    assert [(r.region, r.rows) for r in report] == [("Nowhere", 2)]
    assert C.map_values(df, "region", forms(spark).where(F.lit(False))).first().entry_id == 0
