import random

from quillspark.llm import ocr as O

SCHEMA = "row_id bigint, source string, page_number int, content string, ocr boolean"
SENTENCES = ["The Operator must keep the packing list for twelve months and produce it on request.", "Charges for temperature logging are invoiced with the storage rate each month.", "A failure of stock rotation does not entitle the Carrier to withhold payment of the handling charge.", "The co-operation of the Depositor is needed for long-term holdings in the blast tunnel."]


def pages():
    rng = random.Random(1)
    rows = [(k, "clean", k, "\n".join(rng.choice(SENTENCES) for _ in range(30)), False) for k in range(1, 31)]
    words = [w.strip(".").lower() for s in SENTENCES for w in s.split()]
    filler = lambda: [" ".join(rng.choice(words) for _ in range(9)) for _ in range(6)]
    for k in range(1, 9):
        body = [
            "Acme contract room   sheet %d" % k,
            *filler(),
            "The Operator must keep the packing list for twelve months and pro-",
            "duce it on request. Charges for ternperature logging are invoiced",
            "with the st0rage rate each month. A fai lure of stock rotation does",
            "not entitle the Carrier to ^ withhold payment of the handling charge.",
            "The co-",
            "operation of the Depositor is needed for long-term holdings.",
            *filler(),
            f"— {k} —",
        ]
        rows.append((100 + k, "scan", k, "\n".join(body), True))
    rows += [(200, "scan", 9, None, True), (201, "scan", 10, "", True), (202, None, None, "x" * 100_000, True), (203, "scan", 8, rows[-1][3], None)]
    return rows


def test_found(spark):
    got = {}
    for r in O.found(spark.createDataFrame(pages(), SCHEMA)).collect():
        got.setdefault(r.row_id, set()).add((r.line_no, r.kind))
    for k in range(101, 109):
        assert got[k] == {(1, "header"), (8, "hyphen"), (9, "glyph"), (10, "glyph"), (11, "glyph"), (20, "page_no")}, (k, got[k])
    assert set(got) <= set(range(101, 109)) | {202}


def test_repair(spark):
    df = spark.createDataFrame([(*p, "kept") for p in pages()], SCHEMA + ", _found string")
    got = {r.row_id: r for r in O.repair(df).collect()}
    assert len(got) == len(pages())
    assert (
        "The Operator must keep the packing list for twelve months and produce it on request. Charges for temperature logging are invoiced with the storage rate each month. "
        "A failure of stock rotation does not entitle the Carrier to withhold payment of the handling charge. The co-operation of the Depositor is needed for long-term holdings."
    ) in got[101].content
    assert "Acme" not in got[101].content and not got[101].content.endswith("\u2014")
    assert got[1].content == pages()[0][3] and got[200].content is None and got[201].content == "" and got[203].content == pages()[-1][3]


def test_without_clean_pages_and_empty(spark):
    scanned = spark.createDataFrame([p for p in pages() if p[4]], SCHEMA)
    assert O.found(scanned).count() >= 0
    assert O.found(scanned.limit(0)).count() == 0 and O.repair(scanned.limit(0)).count() == 0


def test_held_out_noise():
    """Noise put on words of the lexicon is found and undone; names stay."""
    import numpy as np

    known = {w.strip(".").lower(): 50 for s in SENTENCES for w in s.split()}
    editor = O.Editor(known, O.train(known, O.OcrConfig()), O.OcrConfig())
    rng = np.random.default_rng(9)
    noisy = [(w, O._noise(w, rng)) for w in sorted(known) if len(w) > 4 and w.isalpha() for _ in range(6)]
    noisy = [(w, n) for w, n in noisy if n.lower() not in known]
    assert sum(editor.word(n) == w for w, n in noisy) / len(noisy) > 0.9
    assert not any(editor.word(n) for n in ("Quenridge", "Ostovic", "Zabmarrick", "Fenansah", "K549/25", "INV-2025-25395", "a@b.example"))


def rare_pages(repeat):
    """A file's own words, met three times each, beside clean pages that grow in number."""
    body = ["Nadramivar keeps the kofogustel.", "The kofogustel of Nadramivar is in the quellbarrow.", "A quellbarrow holds the kofogustel, by Nadramivar.", "No quellbarrow is known to break a packing-quellbarrow."]
    scan = ["Kof0gustel and NADRAM|VAR are here.", "The operator must keep the quell barrow and the kofo-", "gustel on request. A quellbarow is with the packing-quel1barrow."]
    rows = [(k, "clean", k, "\n".join(SENTENCES * 10), False) for k in range(1, repeat + 1)]
    return [*rows, (5000, "own", 1, "\n".join(body), False), (6000, "own", 2, "\n".join(scan), True), (6001, "own", 3, "\n".join(scan), True)]


def test_known_words_do_not_depend_on_the_size_of_the_corpus(spark):
    got = []
    for repeat in (20, 2000):
        df = spark.createDataFrame(rare_pages(repeat), SCHEMA)
        got.append({(r.row_id, r.line_no, r.kind) for r in O.found(df).collect()})
        assert "Kofogustel and NADRAMIVAR are here. The operator must keep the quellbarrow and the kofogustel on request. A quellbarrow is with the packing-quellbarrow." == {r.row_id: r.content for r in O.repair(df).collect()}[6000]
    assert got[0] == got[1] == {(k, *f) for k in (6000, 6001) for f in ((1, "glyph"), (2, "glyph"), (2, "hyphen"), (3, "glyph"))}


def test_words_that_are_not_held_come_by_a_join(spark):
    for rows in (rare_pages(20), pages()):
        df = spark.createDataFrame(rows, SCHEMA)
        whole = sorted(O.inspect(df).collect())
        for held in (0, 12):
            assert sorted(O.inspect(df, cfg=O.OcrConfig(held_words=held)).collect()) == whole


def test_bound_of_held_words(spark):
    words = spark.createDataFrame([(f"w{k}", 3 + 10_000 // (k + 1)) for k in range(5000)], "a string, n bigint")
    assert len(O.most_frequent(words, 5000, 5000)) == 5000
    some = O.most_frequent(words, 5000, 100)
    assert 0 < len(some) <= 100 and "w0" in some


def test_hyphen_of_a_compound_at_a_line_end_is_no_letter():
    known = {w.strip(".").lower(): 50 for s in SENTENCES for w in s.split()} | {"con": 3, "coat": 3}
    editor = O.Editor(known, O.train(known, O.OcrConfig()), O.OcrConfig())
    assert editor.page("The co-\noperation of the Depositor is needed.", 1)[1] == "The co-operation of the Depositor is needed."
    editor.score = lambda features: 1.0 if "edit" in features else -1.0
    assert editor.page("The co-\noperation of the Depositor.", 1)[1].startswith("The co-operation")


def test_page_numbers_with_misread_digits():
    editor = O.Editor({"text": 50}, {}, O.OcrConfig())
    for line, number in (("l4", 14), ("[l7]", 17), ("- l9 -", 19), ("[lO]", 10), ("|5", 15), ("2S", 25), ("— B —", 8), ("I3", None)):
        for page in (f"{line}\ntext", f"text\n{line}"):
            assert [k for _, k in editor.page(page, number)[0]] == ["page_no"] and editor.page(page, number)[1] == "text", (line, number)
    for line, number in (("l4", 15), ("SO", 7), ("BIG", None), ("SO", None), ("l4 text", 14), ("l4", 140)):
        assert "page_no" not in {k for _, k in editor.page(f"text\n{line}", number)[0]}, (line, number)


def test_names_that_no_lexicon_has():
    """Marks and digits inside made-up names are read as letters by their neighbours alone; codes stay."""
    import numpy as np

    words = "storage rate goods frozen pallet temperature agreement supplier customer notice month invoice charge delivery schedule recorded inspection between liability insurance premises warehouse carrier depositor".split()
    known = dict.fromkeys(words, 10)
    editor = O.Editor(known, O.train(known, O.OcrConfig()), O.OcrConfig(), 10, O.trigrams(known))
    rng = np.random.default_rng(3)
    syllables = [a + b for a in "b d f g k l m n p r s t v z br tr".split() for b in "a e i o u al on ir".split()]
    found = exact = tried = 0
    for _ in range(500):
        name = "".join(syllables[rng.integers(0, len(syllables))] for _ in range(4)).capitalize()
        places = [(i, bad) for i in range(1, len(name)) for bad, goods in O._READINGS.items() if name[i] in goods]
        if places:
            i, bad = places[rng.integers(0, len(places))]
            got = editor.word(name[:i] + bad + name[i + 1 :])
            tried, found, exact = tried + 1, found + (got is not None), exact + (got == name)
    print("found", found / tried, "restored", exact / tried)
    assert found >= 0.85 * tried and exact >= 0.65 * tried  # 1 and | may be l as well as i
    assert sum(editor.word(O._code(rng)) is None for _ in range(500)) >= 0.95 * 500
    assert editor.word("x" * 60 + "|" + "y" * 60) is not None  # however long


def test_banded_distance():
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
    for a, b in [(word(), word()) for _ in range(500)]:
        assert O._near(a, b) == min(4, plain(a, b)), (a, b)
    assert O._same("header" * 500 + "x", "header" * 500) and not O._same("header" * 500, "footer" * 500)


def test_a_cut_word_is_found_whatever_the_line():
    assert O._CUT.search(O._last_words("a " * 5000 + "under-"))[1] == "under" and O._last_words("one") == "one"
    assert O._CUT.search(O._last_words("x" * 3000 + " -  "))[1] == "x" * 3000
