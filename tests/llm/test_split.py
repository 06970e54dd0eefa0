import random
import re

from pyspark.sql import functions as F

from quillspark.llm import split as S

WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
WORD = re.compile(f"[^{WHITE}]{{1,200}}[{WHITE}]*")  # a longer run counts as several
PLAIN = re.compile(f"[^{WHITE}]+")
SCHEMA = "chunk_id bigint, content string"


def n_words(text):
    return len(WORD.findall(text))


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))
    out = ["", "  \n ", "one", "w " * 400, "w " * 401, " lead " + "x\xa0" * 900, "　".join(word() for _ in range(1300)), "y" * 100_000, "\n".join(f"{k}.1 Clause title\n" + " ".join(word() for _ in range(90)) for k in range(30)), "; ".join(" ".join(word() for _ in range(12)) for _ in range(200))]
    for _ in range(25):
        out.append("".join(word() + rng.choice([" ", " ", " ", "\n", ". ", "; ", "\n\n", "\t", "\n(a) ", "\n1.2 "]) for _ in range(rng.randint(350, 2500))))
    return out


def test_pieces_are_a_cover(spark):
    all_texts = texts()
    df = spark.createDataFrame(list(enumerate(all_texts)), SCHEMA)
    got = {}
    for r in S.split_pieces(df).orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == set(range(len(all_texts)))
    for k, text in enumerate(all_texts):
        pieces = got[k]
        assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1)) and {p.n_pieces for p in pieces} == {len(pieces)}
        assert (len(pieces) > 1) == (n_words(text) > 400)
        whole = pieces[0].piece
        for before, p in zip(pieces, pieces[1:]):
            units = WORD.findall(p.piece)
            shared = "".join(units[: p.overlap_words])
            assert p.overlap_words == min(50, p.start_word + p.overlap_words) == 50 and before.piece.endswith(shared)
            whole += p.piece[len(shared) :]
        assert whole == text
        for p in pieces:
            assert n_words(p.piece) <= 400 and p.n_words == n_words(p.piece)
    assert {r.chunk_id for r in S.oversized(df, "chunk_id").collect()} == {k for k, t in enumerate(all_texts) if len(PLAIN.findall(t)) > 400}


def test_a_run_without_blanks_is_cut_by_characters(spark):
    text = "head of the text " * 30 + "字" * 150_000 + " tail"
    pieces = S.split_pieces(spark.createDataFrame([(1, text)], SCHEMA)).orderBy("piece_no").collect()
    assert len(pieces) > 2 and max(len(p.piece) for p in pieces) <= 400 * 201
    whole = pieces[0].piece + "".join("".join(WORD.findall(p.piece)[p.overlap_words :]) for p in pieces[1:])
    assert whole == text and S.oversized(spark.createDataFrame([(1, text)], SCHEMA), "chunk_id").count() == 0


def test_cuts_at_boundaries(spark):
    text = "\n".join(f"{k}.1 Title of clause\n" + "\n".join("word " * 20 for _ in range(8)) for k in range(1, 8))
    pieces = S.split_pieces(spark.createDataFrame([(1, text)], SCHEMA)).orderBy("piece_no").collect()
    for p in pieces[1:]:
        new = "".join(WORD.findall(p.piece)[p.overlap_words :])
        assert re.match(r"\d\.1 Title", new)
    sentence = "This is one sentence of nine words right here. " * 120
    pieces = S.split_pieces(spark.createDataFrame([(1, sentence)], SCHEMA)).orderBy("piece_no").collect()
    assert all(p.piece.rstrip().endswith(".") for p in pieces)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 7, "x"), (2, "", 8, "y"), (3, "w " * 500, None, None), (3, "w " * 500, None, None)], "chunk_id bigint, content string, piece_no int, _all string")
    rows = S.split_pieces(df).collect()
    assert sorted((r.chunk_id, r.piece_no) for r in rows) == [(2, 1), (3, 1), (3, 1), (3, 2), (3, 2)]
    assert S.split_pieces(spark.createDataFrame([], SCHEMA)).count() == 0
    small = S.split_pieces(spark.createDataFrame([(1, "a b c d e f g")], SCHEMA), S.SplitConfig(max_words=3, overlap_words=1)).where(F.col("n_words") > 3)
    assert small.count() == 0
