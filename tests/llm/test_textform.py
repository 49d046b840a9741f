import unicodedata

import pytest

from editrail.llm.textform import canonical, look_alike_classes, look_alike_pairs, text_hashes, with_canonical

SAME = [
    ("re‑equipped", "re-equipped"),
    ("Јune", "June"),
    ("ａｌｐｉｎｅ，", "alpine,"),
    ("oﬃce ﬁeld", "office field"),
    ("Title Ⅲ", "Title III"),
    ("a​b﻿c­", "abc"),
    ("a  b\t c ", "a b c"),
    ("é", "é"),
    ("а́", "á"),
    ("ё", "ë"),
    ("№ ５", "No 5"),
]
DIFFERENT = [("A", "a"), ("é", "e"), ("m²", "m2"), ("a—b", "a-b"), ("a–b", "a-b"), ("“a”", '"a"'), ("½", "1/2"), ("β", "ß"), ("…", "..."), ("™", "TM")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert canonical(a) == canonical(b) == b.strip()


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_visible_differences_stay(a, b):
    assert canonical(a) != canonical(b)


def test_idempotent_over_unicode():
    for code in list(range(0x20, 0x3000, 7)) + list(range(0xFB00, 0xFFFF, 5)):
        if not 0xD800 <= code < 0xE000:
            once = canonical(f"x{chr(code)}y")
            assert canonical(once) == once and unicodedata.is_normalized("NFC", once)


def test_case_fold_and_null():
    assert canonical("STRASSE", True) == canonical("straße", True)
    assert canonical(None) is None and canonical(" 　​") == ""


def test_columns_agree_with_function(spark):
    texts = [None, "", "  ", "plain\t text\n", "Тhе end", "a\x07b", "é", "é", "x" * 200_000 + "​", "abc", "abc\u2028", "abc\u0085", "abc\u2029", "abc\n", "\u2028abc"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "id long, text string, canonical_ string")
    got = {r["id"]: r["canonical"] for r in with_canonical(df, "text").collect()}
    assert got == {i: canonical(t) for i, t in enumerate(texts)}


def test_pairs(spark):
    rows = [(1, "p", "June"), (2, "p", "Јune"), (3, "p", "June"), (4, "q", "Јunе"), (5, "p", None), (6, "p", " "), (7, "p", "june"), (2, "p", "Јune")]
    df = spark.createDataFrame(rows, "id long, scope string, text string").selectExpr("*", "0 AS c1_", "'x' AS canonical_")
    pairs = lambda scope: sorted(map(tuple, look_alike_pairs(text_hashes(df, ["id", "scope"]), scope).collect()))
    assert pairs(["scope"]) == [(1, 2), (2, 3)]
    assert pairs([]) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert look_alike_pairs(text_hashes(df.where("false"), ["id"]), []).count() == 0


def test_line_ends_of_every_kind_are_white_space(spark):
    df = spark.createDataFrame([(i, f"abc{end}") for i, end in enumerate(("", "\u2028", "\u0085", "\u2029", "\n", "\x1c"))], "id long, text string")
    assert {r["canonical"] for r in with_canonical(df, "text").collect()} == {"abc"}
    assert look_alike_pairs(text_hashes(df, ["id"]), []).count() == 15


def test_classes_have_a_row_to_a_row(spark, monkeypatch):
    from editrail.llm import textform

    monkeypatch.setattr(textform, "BLOCK_ROWS", 7)
    rows = [(i, "June" if i % 2 else "Јune") for i in range(60)] + [(100, "alone"), (101, "alone")]
    df = spark.createDataFrame(rows, "id long, text string")
    hashes = text_hashes(df, ["id"])
    classes = {r["id"]: (r["class_id"], r["form_id"]) for r in look_alike_classes(hashes, []).collect()}
    assert classes == {i: (0, i % 2) for i in range(60)}
    pairs = sorted(map(tuple, look_alike_pairs(hashes, []).collect()))
    assert pairs == sorted((a, b) for a in range(60) for b in range(60) if a < b and (a + b) % 2)
