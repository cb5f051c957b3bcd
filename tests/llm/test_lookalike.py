import random
import unicodedata

import pytest

from statloom.llm.lookalike import one_form, same_looking, same_looking_pairs, settle


@pytest.mark.parametrize(
    ("stored", "plain"),
    [
        ("ＡＢＣ　１２３（가）", "ABC 123(가)"), (unicodedata.normalize("NFD", "법률 é"), "법률 é"), ("법​률­﻿⁠", "법률"), ("a b c d\te", "a b c d e"),
        ("РСВ-9 АСЕР", "PCB-9 ACEP"), ("ΡΗΕΧ", "PHEX"), ("Ствåvik"[:0] + "Ståvіk", "Ståvik"), ("а́", "á"), ("시·도‧군・읍", "시·도·군·읍"), ("시ㆍ도", "시·도"),
        ("AI‐K2 ‑ −", "AI-K2 - -"), ("女性 理", "女性 理"), ("a\r\nb c", "a\nb\nc"), ("ﾊﾝｸﾞﾙ"[:0] + "ￜ", "ㅣ"), ("⼀", "一"),
    ],
)
def test_same_looks(stored, plain):
    assert one_form(stored) == one_form(plain)


@pytest.mark.parametrize("pair", [("a", "A"), ("e", "é"), ("1", "①"), ("9", "⁹"), ("m2", "㎡"), ("(a)", "[a]"), ("a b", "a  b"), ("a.", "a"), ("등록", "등 록"), ("한다.", "한다"), ("-", "—"), ("", " "), ("叱", "𠮟")])
def test_other_looks(pair):
    assert one_form(pair[0]) != one_form(pair[1])


def test_tokens_are_spelled_in_one_script():
    assert settle("СССР") == "CCCP"  # a whole-script confusable
    assert settle("Рaypal") == "Paypal"  # mixed, consistent in Latin
    assert settle("жа") == "жа" == settle("жa")  # consistent in Cyrillic only
    assert settle("жβа") == settle("жβa")  # no script holds all letters
    assert one_form("Vérani 협약의 PCB-9를") == "Vérani 협약의 PCB-9를"


def test_one_form_is_stable():
    rng = random.Random(6)
    letters = "aAеΕ가각ㆍ·-‐é" + "é​ 　Ｗ１①㎡女\r\nж가ᆞ"
    for _ in range(5_000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 12)))
        once = one_form(text)
        assert one_form(once) == once
        assert one_form(unicodedata.normalize("NFD", text)) == once


def brute(rows):
    rows = set(rows)
    look = lambda r: tuple(x if x is None else one_form(x) for x in r[1:])
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if None not in (a[0], b[0]) and a[0] != b[0] and look(a) == look(b) and a[1:] != b[1:]}


def test_pairs_against_brute_force(spark):
    rng = random.Random(7)
    titles, contents = ["가 나", "가 나", "가나", None, ""], ["A", "Α", "a", "Ａ", None, ""]
    rows = [(f"d{rng.randint(0, 40)}", rng.choice(titles), rng.choice(contents)) for _ in range(80)] + [(None, "가 나", "A")]
    rows += [(f"hot{i}", "똑같은", "글") for i in range(60)]  # copies with one stored form give no pairs
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, title string, content string, look string")
    got = [tuple(r) for r in same_looking_pairs(df, "id", ["title", "content"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert same_looking_pairs(df.limit(0), "id", ["title", "content"]).count() == 0


def test_looks_have_one_representative(spark):
    rows = [("b", "ＡＢ", None), ("a", "AB", None), ("a", "AB", None), ("c", "АВ", None), ("d", "AB", ""), ("e", None, None), (None, None, None), (None, "Z", "z")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, title string, content string, look string")
    got = sorted((tuple(r) for r in same_looking(df, "id", ["title", "content"]).collect()), key=str)
    assert got == sorted([("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 1), ("e", "e", 1), (None, "e", 1), (None, None, 1)], key=str)
    assert same_looking(df.limit(0), "id", ["title", "content"]).count() == 0


def test_cherokee_coptic_and_rarer_cyrillic_letters():
    for text, plain in (("ᎪᏚᏒ", "AᏚᏒ"), ("Ꭺct", "Act"), ("ⲟrder", "order"), ("Ѵalue", "Value"), ("ӏaw", "law")):
        assert one_form(text) == one_form(plain)
    assert one_form("ᏣᎳᎩ") == "ᏣᎳᎩ"
