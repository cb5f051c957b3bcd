import random

import pytest
from pyspark.sql import functions as F

from statloom.llm.splitting import boundaries, pieces_of, split_oversized, split_text


def test_boundaries_have_strengths():
    text = "제1조(목적) 이 법은, 그렇다. 다음\n① 첫째\n1. 하나\n가. 작은\n그 밖\n\n제2조(정의) 2029. 5. 6. 시행"
    found = {text[at : at + 3]: strength for at, strength in boundaries(text)}
    assert (found["이 법"], found["그렇다"], found["다음\n"], found["① 첫"], found["1. "], found["가. "], found["그 밖"], found["제2조"], found["5. "]) == (1, 2, 3, 7, 6, 5, 4, 9, 1)


def test_pieces_cover_the_text_within_the_limit():
    rng = random.Random(1)
    parts = ["가나다", "a ", ". ", "\n", "\n\n① ", "é", "각", "🙂", "abc" * 40, "\r\n", " ", " "]
    for _ in range(200):
        text = "".join(rng.choices(parts, k=rng.randint(0, 400)))
        for limit, overlap in ((1000, 100), (60, 10), (7, 3), (2, 1), (1, 0)):
            pieces = split_text(text, limit, overlap)
            assert "".join(text[s:e] for s, e in pieces) == text
            assert all(0 < e - max(0, s - overlap) <= limit for s, e in pieces)
            assert len(text) > limit or len(pieces) == (1 if text else 0)


def test_cuts_follow_the_strongest_boundaries():
    paragraph = lambda n: f"{'①②③④'[n]} " + "가나다라 마바사. " * 30
    text = "\n".join(paragraph(n) for n in range(4))
    pieces = split_text(text, 1000, 100)
    assert all(s == 0 or text[s] in "①②③④" for s, _ in pieces) and len(pieces) == 2
    word = "나" * 2500
    assert split_text(word, 1000, 100) == [(0, 900), (900, 1800), (1800, 2500)]
    marks = ("e" + "́" * 4) * 400
    assert all(s % 5 == 0 for s, _ in split_text(marks, 1000, 100))


def test_columns(spark):
    long = "법률 조문. " * 300
    df = spark.createDataFrame([(1, long, 0), (1, long, 0), (2, "가" * 1000, 0), (3, "가" * 1001, 0), (4, None, 0), (5, "", 0)], "id int, text string, pieces int")
    got = split_oversized(df.select("id", "text"), "text", 1000, 100).select("id", F.inline("pieces")).collect()
    assert {r.id for r in got} == {1, 3} and sum(r.id == 1 and r.piece_no == 0 for r in got) == 2
    one = sorted({(r.piece_no, r.start, r.stop, r.piece) for r in got if r.id == 1})
    assert all(len(p) <= 1000 for *_, p in one)
    assert all(after[3][:100] == before[3][-100:] for before, after in zip(one, one[1:], strict=False))
    short = {r.id: r.p for r in df.select("id", pieces_of("text", 1000, 100).alias("p")).collect()}
    assert len(short[2]) == 1 and short[4] == short[5] == []
    with pytest.raises(ValueError):
        pieces_of("text", 10, 10)


def test_a_very_long_text():
    text = "가나다라. " * 100_000
    pieces = split_text(text, 1000, 100)
    assert pieces[-1][1] == len(text) and 600 <= len(pieces) <= 1500


def test_marks_without_blanks_are_boundaries():
    text = "이의신청서15,600|수수료3.5|한다.다음은,또한1,000과3.4;끝。이상"
    found = {text[:at][-4:]: s for at, s in boundaries(text)}
    assert found == {"600|": 2, "3.5|": 2, "|한다.": 3, "다음은,": 2, "3.4;": 2, "4;끝。": 3}
    table = "|".join(f"이의신청서{n},600" for n in range(400))
    pieces = split_text(table, 1000, 100)
    assert "".join(table[s:e] for s, e in pieces) == table and all(s == 0 or table[s - 1] == "|" for s, _ in pieces)
