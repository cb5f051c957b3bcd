import pytest

from statloom.llm.truncation import MEASURES, cuts_by_step, ending, readings, storage_limits, truncated, truncation_by_source

WHOLE = [
    "이 법은 국민이 정한다.", "정한다", "정한다 \n\n", "1. 관리번호\n2. 그 밖의 사항", "가. 작은 것", "제12장 폐기절차", "제3조(목적)", "구분 | 비고\n가 | 3일 | -", "정한다.\n<개정 2029. 5. 22.>", "정한다.\n(이하 여백)",
    "정한다.\n붙임: 동의서 1부. 끝.", "정한다.\n근거: 가상법 제3조", "정한다.\n👍", "확인할 수 있나요?", "The fee is due.", "The fee is due.\n[This Article newly inserted]", "Annex 7", "Article 3 (Purpose)",
    "  a. the fee\n  b. other matters", "【주문】\n1. 소송비용은 각자 부담한다.", "정한다.\n재판장 A  판사 B  판사 C", "정한다.\n이상", "", "  \n", "정한다...", "정한다.​­",
]
CUT = [
    "이 법은 국민이 정", "이 법은 국민이 ", "이 법은 국민이…", "이 법은 국민이...  ", "이 법은 국�", "정한다. 그 ", "The fee shall be", "The fee is due. No per", "이용자에게 알린 다", "최고심판원 2029. 5.", "【이유】\n1. 원고의",
    "제58조(보관) 무", "① 신청인은", "이 조에서 양식(樣式)", "정한다. 피고가 예산내역을​\n",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole_endings(text):
    assert ending(text) == "whole"


@pytest.mark.parametrize("text", CUT)
def test_cut_endings(text):
    assert ending(text) == "inside"


def test_unclear_endings():
    assert ending("정한다.\n붙임: 동의서 (2029") == "unclear"


def test_measures():
    text = "가\r\nb<\n😀"
    got = {name: measure(text) for name, measure in MEASURES.items()}
    assert got == {
        "code_points": 7, "utf16_units": 8, "utf8_bytes": 12, "cp949_bytes": 8, "entity_escaped": 10, "json_escaped": 10, "json_ascii": 26, "crlf_code_points": 8, "lf_code_points": 6, "crlf_utf8_bytes": 13,
    }


def test_limits_expose_unclear_cuts(spark):
    sentence = "이 법은 모든 국민이 지켜야 할 사항을 정한다. "
    cut = lambda n, i: (("가" * i + sentence * 20)[:n].rstrip() + "가" * n)[:n]
    rows = [(i, cut(100, i), "narrow") for i in range(30)]
    rows += [(100 + i, sentence * (i % 9 + 1), "narrow") for i in range(60)]
    rows += [(200, "정한다.\n붙임: " + "나" * 88 + "(20", "narrow"), (201, "정한다.\n붙임: " + "나" * 17 + "(20", "narrow"), (202, "정한다.\n붙임: " + "나" * 88 + "(20", None)]
    rows += [(300, None, "narrow"), (301, " ", "narrow"), (302, "그 밖의", None), (302, "그 밖의", None)]
    inside = [i for i, text, _ in rows[:30] if ending(text) == "inside"]
    assert len(rows[90][1]) == 100 and len(inside) > 20
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, source string, ending string")
    read = readings(df, "id", "source", "text")
    limits = {(r.measure, r.storage_limit) for r in storage_limits(read).collect()}
    assert ("code_points", 100) in limits and not any(r.source is None for r in storage_limits(read).collect())
    assert sorted(r.key for r in truncated(read).collect()) == [*inside, 200, 302]
    steps = {(r.source, r.step): r.n for r in cuts_by_step(read).collect()}
    assert steps["narrow", "limit"] == len(inside) + 1 and steps[None, "transfer"] == 1
    shares = {r.source: (r.n_texts, r.n_cut) for r in truncation_by_source(read).collect()}
    assert shares == {"narrow": (92, len(inside) + 1), None: (3, 1)}
    empty = readings(df.limit(0), "id", "source", "text")
    assert truncated(empty).count() == truncation_by_source(empty).count() == 0


def test_lines_show_how_their_kind_ends(spark):
    sentence = "이 법은 모든 국민이 지켜야 할 사항을 정한다."
    rows = [(i, f"{sentence}\n[표 {i}] 관리번호의 수량") for i in range(40)]  # no form knows this kind of heading
    rows += [(100 + i, f"【이유】\n1. {sentence}\n2. {sentence}") for i in range(40)]
    rows += [(200 + i, f"{sentence}\n1. 관리번호\n2. 동의서\n3. 그 밖의 사항") for i in range(40)]
    rows += [(300, f"【이유】\n1. {sentence}\n2. 이 법은 모든"), (301, f"{sentence}\n1. 관리번호\n2. 이 법은 모든"), (302, f"{sentence}\n이 법은 모든")]
    read = readings(spark.createDataFrame(rows, "id long, text string").selectExpr("*", "'x' AS source"), "id", "source", "text")
    assert sorted(r.key for r in truncated(read).collect()) == [300, 302]


def test_whole_and_cut_texts_at_one_length(spark):
    """A heap of whole texts is no limit; at a limit a word that may end a sentence does not excuse a text."""
    words = "The board shall keep every record of the fee"
    cut = [(i, (words + " and no person shall remove a record without notice")[: 60]) for i in range(20)]
    whole = [(100 + i, "The board keeps the record of each fee it collected in full.") for i in range(20)]
    rows = [(*r, "a") for r in cut] + [(*r, "b") for r in whole] + [(200 + i, f"The board keeps fee {i} in full. " * (i + 1), s) for i in range(90) for s in "ab"]
    read = readings(spark.createDataFrame(rows, "id long, text string, source string"), "id", "source", "text")
    assert {r.source for r in storage_limits(read).collect()} == {"a"}
    assert sorted(r.key for r in truncated(read).collect()) == [*range(20)]
