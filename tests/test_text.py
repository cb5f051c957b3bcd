from pyspark.sql import functions as F

from statloom.functions import text as T


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column).collect()]


def test_tokenisers(spark):
    text = "  법률의　Data? 개인정보에서의 A.b, 나는 나는!! "
    assert one(spark, T.words("x"), text, "", None) == [["법률의", "data?", "개인정보에서의", "a.b,", "나는", "나는!!"], [], None]
    assert one(spark, T.query_terms("x"), text) == [["법률", "data", "개인정보", "a.b", "나는", "나는"]]
    assert one(spark, T.query_terms("x"), "?!. 서울로부터 법은") == [["서울", "법은"]]
    assert one(spark, T.letter_runs("x"), "A1-나.다_b") == [["a1", "나", "다", "b"]]
    assert one(spark, T.claim_terms("x"), '(A) "b": c; d?e') == [["a", "b", "c", "d", "e"]]
    assert one(spark, T.claims("x"), "하나. 둘!\n\n 셋 ?") == [["하나", "둘", "셋"]]


def test_trim_and_lines(spark):
    assert one(spark, T.non_empty("x"), " \t a \n", "　") == ["a", None]
    assert one(spark, T.first_line("x"), "\n \n 첫 줄 \n둘", "", None) == ["첫 줄", "", ""]
    assert one(spark, T.statute_prefix("x"), "011357:28-4", "case") == ["011357", "case"]


def test_numbers(spark):
    assert one(spark, T.leading_number(F.col("x")), "0012abc", "x1", "7") == ["12", "x1", "7"]
    assert one(spark, T.padded_digits(F.col("x"), 4), "12345", "7", "제2조") == ["2345", "0007", "0002"]


def test_citations(spark):
    text = "「소수력 정보처리법 제3조(목적)」와 **제15조의2**, 제15조의2 및 제3-2조"
    assert one(spark, T.citations("x"), text, "없음", "") == [["소수력 정보처리법 제3조(목적)", "제15조의2", "제3-2조"], [], []]
    for pieces, whole in zip(one(spark, T.citation_segments("x"), text, "제1조", "없음", ""), (text, "제1조", "없음", ""), strict=True):
        assert "".join(p["text"] for p in pieces) == whole
        assert all(p["is_citation"] == (p["text"].find("제") >= 0) for p in pieces)
