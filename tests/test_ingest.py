import json

from pyspark.sql import functions as F

from statloom.operators import ingest, store
from statloom.sources import documents as sources

DETAIL = {
    "법령": {
        "기본정보": {"법령ID": "law-1", "법령명_한글": "가상법", "공포일자": "20200101", "시행일자": {"content": 20200201}},
        "조문": {
            "조문단위": [
                {"조문번호": "29", "조문내용": "제4장 안전"},
                {"조문번호": "29", "조문제목": "안전조치", "조문내용": "제29조(안전조치)", "항": {"항내용": "① 첫째", "호": [{"호내용": "1. 하나", "목": [{"목내용": "가. 작은"}]}, {"호내용": "2. 둘"}]}},
                {"조문번호": 15, "조문가지번호": "2", "조문내용": "제15조의2 본문\r\n둘째 줄"},
                {"조문번호": "3", "조문내용": "  "},
                {"조문내용": "번호 없음"},
            ]
        },
    }
}


def test_articles(spark):
    df = spark.createDataFrame([("r", json.dumps(DETAIL, ensure_ascii=False)), ("r", json.dumps(DETAIL, ensure_ascii=False)), ("bad", "{"), ("none", None)], "id string, payload string")
    got = {r.document_id: r for r in ingest.statute_articles(df, "id", "payload").collect()}
    assert set(got) == {"law-1:29", "law-1:15-2"}
    article = got["law-1:29"]
    assert article.title == "가상법 제29조(안전조치)" and article.jo == "002900"
    assert article.text == (
        "법령명: 가상법\n조문: 제29조\n조문 제목: 안전조치\n공포일자: 20200101\n시행일자: 20200201\n\n제29조(안전조치)\n① 첫째\n1. 하나\n가. 작은\n2. 둘"
    )
    assert got["law-1:15-2"].text.endswith("제15조의2 본문\n둘째 줄") and got["law-1:15-2"].jo == "001502"


def test_heading_rules(spark):
    only = {"기본정보": {"법령ID": "l"}, "조문": [{"조문번호": "1", "조문내용": "제1장 총칙"}, {"조문번호": "2", "조문내용": "제2장 a"}]}
    df = spark.createDataFrame([("r", json.dumps(only, ensure_ascii=False))], "id string, payload string")
    assert ingest.statute_articles(df, "id", "payload").count() == 0
    assert ingest.statute_articles(df, "id", "payload", strict_headings=True).count() == 2


def test_search_documents(spark):
    items = [{"법령ID": " 7 ", "법령명한글": "가", "공포일자": ""}, {"법령일련번호": 8, "소관부처명": "나"}, {}]
    df = spark.createDataFrame([("r", json.dumps({"LawSearch": {"law": items}}), "src")], "id string, payload string, source_id string")
    got = {tuple(r) for r in ingest.search_documents(df, "id", "payload", "source_id").select("position", "document_id", "title", "text").collect()}
    assert got == {(0, " 7 ", "가", "가"), (1, "8", "", "나"), (2, "src", "", "")}  # values as they are


def test_upsert_keeps_creation_and_takes_the_latest(spark):
    schema = "k string, title string, created int, updated int"
    target = spark.createDataFrame([("a", "old", 1, 1), ("b", "stays", 1, 1)], schema)
    updates = spark.createDataFrame([("a", "new", 9, 2), ("a", "older", 8, 1), ("a", "new", 9, 2), ("c", None, 7, None), (None, "x", 1, 1)], schema)
    got = {tuple(r) for r in store.upsert(target, updates, "k", ["created"], ["updated"]).collect()}
    assert got == {("a", "new", 1, 2), ("b", "stays", 1, 1), ("c", None, 7, None), (None, "x", 1, 1)}
    assert store.upsert(target.limit(0), updates.limit(0), "k", ["created"], ["updated"]).count() == 0


def test_import_policy_and_batches(spark):
    stored = spark.createDataFrame([("a",), ("a",)], "k string")
    incoming = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), (None, 2)], "k string, run int")
    assert sorted(map(tuple, store.import_policy(incoming, stored, "k").collect()), key=str) == [("b", 1), ("b", 1), (None, 2)]
    assert {tuple(r) for r in store.import_counts(incoming, stored, "k", "run").collect()} == {(1, 3, 2, 1), (2, 1, 1, 0)}
    rows = spark.createDataFrame([(i, i % 7 == 0) for i in range(250)], "ord long, bad boolean")
    assert {tuple(r) for r in store.index_batches(rows, "ord", F.col("bad")).collect()} == {(0, 100, 85, 15), (1, 100, 86, 14), (2, 50, 43, 7)}
    again = spark.createDataFrame([("x", 1, "old"), ("y", 2, "y"), ("x", 3, None)], "id string, at long, title string")
    assert {tuple(r) for r in store.indexed_documents(again, "id", "at", ["title"]).collect()} == {("x", 1, None), ("y", 2, "y")}


def test_entities_and_redaction(spark):
    df = spark.createDataFrame([("s", "1", "t", "key=abc")], "source string, id string, title string, log string")
    assert tuple(ingest.to_entities(df, "source", "id", ["id", "title"]).first()) == ("s:1", "s", "1", '{"id":"1","title":"t"}')
    assert df.select(ingest.redacted(F.col("log"), ["abc", "a.c"])).first()[0] == "key=***"


def test_json_documents(spark, tmp_path):
    assert sources.read_json(spark, str(tmp_path / "missing"), sources.DOCUMENT).count() == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps([{"id": "x:1", "articleNo": "1", "text": "t", "paragraphs": [{"no": "1", "text": "p"}, {"no": "2", "text": "q"}]}, {"id": "x:2", "articleNo": "2", "articleTitle": "T", "text": "t"}]))
    (tmp_path / "a" / "2.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"id": "c", "caseNumber": "1", "caseName": " ", "summary": "s", "fullText": "f"}))
    articles, cases = sources.read_json(spark, str(tmp_path / "a"), sources.ARTICLE), sources.read_json(spark, str(tmp_path / "c.json"), sources.CASE)
    found = {r.id: (r.documentType, r.title, r.text) for r in sources.all_documents(articles, cases).collect()}
    assert found == {"x:1": ("STATUTE_ARTICLE", "Article 1", "p\nq"), "x:2": ("STATUTE_ARTICLE", "T", "t"), "c": ("COURT_CASE", "1", "s\nf")}
    sources.write_json(sources.all_documents(articles, cases), str(tmp_path / "out"))
    assert sources.by_id(sources.read_json(spark, str(tmp_path / "out"), sources.DOCUMENT, lines=True), "id", "c").first().title == "1"
    url = spark.createDataFrame([("0 1", None), ("2", "001502")], "id string, jo string").select(sources.view_url("http://x", F.col("id"), F.col("jo"))).collect()
    assert [r[0] for r in url] == ["http://x?ID=0+1", "http://x?ID=2&JO=001502"]


def test_unreadable_records_are_kept(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"id": "1"}, {"id": "2"}]')
    (tmp_path / "bad.json").write_text('{"id": "3"')
    got = sources.read_json(spark, str(tmp_path), sources.CASE)
    assert sorted((r.id or "", bool(r._corrupt)) for r in got.collect()) == [("", True), ("1", False), ("2", False)]
    assert {r.id for r in sources.readable(sources.read_json(spark, str(tmp_path), sources.CASE).cache()).collect()} == {"1", "2"}
    asked = spark.createDataFrame([("1",), ("9",), (None,)], "id string")
    assert {tuple(r) for r in sources.exists(got, "id", asked).collect()} == {("1", True), ("9", False), (None, False)}


def test_written_records_are_all_read(spark, tmp_path):
    sources.write_json(spark.createDataFrame([("a", "x\ny"), ("b", None), ("c", "")], "id string, summary string").coalesce(1), str(tmp_path / "out"))
    read = sources.read_json(spark, str(tmp_path / "out"), "id string, summary string", lines=True)
    assert {(r.id, r.summary) for r in read.collect()} == {("a", "x\ny"), ("b", None), ("c", "")}
