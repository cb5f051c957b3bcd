import json

import pyarrow as pa
import pytest

from statloom.operators import context, evaluation, pipelines

PAYLOAD = {"법령": {"기본정보": {"법령ID": "7", "법령명_한글": "가법"}, "조문": {"조문단위": [{"조문번호": "1", "조문내용": "본문"}, {"조문번호": "2", "조문내용": "또 본문"}]}}}


def test_every_found_statute_has_a_status(spark):
    found = spark.createDataFrame([("7",), ("7",), ("8",), ("9",), ("10",), (None,)], "statute_id string")
    details = [("7", "r1", json.dumps(PAYLOAD)), ("7", "r1", json.dumps(PAYLOAD)), ("8", "r2", "{broken"), ("9", "r3", "{}"), ("11", "r4", json.dumps(PAYLOAD))]
    articles, statuses = pipelines.staged_articles(found, spark.createDataFrame(details, "statute_id string, record_id string, payload string"))
    assert {tuple(r) for r in statuses.collect()} == {("7", 1, 2, "ok"), ("8", 1, 0, "unreadable"), ("9", 1, 0, "empty"), ("10", 0, 0, "missing")}
    assert {r.document_id for r in articles.collect()} == {"7:1", "7:2"}
    assert pipelines.staged_articles(found.limit(0), spark.createDataFrame([], "statute_id string, record_id string, payload string"))[1].count() == 0


def test_bulk_index_tries_again(spark):
    seen: dict = {}

    def send(batch: pa.RecordBatch) -> None:
        ids = batch.column("id").to_pylist()
        for i in ids:
            seen[i] = seen.get(i, 0) + 1
        if "down" in ids and seen["down"] == 1:
            raise ConnectionError
        if bad := [i for i in ids if i == "never" or (i == "second" and seen[i] < 3)]:
            raise pipelines.RefusedDocuments(bad)

    docs = spark.createDataFrame([(i, "x", 0) for i in ("a", "down", "never", "second", "b")], "id string, text string, attempts int").coalesce(1)
    got = {r.id: (r.indexed, r.attempts) for r in pipelines.bulk_index(docs, "id", send, 10, 3).collect()}
    assert got == {"a": (True, 2), "b": (True, 2), "down": (True, 2), "second": (True, 3), "never": (False, 4)}
    assert tuple(pipelines.index_summary(pipelines.bulk_index(docs.limit(0), "id", send)).first()) == (0, 0, 0)


def test_a_sink_that_is_down_loses_nothing_silently(spark):
    def send(batch: pa.RecordBatch) -> None:
        raise OSError

    docs = spark.createDataFrame([(i,) for i in range(250)], "id int")
    results = pipelines.bulk_index(docs, "id", send, max_retries=1).collect()
    assert len(results) == 250 and all(not r.indexed and r.attempts == 2 for r in results)


def test_tables_are_made_once_and_vectors_appended(spark, tmp_path):
    path = str(tmp_path / "table")
    assert pipelines.create_if_absent(spark, path, "id string, vector array<double>")
    vectors = spark.createDataFrame([("a", [1.0], 1)], "id string, vector array<double>, other int")
    pipelines.append_vectors(vectors, path)
    pipelines.append_vectors(vectors, path)
    assert not pipelines.create_if_absent(spark, path, "id string")
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", [1.0])] * 2


def test_import_runs(spark):
    searches = spark.createDataFrame([("1", "s", "q", "{}"), ("1", "s", "q", "{}"), ("2", "s", "q", "{"), ("3", "s", None, None)], "id string, source string, query string, payload string")
    documents = spark.createDataFrame([("1", "a"), ("1", "b")], "record_id string, document_id string")
    stored = spark.createDataFrame([("a",), ("a",)], "document_id string")
    got = {r.id: (r.n_parsed, r.imported_count, r.status, r.error_message) for r in pipelines.import_runs(searches, documents, stored).collect()}
    assert got == {"1": (2, 1, "SUCCESS", None), "2": (0, 0, "FAILED", "unreadable payload"), "3": (0, 0, "FAILED", "unreadable payload")}


def test_cases_run_by_their_target(spark):
    cases = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "case_id int, target string")
    runners = {"x": lambda c: c.selectExpr("case_id", "1 as score"), "y": lambda c: c.selectExpr("case_id", "2 as score")}
    assert {tuple(r) for r in pipelines.run_by_target(cases, runners).collect()} == {(1, 1, "x"), (2, 2, "y"), (3, 1, "x")}
    for bad in ("z", None):
        with pytest.raises(ValueError, match="no runner"):
            pipelines.run_by_target(cases.union(spark.createDataFrame([(4, bad)], "case_id int, target string")), runners)


def test_grounding_of_cases(spark):
    schema = "case_id int, answer string, context string, expected array<string>, retrieved array<string>, cited array<string>"
    rows = [
        (1, "law one holds. unknown words here.", "Law One holds", ["a", "b"], ["a"], ["a"]),
        (2, None, None, [], None, None),
        (3, "law", "law", ["z"], ["a"], ["z", "a"]),
    ]
    grounding = context.case_grounding(spark.createDataFrame(rows, schema))
    got = {tuple(r) for r in grounding.collect()}
    assert got == {(1, 2, 0.5, 0.5, 1, 1.0, False), (2, 0, 1.0, 1.0, 0, 1.0, True), (3, 1, 0.0, 1.0, 0, 0.5, False)}
    assert tuple(context.case_grounding_report(grounding).first()) == (3, 2, 0.25, 0.833333, 1, 1, 0.833333)
    assert context.case_grounding_report(grounding.limit(0)).first().n_cases == 0


def test_failures_and_comparisons(spark):
    analysis = spark.createDataFrame([(1, 7, False, "b"), (2, None, False, "a"), (3, 1, True, None), (4, 6, False, "b")], "case_id int, rank int, success boolean, category string")
    assert tuple(evaluation.failure_summary(analysis).first()) == (4, 1, 3, 4.666667)
    queries = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id int, query string")
    assert [tuple(r) for r in evaluation.failed_cases(analysis, queries, 2).orderBy("place").collect()] == [(1, 4, None, 6, "b"), (2, 1, "q1", 7, "b")]
    comparison = spark.createDataFrame([("m", "improved"), ("n", "regressed"), ("o", "missing")], "metric string, status string")
    assert tuple(evaluation.comparison_summary(comparison).first()) == (1, 0, 1, True)
    timed = evaluation.timed({"x": lambda: spark.range(10)}, 2)
    assert timed[0]["name"] == "x" and timed[0]["passes"] == 2 and 0 < timed[0]["least"] <= timed[0]["average"] <= timed[0]["greatest"]
