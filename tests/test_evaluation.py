import pytest

from statloom.operators import context as C
from statloom.operators import evaluation as E

CASES = "case_id long, expected array<long>, variation_group string"
RANKED = "case_id long, ord long, rank int"


@pytest.fixture(scope="module")
def tables(spark):
    cases = spark.createDataFrame([(1, [1], "g"), (2, [2, 3], "g"), (3, [], None), (4, [9], None), (5, [99], None), (6, [5], None), (7, [7], None)], CASES)
    ranked = [(1, 1, 1), (1, 2, 2), (2, 4, 1), (3, 1, 1), (4, 5, 1), (6, 6, 1), *((7, 10 + i, i) for i in range(1, 6)), (7, 7, 6)]
    corpus = spark.createDataFrame([*((i, f"s{i}") for i in (1, 2, 3, 4, 7, 9)), (5, "s"), (6, "s"), *((10 + i, "t") for i in range(1, 6))], "ord long, group string")
    return spark.createDataFrame(ranked, RANKED), cases, corpus


def test_case_metrics(tables):
    ranked, cases, _ = tables
    got = {r.case_id: r for r in E.case_metrics(ranked, cases).collect()}
    assert (got[1].precision, got[1].recall, got[1].hit, got[1].reciprocal_rank) == (0.5, 1, 1, 1)
    assert (got[2].precision, got[2].recall, got[2].hit, got[2].reciprocal_rank) == (0, 0, 0, 0)
    assert (got[3].precision, got[3].recall, got[3].hit, got[3].recall_at_5, got[3].reciprocal_rank) == (0, 1, 1, 1, 1)
    assert (got[5].precision, got[5].n_retrieved, got[5].first_rank) == (0, 0, None)
    assert (got[7].recall, got[7].recall_at_5, got[7].first_rank) == (1, 0, 6)
    report = E.metrics_report(E.case_metrics(ranked, cases)).first()
    assert (report.n_cases, report.n_positive, report.hit_rate, report.failure_count) == (7, 6, round(2 / 6, 6), 5)
    empty = E.metrics_report(E.case_metrics(ranked, cases.limit(0))).first()
    assert (empty.n_cases, empty.mrr) == (0, 0.0)


def test_failures(spark, tables):
    ranked, cases, corpus = tables
    analysis = E.failure_analysis(ranked, cases, corpus)
    got = {r.case_id: (r.success, r.category) for r in analysis.collect()}
    assert got == {
        1: (True, None), 2: (False, "query-wording-mismatch"), 4: (False, "wrong-document-ranked-higher"), 5: (False, "missing-indexed-content"),
        6: (False, "similar-article-competition"), 7: (False, "retrieved-outside-top-5"),
    }
    counts = {r.category: r.n_cases for r in E.failure_report(analysis).collect()}
    assert list(sorted(counts)) == sorted(E.CATEGORIES) and counts["other"] == 0 and counts["missing-indexed-content"] == 1
    alone = spark.createDataFrame([(8, [1], None)], CASES)
    assert E.failure_analysis(ranked, alone, corpus).first().category == "expected-document-not-retrieved"
    assert [tuple(r) for r in E.missed_documents(ranked, cases, 2).collect()] == [(2, 1), (3, 1)]


def test_report_comparison(spark):
    report = lambda *v: spark.createDataFrame([*zip(("hit_rate", "mrr", "failure_count", "only"), v, strict=False)], "metric string, value double")
    got = {r.metric: r.status for r in E.compare_reports(report(0.5, 0.8, 5.0, 1.0), report(0.6, 0.805, 2.0)).collect()}
    assert got == {"hit_rate": "improved", "mrr": "unchanged", "failure_count": "improved", "only": "missing"}
    assert {r.metric: r.status for r in E.compare_reports(report(0.5, 0.8), report(0.4, 0.805), 0.001).collect()} == {"hit_rate": "regressed", "mrr": "improved"}
    best = spark.createDataFrame([("a", 0, 0.9, 2, 0.5), ("b", 1, 0.9, 1, 0.4), ("c", 2, 0.9, 1, 0.4)], "variant string, place int, hit_rate double, failure_count int, mrr double")
    assert E.best_variant(best).first().variant == "b"


def test_claims_and_answers(spark):
    answers = spark.createDataFrame(
        [(1, "Alpha beta. gamma delta epsilon zeta eta!", "ALPHA beta zeta"), (2, "", None), (3, None, "x"), (4, "…", "x")], "answer_id long, answer string, context string"
    )
    support = C.claim_support(answers)
    assert [(r.answer_id, r.claim_no, r.score, r.supported) for r in support.filter("answer_id < 4").orderBy("answer_id", "claim_no").collect()] == [(1, 0, 1.0, True), (1, 1, 0.4, False)]
    report = C.grounding_report(answers.filter("answer_id < 4"), support.filter("answer_id < 4")).first()
    assert tuple(report) == (3, round((0.5 + 1 + 1) / 3, 6), 1, 1)
    checks = spark.createDataFrame(
        [(1, "Alpha", ["alpha"], ["d"], ["d"]), (2, " ", None, None, None), (3, "x", ["a", "x"], ["d"], ["d", "e"])],
        "answer_id long, answer string, keywords array<string>, cited array<string>, expected_citations array<string>",
    )
    got = {r.answer_id: tuple(r)[1:] for r in C.answer_checks(checks).collect()}
    assert got == {1: (True, 1.0, True, 1.0, True), 2: (False, 1.0, False, 1.0, False), 3: (True, 0.5, True, 0.5, False)}


def test_prompt_context(spark):
    corpus = spark.createDataFrame([(1, "d1", "T1", "\n first \nmore", "statute_article", None), (2, "d2", None, None, "court_case", "u")], "ord long, document_id string, title string, text string, source_type string, source_url string")
    ranked = spark.createDataFrame([(7, 2, 1), (7, 1, 2)], "query_id long, ord long, rank int")
    queries = spark.createDataFrame([(7, "q"), (8, "lonely")], "query_id long, query string")
    found = C.prompt_context(ranked, corpus, queries)
    row = found.filter("query_id = 7").first()
    assert [d.id for d in row.documents] == ["d2", "d1"] and [c.snippet for c in row.citations] == ["", "first"] and row.citations[0].source_url == "u"
    prompts = {r.query_id: r.prompt for r in C.prompt_text(found).collect()}
    assert "[1] \nSource: d2" in prompts[7] and "2. T1 (d1)" in prompts[7] and prompts[8].endswith("No context was found.")
