import random

import numpy as np
import pyarrow as pa
import pytest

from statloom.functions.text import CLAIM_MARKS
from statloom.operators import best as B
from statloom.operators import context, retrieval
from statloom.plans import chains, evaluation


@pytest.mark.parametrize(("score", "required"), [(B.Score(2.0, 1.0, 0.3, 6), 1), (B.Score(1.0, 1.0, 0.0, 6), 2), (B.Score(2.0, 1.0, 1.0, 6), 1)])
def test_bounds_leave_out_no_result(spark, monkeypatch, score, required):
    rng = random.Random(5)
    # few values of the weights, so that many scores are equal; rare and frequent tokens
    rows = [(q, f"t{t}", rng.randint(1, 2), float(rng.choice((0.25, 0.5, 3.0))), required) for q in range(25) for t in rng.sample(range(12), rng.randint(1, 5))]
    found = [(d, f"t{t}", *rng.choice([(True, False), (False, True), (True, True)])) for d in range(400) for t in range(14) if rng.random() < 1 / (1 + t)]
    of = {d: [] for d, *_ in found}
    for d, *match in found:
        of[d].append(match)
    want = set()
    for q in {r[0] for r in rows}:
        scores = []
        for d, matches in of.items():
            title = text = n = 0
            for token, in_title, in_text in matches:
                for _, t, times, weight, _ in (r for r in rows if r[:2] == (q, token)):
                    title, text, n = title + weight * in_title, text + weight * in_text, n + times
            value = float(score(np.array([title]), np.array([text]))[0])
            if value > 0 and n >= required:
                scores.append((-value, d))
        want |= {(q, d, -s) for s, d in sorted(scores)[:4]}
    columns = ["query_no", "token", "n", "weight", "required"]
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)})
    monkeypatch.setattr(B, "LARGEST_BLOCK", 100)
    monkeypatch.setattr(B, "FIRST_BLOCK", 16)
    df = spark.createDataFrame(found, "ord long, token string, in_title boolean, in_text boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = B.best_documents(df, table, score, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert B.best_documents(df, table.slice(0, 0), score, 4).count() == 0


def test_more_tokens_than_are_handed_to_tasks_give_the_same(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, f"a b{i % 3}", f"b c{i % 5} a") for i in range(40)], "ord long, title string, text string")
    queries = spark.createDataFrame([(1, "a b1"), (2, "b c4"), (3, "a a c2")], "query_id long, query string")
    rows = lambda df: {tuple(r) for r in df.select("query", "ord", "score", "rank").collect()}
    few = rows(retrieval.bm25_search(corpus, queries)), rows(retrieval.keyword_search(corpus, queries, 5))
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 2)
    assert few == (rows(retrieval.bm25_search(corpus, queries)), rows(retrieval.keyword_search(corpus, queries, 5)))


def test_results_are_not_sought_again_by_their_readers(spark):
    corpus = spark.createDataFrame([(1, "alpha", "beta"), (2, "beta", "alpha")], "ord long, title string, text string")
    found = retrieval.bm25_search(corpus, spark.createDataFrame([(1, "alpha")], "query_id long, query string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "Join" not in plan and found.count() == 2


@pytest.fixture
def reads(spark, monkeypatch, tmp_path):
    """Counts how often the cases are made; the folder has a few documents."""
    docs = [(i, f"text {i}", f"title {i % 4}", "KIND", "s") for i in range(0, 300, 25)]
    spark.createDataFrame(docs, "doc_id long, text string, title string, document_type string, statute_id string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    made, cases = [], evaluation.cases
    monkeypatch.setattr(evaluation, "cases", lambda *a: made.append(1) or cases(*a))
    return str(tmp_path), made


def test_failures_read_the_cases_once(spark, reads):
    folder, made = reads
    plan = evaluation.failure_analysis(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "regexp_replace" not in plan  # texts are not looked at again for blanks


def test_variants_share_cases_and_matches(spark, reads, monkeypatch):
    folder, made = reads
    passes, matches = [], retrieval.matches
    monkeypatch.setattr(retrieval, "matches", lambda *a: passes.append(1) or matches(*a))
    rows = evaluation.variants(spark, folder).collect()
    assert len(made) == 1 and len(passes) == 1 and [r.variant for r in sorted(rows, key=lambda r: r.place)] == ["keyword", "bm25", "legacy", "hybrid", "reranked"]


def test_shared_matches_of_other_tokens_change_nothing(spark):
    corpus = spark.createDataFrame([(1, "title 3", "의무는 있다"), (2, "의무", "3"), (3, "x", "title")], "ord long, title string, text string")
    queries = spark.createDataFrame([(1, "의무는 3!"), (2, "title 3")], "query_id long, query string")
    shared = retrieval.weighted_matches(corpus, queries, keywords=True)
    rows = lambda df: {tuple(r) for r in df.select("query", "ord", "score", "rank").collect()}
    assert rows(retrieval.keyword_best(retrieval.query_tokens(queries), shared, 5)) == rows(retrieval.keyword_search(corpus, queries, 5))
    assert rows(retrieval.bm25_search(corpus, queries, found=shared)) == rows(retrieval.bm25_search(corpus, queries))


def test_report_comparison_reads_the_cases_once_and_grounds_in_the_texts_of_results(spark, reads):
    folder, made = reads
    rows = chains.report_comparison(spark, folder).collect()
    assert len(made) == 1 and len(rows) == 9
    answers = spark.createDataFrame([(1, "Alpha beta. gamma", "ALPHA beta", ["1"], ["1"], ["1"])], "case_id long, answer string, context string, expected array<string>, retrieved array<string>, cited array<string>")
    grounding = context.case_grounding(answers)
    assert grounding._jdf.queryExecution().analyzed().toString().count(CLAIM_MARKS) == 1  # a claim is cut into terms once
    assert [r.grounded_answer for r in grounding.collect()] == [0.5]


def test_best_variant_seeks_no_terms_that_it_does_not_show(spark, reads, monkeypatch):
    folder, made = reads
    terms, search = [], retrieval.keyword_search
    monkeypatch.setattr(retrieval, "keyword_search", lambda *a: terms.append(1) or search(*a))
    assert evaluation.best_variant(spark, folder).count() == 1 and not terms and len(made) == 1


def test_regression_status_reads_the_cases_once(spark, reads):
    folder, made = reads
    assert len(evaluation.regression_status(spark, folder).collect()) == 6 and len(made) == 1
