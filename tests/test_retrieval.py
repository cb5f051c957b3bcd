import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import fusion, retrieval, vector

CORPUS = "ord long, title string, text string"
QUERIES = "query_id long, query string"


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_keyword_search_matches_inside_words_and_counts_repeats(spark):
    corpus = spark.createDataFrame([(1, "Alpha", "beta alphabet"), (2, None, "ALPHA"), (3, "x", None), (4, "", "")], CORPUS)
    queries = spark.createDataFrame([(1, "alpha alpha b"), (2, "   "), (3, "zzz")], QUERIES)
    got = retrieval.keyword_search(corpus, queries).orderBy("rank")
    assert tuples(got, "query", "ord", "score", "matched_terms") == [("alpha alpha b", 1, 7, ["alpha", "b"]), ("alpha alpha b", 2, 2, ["alpha"])]


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("가나다ab", k=rng.randint(1, 4)))
    docs = [(i, word(), " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(60)]
    queries = [(i, " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(15)]
    corpus, asked = spark.createDataFrame(docs, CORPUS), spark.createDataFrame(queries, QUERIES)
    want = set()
    for q in {q for _, q in queries}:
        scores = [(-sum(2 * (t in d[1]) + (t in d[2]) for t in q.split()), d[0]) for d in docs]
        want |= {(q, o, -s, r + 1) for r, (s, o) in enumerate(sorted(x for x in scores if x[0]))}
    assert set(tuples(retrieval.keyword_search(corpus, asked), "query", "ord", "score", "rank")) == want
    config = retrieval.Bm25Config(size=5)
    tokens = {q: [r for r in spark.createDataFrame([(q,)], "q string").select(retrieval.query_terms("q")).first()[0]] for q in {q for _, q in queries}}
    want = set()
    for q, terms in tokens.items():
        idf = {t: math.log(1 + (60 - df + 0.5) / (df + 0.5)) for t in terms for df in [sum(t in d[1] or t in d[2] for d in docs)]}
        scored = []
        for d in docs:
            a, b = 2 * sum(idf[t] for t in terms if t in d[1]), sum(idf[t] for t in terms if t in d[2])
            if a + b > 0:
                scored.append((-round(max(a, b) + 0.3 * min(a, b), 6), d[0]))
        want |= {(q, o, -s) for s, o in sorted(scored)[:5]}
    assert set(tuples(retrieval.bm25_search(corpus, asked, config), "query", "ord", "score")) == want


def test_many_tokens_match_as_few_do(spark):
    corpus = spark.createDataFrame([(1, "Alpha", "beta\u3000alphabet"), (1, None, "lph"), (2, None, None), (3, "", "가나 x" * 5_000), (4, "\U0001f600b", "B")], CORPUS)
    tokens = spark.createDataFrame([(t,) for t in ("alpha", "lph", "b", "가", "나 x".strip(" x"), "\U0001f600", "zzz", "", None)], "token string").distinct()
    few, many = (tuples(retrieval.matches(corpus, tokens, n), "ord", "token", "in_title", "in_text") for n in (retrieval.MOST_TOKENS, 0))
    want = {(1, "alpha", True, True), (1, "lph", True, True), (1, "b", False, True), (3, "가", False, True), (3, "나", False, True), (4, "\U0001f600", True, False), (4, "b", True, True)}
    assert set(few) == set(many) == want and len(few) == len(many) == len(want)
    long = spark.createDataFrame([("x" * (retrieval.LONGEST_TOKEN + 1),)], "token string")
    assert tuples(retrieval.matches(spark.createDataFrame([(5, "X" * 300, None)], CORPUS), long), "ord", "in_title", "in_text") == [(5, True, False)]
    assert tuples(retrieval.matches(corpus, tokens.limit(0)), "ord") == []


def test_empty_corpus_and_required_matches(spark):
    corpus, queries = spark.createDataFrame([], CORPUS), spark.createDataFrame([(1, "a")], QUERIES)
    assert retrieval.keyword_search(corpus, queries).count() == retrieval.bm25_search(corpus, queries).count() == 0
    for minimum, n, want in ((None, 3, 1), (2, 1, 1), ("75%", 4, 3), ("50%", 3, 2), ("x", 3, 1), ("2", 3, 2), (None, 0, 0)):
        assert spark.range(1).select(retrieval.required_matches(F.lit(n), minimum)).first()[0] == want
    assert retrieval.parse_boost("title^2") == ("title", 2.0) and retrieval.parse_boost("text") == ("text", 1.0) and retrieval.parse_boost("a^b") == ("a", 1.0)


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    x[7] = x[3]
    x[9] = 0
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(50, None)], "ord long, vector array<double>")
    got = vector.knn_search(rows, rows.filter("ord in (3, 9)").withColumnRenamed("ord", "query_id"), 5)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q in (3, 9):
        cosines = np.round(u @ u[q], 6) + 0.0
        want = sorted(range(50), key=lambda i: (-cosines[i], i))[:5]
        assert [r.ord for r in got.filter(f"query_id = {q}").orderBy("rank").collect()] == want
    assert vector.knn_search(rows.limit(0), rows.limit(0).withColumnRenamed("ord", "query_id"), 5).count() == 0


def test_letter_vectors(spark):
    text = "가나😀" * 300
    units = np.frombuffer(text.encode("utf-16-le"), np.uint16)
    want = np.zeros(768)
    for i, u in enumerate(units):
        want[i % 768] += u
    got = spark.createDataFrame([(text,), ("",), (None,)], "x string").select(vector.letter_vector("x")).collect()
    assert np.allclose(got[0][0], want / len(units)) and not any(got[1][0]) and got[2][0] is None


def test_reciprocal_rank_fusion_order(spark):
    # ranks: A 1 and 3, B 2 and 1, C 3, D 2
    first = spark.createDataFrame([(1, 65, 9.0), (1, 66, 8.0), (1, 67, 7.0)], "query_id long, ord long, score double")
    second = spark.createDataFrame([(1, 66, 0.9), (1, 68, 0.8), (1, 65, 0.7)], "query_id long, ord long, score double")
    fused = fusion.reciprocal_rank_fusion(fusion.with_sources(first, second)).orderBy("rank").collect()
    assert [chr(r.ord) for r in fused] == ["B", "A", "D", "C"]
    assert fused[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    raw = fusion.raw_score_fusion(fusion.with_sources(first, second)).orderBy("rank").collect()
    assert [chr(r.ord) for r in raw] == ["A", "B", "C", "D"] and raw[3].first_source == 1


def test_rerank_keeps_old_order_on_ties(spark):
    corpus = spark.createDataFrame([(1, "alpha", "x"), (2, "beta", "alpha"), (3, "", "beta alpha"), (4, "none", None)], CORPUS)
    candidates = spark.createDataFrame([(1, o, r) for r, o in enumerate((4, 1, 2, 3), 1)], "query_id long, ord long, rank int")
    queries = spark.createDataFrame([(1, "alpha, beta")], QUERIES)
    got = fusion.rerank(candidates, queries, corpus, 10, 3).orderBy("rank")
    assert tuples(got, "ord", "score") == [(2, 2), (3, 2), (1, 1)]


def test_boosts_as_text_and_filtered_results(spark):
    config = retrieval.Bm25Config.of_fields("title^3", "text", size=5)
    assert (config.title_boost, config.text_boost, config.size) == (3.0, 1.0, 5) and retrieval.Bm25Config.of_fields("title^x").text_boost == 0.0
    ranked = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3), (2, 11, 0.5, 1), (2, 99, 0.4, 2)], "query_id long, ord long, score double, rank int")
    corpus = spark.createDataFrame([(10, "a"), (11, "b"), (11, "b"), (12, "b"), (13, None), (99, None)], "ord long, kind string")
    got = fusion.filtered(ranked, corpus, F.col("kind") == "b")
    assert set(tuples(got, "query_id", "ord", "rank")) == {(1, 11, 1), (1, 12, 2), (2, 11, 1)}
    assert fusion.filtered(ranked, corpus.limit(0), F.col("kind") == "b").count() == 0
