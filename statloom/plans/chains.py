"""Chains from search responses to stored and indexed articles, and the reports of whole evaluation runs, with their SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators import context as C
from statloom.operators import evaluation as E
from statloom.operators import ingest, pipelines
from statloom.operators.retrieval import documents_of
from statloom.operators.vector import letter_vector
from statloom.plans import evaluation, pipeline, unified
from statloom.plans import problems as P
from statloom.plans import retrieval as R
from statloom.session import written
from statloom.tables import load

MOST_INDEXED_CHARACTERS = 1_000
#: What to do about each kind of failure.
ADVICE = {
    "missing-indexed-content": "index the statutes of these articles again",
    "query-wording-mismatch": "bring queries into one wording: the article is found for others",
    "retrieved-outside-top-5": "widen the context or strengthen the ranking",
    "expected-document-not-retrieved": "cover more of the words that queries and articles share",
    "similar-article-competition": "prefer exact numbers and titles over articles of the same statute",
    "wrong-document-ranked-higher": "weigh titles and exact terms more",
    "other": "look at these cases one by one",
}


# --- ingestion ---------------------------------------------------------------------------------------------------------


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Search items of all responses, and the stored payloads of their statutes (a document's id begins with its statute's)."""
    found = pipeline.search_documents(spark, sf_dir).select(F.col("document_id").alias("statute_id"))
    details = load(spark, sf_dir, "legal_documents").select(
        F.substring_index("document_id", ":", 1).alias("statute_id"), F.col("document_id").alias("record_id"), F.col("raw_data").alias("payload")
    )
    return pipelines.staged_articles(found, details)


def ingest_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each statute that a search found."""
    return _staged(spark, sf_dir)[1]


def ingest_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: statutes by status, articles parsed, and rows that the upsert leaves (one for each document)."""
    articles, statuses = _staged(spark, sf_dir)
    of = lambda s: F.count_if(F.col("status") == s)
    stages = statuses.agg(F.count("*").alias("n_statutes"), of("ok").alias("n_ok"), of("missing").alias("n_missing"), of("unreadable").alias("n_unreadable"), of("empty").alias("n_empty"))
    saved = articles.agg(F.count("*").alias("n_parsed"), F.count_distinct("document_id").alias("n_saved"))
    return stages.join(F.broadcast(saved))  # one row each


def _refuse_long(batch: pa.RecordBatch) -> None:
    """A sink with a limit on the length of a text, in place of a search server."""
    long = pc.greater(pc.utf8_length(batch.column("text")), MOST_INDEXED_CHARACTERS)
    if pc.any(long).as_py():
        raise pipelines.RefusedDocuments(batch.column("document_id").filter(long).to_pylist())


def ingest_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of all found statutes as an index took or refused them, each refused one tried twice."""
    articles, _ = _staged(spark, sf_dir)
    return pipelines.bulk_index(articles.groupBy("document_id").agg(F.max("text").alias("text")), "document_id", _refuse_long, max_retries=1)


def _refuse_without_vector(batch: pa.RecordBatch) -> None:
    usable = pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), 768), False)
    if not pc.all(usable).as_py():
        raise pipelines.RefusedDocuments(batch.column("ord").filter(pc.invert(usable)).to_pylist())


def index_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of the index as a sink took or refused it: rows without a usable vector fail all three attempts."""
    rows = load(spark, sf_dir, "legal_index").select("ord", "embedding")
    return pipelines.bulk_index(rows, "ord", _refuse_without_vector, max_retries=2)


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.index_summary(index_results(spark, sf_dir))


def reindexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows made again from the stored JSON, with the vector of title and text."""
    stored = unified.stored_entities_whole(spark, sf_dir).select(F.from_json("raw_data", "id string, documentType string, title string, text string").alias("d")).select("d.*").distinct()
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return stored.select("id", "documentType", "title", F.length("text").alias("n_chars"), letter_vector(text).alias("embedding"))


def import_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History row of each search response: what it held, what of it was new to the catalogue of statutes."""
    searches = load(spark, sf_dir, "raw_legal_data").select("id", F.col("source_system").alias("source"), F.col("source_id").alias("query"), F.col("content").alias("payload"))
    stored = load(spark, sf_dir, "statutes").select(F.col("law_id").alias("document_id"))
    return pipelines.import_runs(searches, pipeline.search_documents(spark, sf_dir), stored)


# --- evaluation --------------------------------------------------------------------------------------------------------


def regression_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each case by the search that its target names: court cases by keywords, all others by weights."""
    asked = evaluation.cases(spark, sf_dir).withColumn("target", F.when(F.col("category") == "COURT_CASE", "keyword").otherwise("bm25"))
    ways = {"bm25": R.bm25, "keyword": R.keyword_retrieve}

    def runner(way):
        return lambda cases: E.long_metrics(E.case_metrics(evaluation.as_cases(way(spark, sf_dir)), cases.drop("target"))).withColumn("score", F.round("score", 6))

    return pipelines.run_by_target(asked, {name: runner(way) for name, way in ways.items()})


def _grounded(spark: SparkSession, sf_dir: str, ranked: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """The text of each asked document as an answer, to be grounded in what the search retrieved; it cites itself."""
    context = C.prompt_context(ranked, pipeline._cited_corpus(spark, sf_dir), R.asked(spark, sf_dir))
    retrieved = context.select(
        F.col("query_id").alias("case_id"), F.array_join(F.transform("documents", lambda d: d["text"]), "\n").alias("context"), F.transform("documents", lambda d: d["id"]).alias("retrieved")
    )
    cases = evaluation.cases(spark, sf_dir) if cases is None else cases
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    answers = documents_of(texts, cases.select(F.col("case_id").alias("ord"))).select(F.col("ord").alias("a_doc"), F.col("text").alias("answer"))
    asked = cases.select("case_id", F.transform("expected", lambda x: x.cast("string")).alias("expected"))
    return C.case_grounding(
        asked.join(answers, F.col("case_id") == F.col("a_doc")).join(retrieved, "case_id", "left").withColumn("cited", F.array(F.col("case_id").cast("string")))
    )


def case_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounded(spark, sf_dir, R.bm25(spark, sf_dir))


def case_grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_grounding_report(case_grounding(spark, sf_dir))


COMPARED = ("hit_rate", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "context_coverage", "grounded_answer", "unsupported_claims", "citation_coverage")


def _nine(spark: SparkSession, sf_dir: str, ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """(metric, value) of the nine metrics that two runs are compared by."""
    retrieval = E.metrics_report(E.case_metrics(evaluation.as_cases(ranked), cases))
    grounding = C.case_grounding_report(_grounded(spark, sf_dir, ranked, cases))
    return unified._long(retrieval, "x", COMPARED[:5]).unionByName(unified._long(grounding, "x", COMPARED[5:])).drop("report")


def report_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine metrics of the legacy search against those of the present one."""
    found, cases = R.matches(spark, sf_dir), written(evaluation.cases(spark, sf_dir))
    return E.compare_reports(_nine(spark, sf_dir, R.bm25_legacy(spark, sf_dir, found), cases), _nine(spark, sf_dir, R.bm25(spark, sf_dir, found=found), cases))


def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.comparison_summary(report_comparison(spark, sf_dir))


def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failure_summary(evaluation.failure_analysis(spark, sf_dir))


def failed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failed_cases(evaluation.failure_analysis(spark, sf_dir), R.asked(spark, sf_dir))


def failure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failure_patterns(evaluation.failure_report(spark, sf_dir), ADVICE)


def overall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: cases with and without expected documents, and the share of retrieval and grounding evaluations that passed."""
    ranked = R.bm25(spark, sf_dir)
    metrics = E.case_metrics(evaluation.as_cases(ranked), evaluation.cases(spark, sf_dir))
    all_passed = F.lit(True)
    for m in E.METRICS:
        all_passed = all_passed & (F.col(m) >= 1)
    passed = metrics.select("case_id", "n_expected", all_passed.alias("passed")).unionByName(_grounded(spark, sf_dir, ranked).select("case_id", "n_expected", "passed"))
    half = lambda c: (F.count_if(c) / 2).cast("long")  # noqa: E731 - every case is evaluated twice
    return passed.agg(
        half(F.lit(True)).alias("n_cases"),
        half(F.col("n_expected") > 0).alias("n_positive"),
        half(F.col("n_expected") == 0).alias("n_negative"),
        F.count("*").alias("n_evaluations"),
        F.count_if("passed").alias("n_passed"),
        F.round(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)), 6).alias("pass_rate"),
    )


def prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System part and whole prompt of each query: sources with their addresses and the citations allowed, or the notice that there are none."""
    return C.prompt_request(C.prompt_context(R.bm25(spark, sf_dir), pipeline._cited_corpus(spark, sf_dir), R.asked(spark, sf_dir)))


QUERIES = {
    "ingest_statuses": ingest_statuses,
    "ingest_to_table": ingest_to_table,
    "ingest_to_index": ingest_to_index,
    "index_results": index_results,
    "index_summary": index_summary,
    "reindexed_documents": reindexed_documents,
    "import_runs": import_runs,
    "regression_by_target": regression_by_target,
    "case_grounding": case_grounding,
    "case_grounding_report": case_grounding_report,
    "report_comparison": report_comparison,
    "comparison_summary": comparison_summary,
    "failure_summary": failure_summary,
    "failed_cases": failed_cases,
    "failure_patterns": failure_patterns,
    "overall_report": overall_report,
    "prompt_requests": prompt_requests,
}

# --- the same in SQL ---------------------------------------------------------------------------------------------------

_SEARCHED = pipeline.ORACLE_SQL["search_documents"]
_STAGES = f"""
WITH found AS (SELECT DISTINCT document_id AS statute_id FROM ({_SEARCHED}) WHERE document_id IS NOT NULL),
parsed AS ({pipeline.ORACLE_SQL["statute_articles"]}),
details AS (SELECT DISTINCT string_split(document_id, ':')[1] AS statute_id, document_id, coalesce(json_valid(raw_data) AND json_type(CASE WHEN json_valid(raw_data) THEN raw_data::JSON END) IN ('OBJECT', 'ARRAY', 'VARCHAR'), false) AS readable
            FROM legal_documents),
staged AS (SELECT f.statute_id, count(d.document_id) AS n_records, count(*) FILTER (readable) AS n_readable, coalesce(sum(n), 0)::BIGINT AS n_articles FROM found f
           LEFT JOIN details d ON d.statute_id = f.statute_id LEFT JOIN (SELECT record_id, count(*) AS n FROM parsed GROUP BY ALL) p ON p.record_id = d.document_id GROUP BY f.statute_id),
statuses AS (SELECT statute_id, n_records, n_articles, CASE WHEN n_records = 0 THEN 'missing' WHEN n_readable = 0 THEN 'unreadable' WHEN n_articles = 0 THEN 'empty' ELSE 'ok' END AS status FROM staged),
kept AS (SELECT p.* FROM parsed p WHERE string_split(record_id, ':')[1] IN (SELECT statute_id FROM found))"""


def letter_vectors_sql(rows: str, size: int = 768) -> str:
    """CTEs that end in ``vectors`` (key, vector): UTF-16 code units of each text summed by position modulo ``size``, over their number."""
    return f"""
rows_of AS ({rows}),
units AS (SELECT key, i, CASE WHEN c < 65536 THEN [c] ELSE [55296 + (c - 65536) // 1024, 56320 + (c - 65536) % 1024] END AS pair
          FROM (SELECT key, i, unicode(substr(text, i, 1)) AS c FROM (SELECT key, text, unnest(range(1, length(text) + 1)) AS i FROM rows_of))),
placed_units AS (SELECT key, unit, row_number() OVER (PARTITION BY key ORDER BY i, j) - 1 AS spot FROM (SELECT key, i, unnest(pair) AS unit, unnest(range(1, len(pair) + 1)) AS j FROM units)),
sums AS (SELECT key, map_from_entries(list((spot, total))) AS m, sum(n) AS n FROM (SELECT key, (spot % {size})::BIGINT AS spot, sum(unit)::DOUBLE AS total, count(*) AS n FROM placed_units GROUP BY ALL) GROUP BY key),
vectors AS (SELECT r.key, CASE WHEN r.text IS NULL THEN NULL ELSE list_transform(range(0, {size}), lambda p: coalesce(s.m[p], 0.0) / greatest(coalesce(s.n, 0), 1)::DOUBLE) END AS vector FROM rows_of r LEFT JOIN sums s ON s.key = r.key)"""


def _grounding_sql(ranked: str, name: str) -> str:
    return f""",
{name}_context AS (SELECT query_id, string_agg(coalesce(d.text, ''), chr(10) ORDER BY r.rank) AS context, list(r.ord) AS retrieved FROM {ranked} r JOIN documents d ON d.doc_id = r.ord GROUP BY query_id),
{name}_answers AS (SELECT c.case_id, c.positive, lower(coalesce(x.context, '')) AS context, coalesce(list_contains(x.retrieved, c.case_id), false) AS held,
  list_filter(list_transform(string_split_regex(coalesce(d.text, ''), '[.!?\\n]+'), lambda x: {R.sql_trim('x')}), lambda x: x <> '') AS claims
  FROM cases c JOIN documents d ON d.doc_id = c.case_id LEFT JOIN {name}_context x ON x.query_id = c.case_id),
{name}_claims AS (SELECT case_id, context, {R.sql_claim_terms('claim')} AS terms FROM (SELECT case_id, context, unnest(claims) AS claim FROM {name}_answers)),
{name}_support AS (SELECT case_id, count(*) AS n, count(*) FILTER (len(terms) = 0 OR round(len(list_filter(terms, lambda t: contains(context, t)))::DOUBLE / len(terms), 6) >= 0.6) AS good FROM {name}_claims GROUP BY case_id),
{name}_grounding AS (SELECT a.case_id, CASE WHEN positive THEN 1 ELSE 0 END AS n_expected, CASE WHEN NOT positive OR held THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS context_coverage,
  coalesce(round(good::DOUBLE / n, 6), 1.0::DOUBLE) AS grounded_answer, coalesce(n - good, 0) AS unsupported_claims, CASE WHEN held THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS citation_coverage
  FROM {name}_answers a LEFT JOIN {name}_support s ON s.case_id = a.case_id),
{name}_grounding_report AS (SELECT count(*) AS n_cases, count(*) FILTER (n_expected > 0) AS n_positive, round(coalesce(avg(context_coverage) FILTER (n_expected > 0), 0.0)::DOUBLE, 6) AS context_coverage,
  round(coalesce(avg(grounded_answer), 0.0)::DOUBLE, 6) AS grounded_answer, coalesce(sum(unsupported_claims), 0)::BIGINT AS unsupported_claims, count(*) FILTER (unsupported_claims > 0) AS cases_with_unsupported,
  round(coalesce(avg(citation_coverage), 0.0)::DOUBLE, 6) AS citation_coverage FROM {name}_grounding)"""


_ONE_RUN = evaluation.BM25_CASES + _grounding_sql("bm25", "now")
_PASSES = "context_coverage = 1 AND grounded_answer = 1 AND unsupported_claims = 0 AND citation_coverage = 1"
_COMPARISON = (
    R.BM25
    + evaluation._LEGACY
    + evaluation._CASES
    + evaluation.metrics_cte("bm25", "m_bm25")
    + evaluation.metrics_cte("legacy", "m_legacy")
    + _grounding_sql("bm25", "now")
    + _grounding_sql("legacy", "then")
    + f", a AS (SELECT {evaluation.REPORT} FROM m_bm25), b AS (SELECT {evaluation.REPORT} FROM m_legacy), nine AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, y.{m}::DOUBLE AS before, x.{m}::DOUBLE AS after, {-1 if m == 'unsupported_claims' else 1} AS sign FROM {'a x, b y' if m in COMPARED[:5] else 'now_grounding_report x, then_grounding_report y'}"
        for m in COMPARED
    )
    + """), compared AS (SELECT metric, before, after, round(after - before, 6) AS delta,
  CASE WHEN abs(round(after - before, 6)) <= 0.01 THEN 'unchanged' WHEN sign * (after - before) > 0 THEN 'improved' ELSE 'regressed' END AS status FROM nine)"""
)
_ADVICE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS category, '{a}' AS recommendation" for c, a in ADVICE.items())

ORACLE_SQL = {
    "letter_vectors": "WITH "
    + letter_vectors_sql("SELECT row_number() OVER () AS key, id, text FROM (SELECT DISTINCT id, text FROM document_chunks)")
    + " SELECT r.id, v.vector FROM rows_of r JOIN vectors v ON v.key = r.key",
    "ingest_statuses": _STAGES + " SELECT * FROM statuses",
    "ingest_to_table": _STAGES
    + """ SELECT count(*) AS n_statutes, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'unreadable') AS n_unreadable,
  count(*) FILTER (status = 'empty') AS n_empty, (SELECT count(*) FROM kept) AS n_parsed, (SELECT count(DISTINCT document_id) FROM kept) AS n_saved FROM statuses""",
    "ingest_to_index": _STAGES
    + f""" SELECT document_id, length(text) <= {MOST_INDEXED_CHARACTERS} AS indexed, CASE WHEN length(text) <= {MOST_INDEXED_CHARACTERS} THEN 1 ELSE 2 END AS attempts
FROM (SELECT document_id, max(text) AS text FROM kept GROUP BY document_id)""",
    "index_results": "SELECT ord, coalesce(len(embedding) = 768, false) AS indexed, CASE WHEN len(embedding) = 768 THEN 1 ELSE 3 END AS attempts FROM legal_index",
    "index_summary": "SELECT count(*) AS n_total, count(*) FILTER (len(embedding) = 768) AS n_indexed, count(*) - count(*) FILTER (len(embedding) = 768) AS n_failed FROM legal_index",
    "reindexed_documents": "WITH "
    + letter_vectors_sql(
        "SELECT row_number() OVER () AS key, coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '') AS text, * EXCLUDE (title), title FROM (SELECT DISTINCT document_id, statute_id, title, content FROM legal_documents)"
    )
    + """ SELECT r.document_id AS id, CASE WHEN statute_id IS NULL THEN 'COURT_CASE' ELSE 'STATUTE_ARTICLE' END AS "documentType", r.title, length(content) AS n_chars, v.vector AS embedding
FROM rows_of r JOIN vectors v ON v.key = r.key""",
    "import_runs": f"""
WITH documents_of AS ({_SEARCHED}),
counted AS (SELECT record_id, count(*) AS n_parsed, count(*) FILTER (s.law_id IS NULL) AS imported FROM documents_of d LEFT JOIN (SELECT DISTINCT law_id FROM statutes) s ON s.law_id = d.document_id GROUP BY record_id),
runs AS (SELECT *, coalesce(json_valid(content) AND json_type(CASE WHEN json_valid(content) THEN content::JSON END) IN ('OBJECT', 'ARRAY', 'VARCHAR'), false) AS readable
         FROM (SELECT DISTINCT id, source_system AS source, source_id AS query, content FROM raw_legal_data))
SELECT id, source, query, coalesce(n_parsed, 0) AS n_parsed, coalesce(imported, 0) AS imported_count, CASE WHEN readable THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  CASE WHEN NOT readable THEN 'unreadable payload' END AS error_message FROM runs LEFT JOIN counted ON record_id = id""",
    "regression_by_target": R.BM25
    + evaluation._KEYWORD
    + evaluation._CASES
    + evaluation.metrics_cte("bm25", "m_bm25")
    + evaluation.metrics_cte("keyword", "m_keyword")
    + " "
    + " UNION ALL ".join(
        f"SELECT case_id, '{m}' AS metric, round({m}::DOUBLE, 6) AS score, round({m}::DOUBLE, 6) >= 1 AS passed, '{t}' AS target FROM m_{t} WHERE {'' if t == 'keyword' else 'NOT '}coalesce(category = 'COURT_CASE', false)"
        for t in ("bm25", "keyword")
        for m in E.METRICS
    ),
    "case_grounding": _ONE_RUN + f" SELECT *, {_PASSES} AS passed FROM now_grounding",
    "case_grounding_report": _ONE_RUN + " SELECT * FROM now_grounding_report",
    "report_comparison": _COMPARISON + " SELECT * FROM compared",
    "comparison_summary": _COMPARISON
    + " SELECT count(*) FILTER (status = 'improved') AS n_improved, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (status = 'regressed') AS n_regressed, count(*) FILTER (status = 'regressed') > 0 AS has_regressions FROM compared",
    "failure_summary": evaluation.BM25_CASES
    + evaluation._ANALYSIS
    + " SELECT count(*) AS n_applicable, count(*) FILTER (success) AS n_success, count(*) FILTER (NOT success) AS n_failed, round(avg(rank), 6) AS mean_found_rank FROM analysis",
    "failed_cases": evaluation.BM25_CASES
    + evaluation._ANALYSIS
    + """ SELECT row_number() OVER (ORDER BY rank NULLS LAST, case_id) AS place, case_id, title AS query, rank, category
FROM (SELECT a.*, d.title FROM analysis a JOIN documents d ON d.doc_id = a.case_id WHERE NOT success ORDER BY rank NULLS LAST, case_id LIMIT 10)""",
    "failure_patterns": evaluation.BM25_CASES
    + evaluation._ANALYSIS
    + f", advice AS ({_ADVICE_SQL}) SELECT category, count(*) AS n_cases, any_value(recommendation) AS recommendation FROM analysis JOIN advice USING (category) GROUP BY category",
    "overall_report": _ONE_RUN
    + evaluation.metrics_cte("bm25")
    + f""", evaluated AS (SELECT n_expected, {" AND ".join(f"{m} >= 1" for m in E.METRICS)} AS passed FROM metrics UNION ALL SELECT n_expected, {_PASSES} FROM now_grounding)
SELECT count(*) // 2 AS n_cases, count(*) FILTER (n_expected > 0) // 2 AS n_positive, count(*) FILTER (n_expected = 0) // 2 AS n_negative, count(*) AS n_evaluations,
  count(*) FILTER (passed) AS n_passed, round(coalesce(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE, 6) AS pass_rate FROM evaluated""",
    "prompt_requests": R.BM25
    + f""", blocks AS (SELECT query_id,
  string_agg('[' || rank || '] ' || coalesce(d.title, '') || chr(10) || 'Source: ' || coalesce(d.title, '') || ' ()' || chr(10) || 'Text: ' || coalesce(d.text, ''), chr(10) || chr(10) ORDER BY rank) AS documents,
  string_agg(rank || '. ' || coalesce(d.title, '') || ' - ', chr(10) ORDER BY rank) AS citations FROM bm25 JOIN documents d ON d.doc_id = ord GROUP BY query_id)
SELECT a.query_id, {R.sql_text(C.SYSTEM)} AS system, coalesce('Retrieved legal context:' || chr(10) || documents || chr(10) || chr(10) || 'Available citations (cite only these, exactly as written):' || chr(10) || citations,
  {R.sql_text(C.UNGROUNDED)}) || chr(10) || chr(10) || 'Question: ' || a.query AS prompt FROM asked a LEFT JOIN blocks b ON b.query_id = a.query_id""",
}
