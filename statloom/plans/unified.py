"""The unified report, and documents as they are stored and indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators import evaluation as E
from statloom.operators import ingest
from statloom.plans import evaluation, pipeline
from statloom.plans import retrieval as R
from statloom.tables import load

_RETRIEVAL = ("hit_rate", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "failure_count")
_GROUNDING = ("grounded_share", "unsupported_claims", "answers_with_unsupported")


def _long(report: DataFrame, name: str, metrics: tuple[str, ...]) -> DataFrame:
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return report.select(F.lit(name).alias("report"), F.inline(values))


def unified_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, metric, value): retrieval, grounding and the share of answers that pass their checks."""
    metrics = E.case_metrics(evaluation.as_cases(R.bm25(spark, sf_dir)), evaluation.cases(spark, sf_dir))
    answers = pipeline.answer_checks(spark, sf_dir).agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))
    return (
        _long(E.metrics_report(metrics), "retrieval", _RETRIEVAL)
        .unionByName(_long(pipeline.grounding_report(spark, sf_dir), "grounding", _GROUNDING))
        .unionByName(_long(answers, "answers", ("pass_rate",)))
    )


def stored_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the store: key, source and the document as JSON."""
    documents = load(spark, sf_dir, "legal_documents").select("source", "document_id", "title").distinct()
    return ingest.to_entities(documents, "source", "document_id", ["document_id", "title"])


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents as rows of the index; one chunk each."""
    documents = load(spark, sf_dir, "legal_documents").select("document_id", "statute_id", "title", "content").distinct()
    is_case = F.col("statute_id").isNull()
    return documents.select(
        F.col("document_id").alias("id"),
        F.when(is_case, "COURT_CASE").otherwise("STATUTE_ARTICLE").alias("document_type"),
        "title",
        F.length("content").alias("n_chars"),
        F.when(is_case, "court_case").otherwise("statute_article").alias("source_type"),
        F.concat("document_id", F.lit("#chunk-0")).alias("chunk_id"),
    )


_DOCUMENT = ["document_id", "statute_id", "title", "content"]


def stored_entities_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the store, with title and content; the whole document as JSON, nulls left out."""
    documents = load(spark, sf_dir, "legal_documents").select("source", *_DOCUMENT).distinct()
    is_case = F.col("statute_id").isNull()
    document = F.to_json(
        F.struct(
            F.col("document_id").alias("id"),
            F.when(is_case, "COURT_CASE").otherwise("STATUTE_ARTICLE").alias("documentType"),
            "title",
            F.col("content").alias("text"),
            F.struct(F.col("statute_id").alias("statuteId")).alias("metadata"),
            F.struct(F.when(is_case, "court_case").otherwise("statute_article").alias("sourceType"), F.coalesce("statute_id", "document_id").alias("sourceId")).alias("sourceRef"),
        )
    )
    return documents.select(F.concat("source", F.lit(":"), "document_id").alias("id"), "source", "document_id", "title", "content", document.alias("raw_data"))


def index_rows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents as rows of the index: text, source and the vector last indexed for the document, null if there is none."""
    documents = load(spark, sf_dir, "legal_documents").select(*_DOCUMENT).distinct()
    usable = load(spark, sf_dir, "legal_index").filter(F.size("embedding") == 768)
    vectors = usable.groupBy(F.col("id").alias("of")).agg(F.max_by("embedding", "ord").alias("embedding"))
    is_case = F.col("statute_id").isNull()
    return documents.join(vectors, F.col("document_id") == F.col("of"), "left").select(
        F.col("document_id").alias("id"),
        F.when(is_case, "COURT_CASE").otherwise("STATUTE_ARTICLE").alias("document_type"),
        "title",
        F.col("content").alias("text"),
        F.when(is_case, "court_case").otherwise("statute_article").alias("source_type"),
        F.coalesce("statute_id", "document_id").alias("source_id"),
        "embedding",
    )


QUERIES = {
    "unified_report": unified_report,
    "stored_entities": stored_entities,
    "index_rows": index_rows,
    "stored_entities_whole": stored_entities_whole,
    "index_rows_whole": index_rows_whole,
}


def _unpivoted(sql: str, name: str, metrics: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS report, '{m}' AS metric, {m}::DOUBLE AS value FROM ({sql})" for m in metrics)


_KIND = "CASE WHEN statute_id IS NULL THEN 'COURT_CASE' ELSE 'STATUTE_ARTICLE' END"


def _json(name: str, column: str) -> str:
    return f"'\"{name}\":' || to_json({column})"


ORACLE_SQL = {
    "unified_report": " UNION ALL ".join(
        [
            _unpivoted(evaluation.BM25_CASES + evaluation.metrics_cte("bm25") + f" SELECT {evaluation.REPORT} FROM metrics", "retrieval", _RETRIEVAL),
            _unpivoted(pipeline.ORACLE_SQL["grounding_report"], "grounding", _GROUNDING),
            f"SELECT 'answers' AS report, 'pass_rate' AS metric, round(avg(CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS value FROM ({pipeline.ORACLE_SQL['answer_checks']})",
        ]
    ),
    "stored_entities": """
SELECT source || ':' || document_id AS id, source, document_id, '{"document_id":' || to_json(document_id) || CASE WHEN title IS NULL THEN '' ELSE ',"title":' || to_json(title) END || '}' AS raw_data
FROM (SELECT DISTINCT source, document_id, title FROM legal_documents)""",
    "index_rows": """
SELECT document_id AS id, CASE WHEN statute_id IS NULL THEN 'COURT_CASE' ELSE 'STATUTE_ARTICLE' END AS document_type, title, length(content) AS n_chars,
  CASE WHEN statute_id IS NULL THEN 'court_case' ELSE 'statute_article' END AS source_type, document_id || '#chunk-0' AS chunk_id
FROM (SELECT DISTINCT document_id, statute_id, title, content FROM legal_documents)""",
    "stored_entities_whole": f"""
SELECT source || ':' || document_id AS id, source, document_id, title, content,
  '{{' || concat_ws(',', {_json("id", "document_id")}, '"documentType":"' || {_KIND} || '"', {_json("title", "title")}, {_json("text", "content")},
    '"metadata":{{' || coalesce({_json("statuteId", "statute_id")}, '') || '}}',
    '"sourceRef":{{' || concat_ws(',', '"sourceType":"' || lower({_KIND}) || '"', {_json("sourceId", "coalesce(statute_id, document_id)")}) || '}}') || '}}' AS raw_data
FROM (SELECT DISTINCT source, document_id, statute_id, title, content FROM legal_documents)""",
    "index_rows_whole": f"""
SELECT document_id AS id, {_KIND} AS document_type, title, content AS text, lower({_KIND}) AS source_type, coalesce(statute_id, document_id) AS source_id, embedding
FROM (SELECT DISTINCT document_id, statute_id, title, content FROM legal_documents)
LEFT JOIN (SELECT id AS of, arg_max(embedding, ord) AS embedding FROM legal_index WHERE len(embedding) = 768 GROUP BY id) ON of = document_id""",
}
