"""Reading and writing of documents, addresses, and what is done with results of a search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators import fusion, ingest, retrieval, vector
from statloom.plans import pipeline
from statloom.plans import retrieval as R
from statloom.plans.chains import letter_vectors_sql
from statloom.session import ensure_checkpoint_dir
from statloom.sources import documents as sources
from statloom.tables import load

SEARCH, DETAIL, VIEW, KEY = "https://law.example/search", "https://law.example/detail", "https://law.example/view", "key"
FIELDS = ("title^3", "text^0.5")
SECRETS = ["HTTP", "30"]


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and cases written as JSON files, read again and mapped to documents."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/json-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "legal_documents").select("document_id", "statute_id", "title", "content").distinct()
    articles = rows.filter("statute_id is not null").select(F.col("document_id").alias("id"), F.col("statute_id").alias("statuteId"), F.col("title").alias("articleTitle"), F.col("content").alias("text"))
    cases = rows.filter("statute_id is null").select(F.col("document_id").alias("id"), F.col("title").alias("caseName"), F.col("content").alias("fullText"))
    sources.write_json(articles, f"{folder}/articles")
    sources.write_json(cases, f"{folder}/cases")
    read = sources.all_documents(sources.read_json(spark, f"{folder}/articles", sources.ARTICLE, lines=True), sources.read_json(spark, f"{folder}/cases", sources.CASE, lines=True))
    return read.select("id", F.col("documentType").alias("document_type"), "title", "text", F.col("sourceRef.sourceType").alias("source_type"))


def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, found) for every document that chunks name: is it stored?"""
    named = load(spark, sf_dir, "document_chunks").select("document_id").distinct()
    return sources.exists(load(spark, sf_dir, "legal_documents"), "document_id", named)


def document_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the search for a statute, of its articles, of the statute and of its first article."""
    return load(spark, sf_dir, "statutes").select(
        "id",
        sources.search_url(SEARCH, KEY, F.col("title_ko")).alias("search_url"),
        sources.detail_url(DETAIL, KEY, F.col("law_id")).alias("detail_url"),
        sources.view_url(VIEW, F.col("law_id")).alias("view_url"),
        sources.view_url(VIEW, F.col("law_id"), F.lit("000100")).alias("article_url"),
    )


def statute_articles_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, headings taken as such only where a letter or digit follows them at once."""
    return ingest.statute_articles(load(spark, sf_dir, "legal_documents"), "document_id", "raw_data", strict_headings=True)


def bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted search with boosts of its fields as text."""
    return R.bm25(spark, sf_dir, retrieval.Bm25Config.of_fields(*FIELDS))


def filtered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the weighted search that are articles of statutes, ranked anew."""
    kinds = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "document_type")
    return fusion.filtered(R.bm25(spark, sf_dir), kinds, F.col("document_type") == "STATUTE_ARTICLE")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the weighted search as results: the document's fields, the source of the hit, its score; matched terms are dropped."""
    fields = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "title", "text", "document_type", F.col("statute_id").alias("source_id"))
    return R.bm25(spark, sf_dir).join(fields, "ord").select("query_id", F.col("ord").alias("id"), "title", "text", "document_type", "source_id", F.lit("index").alias("source"), "score", "rank")


def embedded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked titles are embedded, then searched among the embedded titles of all documents."""
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), vector.letter_vector("title").alias("vector"))
    asked = R.asked(spark, sf_dir).select("query_id", vector.letter_vector("query").alias("vector"))
    return vector.knn_search(rows, asked, R.SIZE)


def redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of failed imports without the secrets that they might name."""
    return load(spark, sf_dir, "legal_import_histories").select("id", ingest.redacted(F.col("error_message"), SECRETS).alias("message")).distinct()


QUERIES = {
    "json_documents": json_documents,
    "chunk_parents": chunk_parents,
    "document_urls": document_urls,
    "statute_articles_strict": statute_articles_strict,
    "bm25_fields": bm25_fields,
    "filtered_results": filtered_results,
    "search_results": search_results,
    "embedded_search": embedded_search,
    "redacted_messages": redacted_messages,
}


def _encoded(column: str) -> str:
    """Form encoding: a blank is a plus, an asterisk stays, a tilde does not."""
    return f"replace(replace(replace(url_encode({column}), '%20', '+'), '%2A', '*'), '~', '%7E')"


_TRIMMED = "nullif(trim({}, ' '), '')"

ORACLE_SQL = {
    "json_documents": f"""
SELECT document_id AS id, CASE WHEN statute_id IS NULL THEN 'COURT_CASE' ELSE 'STATUTE_ARTICLE' END AS document_type,
  CASE WHEN statute_id IS NULL THEN coalesce({_TRIMMED.format("title")}, '') ELSE title END AS title,
  CASE WHEN statute_id IS NULL THEN coalesce({_TRIMMED.format("content")}, '') ELSE content END AS text,
  CASE WHEN statute_id IS NULL THEN 'court_case' ELSE 'statute_article' END AS source_type
FROM (SELECT DISTINCT document_id, statute_id, title, content FROM legal_documents)""",
    "chunk_parents": "SELECT document_id, document_id IS NOT NULL AND document_id IN (SELECT document_id FROM legal_documents WHERE document_id IS NOT NULL) AS found FROM (SELECT DISTINCT document_id FROM document_chunks)",
    "document_urls": f"""
SELECT id, '{SEARCH}?OC={KEY}&target=law&type=JSON&display=100&query=' || {_encoded("title_ko")} AS search_url, '{DETAIL}?OC={KEY}&target=law&type=JSON&ID=' || {_encoded("law_id")} AS detail_url,
  '{VIEW}?ID=' || {_encoded("law_id")} AS view_url, '{VIEW}?ID=' || {_encoded("law_id")} || '&JO=000100' AS article_url FROM statutes""",
    "statute_articles_strict": pipeline.ORACLE_SQL["statute_articles"].replace("(편|장|절|관)(\\s|$)", "(편|장|절|관)[A-Za-z0-9_]"),
    "bm25_fields": R.TERMS + R.bm25_cte("boosted", retrieval.Bm25Config(title_boost=3.0, text_boost=0.5)) + " SELECT * FROM boosted",
    "filtered_results": R.BM25
    + """ SELECT query_id, ord, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
FROM bm25 WHERE ord IN (SELECT doc_id FROM documents WHERE document_type = 'STATUTE_ARTICLE')""",
    "search_results": R.BM25 + " SELECT query_id, doc_id AS id, title, text, document_type, statute_id AS source_id, 'index' AS source, score, rank FROM bm25 JOIN documents ON doc_id = ord",
    "embedded_search": "WITH "
    + letter_vectors_sql("SELECT doc_id AS key, title AS text FROM documents")
    + """,
members AS (SELECT key AS ord, vector::DOUBLE[768] AS v FROM vectors WHERE vector IS NOT NULL),
compared AS (SELECT q.ord AS query_id, d.ord AS ord, coalesce(round(nullif(array_cosine_similarity(q.v, d.v), 'nan'::DOUBLE), 6), 0.0) AS score FROM members q CROSS JOIN members d WHERE q.ord % 50 = 0)
SELECT query_id, ord, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM compared) WHERE rank <= 10""",
    "redacted_messages": "SELECT DISTINCT id, replace(replace(error_message, 'HTTP', '***'), '30', '***') AS message FROM legal_import_histories",
}
