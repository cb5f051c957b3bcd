"""Ingestion, storage, context and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import text as T
from statloom.operators import context as C
from statloom.operators import ingest, stateful, store
from statloom.plans import problems as P
from statloom.plans import retrieval as R
from statloom.tables import load


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all search items."""
    return ingest.search_documents(load(spark, sf_dir, "raw_legal_data"), "id", "content", "source_id")


def statute_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all articles in the stored payloads."""
    return ingest.statute_articles(load(spark, sf_dir, "legal_documents"), "document_id", "raw_data")


def import_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed rows whose document is not stored."""
    incoming = load(spark, sf_dir, "legal_index").select("ord", F.col("id").alias("document_id"), "source_type")
    return store.import_policy(incoming, load(spark, sf_dir, "legal_documents"), "document_id")


def import_policy_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered rows whose document is not stored."""
    incoming = load(spark, sf_dir, "legal_document_snapshots").select("snapshot_no", "source", "document_id")
    return store.import_policy(incoming, load(spark, sf_dir, "legal_documents"), "document_id")


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of known and unknown documents, by their order."""
    return store.import_counts(load(spark, sf_dir, "document_chunks"), load(spark, sf_dir, "legal_documents"), "document_id", "chunk_order")


_STORED = ["document_id", "title", "created_at", "updated_at"]


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored documents after all deliveries: the newest values, the oldest time of creation."""
    target = store.latest_by_key(load(spark, sf_dir, "legal_documents").select(*_STORED), "document_id", ["updated_at"])
    return store.upsert(target, load(spark, sf_dir, "legal_document_snapshots").select(*_STORED), "document_id", ["created_at"], ["updated_at"])


_WHOLE = ["id", "source", "document_id", "statute_id", "title", "content", "created_at", "updated_at"]


def upsert_documents_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored documents after all deliveries, with all columns that deliveries hold."""
    target = store.latest_by_key(load(spark, sf_dir, "legal_documents").select(*_WHOLE), "document_id", ["updated_at"])
    return store.upsert(target, load(spark, sf_dir, "legal_document_snapshots").select(*_WHOLE), "document_id", ["created_at"], ["updated_at"])


def import_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import runs, newest first, with their statuses in one spelling."""
    histories = load(spark, sf_dir, "legal_import_histories").distinct()
    return histories.select("id", "source", F.lower(F.trim("status")).alias("status"), "imported_count", "started_at").orderBy(F.col("started_at").desc_nulls_last(), "id")


def statutes_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_seen(load(spark, sf_dir, "documents"), "statute_id", "doc_id")


def index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 100 ordinals of the index; rows without a usable vector have failed."""
    failed = F.coalesce(F.size("embedding") != 768, F.lit(True))
    return store.index_batches(load(spark, sf_dir, "legal_index").select("ord", "embedding"), "ord", failed)


def indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index by document: place of the first indexing, values of the last."""
    return store.indexed_documents(load(spark, sf_dir, "legal_index").select("id", F.col("ord").alias("indexed_ord"), "title"), "id", "indexed_ord", ["title"])


_INDEXED = ["document_type", "title", "text", "source_type", "source_id", "embedding"]


def indexed_documents_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index by document, with all of its columns: place of the first indexing, values of the last."""
    return store.indexed_documents(load(spark, sf_dir, "legal_index").select("id", F.col("ord").alias("indexed_ord"), *_INDEXED), "id", "indexed_ord", _INDEXED)


def statute_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes with the number of their documents; a statute without any has none."""
    counts = load(spark, sf_dir, "documents").groupBy("statute_id").agg(F.count("*").alias("n_documents"))
    return (
        load(spark, sf_dir, "statutes")
        .join(counts, F.col("id") == F.col("statute_id"), "left")
        .select("id", F.coalesce(T.non_empty("title_ko"), T.non_empty("title_en"), F.lit("")).alias("title"), "ministry", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
    )


def _cited_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("document_id"), "title", "text", F.col("document_type").alias("source_type"), F.lit("").alias("source_url")
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation of each retrieved document, in the order of the ranks."""
    found = C.prompt_context(R.bm25(spark, sf_dir), _cited_corpus(spark, sf_dir), R.asked(spark, sf_dir))
    return found.select("query_id", F.posexplode("citations").alias("place", "c")).select("query_id", "place", F.col("c.id").alias("citation_id"), "c.source_type", "c.title", "c.snippet")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt of each query over its retrieved documents."""
    return C.prompt_text(C.prompt_context(R.bm25(spark, sf_dir), _cited_corpus(spark, sf_dir), R.asked(spark, sf_dir)))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk as an answer, to be grounded in the document it is from; a document counts once."""
    documents = store.latest_by_key(load(spark, sf_dir, "legal_documents").select("document_id", "content", "updated_at"), "document_id", ["updated_at", "content"])
    chunks = load(spark, sf_dir, "document_chunks").select("id", F.col("document_id").alias("of"), "text").distinct()
    return chunks.join(documents, F.col("of") == F.col("document_id"), "left").select(
        F.concat_ws("/", "id", F.md5(F.coalesce("text", F.lit("")))).alias("answer_id"), F.col("text").alias("answer"), F.col("content").alias("context"), "document_id"
    )


def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claim_support(_answers(spark, sf_dir)).select("answer_id", "claim_no", "score", "supported")


def grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    return C.grounding_report(answers, C.claim_support(answers))


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each chunk as an answer that should name its document's first line and cite the articles that the document cites."""
    answers = _answers(spark, sf_dir).select(
        "answer_id",
        "answer",
        F.array(T.first_line("context")).alias("keywords"),
        T.citations("answer").alias("cited"),
        F.coalesce(T.citations("context"), F.array().cast("array<string>")).alias("expected_citations"),
    )
    return C.answer_checks(answers)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")
    return load(spark, sf_dir, "events").select("user_id", at, "event_id", (F.col("event_type") == "error").alias("failed"))


DAY_MS = 86_400_000


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a day for each user, windows from the user's own requests."""
    return stateful.rate_limit(_requests(spark, sf_dir), "user_id", "at_ms", "event_id", 3, DAY_MS)


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breaker for each user that two errors in a row open for half a day."""
    return stateful.circuit_breaker(_requests(spark, sf_dir), "user_id", "at_ms", "event_id", "failed", 2, DAY_MS // 2)


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each request: refused by the limiter, invalid (its properties hold more than nine characters), or served."""
    return stateful.admission(load(spark, sf_dir, "events"), rate_limit(spark, sf_dir), "event_id", "props", 9)


def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.metric_rollup(load(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")


def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of each source by its worst import."""
    status = F.lower(F.trim("status"))
    checks = load(spark, sf_dir, "legal_import_histories").distinct()
    mapped = F.when(status == "completed", "healthy").when(status == "running", "degraded").otherwise("unhealthy")
    return stateful.health(checks.withColumn("check", mapped), "source", "check")


def input_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each language would be admitted as a question of at most 2,000 characters."""
    texts = load(spark, sf_dir, "documents").select("lang", stateful.input_status(F.col("text"), 2_000).alias("status"))
    return texts.groupBy("lang", "status").agg(F.count("*").alias("n"))


QUERIES = {
    "search_documents": search_documents,
    "statute_articles": statute_articles,
    "import_policy": import_policy,
    "import_policy_deliveries": import_policy_deliveries,
    "import_counts": import_counts,
    "upsert_documents": upsert_documents,
    "upsert_documents_whole": upsert_documents_whole,
    "import_history": import_history,
    "statutes_first_seen": statutes_first_seen,
    "index_batches": index_batches,
    "indexed_documents": indexed_documents,
    "indexed_documents_whole": indexed_documents_whole,
    "statute_catalogue": statute_catalogue,
    "citations": citations,
    "prompts": prompts,
    "claim_support": claim_support,
    "grounding_report": grounding_report,
    "answer_checks": answer_checks,
    "rate_limit": rate_limit,
    "circuit_breaker": circuit_breaker,
    "admission": admission,
    "metric_rollup": metric_rollup,
    "health_status": health_status,
    "input_status": input_status,
}


def _first_line(text: str) -> str:
    return f"coalesce(list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {R.sql_trim('x')}), lambda x: x <> '')[1], '')"


_ANSWERS = """
WITH RECURSIVE latest AS (SELECT document_id, content FROM (SELECT document_id, content, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST, content DESC NULLS LAST) AS rn
                FROM legal_documents) WHERE rn = 1),
answers AS (SELECT c.id || '/' || md5(coalesce(c.text, '')) AS answer_id, c.text AS answer, l.content AS context, l.document_id
            FROM (SELECT DISTINCT id, document_id, text FROM document_chunks) c LEFT JOIN latest l ON l.document_id = c.document_id)"""
_SUPPORT = (
    _ANSWERS
    + f""",
split_claims AS (SELECT answer_id, lower(coalesce(context, '')) AS context,
  list_filter(list_transform(string_split_regex(coalesce(answer, ''), '[.!?\\n]+'), lambda x: {R.sql_trim('x')}), lambda x: x <> '') AS claims FROM answers),
each AS (SELECT answer_id, context, claims[i] AS claim, i - 1 AS claim_no FROM (SELECT *, unnest(range(1, len(claims) + 1)) AS i FROM split_claims)),
termed AS (SELECT answer_id, claim_no, context, {R.sql_claim_terms('claim')} AS terms FROM each),
support AS (SELECT answer_id, claim_no,
  CASE WHEN len(terms) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(terms, lambda t: contains(context, t)))::DOUBLE / len(terms), 6) END AS score FROM termed)"""
)
_REQUESTS = """
WITH RECURSIVE ordered AS (
  SELECT user_id, epoch_us(ts) // 1000 AS at_ms, event_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),"""

def _member(item: str, name: str) -> str:
    return P.scalar_sql(f"json_extract({item}, '$.{name}')")


def _untrimmed(item: str, name: str) -> str:
    value = f"json_extract({item}, '$.{name}')"
    return f"nullif(CASE json_type({value}) WHEN 'OBJECT' THEN json_extract_string({value}, '$.content') ELSE json_extract_string({value}, '$') END, '')"


def _number(value: str) -> str:
    return f"CASE WHEN regexp_extract({value}, '^([+-]?[0-9]+)', 1) = '' THEN {value} ELSE regexp_extract({value}, '^([+-]?[0-9]+)', 1)::HUGEINT::VARCHAR END"


def _padded(value: str, width: int) -> str:
    return f"right(repeat('0', {width}) || regexp_replace({value}, '[^0-9]', '', 'g'), {width})"


_ARTICLES_SQL = (
    P.NODES_SQL
    + f""",
lines AS (SELECT record_id, string_split(path, '.')[1] AS article, list(line ORDER BY place) AS lines FROM (
    SELECT DISTINCT record_id, path, string_split(path, '.')::INT[] AS place, line FROM (
      SELECT record_id, path, {_member("item", "항내용")} AS line FROM paragraph UNION ALL SELECT record_id, path, {_member("item", "호내용")} FROM item
      UNION ALL SELECT record_id, path, {_member("item", "목내용")} FROM subitem)
    WHERE line IS NOT NULL) GROUP BY ALL),
basics AS (SELECT record_id, max({_member("b", "법령ID")}) AS statute_id, max(coalesce({_member("b", "법령명_한글")}, {_member("b", "법령명한글")}, {_member("b", "법령명")})) AS statute_title,
    max({_member("b", "공포일자")}) AS promulgated, max({_member("b", "시행일자")}) AS enforced
  FROM (SELECT record_id, CASE WHEN json_type(r, '$.기본정보') = 'OBJECT' THEN json_extract(r, '$.기본정보') ELSE r END AS b FROM roots) WHERE json_type(b) = 'OBJECT' GROUP BY ALL),
entries AS (
  SELECT DISTINCT a.record_id, a.path::INT AS place, {_number(_member("a.item", "조문번호"))} AS number, {_number(_member("a.item", "조문가지번호"))} AS branch,
    {_member("a.item", "조문제목")} AS article_title, {_member("a.item", "조문내용")} AS content, coalesce(l.lines, []) AS lines, b.statute_id, coalesce(b.statute_title, '') AS st, b.promulgated, b.enforced
  FROM article a LEFT JOIN lines l ON l.record_id = a.record_id AND l.article = a.path LEFT JOIN basics b ON b.record_id = a.record_id
  WHERE a.record_id IN (SELECT document_id FROM legal_documents)),
shown AS (SELECT *, number || CASE WHEN branch <> '0' THEN '-' || branch ELSE '' END AS article FROM entries WHERE number IS NOT NULL AND (content IS NOT NULL OR len(lines) > 0)
  AND NOT coalesce(article_title IS NULL AND len(lines) = 0 AND regexp_matches(content, '^제\\s*\\d+\\s*(편|장|절|관)(\\s|$)'), false)),
best AS (SELECT *, coalesce(statute_id, record_id) || ':' || article AS document_id,
  row_number() OVER (PARTITION BY record_id, coalesce(statute_id, record_id) || ':' || article
                     ORDER BY (CASE WHEN len(lines) > 0 THEN 2 ELSE 0 END) + coalesce(length(content), 0) / 10000 DESC, place) AS rn FROM shown)
SELECT document_id, record_id, statute_id, article, {_padded("number", 4)} || {_padded("coalesce(branch, '0')", 2)} AS jo,
  {R.sql_trim("st || ' 제' || article || '조' || coalesce('(' || article_title || ')', '')")} AS title,
  concat_ws(chr(10) || chr(10), concat_ws(chr(10), CASE WHEN st <> '' THEN '법령명: ' || st END, '조문: 제' || article || '조', '조문 제목: ' || article_title, '공포일자: ' || promulgated, '시행일자: ' || enforced),
    nullif(concat_ws(chr(10), regexp_replace(content, '\\r\\n?', chr(10), 'g'), CASE WHEN len(lines) > 0 THEN array_to_string(lines, chr(10)) END), '')) AS text
FROM best WHERE rn = 1"""
)

_RATE_LIMIT = (
    _REQUESTS
    + f"""
walk AS (
  SELECT user_id, at_ms, event_id, rn, at_ms AS opened, 1 AS used, true AS allowed FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.at_ms, o.event_id, o.rn, CASE WHEN o.at_ms - w.opened >= {DAY_MS} THEN o.at_ms ELSE w.opened END,
    CASE WHEN o.at_ms - w.opened >= {DAY_MS} THEN 1 ELSE least(w.used + 1, 3) END, o.at_ms - w.opened >= {DAY_MS} OR w.used < 3
  FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.rn = w.rn + 1)"""
)

_NEWEST = ", ".join(f"{c} DESC NULLS LAST" for c in ["updated_at", *(c for c in _WHOLE if c not in ("updated_at", "document_id"))])

ORACLE_SQL = {
    "search_documents": P.NODES_SQL
    + f""" SELECT DISTINCT record_id, position, coalesce({_untrimmed("item", "법령ID")}, {_untrimmed("item", "법령일련번호")}, source_id) AS document_id, coalesce({_untrimmed("item", "법령명한글")}, '') AS title,
  concat_ws(' ', {", ".join(_untrimmed("item", n) for n in ("법령명한글", "법령구분명", "소관부처명", "공포일자", "시행일자"))}) AS text
FROM law JOIN raw_legal_data r ON r.id = record_id""",
    "statute_articles": _ARTICLES_SQL,
    "import_policy": """
SELECT ord, id AS document_id, source_type FROM legal_index i WHERE id IS NULL OR NOT EXISTS (SELECT 1 FROM legal_documents d WHERE d.document_id = i.id)""",
    "import_policy_deliveries": """
SELECT snapshot_no, source, document_id FROM legal_document_snapshots s WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM legal_documents WHERE document_id IS NOT NULL)""",
    "import_counts": """
SELECT chunk_order, count(*) AS n_total, count(*) FILTER (d.document_id IS NULL) AS n_saved, count(*) FILTER (d.document_id IS NOT NULL) AS n_skipped
FROM document_chunks c LEFT JOIN (SELECT DISTINCT document_id FROM legal_documents) d ON d.document_id = c.document_id GROUP BY chunk_order""",
    "upsert_documents": """
WITH stored AS (SELECT * FROM (SELECT document_id, title, created_at, updated_at, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST, created_at DESC NULLS LAST) AS rn
   FROM legal_documents) WHERE rn = 1),
fresh AS (SELECT * FROM (SELECT document_id, title, created_at, updated_at, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST, created_at DESC NULLS LAST) AS rn
   FROM legal_document_snapshots WHERE document_id IS NOT NULL) WHERE rn = 1)
SELECT coalesce(s.document_id, f.document_id) AS document_id, CASE WHEN f.rn = 1 THEN f.title ELSE s.title END AS title,
       coalesce(s.created_at, f.created_at) AS created_at, CASE WHEN f.rn = 1 THEN f.updated_at ELSE s.updated_at END AS updated_at
FROM stored s FULL JOIN fresh f ON s.document_id = f.document_id
UNION ALL SELECT document_id, title, created_at, updated_at FROM legal_document_snapshots WHERE document_id IS NULL""",
    "upsert_documents_whole": f"""
WITH stored AS (SELECT * FROM (SELECT {", ".join(_WHOLE)}, row_number() OVER (PARTITION BY document_id ORDER BY {_NEWEST}) AS rn FROM legal_documents) WHERE rn = 1),
fresh AS (SELECT * FROM (SELECT {", ".join(_WHOLE)}, row_number() OVER (PARTITION BY document_id ORDER BY {_NEWEST}) AS rn FROM legal_document_snapshots WHERE document_id IS NOT NULL) WHERE rn = 1)
SELECT coalesce(s.document_id, f.document_id) AS document_id, coalesce(s.created_at, f.created_at) AS created_at,
  {", ".join(f"CASE WHEN f.rn = 1 THEN f.{c} ELSE s.{c} END AS {c}" for c in _WHOLE if c not in ("document_id", "created_at"))}
FROM stored s FULL JOIN fresh f ON s.document_id = f.document_id
UNION ALL SELECT document_id, created_at, {", ".join(c for c in _WHOLE if c not in ("document_id", "created_at"))} FROM legal_document_snapshots WHERE document_id IS NULL""",
    "import_history": "SELECT DISTINCT id, source, lower(trim(status)) AS status, imported_count, started_at FROM (SELECT DISTINCT * FROM legal_import_histories)",
    "statutes_first_seen": "SELECT statute_id, min(doc_id) AS first_seen FROM documents WHERE statute_id IS NOT NULL GROUP BY ALL",
    "index_batches": """
SELECT ord // 100 AS batch, count(*) AS n_total, count(*) FILTER (coalesce(len(embedding), 0) = 768) AS n_indexed, count(*) FILTER (coalesce(len(embedding), 0) <> 768) AS n_failed
FROM legal_index GROUP BY ALL""",
    "indexed_documents": """
SELECT id, min(ord) AS ord, arg_max(coalesce(title, chr(0)), (ord, coalesce(title, chr(0)))) AS title FROM legal_index GROUP BY id""",
    "indexed_documents_whole": f"""
SELECT id, ord, {", ".join(_INDEXED)} FROM (SELECT *EXCLUDE (ord), min(ord) OVER (PARTITION BY id) AS ord, row_number() OVER (PARTITION BY id ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in ["ord", *_INDEXED])}) AS rn
FROM legal_index) WHERE rn = 1""",
    "statute_catalogue": f"""
SELECT s.id, coalesce(nullif({R.sql_trim('title_ko')}, ''), nullif({R.sql_trim('title_en')}, ''), '') AS title, ministry, coalesce(n, 0) AS n_documents
FROM statutes s LEFT JOIN (SELECT statute_id, count(*) AS n FROM documents GROUP BY ALL) d ON d.statute_id = s.id""",
    "citations": R.BM25
    + f""" SELECT query_id, rank - 1 AS place, 'citation:' || d.doc_id AS citation_id, d.document_type AS source_type, coalesce(d.title, '') AS title, {_first_line('d.text')} AS snippet
FROM bm25 b JOIN documents d ON d.doc_id = b.ord""",
    "prompts": R.BM25
    + """, blocks AS (SELECT query_id,
  string_agg('[' || rank || '] ' || coalesce(d.title, '') || chr(10) || 'Source: ' || d.doc_id || chr(10) || 'Text: ' || coalesce(d.text, ''), chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg(rank || '. ' || coalesce(d.title, '') || ' (' || d.doc_id || ')', chr(10) ORDER BY rank) AS refs
  FROM bm25 b JOIN documents d ON d.doc_id = b.ord GROUP BY ALL)
SELECT query_id, CASE WHEN context IS NULL THEN 'Question: ' || query || chr(10) || chr(10) || 'No context was found.'
  ELSE 'Question: ' || query || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Citations:' || chr(10) || refs END AS prompt
FROM asked LEFT JOIN blocks USING (query_id)""",
    "claim_support": _SUPPORT + " SELECT *, score >= 0.6 AS supported FROM support",
    "grounding_report": _SUPPORT
    + """, per_answer AS (SELECT a.answer_id, coalesce(g, 1.0) AS grounded, coalesce(u, 0) AS unsupported FROM answers a LEFT JOIN (
  SELECT answer_id, avg(CASE WHEN score >= 0.6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS g, count(*) FILTER (score < 0.6) AS u FROM support GROUP BY ALL) s USING (answer_id))
SELECT count(*) AS n_answers, round(avg(grounded), 6) AS grounded_share, sum(unsupported)::BIGINT AS unsupported_claims, count(*) FILTER (unsupported > 0) AS answers_with_unsupported FROM per_answer""",
    "answer_checks": _ANSWERS
    + f""", checked AS (SELECT answer_id, trim(lower(coalesce(answer, ''))) <> '' AS not_empty,
  CASE WHEN contains(lower(coalesce(answer, '')), lower({_first_line('context')})) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS keyword_share,
  len({R.sql_citations("coalesce(answer, '')")}) > 0 AS has_citation, list_distinct({R.sql_citations("coalesce(context, '')")}) AS expected, list_distinct({R.sql_citations("coalesce(answer, '')")}) AS cited FROM answers),
shared AS (SELECT answer_id, not_empty, keyword_share, has_citation, CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(expected, cited))::DOUBLE / len(expected), 6) END AS citation_share FROM checked)
SELECT *, not_empty AND keyword_share >= 1 AND has_citation AND citation_share >= 1 AS passed FROM shared""",
    "rate_limit": _RATE_LIMIT + " SELECT user_id, at_ms, event_id, allowed, 3 - used AS remaining FROM walk",
    "admission": _RATE_LIMIT
    + """ SELECT event_id, CASE WHEN NOT allowed THEN 429 WHEN trim(coalesce(props, '')) = '' OR length(props) > 9 OR contains(props, chr(0)) THEN 400 ELSE 200 END AS status
FROM walk JOIN events USING (event_id)""",
    "circuit_breaker": _REQUESTS
    + f"""
walk AS (
  SELECT user_id, at_ms, event_id, rn, true AS admitted, 'closed' AS state, CASE WHEN failed THEN 1 ELSE 0 END AS fails, 0::BIGINT AS opened FROM ordered WHERE rn = 1
  UNION ALL
  SELECT user_id, at_ms, event_id, rn, admitted,
    CASE WHEN NOT admitted THEN 'open' WHEN failed AND (half OR fails + 1 >= 2) THEN 'open' WHEN failed THEN before ELSE 'closed' END,
    CASE WHEN NOT admitted THEN fails WHEN failed THEN fails + 1 ELSE 0 END,
    CASE WHEN admitted AND failed AND (half OR fails + 1 >= 2) THEN at_ms ELSE opened END
  FROM (SELECT o.user_id, o.at_ms, o.event_id, o.rn, o.failed, w.fails, w.opened, w.state = 'open' AND o.at_ms - w.opened >= {DAY_MS // 2} AS half,
          w.state <> 'open' OR o.at_ms - w.opened >= {DAY_MS // 2} AS admitted, w.state AS before
        FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.rn = w.rn + 1))
SELECT user_id, at_ms, event_id, admitted, state FROM walk""",
    "metric_rollup": """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS name, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY ALL""",
    "health_status": """
SELECT source, ['healthy', 'degraded', 'unhealthy'][max(CASE lower(trim(status)) WHEN 'completed' THEN 1 WHEN 'running' THEN 2 ELSE 3 END)] AS status, count(*) AS n_checks
FROM (SELECT DISTINCT * FROM legal_import_histories) GROUP BY source""",
    "input_status": f"""
SELECT lang, CASE WHEN {R.sql_trim("coalesce(text, '')")} = '' THEN 'empty' WHEN length(text) > 2000 THEN 'too-long' WHEN contains(text, chr(0)) THEN 'invalid' ELSE 'ok' END AS status, count(*) AS n
FROM documents GROUP BY ALL""",
}
