"""Registered queries against DuckDB on small tables that hold the awkward cases, and on empty ones."""

import collections

import duckdb
import pytest

from statloom.plans import registry

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, title string, document_type string, statute_id string, retrieved_at timestamp_ntz",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "legal_documents": "id string, source string, document_id string, statute_id string, title string, content string, raw_data string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "raw_legal_data": "id string, source_system string, source_id string, raw_format string, content string, collected_at string",
    "legal_document_snapshots": "snapshot_no int, delivered_at timestamp_ntz, id string, source string, document_id string, statute_id string, title string, content string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "document_chunks": "id string, document_id string, text string, chunk_order int",
    "legal_index": "ord long, id string, document_type string, title string, text string, source_type string, source_id string, embedding array<float>",
    "legal_import_histories": "id string, source string, query string, imported_count int, status string, started_at timestamp_ntz, finished_at timestamp_ntz, error_message string",
    "statutes": "id string, law_id string, law_master_no string, title_ko string, title_en string, ministry string, law_type string, promulgation_date string, enforcement_date string, status string",
}
DOCUMENTS = [
    (0, "법률의 목적. 제3조(정의)에 따른다", "ko", "s", 20, "법률의 목적?", "STATUTE_ARTICLE", "a", None),
    (50, None, None, None, None, "목적을", "STATUTE_ARTICLE", "a", None),
    (100, " \n", "ko", "s", 2, "  ", "GUIDANCE", None, None),
    (150, "the Purpose of this law! purpose", "en", "t", 32, "purpose PURPOSE zzz", "STATUTE_ARTICLE", "b", None),
    (7, "목적 purpose " * 40, "ko", "s", 480, None, "COURT_CASE", None, None),
    (200, "", "ko", "s", 0, None, "GUIDANCE", "b", None),
    (250, "nothing", "en", "t", 7, "목적에서", "COURT_CASE", "a", None),
]
QUERIES = [
    "keyword_retrieve", "token_df", "bm25_search", "bm25_minimum_match", "tokens_by_rule", "claim_sentences", "cited_articles", "citation_segments", "case_metrics", "metrics_report", "failure_report", "prompts", "input_status",
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    empty, full = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("full")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(empty / f"{name}.parquet"))
        rows = DOCUMENTS if name == "documents" else []
        spark.createDataFrame(rows, schema).write.parquet(str(full / f"{name}.parquet"))
    return str(empty), str(full)


def test_sql_belongs_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_awkward_rows(spark, folders, name):
    _, full = folders
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{full}/documents.parquet/*.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = registry.queries()[name](spark, full)
    assert sorted(df.columns) == sorted(columns)
    plain = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert collections.Counter(map(plain, df.select(*columns).collect())) == collections.Counter(map(plain, result.fetchall()))


@pytest.mark.parametrize("name", ["p1_found", "p1_tables", "p2_found", "bm25_search", "rrf_fusion", "statute_articles", "upsert_documents", "claim_support", "rate_limit", "failure_report"])
def test_empty_tables(spark, folders, name):
    found = registry.queries()[name](spark, folders[0]).collect()
    assert all(r.n_cases == 0 for r in found) if name == "failure_report" else found == []


@pytest.mark.parametrize("name", ["p1_laws", "p1_cited_statutes", "ingest_statuses", "ingest_to_index", "index_results", "reindexed_documents", "import_runs", "case_grounding", "failed_cases", "failure_patterns", "prompt_requests", "letter_vectors", "json_documents", "chunk_parents", "document_urls", "embedded_search", "search_results"])
def test_chains_over_empty_tables(spark, folders, name):
    assert registry.queries()[name](spark, folders[0]).collect() == []


@pytest.mark.parametrize("name", ["overall_report", "case_grounding_report", "index_summary", "failure_summary", "ingest_to_table"])
def test_reports_over_empty_tables(spark, folders, name):
    (row,) = registry.queries()[name](spark, folders[0]).collect()
    assert not any(row)


@pytest.mark.parametrize("name", ["case_grounding", "overall_report", "failed_cases", "prompt_requests", "report_comparison", "regression_by_target", "bm25_fields", "filtered_results", "search_results"])
def test_chains_over_awkward_rows(spark, folders, name):
    test_awkward_rows(spark, folders, name)
