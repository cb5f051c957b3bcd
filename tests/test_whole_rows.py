"""Queries over whole rows: nothing of a document is left out, as in DuckDB."""

import datetime

import duckdb
import pytest
from test_queries import TABLES

from statloom.plans import registry

T1, T2 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
ROWS = {
    "legal_documents": [
        ("i", "s", "a", "st", "title", 'old "text"\n\ttwo', "{}", T1, T1),
        ("i", "s", "a", "st", "title", 'old "text"\n\ttwo', "{}", T1, T1),
        ("j", "s", "b", None, None, None, None, T1, T1),
        ("k", "s", None, None, "no id", "text", None, T1, None),
    ],
    "legal_document_snapshots": [(1, T2, "i2", "t", "a", "st2", "title", "new text", T2, T2), (1, T2, "n", "t", "c", None, "c", "added", T2, T2), (1, T2, "o", "t", None, None, "o", "null id", T2, T2)],
    "legal_index": [
        (1, "a", "STATUTE_ARTICLE", "title", "old", "statute_article", "st", [1.0] * 768),
        (2, "a", "STATUTE_ARTICLE", "title", "new", "statute_article", "st", [2.0] * 768),
        (3, "a", None, "title", None, None, None, [3.0]),
        (4, "b", "COURT_CASE", None, "case", "court_case", "b", None),
    ],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    for name, rows in ROWS.items():
        spark.createDataFrame(rows, TABLES[name]).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


@pytest.mark.parametrize("name", ["stored_entities_whole", "index_rows_whole", "upsert_documents_whole", "indexed_documents_whole"])
def test_same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ROWS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = registry.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


def test_content_and_vectors_arrive(spark, folder):
    found = lambda name: registry.queries()[name](spark, folder).collect()
    assert '"text":"old \\"text\\"\\n\\ttwo"' in next(r.raw_data for r in found("stored_entities_whole") if r.document_id == "a")
    row = next(r for r in found("index_rows_whole") if r.id == "a")
    assert (row.text, row.source_id, row.embedding[0]) == ('old "text"\n\ttwo', "st", 2.0)
    assert next((r.content, r.source, r.statute_id, r.created_at) for r in found("upsert_documents_whole") if r.document_id == "a") == ("new text", "t", "st2", T1)
    assert next((r.ord, r.text, len(r.embedding)) for r in found("indexed_documents_whole") if r.id == "a") == (1, None, 1)
