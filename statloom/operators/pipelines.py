"""Chains over whole tables: search, details, articles and a sink, with a status for everything that came in.

Nothing fails silently and nothing stops the rest: what could not be read, found or stored comes out as a row with its
status. An empty first stage is an error, as there is nothing to do then.

Defined cases
- Null ids are no statutes; a statute that was found often is fetched once. A statute without a record has the status
  ``missing``, one whose records are all no JSON ``unreadable``, one without any article ``empty``, others ``ok``.
- A sink may refuse documents or fail as a whole. Refused ones are tried again ``max_retries`` times, and after a failure
  all that remain of the batch. A document that is sent twice is told of twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators.ingest import statute_articles
from statloom.operators.nested import decode_payload


class RefusedDocuments(Exception):
    """What a sink raises for the documents of a batch that it refused; it has taken the others."""

    def __init__(self, ids: Iterable[str]) -> None:
        super().__init__("documents were refused")
        self.ids = frozenset(ids)


def create_if_absent(spark: SparkSession, path: str, schema: str) -> bool:
    """Make an empty table at ``path`` unless there is one; tells whether it was made."""
    try:
        spark.read.parquet(path)
        return False
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return True


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Append (id, vector) to a table of vectors."""
    vectors.select("id", "vector").write.mode("append").parquet(path)


def bulk_index(documents: DataFrame, key: str, send: Callable[[pa.RecordBatch], None], batch_size: int = 100, max_retries: int = 0) -> DataFrame:
    """(key, indexed, attempts): each document as ``send`` took or refused it, in batches of ``batch_size``.

    ``send`` runs in the tasks. It raises RefusedDocuments for those it did not take; any other error means that it took none.
    """
    at = documents.columns.index(key)

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                ids = part.column(at).to_pylist()
                indexed, attempts, remaining = [False] * len(ids), [0] * len(ids), [*range(len(ids))]
                for _ in range(max_retries + 1):
                    if not remaining:
                        break
                    for i in remaining:
                        attempts[i] += 1
                    try:
                        send(part.take(pa.array(remaining)))
                        refused: frozenset = frozenset()
                    except RefusedDocuments as e:
                        refused = e.ids
                    except Exception:  # noqa: BLE001 - whatever a sink raises, its documents are told of as not indexed
                        continue
                    for i in remaining:
                        indexed[i] = ids[i] not in refused
                    remaining = [i for i in remaining if not indexed[i]]
                yield pa.RecordBatch.from_arrays([part.column(at), pa.array(indexed, pa.bool_()), pa.array(attempts, pa.int32())], names=[key, "indexed", "attempts"])

    return documents.mapInArrow(store, f"`{key}` {documents.schema[key].dataType.simpleString()}, indexed boolean, attempts int")


def index_summary(results: DataFrame) -> DataFrame:
    """One row: (n_total, n_indexed, n_failed) of what :func:`bulk_index` told; the failed ids are its own rows."""
    return results.agg(F.count("*").alias("n_total"), F.count_if("indexed").alias("n_indexed"), F.count_if(~F.col("indexed")).alias("n_failed"))


def is_readable(payload):
    """Column: does a payload hold a JSON object or list?"""

    @F.arrow_udf("boolean")
    def readable(payloads: pa.Array) -> pa.Array:
        return pa.array([decode_payload(x) is not None for x in payloads.to_pylist()], pa.bool_())

    return readable(payload)


def staged_articles(found: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles of all statutes that a search found, and the status of each.

    ``found`` has statute_id, ``details`` (statute_id, record_id, payload). The articles are those of
    :func:`~statloom.operators.ingest.statute_articles`; the statuses (statute_id, n_records, n_articles, status).
    """
    statutes = found.select("statute_id").filter("statute_id is not null").distinct()
    fetched = details.join(statutes, "statute_id", "left_semi").distinct()
    articles = statute_articles(fetched, "record_id", "payload")
    per_record = articles.groupBy(F.col("record_id").alias("a_record")).agg(F.count("*").alias("n_articles"))
    told = fetched.select("statute_id", "record_id", is_readable("payload").alias("readable")).join(per_record, F.col("record_id") == F.col("a_record"), "left")
    per_statute = told.groupBy(F.col("statute_id").alias("t_statute")).agg(
        F.count("*").alias("n_records"), F.count_if("readable").alias("n_readable"), F.sum("n_articles").alias("n_articles")
    )
    n_articles = F.coalesce("n_articles", F.lit(0))
    status = F.when(F.col("n_records").isNull(), "missing").when(F.col("n_readable") == 0, "unreadable").when(n_articles == 0, "empty").otherwise("ok")
    statuses = statutes.join(per_statute, F.col("statute_id") == F.col("t_statute"), "left").select(
        "statute_id", F.coalesce("n_records", F.lit(0)).alias("n_records"), n_articles.alias("n_articles"), status.alias("status")
    )
    return articles, statuses


def import_runs(searches: DataFrame, documents: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, source, query, n_parsed, imported_count, status, error_message): the history row of each search response.

    ``searches`` has (id, source, query, payload), ``documents`` (record_id, document_id) what was parsed from them, ``stored``
    the document_ids that are stored already and so not imported. A run that could not be read has failed.
    """
    known = stored.select(F.col("document_id").alias("known_id")).distinct()
    counted = (
        documents.join(known, F.col("document_id") == F.col("known_id"), "left")
        .groupBy("record_id")
        .agg(F.count("*").alias("n_parsed"), F.count_if(F.col("known_id").isNull()).alias("imported_count"))
    )
    runs = searches.distinct().withColumn("readable", is_readable("payload"))
    return runs.join(counted, F.col("id") == F.col("record_id"), "left").select(
        "id",
        "source",
        "query",
        F.coalesce("n_parsed", F.lit(0)).alias("n_parsed"),
        F.coalesce("imported_count", F.lit(0)).alias("imported_count"),
        F.when(F.col("readable"), "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(~F.col("readable"), "unreadable payload").alias("error_message"),
    )


def run_by_target(cases: DataFrame, runners: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Results of each case's target, one below the other; a target without a runner is an error that names it."""
    unknown = [r.target for r in cases.select("target").distinct().filter(~F.coalesce(F.col("target").isin(*runners), F.lit(False))).limit(10).collect()]
    if unknown:
        raise ValueError(f"no runner for {sorted(map(str, unknown))}")
    out = None
    for target, runner in runners.items():
        found = runner(cases.filter(F.col("target") == target)).withColumn("target", F.lit(target))
        out = found if out is None else out.unionByName(found)
    return out
