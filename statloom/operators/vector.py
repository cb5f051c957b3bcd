"""Exact vector search of a set of queries against all rows, in blocks.

Queries and rows are gathered into blocks of bounded size; every pair of a query block and a row block is one matrix
product, from which each query keeps its best k. The blocks' results are merged for each query.

Defined cases: rows without a vector are not searched; a vector of length 0 has similarity 0 to everything; vectors of
another size than the query's are compared over the shorter one, with their full lengths in the denominator; ties keep
the order of ``ord``; similarities are rounded to six digits before they are ranked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 256, 4_096


def _blocks(df: DataFrame, key: str, rows: int, prefix: str) -> DataFrame:
    """One row for about ``rows`` vectors; the number of blocks follows the table."""
    n = max(1, -(-df.count() // rows))
    return (
        df.groupBy(F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(n)).alias(f"{prefix}_block"))
        .agg(F.collect_list(F.struct(F.col(key).alias("id"), "vector")).alias(f"{prefix}_rows"))
        .drop(f"{prefix}_block")
    )


def _matrix(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = max(len(r["vector"]) for r in rows)
    x = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        x[i, : len(r["vector"])] = r["vector"]
    return np.array([r["id"] for r in rows]), x, np.sqrt(np.einsum("ij,ij->i", x, x))


def knn_search(rows: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, ord, score, rank) for ``rows`` (ord, vector) and ``queries`` (query_id, vector)."""

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for q_rows, d_rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q_ids, q, q_norm = _matrix(q_rows)
                d_ids, d, d_norm = _matrix(d_rows)
                shared = min(q.shape[1], d.shape[1])
                norms = q_norm[:, None] * d_norm[None, :]
                cosine = np.round(np.divide(q[:, :shared] @ d[:, :shared].T, norms, out=np.zeros_like(norms), where=norms > 0), 6) + 0.0
                for i, query in enumerate(q_ids):
                    order = np.lexsort((d_ids, -cosine[i]))
                    kept = [j for j in order[: k + 1].tolist() if not (exclude_self and d_ids[j] == query)][:k]
                    out += [(int(query), int(d_ids[j]), float(cosine[i, j])) for j in kept]
            columns = [*zip(*out, strict=True)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "ord", "score"])

    stored = rows.filter("vector is not null").select(F.col("ord").cast("long").alias("ord"), "vector")
    asked = queries.filter("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), "vector")
    pairs = _blocks(asked, "query_id", QUERY_BLOCK, "q").crossJoin(_blocks(stored, "ord", ROW_BLOCK, "d"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return pairs.mapInArrow(best, "query_id long, ord long, score double").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def letter_vector(text, size: int = 768):
    """Deterministic stand-in for an embedding: UTF-16 code units summed by position modulo ``size``, over the length."""

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts.to_pylist():
            if x is None:
                rows.append(None)
                continue
            units = np.frombuffer(x.encode("utf-16-le", "surrogatepass"), np.uint16)
            rows.append(np.bincount(np.arange(len(units)) % size, units, size) / max(1, len(units)))
        return pa.array(rows, pa.list_(pa.float64()))

    return embed(text)
