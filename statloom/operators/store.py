"""Upserts, import policies and index batches over plain tables.

Plain parquet has no MERGE: an upsert reads both tables, keeps one row for each key and is written to a new place.
Choices between rows of one key are aggregates with partial aggregation, so that a key with many rows does not gather.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: that with the greatest ``order`` columns, nulls least; repeated rows count once."""
    columns = df.columns
    best = F.max(F.struct(*(F.col(c) for c in order), *(F.col(c) for c in columns if c not in order and c != key)))
    return df.groupBy(key).agg(best.alias("best")).select(*(F.col(c) if c == key else F.col(f"best.{c}").alias(c) for c in columns))


def upsert(target: DataFrame, updates: DataFrame, key: str, kept: list[str], order: list[str]) -> DataFrame:
    """``target`` after the upsert: updates replace rows of the same key, except the ``kept`` columns of those.

    Of several updates of a key the greatest by ``order`` wins. Null keys are never equal and all stay.
    """
    columns = target.columns
    fresh = latest_by_key(updates.filter(F.col(key).isNotNull()), key, order).select(*(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("is_new"))
    joined = target.join(fresh, F.col(key) == F.col("new_" + key), "full_outer")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"new_{c}")) if c in kept else F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c))
    return joined.select(*(pick(c).alias(c) for c in columns)).unionByName(updates.filter(F.col(key).isNull()).select(*columns))


def import_policy(incoming: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key the store does not have; rows repeated within one import all pass."""
    return incoming.join(store.select(F.col(key).alias("stored_key")).distinct(), F.col(key) == F.col("stored_key"), "left_anti")


def import_counts(incoming: DataFrame, store: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n_total, n_saved, n_skipped)."""
    known = store.select(F.col(key).alias("stored_key"), F.lit(True).alias("known")).distinct()
    return (
        incoming.join(known, F.col(key) == F.col("stored_key"), "left")
        .groupBy(by)
        .agg(F.count("*").alias("n_total"), F.count_if(F.col("known").isNull()).alias("n_saved"), F.count_if("known").alias("n_skipped"))
    )


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys and where each was first seen."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_seen"))


def index_batches(df: DataFrame, ord_col: str, failed: Column, size: int = 100) -> DataFrame:
    """(batch, n_total, n_indexed, n_failed): documents by blocks of ``size`` consecutive ordinals."""
    return df.groupBy(F.floor(F.col(ord_col) / size).alias("batch")).agg(
        F.count("*").alias("n_total"), F.count_if(~failed).alias("n_indexed"), F.count_if(failed).alias("n_failed")
    )


def indexed_documents(df: DataFrame, key: str, ord_col: str, value: list[str]) -> DataFrame:
    """One row for each key, as an index keeps it: the place of its first row and the values of its last."""
    last = F.max(F.struct(ord_col, *value))
    return df.groupBy(key).agg(F.min(ord_col).alias("ord"), last.alias("last")).select(key, "ord", *(F.col(f"last.{v}").alias(v) for v in value))
