"""Fusion and re-ranking of ranked lists: (query_id, source, ord, score).

Sources are numbered in the order in which they were asked; ties keep the earlier source, then the smaller ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.text import letter_runs
from statloom.operators.retrieval import documents_of
from statloom.session import written

RRF_K = 60


def with_sources(*lists: DataFrame) -> DataFrame:
    """Ranked lists (query_id, ord, score) one below the other, each with its number."""
    parts = [x.select("query_id", F.lit(i).alias("source"), "ord", F.col("score").cast("double").alias("score")) for i, x in enumerate(lists)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_source", "ord")))


def reciprocal_rank_fusion(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, ord, score, first_source, rank): sum of 1 / (k + rank) over the sources."""
    place = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "ord"))
    fused = (
        lists.withColumn("place", place)
        .groupBy("query_id", "ord")
        .agg(F.round(F.sum(1 / (F.lit(k) + F.col("place"))), 9).alias("score"), F.min("source").alias("first_source"))
    )
    return _rank(fused)


def raw_score_fusion(lists: DataFrame) -> DataFrame:
    """(query_id, ord, score, first_source, rank): the best score of each document, scales mixed as they are."""
    best = F.max(F.struct("score", (-F.col("source")).alias("minus_source")))
    fused = lists.groupBy("query_id", "ord").agg(best.alias("best")).select("query_id", "ord", F.col("best.score").alias("score"), (-F.col("best.minus_source")).alias("first_source"))
    return _rank(fused)


def filtered(ranked: DataFrame, corpus: DataFrame, keep: Column) -> DataFrame:
    """Results whose document in ``corpus`` (by ord) fulfils ``keep``, ranked anew in their old order; unknown is not kept."""
    kept = ranked.join(corpus.filter(keep).select("ord").distinct(), "ord", "left_semi").withColumnRenamed("rank", "old_rank")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("old_rank"))).drop("old_rank")


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, candidate_limit: int = 50, limit: int = 10) -> DataFrame:
    """(query_id, ord, score, rank): candidates by how many query terms their title and text hold, then by old rank."""
    kept = written(candidates.filter(F.col("rank") <= candidate_limit).select("query_id", "ord", F.col("rank").alias("old_rank")))
    terms = queries.select("query_id", letter_runs("query").alias("terms"))
    # the candidates are few: only their texts are cut into terms, each once
    texts = documents_of(corpus, kept).select("ord", F.array_distinct(letter_runs(F.concat_ws(" ", "title", "text"))).alias("held"))
    held = kept.join(terms, "query_id").join(texts, "ord")
    scored = held.select("query_id", "ord", "old_rank", F.size(F.filter("terms", lambda t: F.array_contains("held", t))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "old_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("old_rank")
