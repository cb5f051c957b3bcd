"""Retrieval metrics, failure analysis and report comparison over long tables.

``ranked`` is (case_id, ord, rank), ``cases`` (case_id, expected array<long>, variation_group). Expected documents are
exploded and joined to the ranks by key; no list of results is gathered for a case.

Defined cases: a case that expects nothing scores 1 in hit, recall and reciprocal rank, and is left out of the averages
of a report; precision is 0 if nothing was retrieved; an expected document that was not retrieved has no rank.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECALL_AT = (1, 3, 5)
SUCCESS_RANK = 5
THRESHOLD = 0.01

# Failure categories in the order in which they are tested; the last one is never reached.
CATEGORIES = (
    "missing-indexed-content",
    "query-wording-mismatch",
    "retrieved-outside-top-5",
    "expected-document-not-retrieved",
    "similar-article-competition",
    "wrong-document-ranked-higher",
    "other",
)
# Metrics of a report of which less is better.
LESS_IS_BETTER = ("unsupported_claims", "failure_count")


def expected_ranks(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, expected_ord, rank): one row for each expected document, rank null if it was not retrieved."""
    wanted = cases.select("case_id", F.explode("expected").alias("expected_ord"))
    best = ranked.groupBy(F.col("case_id").alias("r_case"), F.col("ord").alias("r_ord")).agg(F.min("rank").alias("rank"))
    return wanted.join(best, (F.col("case_id") == F.col("r_case")) & (F.col("expected_ord") == F.col("r_ord")), "left").select("case_id", "expected_ord", "rank")


def _share(count: Column, of: Column, otherwise: float) -> Column:
    return F.coalesce(F.try_divide(count, of), F.lit(otherwise))


def case_metrics(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """One row for each case: precision, recall, hit, recall at 1, 3 and 5, reciprocal rank."""
    per_case = expected_ranks(ranked, cases).groupBy("case_id").agg(
        F.count("rank").alias("n_found"),
        *(F.count_if(F.col("rank") <= k).alias(f"n_found_{k}") for k in RECALL_AT),
        F.min("rank").alias("first_rank"),
    )
    retrieved = ranked.groupBy("case_id").agg(F.count("*").alias("n_retrieved"))
    n_expected = F.size("expected")
    zero = F.lit(0)
    return (
        cases.join(per_case, "case_id", "left")
        .join(retrieved, "case_id", "left")
        .select(
            "case_id",
            n_expected.alias("n_expected"),
            F.coalesce("n_retrieved", zero).alias("n_retrieved"),
            _share(F.coalesce("n_found", zero), F.coalesce("n_retrieved", zero), 0.0).alias("precision"),
            _share(F.coalesce("n_found", zero), n_expected, 1.0).alias("recall"),
            F.when(n_expected == 0, 1.0).otherwise(F.when(F.coalesce("n_found", zero) > 0, 1.0).otherwise(0.0)).alias("hit"),
            *(_share(F.coalesce(f"n_found_{k}", zero), n_expected, 1.0).alias(f"recall_at_{k}") for k in RECALL_AT),
            F.when(n_expected == 0, 1.0).otherwise(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))).alias("reciprocal_rank"),
            "first_rank",
        )
    )


METRICS = ("precision", "recall", "hit", "recall_at_1", "recall_at_3", "recall_at_5", "reciprocal_rank")


def long_metrics(metrics: DataFrame) -> DataFrame:
    """(case_id, metric, score, passed); a metric is passed at 1."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in METRICS))
    return metrics.select("case_id", F.inline(pairs)).withColumn("passed", F.col("score") >= 1)


def metrics_report(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Averages over the cases that expect something, for each value of ``by``."""
    positive = F.col("n_expected") > 0
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(positive, F.col(c))), F.lit(0.0)), 6)
    return metrics.groupBy(*(by or [])).agg(
        F.count("*").alias("n_cases"),
        F.count_if(positive).alias("n_positive"),
        mean("hit").alias("hit_rate"),
        *(mean(f"recall_at_{k}").alias(f"recall_at_{k}") for k in RECALL_AT),
        mean("reciprocal_rank").alias("mrr"),
        F.count_if(positive & (F.coalesce("first_rank", F.lit(1 << 30)) > SUCCESS_RANK)).alias("failure_count"),
    )


def failure_analysis(ranked: DataFrame, cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """(case_id, rank, success, category): why each case that expects something failed, null where it did not.

    ``corpus`` is (ord, group): documents of one group are articles of one statute.
    """
    positive = cases.filter(F.size("expected") > 0)
    ranks = expected_ranks(ranked, positive)
    groups = corpus.select(F.col("ord").alias("g_ord"), F.col("group"))
    first = (
        ranks.join(groups, F.col("expected_ord") == F.col("g_ord"), "left")
        .groupBy("case_id")
        .agg(F.min("rank").alias("rank"), F.count("g_ord").alias("n_indexed"))
    )
    top = ranked.filter(F.col("rank") <= SUCCESS_RANK).join(groups, F.col("ord") == F.col("g_ord")).select("case_id", "ord", "group")
    wanted = ranks.join(groups, F.col("expected_ord") == F.col("g_ord")).select(F.col("case_id").alias("w_case"), "expected_ord", F.col("group").alias("w_group"))
    siblings = (
        top.join(wanted, (F.col("case_id") == F.col("w_case")) & (F.col("group") == F.col("w_group")) & (F.col("ord") != F.col("expected_ord")))
        .select(F.col("case_id").alias("s_case"))
        .distinct()
    )
    retrieved = ranked.select(F.col("case_id").alias("t_case")).distinct()
    success = F.coalesce(F.col("rank") <= SUCCESS_RANK, F.lit(False))
    # cases without a group never meet: each is a group of its own
    group = F.when(F.col("variation_group").isNotNull(), F.concat(F.lit("g"), F.col("variation_group"))).otherwise(F.concat(F.lit("c"), F.col("case_id").cast("string")))
    out = (
        positive.join(first, "case_id")
        .join(retrieved, F.col("case_id") == F.col("t_case"), "left")
        .join(siblings, F.col("case_id") == F.col("s_case"), "left")
        .withColumn("success", success)
        .withColumn("sibling_query_worked", F.bool_or("success").over(Window.partitionBy(group)))
    )
    category = (
        F.when(F.col("success"), None)
        .when(F.col("n_indexed") == 0, CATEGORIES[0])
        .when(F.col("sibling_query_worked"), CATEGORIES[1])
        .when(F.col("rank").isNotNull(), CATEGORIES[2])
        .when(F.col("t_case").isNull(), CATEGORIES[3])
        .when(F.col("s_case").isNotNull(), CATEGORIES[4])
        .otherwise(CATEGORIES[5])
    )
    return out.select("case_id", "rank", "success", category.alias("category"))


def failure_report(analysis: DataFrame) -> DataFrame:
    """(category, place, n_cases) for every category, also those without a case."""
    names = analysis.sparkSession.createDataFrame([*enumerate(CATEGORIES)], "place int, category string")
    counted = analysis.groupBy("category").agg(F.count("*").alias("n_cases"))
    return names.join(counted, "category", "left").select("category", "place", F.coalesce("n_cases", F.lit(0)).alias("n_cases"))


def failure_summary(analysis: DataFrame) -> DataFrame:
    """One row: how many cases apply, succeeded and failed, and the mean rank of what was found (null if nothing was)."""
    return analysis.agg(
        F.count("*").alias("n_applicable"), F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_failed"), F.round(F.avg("rank"), 6).alias("mean_found_rank")
    )


def failed_cases(analysis: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """(place, case_id, query, rank, category) of the failed cases, those found best first and those never found last."""
    failed = analysis.filter(~F.col("success")).join(queries.select(F.col("query_id").alias("case_id"), "query"), "case_id", "left")
    kept = failed.orderBy(F.col("rank").asc_nulls_last(), "case_id").limit(top)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.col("rank").asc_nulls_last(), "case_id"))).select("place", "case_id", "query", "rank", "category")


def failure_patterns(report: DataFrame, advice: dict[str, str]) -> DataFrame:
    """(category, n_cases, recommendation) of the categories that occur, the most frequent first."""
    known = F.create_map(*(F.lit(x) for pair in advice.items() for x in pair))
    return report.filter("n_cases > 0").orderBy(F.desc("n_cases"), "place").select("category", "n_cases", known[F.col("category")].alias("recommendation"))


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """One row: how many metrics improved, stayed and regressed, and whether any regressed."""
    of = lambda s: F.count_if(F.col("status") == s)
    return comparison.agg(
        of("improved").alias("n_improved"), of("unchanged").alias("n_unchanged"), of("regressed").alias("n_regressed"), (of("regressed") > 0).alias("has_regressions")
    )


def timed(jobs: dict[str, Callable[[], DataFrame]], passes: int = 3) -> list[dict]:
    """(name, passes, average, least, greatest) seconds of each job, its rows counted and thrown away."""
    out = []
    for name, job in jobs.items():
        seconds = []
        for _ in range(passes):
            started = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - started)
        out.append({"name": name, "passes": passes, "average": sum(seconds) / passes, "least": min(seconds), "greatest": max(seconds)})
    return out


def missed_documents(ranked: DataFrame, cases: DataFrame, top: int = 10) -> DataFrame:
    """(expected_ord, n_missed): the documents that were most often expected and not found among the best."""
    missed = expected_ranks(ranked, cases).filter(F.coalesce("rank", F.lit(1 << 30)) > SUCCESS_RANK)
    return missed.groupBy("expected_ord").agg(F.count("*").alias("n_missed")).orderBy(F.desc("n_missed"), "expected_ord").limit(top)


def long_report(report: DataFrame, key: str) -> DataFrame:
    """(key, metric, value) of a report with one row for each key."""
    names = [c for c in report.columns if c not in (key, "n_cases", "n_positive")]
    return report.select(key, F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))))


def compare_reports(before: DataFrame, after: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(metric, before, after, delta, status) of two (metric, value) reports; a missing value has status ``missing``."""
    joined = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full_outer")
    delta = F.round(F.col("after") - F.col("before"), 6)
    better = F.when(F.col("metric").isin(*LESS_IS_BETTER), -delta).otherwise(delta)
    status = F.when(delta.isNull(), "missing").when(F.abs(delta) <= threshold, "unchanged").when(better > 0, "improved").otherwise("regressed")
    return joined.select("metric", "before", "after", delta.alias("delta"), status.alias("status"))


def best_variant(report: DataFrame) -> DataFrame:
    """The row with the highest hit rate, then the fewest failures, then the highest MRR; of equal ones the first."""
    return report.orderBy(F.desc("hit_rate"), "failure_count", F.desc("mrr"), "place").limit(1)


def duration_statistics(durations: DataFrame, by: str, value: str) -> DataFrame:
    """Average, least and greatest duration and their number."""
    return durations.groupBy(by).agg(
        F.round(F.avg(value), 6).alias("average"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(value).alias("n")
    )
