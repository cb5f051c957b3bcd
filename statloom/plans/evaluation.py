"""Evaluation queries: each asked title should bring back the document it is the title of.

Documents with a blank text expect nothing; a document's statute is its variation group; its type is its category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.text import utrim
from statloom.operators import evaluation as E
from statloom.operators import fusion, retrieval
from statloom.plans import retrieval as R
from statloom.session import written
from statloom.tables import load

RRF_GRID = (1, 5, 10, 30, 60)
RERANK_GRID = ((5, 3), (5, 5), (10, 3), (10, 5), (20, 3), (20, 5))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = utrim(F.coalesce("text", F.lit(""))) == ""
    return (
        load(spark, sf_dir, "documents")
        .filter("doc_id % 50 = 0 and title is not null")
        .select(
            F.col("doc_id").alias("case_id"),
            F.when(blank, F.array().cast("array<bigint>")).otherwise(F.array("doc_id")).alias("expected"),
            F.col("statute_id").alias("variation_group"),
            F.col("document_type").alias("category"),
        )
    )


def as_cases(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.col("query_id").alias("case_id"), "ord", "rank")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("statute_id").alias("group"))


def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = E.case_metrics(as_cases(R.bm25(spark, sf_dir)), cases(spark, sf_dir))
    return metrics.select(*(F.round(c, 6).alias(c) if c in E.METRICS else F.col(c) for c in metrics.columns))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.long_metrics(case_metrics(spark, sf_dir))


def _by_category(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    asked = cases(spark, sf_dir)
    metrics = E.case_metrics(as_cases(ranked), asked).join(asked.select("case_id", "category"), "case_id")
    return E.metrics_report(metrics, ["category"])


def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_category(spark, sf_dir, R.bm25(spark, sf_dir))


def failure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    # cases are read more than once, and their texts only to see which are blank
    return E.failure_analysis(as_cases(R.bm25(spark, sf_dir)), written(cases(spark, sf_dir)), groups(spark, sf_dir))


def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failure_report(failure_analysis(spark, sf_dir))


def missed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.missed_documents(as_cases(R.bm25(spark, sf_dir)), cases(spark, sf_dir))


def _report(asked: DataFrame, ranked: DataFrame, variant: str, place: int) -> DataFrame:
    report = E.metrics_report(E.case_metrics(as_cases(ranked), asked))
    return report.select(F.lit(variant).alias("variant"), F.lit(place).alias("place"), *report.columns)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report for each way to search, in the order in which they are compared."""
    found = R.matches(spark, sf_dir, keywords=True)  # one pass over the texts for all searches
    asked, weighted = written(cases(spark, sf_dir)), R.bm25(spark, sf_dir, found=found)
    fused = written(R.rrf_fusion(spark, sf_dir, weighted))  # a report reads its results twice
    ways = {"keyword": R.keyword_ranks(spark, sf_dir, found), "bm25": weighted, "legacy": R.bm25_legacy(spark, sf_dir, found)}
    ways |= {"hybrid": fused, "reranked": written(R.rerank(spark, sf_dir, fused))}
    reports = [_report(asked, ranked, name, i) for i, (name, ranked) in enumerate(ways.items())]
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_variant(variants(spark, sf_dir)).select("variant", "hit_rate", "failure_count", "mrr")


def regression_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legacy report against that of the present search."""
    asked, found = written(cases(spark, sf_dir)), R.matches(spark, sf_dir)
    long = lambda ranked: E.long_report(_report(asked, ranked, "v", 0).drop("place"), "variant")
    return E.compare_reports(long(R.bm25_legacy(spark, sf_dir, found)), long(R.bm25(spark, sf_dir, found=found)))


def rrf_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all fusion constants in one job: the ranked lists are made once and crossed with the five constants."""
    lists = fusion.with_sources(R.bm25(spark, sf_dir), R.knn(spark, sf_dir))
    grid = spark.createDataFrame([(k,) for k in RRF_GRID], "k int")
    by_source = F.row_number().over(E.Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "ord"))
    fused = (
        lists.withColumn("at", by_source)
        .join(F.broadcast(grid))
        .groupBy("k", "query_id", "ord")
        .agg(F.round(F.sum(1 / (F.col("k") + F.col("at"))), 9).alias("score"), F.min("source").alias("first_source"))
    )
    order = F.row_number().over(E.Window.partitionBy("k", "query_id").orderBy(F.desc("score"), "first_source", "ord"))
    return _sweep(spark, sf_dir, fused.withColumn("rank", order), "k")


def rerank_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all pairs of candidate and result limits, from one list of scored candidates."""
    fused = written(R.rrf_fusion(spark, sf_dir))  # candidates and their old ranks are read from it
    candidates = fusion.rerank(fused, R.asked(spark, sf_dir), R.corpus(spark, sf_dir), max(k for k, _ in RERANK_GRID), 1 << 30)
    fused = fused.select("query_id", "ord", F.col("rank").alias("old_rank"))
    grid = spark.createDataFrame([*RERANK_GRID], "candidates int, results int")
    order = F.row_number().over(E.Window.partitionBy("setting", "query_id").orderBy(F.desc("score"), "old_rank"))
    ranked = (
        candidates.drop("rank")
        .join(fused, ["query_id", "ord"])
        .join(F.broadcast(grid), F.col("old_rank") <= F.col("candidates"))
        .withColumn("setting", F.concat_ws("/", "candidates", "results"))
        .withColumn("rank", order)
        .filter(F.col("rank") <= F.col("results"))
    )
    return _sweep(spark, sf_dir, ranked, "setting")


def _sweep(spark: SparkSession, sf_dir: str, ranked: DataFrame, setting: str) -> DataFrame:
    """One report for each setting; a case that a setting finds nothing for counts there as not found."""
    asked = cases(spark, sf_dir).select("case_id", F.explode_outer("expected").alias("wanted"))
    settings = ranked.select(setting).distinct()
    best = ranked.groupBy(F.col(setting).alias("s"), F.col("query_id").alias("q"), F.col("ord").alias("o")).agg(F.min("rank").alias("first_rank"))
    scored = settings.crossJoin(asked.filter("wanted is not null")).join(best, (F.col(setting) == F.col("s")) & (F.col("case_id") == F.col("q")) & (F.col("wanted") == F.col("o")), "left")
    return scored.groupBy(setting).agg(
        F.round(F.avg(F.col("first_rank").isNotNull().cast("double")), 6).alias("hit_rate"),
        F.count_if(F.coalesce("first_rank", F.lit(1 << 30)) > E.SUCCESS_RANK).alias("failure_count"),
        F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def import_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration statistics of the imports of each source, impossible times left out."""
    histories = load(spark, sf_dir, "legal_import_histories").distinct()
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("finished_at") - micros("started_at")) / 1e6
    return E.duration_statistics(histories.withColumn("seconds", F.when(seconds >= 0, seconds)), "source", "seconds")


QUERIES = {
    "case_metrics": case_metrics,
    "retrieval_metrics": retrieval_metrics,
    "metrics_report": metrics_report,
    "failure_analysis": failure_analysis,
    "failure_report": failure_report,
    "missed_documents": missed_documents,
    "search_variants": variants,
    "best_variant": best_variant,
    "regression_status": regression_status,
    "rrf_k_sweep": rrf_k_sweep,
    "rerank_sweep": rerank_sweep,
    "import_durations": import_durations,
}

_CASES = f""",
cases AS (SELECT doc_id AS case_id, {R.sql_trim("coalesce(text, '')")} <> '' AS positive, statute_id AS variation_group, document_type AS category
          FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL)"""


def metrics_cte(ranked: str, name: str = "metrics") -> str:
    return f""",
{name} AS (
  SELECT c.case_id, c.category, CASE WHEN positive THEN 1 ELSE 0 END AS n_expected, coalesce(r.n, 0) AS n_retrieved,
    CASE WHEN r.n > 0 THEN (CASE WHEN f.rank IS NOT NULL THEN 1 ELSE 0 END) / r.n ELSE 0.0 END AS precision,
    CASE WHEN NOT positive OR f.rank IS NOT NULL THEN 1.0 ELSE 0.0 END AS recall,
    CASE WHEN NOT positive OR f.rank IS NOT NULL THEN 1.0 ELSE 0.0 END AS hit,
    CASE WHEN NOT positive OR f.rank <= 1 THEN 1.0 ELSE 0.0 END AS recall_at_1,
    CASE WHEN NOT positive OR f.rank <= 3 THEN 1.0 ELSE 0.0 END AS recall_at_3,
    CASE WHEN NOT positive OR f.rank <= 5 THEN 1.0 ELSE 0.0 END AS recall_at_5,
    CASE WHEN NOT positive THEN 1.0 WHEN f.rank IS NULL THEN 0.0 ELSE 1.0::DOUBLE / f.rank END AS reciprocal_rank,
    f.rank AS first_rank
  FROM cases c
  LEFT JOIN (SELECT query_id, count(*) AS n FROM {ranked} GROUP BY ALL) r ON r.query_id = c.case_id
  LEFT JOIN {ranked} f ON f.query_id = c.case_id AND f.ord = c.case_id AND c.positive)"""


REPORT = """count(*) AS n_cases, count(*) FILTER (n_expected > 0) AS n_positive,
  round(coalesce(avg(hit) FILTER (n_expected > 0), 0.0)::DOUBLE, 6) AS hit_rate, round(coalesce(avg(recall_at_1) FILTER (n_expected > 0), 0.0)::DOUBLE, 6) AS recall_at_1,
  round(coalesce(avg(recall_at_3) FILTER (n_expected > 0), 0.0)::DOUBLE, 6) AS recall_at_3, round(coalesce(avg(recall_at_5) FILTER (n_expected > 0), 0.0)::DOUBLE, 6) AS recall_at_5,
  round(coalesce(avg(reciprocal_rank) FILTER (n_expected > 0), 0.0)::DOUBLE, 6) AS mrr,
  count(*) FILTER (n_expected > 0 AND coalesce(first_rank, 1000000000) > 5) AS failure_count"""

_ANALYSIS = """,
found_ranks AS (SELECT c.case_id, f.rank, coalesce(f.rank <= 5, false) AS success, c.variation_group
  FROM cases c LEFT JOIN bm25 f ON f.query_id = c.case_id AND f.ord = c.case_id WHERE c.positive),
analysis AS (
  SELECT a.case_id, a.rank, a.success,
    CASE WHEN a.success THEN NULL
         WHEN a.variation_group IS NOT NULL AND EXISTS (SELECT 1 FROM found_ranks o WHERE o.variation_group = a.variation_group AND o.success) THEN 'query-wording-mismatch'
         WHEN a.rank IS NOT NULL THEN 'retrieved-outside-top-5'
         WHEN NOT EXISTS (SELECT 1 FROM bm25 b WHERE b.query_id = a.case_id) THEN 'expected-document-not-retrieved'
         WHEN EXISTS (SELECT 1 FROM bm25 b JOIN documents d ON d.doc_id = b.ord WHERE b.query_id = a.case_id AND b.rank <= 5 AND b.ord <> a.case_id
                      AND d.statute_id = a.variation_group) THEN 'similar-article-competition'
         ELSE 'wrong-document-ranked-higher' END AS category
  FROM found_ranks a)"""

_KEYWORD = (
    f""",
k_tokens AS (SELECT query, token, count(*) AS n FROM (SELECT query, unnest({R.sql_words('query')}) AS token FROM texts) GROUP BY ALL),
k_scored AS (SELECT query, ord, sum(n * ((CASE WHEN contains(lt, token) THEN 2 ELSE 0 END) + (CASE WHEN contains(lx, token) THEN 1 ELSE 0 END))) AS score
  FROM k_tokens CROSS JOIN corpus WHERE contains(lt, token) OR contains(lx, token) GROUP BY ALL),
keyword AS (SELECT query_id, ord, rank FROM asked JOIN (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS rank FROM k_scored) USING (query) WHERE rank <= 10)"""
)
_LEGACY = R.bm25_cte("legacy", retrieval.LEGACY)
_VARIANTS = R.LISTS + R.RERANK_CTE + _LEGACY + _KEYWORD + _CASES + "".join(metrics_cte(t, "m_" + t) for t in ("keyword", "bm25", "legacy", "rrf", "reranked"))
_VARIANT_ROWS = ",\nvariants AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS variant, {i} AS place, {REPORT} FROM m_{table}"
    for i, (name, table) in enumerate({"keyword": "keyword", "bm25": "bm25", "legacy": "legacy", "hybrid": "rrf", "reranked": "reranked"}.items())
) + ")"
_NAMES = ("hit_rate", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "failure_count")
_SWEEP = """SELECT {setting}, round(avg(CASE WHEN first_rank IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE, 6) AS hit_rate, count(*) FILTER (coalesce(first_rank, 1000000000) > 5) AS failure_count,
  round(avg(CASE WHEN first_rank IS NULL THEN 0.0 ELSE 1.0::DOUBLE / first_rank END), 6) AS mrr
FROM (SELECT s.{setting}, c.case_id, min(r.rank) AS first_rank FROM (SELECT DISTINCT {setting} FROM swept) s CROSS JOIN (SELECT * FROM cases WHERE positive) c
      LEFT JOIN swept r ON r.{setting} = s.{setting} AND r.query_id = c.case_id AND r.ord = c.case_id GROUP BY ALL) GROUP BY ALL"""

BM25_CASES = R.BM25 + _CASES
ORACLE_SQL = {
    "case_metrics": BM25_CASES
    + metrics_cte("bm25")
    + """ SELECT case_id, n_expected, n_retrieved, round(precision::DOUBLE, 6) AS precision, recall::DOUBLE AS recall, hit::DOUBLE AS hit, recall_at_1::DOUBLE AS recall_at_1,
 recall_at_3::DOUBLE AS recall_at_3, recall_at_5::DOUBLE AS recall_at_5, round(reciprocal_rank::DOUBLE, 6) AS reciprocal_rank, first_rank FROM metrics""",
    "retrieval_metrics": BM25_CASES
    + metrics_cte("bm25")
    + " "
    + " UNION ALL ".join(f"SELECT case_id, '{m}' AS metric, round({m}::DOUBLE, 6) AS score, round({m}::DOUBLE, 6) >= 1 AS passed FROM metrics" for m in E.METRICS),
    "metrics_report": BM25_CASES + metrics_cte("bm25") + f" SELECT category, {REPORT} FROM metrics GROUP BY category",
    "failure_analysis": BM25_CASES + _ANALYSIS + " SELECT * FROM analysis",
    "failure_report": BM25_CASES
    + _ANALYSIS
    + ", names AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS category, {i} AS place" for i, c in enumerate(E.CATEGORIES))
    + ") SELECT n.category, n.place, count(a.case_id) AS n_cases FROM names n LEFT JOIN analysis a ON a.category = n.category GROUP BY ALL",
    "missed_documents": BM25_CASES + _ANALYSIS + " SELECT case_id AS expected_ord, count(*) AS n_missed FROM analysis WHERE NOT success GROUP BY ALL ORDER BY n_missed DESC, expected_ord LIMIT 10",
    "search_variants": _VARIANTS + _VARIANT_ROWS + " SELECT * FROM variants",
    "best_variant": _VARIANTS + _VARIANT_ROWS + " SELECT variant, hit_rate, failure_count, mrr FROM variants ORDER BY hit_rate DESC, failure_count, mrr DESC, place LIMIT 1",
    "regression_status": R.BM25
    + _LEGACY
    + _CASES
    + metrics_cte("bm25", "m_bm25")
    + metrics_cte("legacy", "m_legacy")
    + f", a AS (SELECT {REPORT} FROM m_bm25), b AS (SELECT {REPORT} FROM m_legacy), both_reports AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, b.{m}::DOUBLE AS before, a.{m}::DOUBLE AS after, {-1 if m in E.LESS_IS_BETTER else 1} AS sign FROM a, b" for m in _NAMES)
    + """) SELECT metric, before, after, round(after - before, 6) AS delta,
  CASE WHEN abs(round(after - before, 6)) <= 0.01 THEN 'unchanged' WHEN sign * (after - before) > 0 THEN 'improved' ELSE 'regressed' END AS status FROM both_reports""",
    "rrf_k_sweep": R.LISTS
    + _CASES
    + f""", grid AS (SELECT unnest({[*RRF_GRID]}) AS k),
swept AS (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY score DESC, first_source, ord) AS rank FROM (
  SELECT k, query_id, ord, round(sum(1.0::DOUBLE / (k + place)), 9) AS score, min(source) AS first_source FROM placed CROSS JOIN grid GROUP BY ALL)) """
    + _SWEEP.format(setting="k"),
    "rerank_sweep": R.LISTS
    + R.RERANK_CTE
    + _CASES
    + ", grid AS ("
    + " UNION ALL ".join(f"SELECT {a} AS candidates, {b} AS results, '{a}/{b}' AS setting" for a, b in RERANK_GRID)
    + """), swept AS (SELECT * FROM (SELECT setting, results, query_id, ord, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, old_rank) AS rank
  FROM candidates c JOIN grid g ON c.old_rank <= g.candidates) WHERE rank <= results) """
    + _SWEEP.format(setting="setting"),
    "import_durations": """
WITH d AS (SELECT source, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS s FROM (SELECT DISTINCT * FROM legal_import_histories))
SELECT source, round(avg(CASE WHEN s >= 0 THEN s END), 6) AS average, min(CASE WHEN s >= 0 THEN s END) AS least, max(CASE WHEN s >= 0 THEN s END) AS greatest,
  count(CASE WHEN s >= 0 THEN s END) AS n FROM d GROUP BY source""",
}
