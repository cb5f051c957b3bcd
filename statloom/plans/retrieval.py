"""Text and retrieval queries. Asked are the titles of all documents whose id is divisible by 50, against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import text as T
from statloom.operators import fusion, retrieval, vector
from statloom.tables import load

SIZE = 10


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "title", "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query)."""
    return load(spark, sf_dir, "documents").filter("doc_id % 50 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def per_query(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Results of distinct query texts for each query."""
    return queries.join(found, "query").drop("query").select("query_id", *(c for c in found.columns if c != "query"))


def keyword_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    found = retrieval.keyword_search(corpus(spark, sf_dir), queries, SIZE)
    return per_query(queries, found).select("query_id", "ord", "score", F.concat_ws("|", "matched_terms").alias("matched_terms"), "rank")


def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = retrieval.query_tokens(asked(spark, sf_dir), T.query_terms).select("token").distinct()
    return retrieval.document_frequency(corpus(spark, sf_dir), tokens).select("token", "df", F.round("idf", 6).alias("idf"))


def matches(spark: SparkSession, sf_dir: str, keywords: bool = False) -> DataFrame:
    """Matches of the asked titles, for several searches to share, a keyword search among them if ``keywords``."""
    return retrieval.weighted_matches(corpus(spark, sf_dir), asked(spark, sf_dir), keywords)


def keyword_ranks(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """``keyword_retrieve`` without the matched terms, from shared matches."""
    queries = asked(spark, sf_dir)
    return per_query(queries, retrieval.keyword_best(retrieval.query_tokens(queries), found, SIZE))


def bm25(spark: SparkSession, sf_dir: str, config: retrieval.Bm25Config = retrieval.PRODUCTION, found: DataFrame | None = None) -> DataFrame:
    queries = asked(spark, sf_dir)
    return per_query(queries, retrieval.bm25_search(corpus(spark, sf_dir), queries, config, found))


def bm25_legacy(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    return bm25(spark, sf_dir, retrieval.LEGACY, found)


def bm25_minimum_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(spark, sf_dir, retrieval.Bm25Config(minimum_should_match="75%"))


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return vector.knn_search(rows, rows.filter("ord % 50 = 0").withColumnRenamed("ord", "query_id"), SIZE)


def _lists(spark: SparkSession, sf_dir: str, weighted: DataFrame | None = None) -> DataFrame:
    return fusion.with_sources(bm25(spark, sf_dir) if weighted is None else weighted, knn(spark, sf_dir))


def rrf_fusion(spark: SparkSession, sf_dir: str, weighted: DataFrame | None = None) -> DataFrame:
    """Weighted search, anew or as given, fused with vector search."""
    return fusion.reciprocal_rank_fusion(_lists(spark, sf_dir, weighted))


def raw_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.raw_score_fusion(_lists(spark, sf_dir))


def rerank(spark: SparkSession, sf_dir: str, fused: DataFrame | None = None) -> DataFrame:
    return fusion.rerank(rrf_fusion(spark, sf_dir) if fused is None else fused, asked(spark, sf_dir), corpus(spark, sf_dir), 20, 5)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "title", "text")


def tokens_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tokenisers: what they make of titles, and how many tokens, and distinct ones, of whole texts."""
    of_texts = {"words": T.words("text"), "query_terms": T.query_terms("text"), "letter_runs": T.letter_runs("text"), "claim_terms": T.claim_terms("text")}
    return _texts(spark, sf_dir).select(
        "doc_id",
        F.concat_ws("|", T.words("title")).alias("words"),
        F.concat_ws("|", T.query_terms("title")).alias("query_terms"),
        F.concat_ws("|", T.letter_runs("title")).alias("letter_runs"),
        F.concat_ws("|", T.claim_terms("title")).alias("claim_terms"),
        *(F.when(F.col("text").isNotNull(), F.size(tokens)).alias(f"n_text_{name}") for name, tokens in of_texts.items()),
        *(F.when(F.col("text").isNotNull(), F.size(F.array_distinct(tokens))).alias(f"n_distinct_{name}") for name, tokens in of_texts.items()),
    )


def claim_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.posexplode(T.claims("text")).alias("claim_no", "claim"))


def cited_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.posexplode(T.citations("text")).alias("place", "citation"))


def citation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments and references each text is cut into, and that no character is lost."""
    segments = T.citation_segments("text")
    parts = _texts(spark, sf_dir).filter("text is not null").select("doc_id", "text", segments.alias("s"))
    return parts.select(
        "doc_id",
        F.size("s").alias("n_segments"),
        F.size(F.filter("s", lambda x: x["is_citation"])).alias("n_citations"),
        (F.array_join(F.transform("s", lambda x: x["text"]), "") == F.col("text")).alias("is_whole"),
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "legal_documents").select("document_id", T.first_line("content").alias("snippet"), T.statute_prefix("document_id").alias("prefix")).distinct()


def letter_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "document_chunks").select("id", "text").distinct()
    return chunks.select("id", vector.letter_vector("text").alias("vector"))


QUERIES = {
    "keyword_retrieve": keyword_retrieve,
    "token_df": token_df,
    "bm25_search": bm25,
    "bm25_legacy": bm25_legacy,
    "bm25_minimum_match": bm25_minimum_match,
    "knn_search": knn,
    "rrf_fusion": rrf_fusion,
    "raw_fusion": raw_fusion,
    "rerank_topn": rerank,
    "tokens_by_rule": tokens_by_rule,
    "claim_sentences": claim_sentences,
    "cited_articles": cited_articles,
    "citation_segments": citation_segments,
    "snippets": snippets,
    "letter_vectors": letter_vectors,
}

# --- the same in SQL ---------------------------------------------------------------------------------------------------


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# SQL spells its own white space, particles and reference pattern, so that a slip in the library's shows.
_WHITE = [*range(0x9, 0xE), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_SPACE = "[" + "".join(rf"\x{{{c:x}}}" for c in _WHITE) + "]"
_INLINE = "[" + "".join(rf"\x{{{c:x}}}" for c in _WHITE if c != 0xA) + "]"
# Particles that may trail a query word.
_PARTICLES = "의 은 는 이 가 을 를 로 와 과 도 만 나 에서의 으로부터 로부터 에게서 이라는 이란 라는 란 에서 에게 으로 이나 라면 지만 라고 으로서 이라면 이지만 이라고".split()
_SQL_CITATION = (
    rf"(?:(?:[A-Za-z0-9가-힣·ㆍ]+{_INLINE}){{0,2}}[A-Za-z0-9가-힣·ㆍ]*(?:법률|법|규칙|조례|시행령|시행규칙){_INLINE}*)?제[0-9]+(?:-[0-9]+)?조(?:의[0-9]+)?(?:\([^)\n]{{1,24}}\))?"
)
SPACES = sql_text(_SPACE + "+")
_TRIM = sql_text(f"^{_SPACE}+|{_SPACE}+$")


def sql_trim(text: str) -> str:
    return f"regexp_replace({text}, {_TRIM}, '', 'g')"


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), {SPACES}), lambda x: x <> '')"


def sql_query_terms(text: str) -> str:
    bare = f"list_filter(list_transform({sql_words(text)}, lambda x: regexp_replace(x, '[?!.,]+$', '')), lambda x: x <> '')"
    longest_first = "[" + ", ".join(f"'{p}'" for p in sorted(_PARTICLES, key=len, reverse=True)) + "]"
    fits = f"list_filter({longest_first}, lambda p: ends_with(x, p) AND length(x) - length(p) >= 2)[1]"
    return f"list_transform({bare}, lambda x: CASE WHEN {fits} IS NULL THEN x ELSE left(x, length(x) - length({fits})) END)"


def sql_letter_runs(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def sql_claim_terms(text: str) -> str:
    marks = sql_text(".,!?\"'()[]{}:;")
    return f"list_filter(string_split_regex(lower(translate({text}, {marks}, repeat(' ', 14))), {SPACES}), lambda x: x <> '')"


CORPUS = """
WITH RECURSIVE corpus AS (SELECT doc_id AS ord, title, text, lower(coalesce(title, '')) AS lt, lower(coalesce(text, '')) AS lx FROM documents),
asked AS (SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
texts AS (SELECT DISTINCT query FROM asked)"""

TERMS = (
    CORPUS
    + f""",
terms AS (SELECT query, token, count(*) AS n FROM (SELECT query, unnest({sql_query_terms('query')}) AS token FROM texts) GROUP BY ALL),
found AS (SELECT token, ord, contains(lt, token) AS in_title, contains(lx, token) AS in_text
          FROM (SELECT DISTINCT token FROM terms) CROSS JOIN corpus WHERE contains(lt, token) OR contains(lx, token)),
freq AS (SELECT t.token, count(f.ord) AS df FROM (SELECT DISTINCT token FROM terms) t LEFT JOIN found f USING (token) GROUP BY ALL),
weights AS (SELECT token, df, ln(1 + ((SELECT count(*) FROM corpus) - df + 0.5) / (df + 0.5)) AS idf FROM freq)"""
)


def bm25_cte(name: str, config: retrieval.Bm25Config, required: str = "1") -> str:
    return f""",
{name}_scores AS (
  SELECT query, ord, round(greatest({config.title_boost} * ts, {config.text_boost} * xs) + {config.tie_breaker} * least({config.title_boost} * ts, {config.text_boost} * xs), 6) AS score
  FROM (SELECT query, ord, sum(CASE WHEN in_title THEN n * idf ELSE 0 END) AS ts, sum(CASE WHEN in_text THEN n * idf ELSE 0 END) AS xs, sum(n) AS matched
        FROM terms JOIN found USING (token) JOIN weights USING (token) GROUP BY ALL)
  JOIN (SELECT query, sum(n) AS n_tokens FROM terms GROUP BY ALL) USING (query)
  WHERE matched >= {required}),
{name} AS (
  SELECT query_id, ord, score, rank FROM asked JOIN (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS rank FROM {name}_scores WHERE score > 0) USING (query)
  WHERE rank <= {config.size})"""


BM25 = TERMS + bm25_cte("bm25", retrieval.PRODUCTION)
KNN_CTE = """,
vectors AS (SELECT vec_id AS ord, embedding::DOUBLE[64] AS v FROM embeddings),
knn AS (SELECT query_id, ord, score, rank FROM (
  SELECT q.ord AS query_id, d.ord AS ord, round(array_cosine_similarity(q.v, d.v), 6) AS score,
         row_number() OVER (PARTITION BY q.ord ORDER BY round(array_cosine_similarity(q.v, d.v), 6) DESC, d.ord) AS rank
  FROM vectors q CROSS JOIN vectors d WHERE q.ord % 50 = 0) WHERE rank <= 10)"""
LISTS = (
    BM25
    + KNN_CTE
    + """,
lists AS (SELECT query_id, 0 AS source, ord, score FROM bm25 UNION ALL SELECT query_id, 1, ord, score FROM knn),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, ord) AS place FROM lists),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_source, ord) AS rank FROM (
  SELECT query_id, ord, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score, min(source) AS first_source FROM placed GROUP BY ALL))"""
)
RERANK_CTE = f""",
candidates AS (
  SELECT r.query_id, r.ord, r.rank AS old_rank,
         len(list_filter({sql_letter_runs('a.query')}, lambda t: list_contains({sql_letter_runs("concat_ws(' ', c.title, c.text)")}, t))) AS score
  FROM rrf r JOIN asked a USING (query_id) JOIN corpus c USING (ord) WHERE r.rank <= 20),
reranked AS (SELECT query_id, ord, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank FROM candidates) WHERE rank <= 5)"""

_BARE = sql_trim("regexp_replace(x, '[*_`]', '', 'g')")


def sql_citations(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, {sql_text(_SQL_CITATION)}, 0), lambda x: {_BARE}), lambda x: x <> '')"


_LINES = f"list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> '')"

ORACLE_SQL = {
    "keyword_retrieve": CORPUS
    + f""",
tokens AS (SELECT query, token, count(*) AS n FROM (SELECT query, unnest({sql_words('query')}) AS token FROM texts) GROUP BY ALL),
scored AS (
  SELECT query, ord, sum(n * ((CASE WHEN contains(lt, token) THEN 2 ELSE 0 END) + (CASE WHEN contains(lx, token) THEN 1 ELSE 0 END))) AS score,
         string_agg(token, '|' ORDER BY token) AS matched_terms
  FROM tokens CROSS JOIN corpus WHERE contains(lt, token) OR contains(lx, token) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS rank FROM scored)
SELECT query_id, ord, score::BIGINT AS score, matched_terms, rank FROM asked JOIN best USING (query) WHERE rank <= 10""",
    "token_df": TERMS + " SELECT token, df, round(idf, 6) AS idf FROM weights",
    "bm25_search": BM25 + " SELECT * FROM bm25",
    "bm25_legacy": TERMS + bm25_cte("legacy", retrieval.LEGACY) + " SELECT * FROM legacy",
    "bm25_minimum_match": TERMS + bm25_cte("strict", retrieval.PRODUCTION, "least(ceil(0.75 * n_tokens), n_tokens)") + " SELECT * FROM strict",
    "knn_search": "WITH RECURSIVE nothing AS (SELECT 1)" + KNN_CTE + " SELECT * FROM knn",
    "rrf_fusion": LISTS + " SELECT * FROM rrf",
    "raw_fusion": LISTS
    + """, fused AS (SELECT query_id, ord, max(score) AS score, arg_min(source, (-score, source)) AS first_source FROM lists GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_source, ord) AS rank FROM fused""",
    "rerank_topn": LISTS + RERANK_CTE + " SELECT * FROM reranked",
    "tokens_by_rule": f"""
SELECT doc_id, coalesce(array_to_string({sql_words('title')}, '|'), '') AS words, coalesce(array_to_string({sql_query_terms('title')}, '|'), '') AS query_terms,
       coalesce(array_to_string({sql_letter_runs('title')}, '|'), '') AS letter_runs, coalesce(array_to_string({sql_claim_terms('title')}, '|'), '') AS claim_terms,
       {", ".join(f"len({f('text')}) AS n_text_{n}, len(list_distinct({f('text')})) AS n_distinct_{n}" for n, f in (("words", sql_words), ("query_terms", sql_query_terms), ("letter_runs", sql_letter_runs), ("claim_terms", sql_claim_terms)))}
FROM documents""",
    "claim_sentences": f"""
SELECT doc_id, place - 1 AS claim_no, claims[place] AS claim FROM (
  SELECT doc_id, claims, unnest(range(1, len(claims) + 1)) AS place FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: {sql_trim('x')}), lambda x: x <> '') AS claims FROM documents))""",
    "cited_articles": f"""
WITH found AS (SELECT doc_id, {sql_citations('text')} AS c FROM documents),
each AS (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM found),
firsts AS (SELECT doc_id, c[i] AS citation, min(i) AS i FROM each GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place, citation FROM firsts""",
    "citation_segments": f"""
WITH cut AS (SELECT doc_id, string_split_regex(text, {sql_text(_SQL_CITATION)}) AS gaps, regexp_extract_all(text, {sql_text(_SQL_CITATION)}, 0) AS refs FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(gaps, lambda x: x <> '')) + len(refs) AS n_segments, len(refs) AS n_citations, true AS is_whole FROM cut""",
    "snippets": f"SELECT DISTINCT document_id, coalesce({_LINES}[1], '') AS snippet, string_split(document_id, ':')[1] AS prefix FROM legal_documents",
}
