"""Keyword and idf-weighted retrieval for whole batches of queries.

A token matches a text that contains it, also inside a word. The distinct tokens of the queries are counted first. Up to
MOST_TOKENS are handed to the tasks, where one automaton finds all of them in a single pass over each text: texts are read
once and not shuffled, only matches are. More tokens meet the distinct words of the corpus, which hold them as tokens hold
no white space, in an equi-join on the token's first two characters, and only words that match are joined back to the
documents: as a broadcast up to MOST_BROADCAST rows, by shuffle beyond. Both ways give the same rows. The best documents of
each query are kept in the tasks (see ``best``) up to MOST_BROADCAST rows of query and token; beyond, a pair of query and
document is formed where they share a token, and the pairs of one document meet in one task.

Defined cases: null titles and texts match nothing; a query without tokens has no result; repeated query tokens count
each time; equal queries are scored once; ties keep the order of ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.text import SPACE, query_terms, words
from statloom.operators.best import Score, best_documents
from statloom.session import written

#: Scores are rounded before they are ranked, so that the order of summation decides nothing.
DIGITS = 6
#: Tokens, characters of one and of all of them, that are handed to each task (some 50 MB as an automaton).
MOST_TOKENS, LONGEST_TOKEN, MOST_CHARACTERS = 100_000, 200, 500_000
#: Matches that a task holds before it hands them on.
HELD = 100_000
#: Rows of (word, token) or (query, token, n) that are broadcast, some 10 MB; more are joined by shuffle.
MOST_BROADCAST = 200_000


@dataclass(frozen=True)
class Bm25Config:
    """Field boosts, the share of lesser fields, matches required (count, or percentage like "75%"), results kept."""

    title_boost: float = 2.0
    text_boost: float = 1.0
    tie_breaker: float = 0.3
    minimum_should_match: int | str | None = None
    size: int = 10

    @classmethod
    def of_fields(cls, *fields: str, **others) -> Bm25Config:
        """Boosts as in "title^2", "text"; a field that is not named is not searched."""
        boosts = dict(map(parse_boost, fields))
        return cls(title_boost=boosts.get("title", 0.0), text_boost=boosts.get("text", 0.0), **others)


PRODUCTION = Bm25Config()
LEGACY = Bm25Config(title_boost=1.0, tie_breaker=0.0)


def parse_boost(field: str) -> tuple[str, float]:
    """"title^2" -> ("title", 2.0); a missing or unreadable boost is 1."""
    name, _, boost = field.partition("^")
    try:
        return name, float(boost or 1)
    except ValueError:
        return name, 1.0


def required_matches(n_tokens: Column, minimum: int | str | None) -> Column:
    """How many tokens have to match."""
    text = "" if minimum is None else str(minimum).strip()
    if text.endswith("%"):
        try:
            return F.least(F.ceil(F.lit(float(text[:-1]) / 100) * n_tokens), n_tokens)
        except ValueError:
            return F.lit(1)
    try:
        return F.least(F.lit(int(text)), n_tokens)
    except ValueError:
        return F.least(F.lit(1), n_tokens)


def query_tokens(queries: DataFrame, tokens=words) -> DataFrame:
    """(query, token, n): tokens of each distinct query text and how often it has them."""
    return queries.select("query").distinct().select("query", F.explode(tokens("query")).alias("token")).groupBy("query", "token").agg(F.count("*").alias("n"))


def _counted(df: DataFrame) -> DataFrame:
    """``df``, written, as a broadcast up to MOST_BROADCAST rows."""
    df = written(df)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def documents_of(corpus: DataFrame, ords: DataFrame) -> DataFrame:
    """The rows of ``corpus`` whose ord is in ``ords``: results are few, and only their texts go on to a shuffle."""
    return corpus.join(_counted(ords.select("ord").distinct()), "ord", "left_semi")


def _starts(word: Column) -> Column:
    """Every place in a word where a token could begin: its two-character and one-character parts."""
    places = F.sequence(F.lit(1), F.length(word))
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(F.substring(word, i, F.lit(1)), F.substring(word, i, F.lit(2))))))


def _matches_in_texts(texts: DataFrame, tokens: list[str]) -> DataFrame:
    """(ord, token, in_title, in_text), found by one automaton of all tokens; ``texts`` are lower-cased."""
    kind = texts.schema["ord"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast(tokens)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, automaton = pa.array(shared.value, pa.string()), ahocorasick.Automaton()
        for i, token in enumerate(shared.value):
            automaton.add_word(token, i)
        automaton.make_automaton()
        held_in = lambda x: {i for _, i in automaton.iter(x)} if x and len(automaton) else set()
        for batch in batches:
            ords, titles, bodies = batch.columns
            at, token, in_title, in_text = [], [], [], []
            for row, (title, text) in enumerate(zip(titles, bodies, strict=True)):
                of_title, of_text = held_in(title.as_py()), held_in(text.as_py())
                both = of_title | of_text
                at += [row] * len(both)
                token += both
                in_title += [i in of_title for i in both]
                in_text += [i in of_text for i in both]
                if len(at) >= HELD or row == len(batch) - 1:
                    columns = [ords.take(pa.array(at, pa.int64())), names.take(pa.array(token, pa.int64())), pa.array(in_title, pa.bool_()), pa.array(in_text, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=["ord", "token", "in_title", "in_text"])
                    at, token, in_title, in_text = [], [], [], []

    return texts.mapInArrow(find, f"ord {kind}, token string, in_title boolean, in_text boolean")


def _matches_by_words(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """The same for any number of tokens, by way of the distinct words of the corpus."""
    in_words = texts.select(
        "ord",
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("of_title"), F.array_distinct(F.split("title", f"{SPACE}+")).alias("list")),
                F.struct(F.lit(False).alias("of_title"), F.array_distinct(F.split("text", f"{SPACE}+")).alias("list")),
            )
        ),
    ).select("ord", "of_title", F.explode("list").alias("word"))
    vocabulary = in_words.select("word").filter("word <> ''").distinct()
    starts = vocabulary.select("word", F.explode(_starts(F.col("word"))).alias("start"))
    keyed = tokens.select("token", F.substring("token", 1, 2).alias("token_start"))
    hits = _counted(starts.join(keyed, F.col("start") == F.col("token_start")).filter(F.contains("word", "token")).select("word", "token").distinct())
    joined = in_words.join(hits, "word")
    return joined.select("ord", "token", F.col("of_title").alias("in_title"), (~F.col("of_title")).alias("in_text"))


def matches(corpus: DataFrame, tokens: DataFrame, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """(ord, token, in_title, in_text) of every document that contains a token; ``tokens`` has distinct tokens."""
    texts = corpus.select("ord", F.lower("title").alias("title"), F.lower("text").alias("text"))
    tokens = tokens.select("token").filter("token <> ''")
    # no more than one token over the bound reaches the driver, and none of unbounded length
    seen = [r.token for r in tokens.select(F.when(F.length("token") <= LONGEST_TOKEN, F.col("token")).alias("token")).limit(most_tokens + 1).collect()]
    few = len(seen) <= most_tokens and None not in seen and sum(map(len, seen)) <= MOST_CHARACTERS
    found = _matches_in_texts(texts, seen) if few else _matches_by_words(texts, tokens)
    # rows of one ord, also repeated ones, are one document
    return by_document(found).groupBy("ord", "token").agg(F.bool_or("in_title").alias("in_title"), F.bool_or("in_text").alias("in_text"))


def by_document(found: DataFrame) -> DataFrame:
    """Matches of one document in one partition. The number of partitions is given, so that it is kept: matches are few bytes, but become many pairs."""
    return found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ord")


def ranked(scored: DataFrame, size: int | None) -> DataFrame:
    """(query, ord, score, rank), best first."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= size) if size else out


def _best(found: DataFrame, weighted: DataFrame, score: Score, size: int | None) -> DataFrame | None:
    """(query, ord, score, rank), written, by scores that are bounded early; none where all results are asked for or the tokens are many.

    ``weighted`` is (query, token, n, weight, required).
    """
    if not size or min(score.title_boost, score.text_boost, score.tie_breaker) < 0:
        return None
    numbered = written(weighted.select("query").distinct().withColumn("query_no", F.monotonically_increasing_id()))
    token = F.when(F.length("token") <= LONGEST_TOKEN, F.col("token")).alias("token")
    rows = weighted.join(numbered, "query").select("query_no", token, "n", "weight", "required").limit(MOST_BROADCAST + 1).toArrow()
    if rows.num_rows > MOST_BROADCAST or rows["token"].null_count:
        return None
    return written(ranked(best_documents(found, rows, score, size).join(numbered, "query_no").select("query", "ord", "score"), size))


def keyword_best(tokens: DataFrame, found: DataFrame, size: int | None = None) -> DataFrame:
    """(query, ord, score, rank) of ``tokens`` (query, token, n), from ``found`` matches of these tokens and perhaps of others."""
    weighted = tokens.withColumn("weight", F.col("n").cast("double")).withColumn("required", F.lit(1))
    best = _best(found, weighted, Score(2.0, 1.0, 1.0, DIGITS), size)
    if best is not None:
        return best.withColumn("score", F.col("score").cast("long"))
    points = F.col("n") * (F.when(F.col("in_title"), 2).otherwise(0) + F.when(F.col("in_text"), 1).otherwise(0))
    return ranked(by_document(found).join(tokens, "token").groupBy("query", "ord").agg(F.sum(points).alias("score")), size)


def keyword_search(corpus: DataFrame, queries: DataFrame, size: int | None = None) -> DataFrame:
    """(query, ord, score, matched_terms, rank): 2 for each token in the title, 1 for each in the text."""
    tokens = _counted(query_tokens(queries))
    found = written(matches(corpus, tokens.select("token").distinct()))
    kept = keyword_best(tokens, found, size)
    # terms are gathered for the results only
    terms = kept.join(tokens.select("query", "token"), "query").join(found.select("ord", "token"), ["ord", "token"])
    return terms.groupBy("query", "ord", "score", "rank").agg(F.sort_array(F.collect_set("token")).alias("matched_terms")).select("query", "ord", "score", "matched_terms", "rank")


def document_frequency(corpus: DataFrame, tokens: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(token, df, idf) over the whole corpus; tokens without a document have df 0."""
    found = matches(corpus, tokens) if found is None else found
    total = corpus.agg(F.count("*").alias("total"))
    counted = tokens.join(found.groupBy("token").agg(F.count("*").alias("df")), "token", "left")
    df = F.coalesce("df", F.lit(0))
    # one row on the right
    return counted.join(F.broadcast(total)).select("token", df.alias("df"), F.ln(1 + (F.col("total") - df + 0.5) / (df + 0.5)).alias("idf"))


def weighted_matches(corpus: DataFrame, queries: DataFrame, keywords: bool = False) -> DataFrame:
    """The matches of all query terms, written: every search of these queries reads them, however it is configured.

    With ``keywords`` those of all words as well, for a keyword search to share them.
    """
    tokens = query_tokens(queries, query_terms).select("token")
    if keywords:
        tokens = tokens.union(query_tokens(queries).select("token"))
    return written(matches(corpus, tokens.distinct()))


def bm25_search(corpus: DataFrame, queries: DataFrame, config: Bm25Config = PRODUCTION, found: DataFrame | None = None) -> DataFrame:
    """(query, ord, score, rank): idf of the tokens in each field, boosted; the best field and a share of the other.

    ``found`` are the :func:`weighted_matches` of these queries, where several searches share them.
    """
    tokens = _counted(query_tokens(queries, query_terms))
    distinct = tokens.select("token").distinct()
    found = weighted_matches(corpus, queries) if found is None else found
    idf = document_frequency(corpus, distinct, found).select("token", "idf")
    lengths = tokens.groupBy("query").agg(F.sum("n").alias("n_tokens"))
    weight, required = F.col("n") * F.col("idf"), required_matches(F.col("n_tokens"), config.minimum_should_match)
    of_queries = tokens.join(idf, "token").join(lengths, "query").select("query", "token", "n", weight.alias("weight"), required.alias("required"))
    best = _best(found, of_queries, Score(config.title_boost, config.text_boost, config.tie_breaker, DIGITS), config.size)
    if best is not None:
        return best
    fields = (
        by_document(found)
        .join(idf, "token")
        .join(tokens, "token")
        .groupBy("query", "ord")
        .agg(
            F.sum(F.when(F.col("in_title"), weight).otherwise(0.0)).alias("title_score"),
            F.sum(F.when(F.col("in_text"), weight).otherwise(0.0)).alias("text_score"),
            F.sum("n").alias("n_matched"),
        )
        .join(lengths, "query")
        .filter(F.col("n_matched") >= required)
    )
    title, text = F.col("title_score") * config.title_boost, F.col("text_score") * config.text_boost
    score = F.round(F.greatest(title, text) + config.tie_breaker * F.least(title, text), DIGITS)
    return ranked(fields.select("query", "ord", score.alias("score")).filter("score > 0"), config.size)
