"""Citations, prompt context and grounding of answers.

Contexts are gathered for one query over its ranked documents, whose number the search limits. Null titles and texts
read as empty; a query without documents has an empty context and the ungrounded prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import claim_terms, claims, first_line, once
from statloom.operators.retrieval import documents_of

SUPPORTED_FROM = 0.6


def citation(document_id: Column, title: Column, source_type: Column, source_url: Column, text: Column) -> Column:
    """Citation of one document, with its first line as snippet."""
    return F.struct(
        F.concat(F.lit("citation:"), document_id).alias("id"),
        source_type.alias("source_type"),
        document_id.alias("source_id"),
        F.coalesce(title, F.lit("")).alias("title"),
        F.coalesce(source_url, F.lit("")).alias("source_url"),
        first_line(text).alias("snippet"),
    )


def prompt_context(ranked: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, documents, citations): retrieved documents and their citations in the order of their ranks."""
    document = F.struct("rank", F.col("document_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    cited = citation(F.col("document_id"), F.col("title"), F.col("source_type"), F.col("source_url"), F.col("text"))
    gathered = (
        ranked.select("query_id", "ord", "rank")
        .join(documents_of(corpus, ranked), "ord")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", document.alias("document"), cited.alias("cited")))).alias("found"))
    )
    return queries.select("query_id", "query").join(gathered, "query_id", "left").select(
        "query_id",
        "query",
        F.transform(F.coalesce("found", F.array()), lambda x: x["document"]).alias("documents"),
        F.transform(F.coalesce("found", F.array()), lambda x: x["cited"]).alias("citations"),
    )


def prompt_text(context: DataFrame) -> DataFrame:
    """(query_id, prompt): numbered context blocks and citations, or a plain question if nothing was retrieved."""
    blocks = F.array_join(
        F.transform(
            "documents",
            lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d["title"], F.lit("\nSource: "), d["id"], F.lit("\nText: "), d["text"]),
        ),
        "\n\n",
    )
    refs = F.array_join(F.transform("citations", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["title"], F.lit(" ("), c["source_id"], F.lit(")"))), "\n")
    grounded = F.concat(F.lit("Question: "), "query", F.lit("\n\nContext:\n"), blocks, F.lit("\n\nCitations:\n"), refs)
    plain = F.concat(F.lit("Question: "), "query", F.lit("\n\nNo context was found."))
    return context.select("query_id", F.when(F.size("documents") > 0, grounded).otherwise(plain).alias("prompt"))


#: What the model is told beside the prompt, and in place of a context that was not found; callers may pass their own.
SYSTEM = "Answer from the retrieved legal context alone, and say so where it does not suffice. Cite only the listed citations, exactly as they are written, near the claims they support."
UNGROUNDED = "No retrieved legal sources were found for this question.\nDo not answer from memory: state that no sufficient source was found, and point to the text of the statute or to a professional."


def prompt_request(context: DataFrame, system: str = SYSTEM, ungrounded: str = UNGROUNDED) -> DataFrame:
    """(query_id, system, prompt): the documents with their sources, the citations allowed, and the question."""
    number = lambda i: (i + 1).cast("string")
    documents = F.transform(
        F.arrays_zip("documents", "citations"),
        lambda x, i: F.concat(
            F.lit("["), number(i), F.lit("] "), x["documents"]["title"], F.lit("\nSource: "), x["citations"]["title"], F.lit(" ("), x["citations"]["source_url"], F.lit(")\nText: "), x["documents"]["text"]
        ),
    )
    cited = F.transform("citations", lambda c, i: F.concat(number(i), F.lit(". "), c["title"], F.lit(" - "), c["source_url"]))
    grounded = F.concat(
        F.lit("Retrieved legal context:\n"), F.array_join(documents, "\n\n"), F.lit("\n\nAvailable citations (cite only these, exactly as written):\n"), F.array_join(cited, "\n")
    )
    body = F.when(F.size("documents") > 0, grounded).otherwise(F.lit(ungrounded))
    return context.select("query_id", F.lit(system).alias("system"), F.concat(body, F.lit("\n\nQuestion: "), "query").alias("prompt"))


def overlap(terms: Column, context: Column) -> Column:
    """Share of terms that the lower-cased context contains; 1 if there is no term."""
    return F.coalesce(F.try_divide(F.size(F.filter(terms, lambda t: F.contains(context, t))), F.size(terms)), F.lit(1.0))


def claim_support(answers: DataFrame) -> DataFrame:
    """(answer_id, claim_no, claim, score, supported) for ``answers`` (answer_id, answer, context)."""
    # claims are scored within their row, so that no context is copied onto each of them
    score = lambda claim, context: once(claim_terms(claim), lambda terms: F.round(overlap(terms, context), 6))
    scored = once(
        F.lower(F.coalesce("context", F.lit(""))),
        lambda context: F.transform(claims(F.coalesce("answer", F.lit(""))), lambda c: F.struct(c.alias("claim"), score(c, context).alias("score"))),
    )
    return answers.select("answer_id", F.posexplode(scored).alias("claim_no", "c")).select(
        "answer_id", "claim_no", "c.claim", "c.score", (F.col("c.score") >= SUPPORTED_FROM).alias("supported")
    )


def grounding_report(answers: DataFrame, support: DataFrame) -> DataFrame:
    """One row: share of supported claims (1 for an answer without any), unsupported claims, answers that have some."""
    per_answer = (
        answers.select("answer_id")
        .join(support.groupBy("answer_id").agg(F.avg(F.col("supported").cast("double")).alias("grounded"), F.count_if(~F.col("supported")).alias("unsupported")), "answer_id", "left")
        .select(F.coalesce("grounded", F.lit(1.0)).alias("grounded"), F.coalesce("unsupported", F.lit(0)).alias("unsupported"))
    )
    return per_answer.agg(
        F.count("*").alias("n_answers"),
        F.round(F.coalesce(F.avg("grounded"), F.lit(0.0)), 6).alias("grounded_share"),
        F.coalesce(F.sum("unsupported"), F.lit(0)).alias("unsupported_claims"),
        F.count_if(F.col("unsupported") > 0).alias("answers_with_unsupported"),
    )


def case_grounding(answers: DataFrame) -> DataFrame:
    """(case_id, n_expected, context_coverage, grounded_answer, unsupported_claims, citation_coverage, passed) of each answered case.

    ``answers`` has case_id, answer, context, and arrays expected, retrieved and cited of document ids. What is not expected
    or cited counts as covered; an answer without claims is grounded.
    """
    empty = F.array().cast(answers.schema["retrieved"].dataType)
    expected, retrieved, cited = (F.array_distinct(F.coalesce(c, empty)) for c in ("expected", "retrieved", "cited"))
    share = lambda of: F.coalesce(F.try_divide(F.size(F.array_intersect(of, retrieved)), F.size(of)), F.lit(1.0))
    # the context is lower-cased once for each answer, and a claim is cut into terms once
    score = lambda claim, context: once(claim_terms(claim), lambda terms: F.round(overlap(terms, context), 6))
    scores = once(F.lower(F.coalesce("context", F.lit(""))), lambda context: F.transform(claims(F.coalesce("answer", F.lit(""))), lambda c: score(c, context)))
    scored = answers.select("case_id", F.size(expected).alias("n_expected"), share(expected).alias("context_coverage"), scores.alias("scores"), share(cited).alias("citation_coverage"))
    supported = F.size(F.filter("scores", lambda s: s >= SUPPORTED_FROM))
    out = scored.select(
        "case_id",
        "n_expected",
        F.round("context_coverage", 6).alias("context_coverage"),
        F.round(F.coalesce(F.try_divide(supported, F.size("scores")), F.lit(1.0)), 6).alias("grounded_answer"),
        (F.size("scores") - supported).alias("unsupported_claims"),
        F.round("citation_coverage", 6).alias("citation_coverage"),
    )
    passed = (F.col("context_coverage") == 1) & (F.col("grounded_answer") == 1) & (F.col("unsupported_claims") == 0) & (F.col("citation_coverage") == 1)
    return out.withColumn("passed", passed)


def case_grounding_report(grounding: DataFrame) -> DataFrame:
    """One row: context coverage over the cases that expect something, all else over all cases."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return grounding.agg(
        F.count("*").alias("n_cases"),
        F.count_if(F.col("n_expected") > 0).alias("n_positive"),
        mean(F.when(F.col("n_expected") > 0, F.col("context_coverage"))).alias("context_coverage"),
        mean("grounded_answer").alias("grounded_answer"),
        F.coalesce(F.sum("unsupported_claims"), F.lit(0)).alias("unsupported_claims"),
        F.count_if(F.col("unsupported_claims") > 0).alias("cases_with_unsupported"),
        mean("citation_coverage").alias("citation_coverage"),
    )


def answer_checks(answers: DataFrame) -> DataFrame:
    """(answer_id, not_empty, keyword_share, has_citation, citation_share, passed).

    ``answers`` has answer, keywords, cited and expected_citations (arrays); what is not expected counts as met.
    """
    answer = F.lower(F.coalesce("answer", F.lit("")))
    keywords = F.coalesce("keywords", F.array().cast("array<string>"))
    cited = F.coalesce("cited", F.array().cast("array<string>"))
    expected = F.coalesce("expected_citations", F.array().cast("array<string>"))
    share = F.coalesce(F.try_divide(F.size(F.filter(keywords, lambda k: F.contains(answer, F.lower(k)))), F.size(keywords)), F.lit(1.0))
    met = F.coalesce(F.try_divide(F.size(F.array_intersect(expected, cited)), F.size(F.array_distinct(expected))), F.lit(1.0))
    return answers.select(
        "answer_id",
        (F.trim(answer) != "").alias("not_empty"),
        F.round(share, 6).alias("keyword_share"),
        (F.size(cited) > 0).alias("has_citation"),
        F.round(met, 6).alias("citation_share"),
    ).withColumn("passed", F.col("not_empty") & (F.col("keyword_share") >= 1) & F.col("has_citation") & (F.col("citation_share") >= 1))
