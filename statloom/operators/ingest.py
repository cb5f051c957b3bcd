"""Search results and statute payloads to documents, on the flat tables of shared inlining.

Defined cases: unreadable payloads give no rows; articles without a number, headings and articles without any text are
dropped; of several entries of one article the richest counts, of equal ones the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.text import leading_number, non_empty, padded_digits, utrim
from statloom.operators.nested import inline_shared
from statloom.operators.statute_nodes import REPEATABLE

# A heading's text; the strict form asks for a letter or digit right after it.
HEADING = r"^제\s*\d+\s*(편|장|절|관)(?=\s|$)"
HEADING_STRICT = r"^제\s*\d+\s*(편|장|절|관)(?=[A-Za-z0-9_])"


def search_documents(df: DataFrame, record_id: str, payload: str, source_id: str) -> DataFrame:
    """(record_id, position, document_id, title, text) of each search item; its values are not trimmed."""
    _, nodes = inline_shared(df, record_id, payload, {"법령ID", "법령일련번호", "법령명한글", "법령구분명", "소관부처명", "공포일자", "시행일자"}, REPEATABLE)
    items = nodes.filter((F.col("table_name") == "law") & (F.col("parent_table") == "$"))
    attr = lambda n: F.nullif(F.col("attrs")[n], F.lit(""))
    sources = df.select(F.col(record_id).alias("s_record"), F.col(source_id).alias("s_source")).distinct()
    return (
        items.join(sources, F.col("record_id") == F.col("s_record"))
        .select(
            "record_id",
            F.element_at("path_positions", -1).alias("position"),
            F.coalesce(attr("법령ID"), attr("법령일련번호"), F.col("s_source")).alias("document_id"),
            F.coalesce(attr("법령명한글"), F.lit("")).alias("title"),
            F.concat_ws(" ", *(attr(n) for n in ("법령명한글", "법령구분명", "소관부처명", "공포일자", "시행일자"))).alias("text"),
        )
        .distinct()
    )


def statute_articles(df: DataFrame, record_id: str, payload: str, strict_headings: bool = False) -> DataFrame:
    """(document_id, record_id, statute_id, article, jo, title, text) of each article, one row for each document_id."""
    names = {"조문번호", "조문가지번호", "조문제목", "조문내용", "항내용", "호내용", "목내용", "법령ID", "법령명_한글", "법령명한글", "법령명", "공포일자", "시행일자"}
    _, nodes = inline_shared(df, record_id, payload, names, REPEATABLE | {"기본정보", "법령"})
    attr = lambda n: non_empty(F.col("attrs")[n])
    last, path = F.element_at("path_names", -1), F.col("path_positions")
    unit = F.array_position("path_names", "조문단위")
    depth = F.when(unit > 0, unit).otherwise(F.array_position("path_names", "조문")).cast("int")
    container = (last == "조문") & F.array_contains("members", "조문단위")
    inside = nodes.filter((F.array_position("path_names", "조문") > 0) & ~container).withColumn("article_path", F.slice(path, 1, depth))
    lines = (
        inside.filter(last.isin("항", "호", "목"))
        .withColumn("line", F.coalesce(attr("항내용"), attr("호내용"), attr("목내용")))
        .filter("line is not null")
        .groupBy("record_id", "article_path")
        # an article's own lines; the paths sort them depth first
        .agg(F.transform(F.array_sort(F.collect_set(F.struct("path_positions", "line"))), lambda x: x["line"]).alias("lines"))
    )
    # the basics of a statute stand in their own object, or in the root if there is none
    place = F.when((last == "기본정보") & F.col("parent_table").isin("법령", "$"), 0).when(last == "법령", 1).when(last == "$", 2)
    titles = F.coalesce(attr("법령명_한글"), attr("법령명한글"), attr("법령명"))
    found = F.struct(attr("법령ID").alias("statute_id"), titles.alias("statute_title"), attr("공포일자").alias("promulgated"), attr("시행일자").alias("enforced"))
    basics = (
        nodes.select("record_id", place.alias("place"), found.alias("found"))
        .filter("place is not null")
        .groupBy("record_id", "place")
        .agg(F.struct(*(F.max(f"found.{c}").alias(c) for c in ("statute_id", "statute_title", "promulgated", "enforced"))).alias("found"))
        .groupBy("record_id")
        .agg(F.min_by("found", "place").alias("found"))
        .select("record_id", "found.*")
    )
    articles = (
        inside.filter(last.isin("조문", "조문단위") & (F.size("path_positions") == F.size("article_path")))
        .select(
            "record_id",
            "article_path",
            leading_number(attr("조문번호")).alias("number"),
            leading_number(attr("조문가지번호")).alias("branch"),
            attr("조문제목").alias("article_title"),
            attr("조문내용").alias("content"),
        )
        .distinct()
        .filter("number is not null")
        .join(lines, ["record_id", "article_path"], "left")
        .join(basics, "record_id", "left")
    )
    has_branch = F.coalesce(F.col("branch") != "0", F.lit(False))
    shown = F.when(has_branch, F.concat("number", F.lit("-"), "branch")).otherwise(F.col("number"))
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    heading = F.col("article_title").isNull() & (n_lines == 0) & F.col("content").rlike(HEADING_STRICT if strict_headings else HEADING)
    richness = F.when(n_lines > 0, 2).otherwise(0) + F.coalesce(F.length("content"), F.lit(0)) / 10_000
    title = F.coalesce("statute_title", F.lit(""))
    header = F.concat_ws(
        "\n",
        F.when(title != "", F.concat(F.lit("법령명: "), title)),
        F.concat(F.lit("조문: 제"), shown, F.lit("조")),
        F.concat(F.lit("조문 제목: "), "article_title"),
        F.concat(F.lit("공포일자: "), "promulgated"),
        F.concat(F.lit("시행일자: "), "enforced"),
    )
    body = F.concat_ws("\n", F.regexp_replace("content", "\r\n?", "\n"), F.array_join("lines", "\n"))
    kept = (
        articles.filter(~F.coalesce(heading, F.lit(False)) & (F.col("content").isNotNull() | (n_lines > 0)))
        .withColumn("document_id", F.concat(F.coalesce("statute_id", F.col("record_id")), F.lit(":"), shown))
        .withColumn("richness", richness)
    )
    first = Window.partitionBy("record_id", "document_id").orderBy(F.desc("richness"), "article_path")
    return (
        kept.withColumn("place", F.row_number().over(first))
        .filter("place = 1")
        .select(
            "document_id",
            "record_id",
            "statute_id",
            shown.alias("article"),
            F.concat(padded_digits(F.col("number"), 4), padded_digits(F.coalesce("branch", F.lit("0")), 2)).alias("jo"),
            utrim(F.concat(title, F.lit(" 제"), shown, F.lit("조"), F.coalesce(F.concat(F.lit("("), "article_title", F.lit(")")), F.lit("")))).alias("title"),
            F.concat_ws("\n\n", header, F.nullif(body, F.lit(""))).alias("text"),
        )
    )


def to_entities(df: DataFrame, source: str, document_id: str, columns: list[str]) -> DataFrame:
    """(id, source, document_id, raw_data): rows as they are stored, the document as JSON in field order."""
    return df.select(F.concat(source, F.lit(":"), document_id).alias("id"), F.col(source).alias("source"), F.col(document_id).alias("document_id"), F.to_json(F.struct(*columns)).alias("raw_data"))


def redacted(text, secrets: list[str], by: str = "***"):
    """Column with every secret replaced literally."""
    for secret in secrets:
        text = F.replace(text, F.lit(secret), F.lit(by))
    return text
