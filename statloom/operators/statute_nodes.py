"""Search items, articles, paragraphs, items and sub-items of statute payloads, from the tables of shared inlining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.nested import inline_shared

# Member names of the payloads.
SEARCH, SEARCH_ITEM, LAW_ID, LAW_MASTER_NO = "LawSearch", "law", "법령ID", "법령일련번호"
ARTICLES, ARTICLE_UNIT, ARTICLE_NO, BRANCH_NO = "조문", "조문단위", "조문번호", "조문가지번호"
LEVELS = {ARTICLES: "article", ARTICLE_UNIT: "article", "항": "paragraph", "호": "item", "목": "subitem"}
#: Elements that may repeat by the payloads' schema.
REPEATABLE = frozenset({SEARCH_ITEM, *LEVELS})


def _filled(name: str):
    value = F.col("attrs")[name]
    return F.when(F.trim(value) != "", value)


def _plain_number(value):
    """Without leading zeros; of zeros alone one stays."""
    return F.regexp_replace(value, "^0+(?=.)", "")


def statute_nodes(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(record_id, node_level, node_path, parent_path, node_key), distinct.

    A ``조문`` that holds ``조문단위`` is their container, not an article. Paths join the positions from the article down;
    a search item has its own position. The parent is the row that shredding names as such, or, where that is of an element
    between two levels, the nearest row above it that has a level.
    """
    _, nodes = inline_shared(df, id_col, json_col, {LAW_ID, LAW_MASTER_NO, ARTICLE_NO, BRANCH_NO}, REPEATABLE)
    names = F.col("path_names")
    depth = F.size(names)
    name, above = F.element_at(names, -1), F.try_element_at(names, F.lit(-2))
    # where the article stands in the path: its unit if there is one, else the first 조문
    unit = F.array_position(names, ARTICLE_UNIT)
    start = F.when(unit > 0, unit).otherwise(F.array_position(names, ARTICLES)).cast("int")
    container = (name == ARTICLES) & F.array_contains("members", ARTICLE_UNIT)
    # as far down as the parent row; what is inlined between it and the node has no row to link to
    above_levels = F.transform("path_names", lambda x, i: F.when(x.isin(*LEVELS) & (i < F.col("parent_depth")), i + 1).otherwise(0))
    branch = _filled(BRANCH_NO)
    joined = lambda down_to: F.array_join(F.slice("path_positions", start, F.greatest(down_to - start + 1, F.lit(0))), ".")
    is_law = (name == SEARCH_ITEM) & (above == SEARCH)
    level = F.when(is_law, "law").when((start > 0) & ~container, F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[name])
    return (
        nodes.withColumn("node_level", level)
        .filter(F.col("node_level").isNotNull())
        .select(
            "record_id",
            "node_level",
            F.when(is_law, F.element_at("path_positions", -1).cast("string")).otherwise(joined(depth)).alias("node_path"),
            F.when(is_law, "").otherwise(joined(F.array_max(above_levels))).alias("parent_path"),
            F.when(is_law, F.coalesce(_filled(LAW_ID), _filled(LAW_MASTER_NO), F.lit("")))
            .when(
                F.col("node_level") == "article",
                F.concat(
                    F.coalesce(_plain_number(_filled(ARTICLE_NO)), F.lit("")),
                    F.when(_plain_number(branch) != "0", F.concat(F.lit("-"), _plain_number(branch))).otherwise(""),
                ),
            )
            .otherwise("")
            .alias("node_key"),
        )
        .distinct()
    )
