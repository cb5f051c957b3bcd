"""The pN_ queries of the problems in this package."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm import lookalike
from statloom.llm.lookalike import same_looking, same_looking_pairs
from statloom.llm.neighbours import nearest, neighbour_pairs
from statloom.llm.packing import fill_report, pack
from statloom.llm.splitting import split_oversized
from statloom.llm.tokenizer import token_count, token_ids
from statloom.llm.truncation import cuts_by_step, readings, storage_limits, truncated, truncation_by_source
from statloom.session import written
from statloom.tables import load

PIECE_LIMIT, PIECE_OVERLAP = 1_000, 100
CONTAINER = 4_096
NEIGHBOURS, DIMENSIONS, PROBES = 10, 768, 24


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every content and chunk of more than PIECE_LIMIT characters."""
    documents = load(spark, sf_dir, "legal_documents").select(F.lit("legal_documents").alias("item_table"), F.col("document_id").alias("item_id"), F.col("content").alias("text"))
    chunks = load(spark, sf_dir, "document_chunks").select(F.lit("document_chunks").alias("item_table"), F.col("id").alias("item_id"), "text")
    return split_oversized(documents.unionAll(chunks), "text", PIECE_LIMIT, PIECE_OVERLAP).select("item_table", "item_id", F.inline("pieces"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that were cut: those that came out as more than one piece."""
    return p3_pieces(spark, sf_dir).filter("piece_no > 0").select("item_table", "item_id").distinct()


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the pieces of each value: none over the limit, the overlap repeated, the text whole, no number cut at its comma."""
    pieces = p3_pieces(spark, sf_dir).distinct()
    before = Window.partitionBy("item_table", "item_id").orderBy("piece_no")
    seen = pieces.withColumn("before", F.lag("piece").over(before)).withColumn("stopped", F.lag("stop").over(before))
    number_cut = F.regexp_like(F.concat(F.right("before", F.lit(2)), F.substr("piece", F.lit(PIECE_OVERLAP + 1), F.lit(2))), F.lit(r"^\d,\d\d"))
    return seen.groupBy("item_table", "item_id").agg(
        F.max("stop").alias("n_chars"),
        F.count_if(F.length("piece") > PIECE_LIMIT).alias("n_too_long"),
        F.count_if(F.left("piece", F.lit(PIECE_OVERLAP)) != F.right("before", F.lit(PIECE_OVERLAP))).alias("n_wrong_overlaps"),
        F.count_if((F.col("stopped") - F.col("start") != PIECE_OVERLAP) | (F.length("piece") != F.col("stop") - F.col("start"))).alias("n_gaps"),
        F.count_if(number_cut).alias("n_cut_numbers"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose title and content look the same but are stored in different characters."""
    pairs = same_looking_pairs(load(spark, sf_dir, "legal_documents"), "document_id", ["title", "content"])
    return pairs.select(F.col("a").alias("document_id_a"), F.col("b").alias("document_id_b"))


def p4_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stands for each look, and its number of stored forms."""
    members = same_looking(load(spark, sf_dir, "legal_documents"), "document_id", ["title", "content"])
    return members.select(F.col("key").alias("document_id"), "representative", "n_forms")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of indexed documents of which one is among the nearest of the other."""
    pairs = neighbour_pairs(load(spark, sf_dir, "legal_index"), "ord", "embedding", NEIGHBOURS, DIMENSIONS, probes=PROBES)
    return pairs.select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"))


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest documents of each, in order."""
    near = nearest(load(spark, sf_dir, "legal_index"), "ord", "embedding", NEIGHBOURS, DIMENSIONS, probes=PROBES)
    return near.select(F.col("id").alias("ord"), "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    return load(spark, sf_dir, "documents").select("doc_id", token_ids("text").alias("ids"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of CONTAINER tokens, and which text stands in which."""
    sized = load(spark, sf_dir, "documents").select("doc_id", token_count("text").alias("n_tokens"))
    return pack(sized, "doc_id", "n_tokens", CONTAINER)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the packing: every text in it with all its tokens, none over a container, containers nearly full."""
    sized = load(spark, sf_dir, "documents").select("doc_id", token_count("text").alias("n_tokens"))
    packed = written(pack(sized, "doc_id", "n_tokens", CONTAINER))
    per_text = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_packed"), F.count("*").alias("n_pieces"))
    joined = sized.withColumnRenamed("doc_id", "t_doc").join(per_text, F.col("t_doc") == F.col("doc_id"), "left")
    kept = joined.agg(
        F.count("*").alias("n_texts"),
        F.count_if(F.coalesce("n_packed", F.lit(-1)) != F.col("n_tokens")).alias("n_wrong"),
        F.count_if(F.col("n_pieces") != F.greatest(F.ceil(F.col("n_tokens") / CONTAINER), F.lit(1))).alias("n_split"),
    )
    report = fill_report(packed, CONTAINER).select("n_over", (F.col("share_filled") >= 0.99).alias("is_full"))
    return kept.join(F.broadcast(report))  # one row each


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are, and how full."""
    return fill_report(p7_pack(spark, sf_dir), CONTAINER)


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(load(spark, sf_dir, "documents"), "doc_id", "source", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were cut on their way."""
    return truncated(_readings(spark, sf_dir)).select(F.col("key").alias("doc_id")).distinct()


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at which sources cut, in each measure that exposes them."""
    return storage_limits(_readings(spark, sf_dir))


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's texts that were cut."""
    return truncation_by_source(_readings(spark, sf_dir))


def p8_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cut texts of each source stand at a storage limit, and how many were cut mid-transfer."""
    return cuts_by_step(_readings(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_checks": p3_checks, "p4_found": p4_found, "p4_looks": p4_looks, "p5_found": p5_found, "p5_nearest": p5_nearest, "p6_ids": p6_ids, "p7_pack": p7_pack, "p7_fill": p7_fill, "p7_checks": p7_checks, "p8_found": p8_found, "p8_limits": p8_limits, "p8_sources": p8_sources, "p8_steps": p8_steps}

_NEAREST_SQL = f"""
WITH members AS (SELECT ord, any_value(embedding)::DOUBLE[{DIMENSIONS}] AS v FROM legal_index
                 WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY ord),
near AS (SELECT ord, neighbour, similarity, rank FROM (
  SELECT a.ord AS ord, b.ord AS neighbour, array_cosine_similarity(a.v, b.v) AS similarity,
         row_number() OVER (PARTITION BY a.ord ORDER BY round(array_cosine_similarity(a.v, b.v), 12) DESC, b.ord) AS rank
  FROM members a JOIN members b ON a.ord <> b.ord) WHERE rank <= {NEIGHBOURS})"""


def _plain_sql(column: str) -> str:
    """DuckDB's side of problem 4: single characters only, which is enough where no token mixes scripts of its own."""
    pairs = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= {c: " " for c in "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"}
    for line in lookalike.SAME_MARKS.split("\n"):
        if line:
            mark, *codes = line.split()
            pairs |= {chr(int(c, 16)): mark for c in codes}
    pairs |= {x: next(iter(row.values())) for x, row in lookalike.spellings().items()}
    for letter in map(chr, range(0x370, 0x530)):  # composed ones, as far as the spelling is composed too
        base, marks = (d := unicodedata.normalize("NFD", letter))[0], d[1:]
        to = unicodedata.normalize("NFC", pairs.get(base, base) + marks)
        if marks and len(to) == 1:
            pairs[letter] = to
    old, new = ("".join(x).replace("'", "''") for x in zip(*((a, b) for a, b in pairs.items() if a != b), strict=True))
    hidden = r"[\p{Cf}\x{34f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180d}\x{3164}\x{ffa0}\x{fe00}-\x{fe0f}]"
    return f"nfc_normalize(translate(regexp_replace(nfc_normalize({column}), '{hidden}', '', 'g'), '{old}', '{new}'))"


_PLAIN = f"""
WITH rows_of AS (SELECT DISTINCT document_id, title, content FROM legal_documents),
plain AS (SELECT *, {_plain_sql("title")} AS t, {_plain_sql("content")} AS c FROM rows_of)"""

ORACLE_SQL = {
    "p4_looks": _PLAIN
    + """,
looks AS (SELECT t, c, min(document_id) AS representative, count(DISTINCT (title, content)) AS n_forms FROM plain GROUP BY ALL)
SELECT DISTINCT document_id, representative, n_forms FROM plain p JOIN looks l ON p.t IS NOT DISTINCT FROM l.t AND p.c IS NOT DISTINCT FROM l.c""",
    "p4_found": _PLAIN
    + """
SELECT DISTINCT a.document_id AS document_id_a, b.document_id AS document_id_b FROM plain a JOIN plain b
  ON a.t IS NOT DISTINCT FROM b.t AND a.c IS NOT DISTINCT FROM b.c AND a.document_id < b.document_id
WHERE a.title IS DISTINCT FROM b.title OR a.content IS DISTINCT FROM b.content
""",
    "p5_found": _NEAREST_SQL + " SELECT DISTINCT least(ord, neighbour) AS ord_a, greatest(ord, neighbour) AS ord_b FROM near",
    "p5_nearest": _NEAREST_SQL + " SELECT ord, neighbour, round(similarity, 6) AS similarity, rank FROM near",
    "p3_checks": """
SELECT item_table, item_id, length(text) AS n_chars, 0 AS n_too_long, 0 AS n_wrong_overlaps, 0 AS n_gaps, 0 AS n_cut_numbers FROM (
  SELECT DISTINCT 'legal_documents' AS item_table, document_id AS item_id, content AS text FROM legal_documents
  UNION SELECT DISTINCT 'document_chunks', id, text FROM document_chunks) WHERE length(text) > 1000
""",
    "p7_checks": "SELECT count(*) AS n_texts, 0 AS n_wrong, 0 AS n_split, 0 AS n_over, true AS is_full FROM documents",
    "p3_found": """
SELECT DISTINCT 'legal_documents' AS item_table, document_id AS item_id FROM legal_documents WHERE length(content) > 1000
UNION
SELECT DISTINCT 'document_chunks', id FROM document_chunks WHERE length(text) > 1000
""",
}
