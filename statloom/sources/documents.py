"""Readers and writers of document files and tables.

A missing folder reads as an empty table with the given schema. An unreadable record is a row of nulls with its text in
``_corrupt``, never an error and never lost. Point lookups are filters, which reach the scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("documentType", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.StructType([T.StructField(n, T.StringType()) for n in ("sourceSystem", "sourceId", "sourceUrl", "retrievedAt")])),
        T.StructField("sourceRef", T.StructType([T.StructField(n, T.StringType()) for n in ("sourceType", "sourceId")])),
    ]
)
ARTICLE = "id string, statuteId string, articleNo string, articleTitle string, text string, paragraphs array<struct<no:string,text:string>>"
CASE = "id string, caseNumber string, caseName string, court string, summary string, fullText string"


def read_json(spark: SparkSession, path: str, schema, lines: bool = False) -> DataFrame:
    """JSON files that hold one record or an array of records each, or with ``lines`` a record a line, which Spark can split: the columns of ``schema`` and ``_corrupt``."""
    schema = (T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType([*schema])).add("_corrupt", T.StringType())
    try:
        return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return spark.createDataFrame([], schema)
        raise


def readable(df: DataFrame) -> DataFrame:
    """The records of :func:`read_json` that could be read."""
    return df.filter("_corrupt is null").drop("_corrupt") if "_corrupt" in df.columns else df


def write_json(df: DataFrame, path: str) -> None:
    """A record a line; ``read_json(..., lines=True)`` reads them."""
    df.write.mode("overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A database table, read in ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, **options).load()


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(key) == value).limit(1)


def articles_as_documents(df: DataFrame) -> DataFrame:
    """Statute articles as documents: the text, or the paragraphs one below the other."""
    paragraphs = F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n")
    return df.select(
        "id",
        F.lit("STATUTE_ARTICLE").alias("documentType"),
        F.coalesce("articleTitle", F.concat(F.lit("Article "), "articleNo")).alias("title"),
        F.coalesce(F.nullif(paragraphs, F.lit("")), "text").alias("text"),
        F.struct(F.lit("statute_article").alias("sourceType"), F.col("id").alias("sourceId")).alias("sourceRef"),
    )


def cases_as_documents(df: DataFrame) -> DataFrame:
    """Court cases as documents: title and text from the parts that are not blank."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return df.select(
        "id",
        F.lit("COURT_CASE").alias("documentType"),
        F.concat_ws(" ", part("caseNumber"), part("caseName")).alias("title"),
        F.concat_ws("\n", part("summary"), part("fullText")).alias("text"),
        F.struct(F.lit("court_case").alias("sourceType"), F.col("id").alias("sourceId")).alias("sourceRef"),
    )


def all_documents(articles: DataFrame, cases: DataFrame) -> DataFrame:
    """Both as documents, without the records that could not be read."""
    return articles_as_documents(readable(articles)).unionByName(cases_as_documents(readable(cases)))


def exists(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """``values`` (one column, named as ``key``) with ``found``: does ``df`` hold it? Null is never found."""
    known = df.select(F.col(key).alias("known_key")).distinct().withColumn("known", F.lit(True))
    return values.join(known, F.col(key) == F.col("known_key"), "left").select(key, F.coalesce("known", F.lit(False)).alias("found"))


def search_url(base: str, key: str, query, display: int = 100):
    """Address of a statute search."""
    return F.concat(F.lit(f"{base}?OC={key}&target=law&type=JSON&display={display}&query="), F.url_encode(query))


def detail_url(base: str, key: str, statute_id):
    """Address of a statute's articles."""
    return F.concat(F.lit(f"{base}?OC={key}&target=law&type=JSON&ID="), F.url_encode(statute_id))


def view_url(base: str, statute_id, jo=None):
    """Address of a statute, or of one of its articles."""
    url = F.concat(F.lit(f"{base}?ID="), F.url_encode(statute_id))
    return url if jo is None else F.concat(url, F.coalesce(F.concat(F.lit("&JO="), F.url_encode(jo)), F.lit("")))
