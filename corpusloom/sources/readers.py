"""Table and file readers; every file of our own has a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.operators.increment import DAY_COLUMN
from corpusloom.session import stage


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The article table with its day column; a filter on the day prunes partitions."""
    fields = schema.T.StructType([*schema.ARTICLE.fields, schema.T.StructField(DAY_COLUMN, schema.T.DateType())])
    return spark.read.schema(fields).parquet(path)


CORRUPT = "corrupt_record"


def _read_csv(spark: SparkSession, path: str, fields, outside: bool) -> DataFrame:
    """Our own files fail on a bad row. Files from outside are read with one column more that
    holds the bad rows as they are; ``good_rows`` and ``bad_rows`` tell them apart."""
    reader = spark.read.option("header", True)
    if not outside:
        return reader.schema(fields).option("mode", "FAILFAST").csv(path)
    with_bad = schema.T.StructType([*fields.fields, schema.T.StructField(CORRUPT, schema.T.StringType())])
    return reader.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def good_rows(table: DataFrame) -> DataFrame:
    return table.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_rows(table: DataFrame) -> DataFrame:
    return table.where(F.col(CORRUPT).isNotNull())


def read_topic_terms(spark: SparkSession, path: str, outside: bool = False) -> DataFrame:
    """``topic, term, weight`` as in the file; topics stay strings."""
    return _read_csv(spark, path, schema.TOPIC_TERMS, outside)


def in_file_order(table: DataFrame) -> DataFrame:
    """Adds ``rank``, the order of the rows in their file, which settles ties.

    For a table as read from a file (of a topic-terms size: it is read in one pass per split
    and ranked by split and place).
    """
    return table.withColumn("rank", F.monotonically_increasing_id())


def with_rank(topic_terms: DataFrame) -> DataFrame:
    """Rank of a topic-term row: by topic, heaviest first, then term.

    Topics have few terms each, so the numbering within a topic is a small window; the
    rank is the pair (topic number, place) packed into one number.
    """
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return topic_terms.withColumn("rank", F.col("topic").cast("bigint") * 1_000_000 + place)


def read_doc_topics(spark: SparkSession, path: str, outside: bool = False) -> DataFrame:
    return _read_csv(spark, path, schema.DOC_TOPICS, outside)


def read_corpus(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """``(docname, text)`` of the runs up to ``upto``: the text of a document's last run.

    Runs are settled on names and run numbers; the texts are only filtered by what a later
    run replaced.
    """
    parts = spark.read.parquet(path).where(F.col("run") <= upto)
    last = parts.groupBy("docname").agg(F.max("run").alias("last"), F.count("*").alias("n")).where("n > 1").select("docname", "last")
    replaced = stage(parts.select("docname", "run").join(last, "docname").where("run < last").select("docname", "run"), "replaced-texts")
    return parts.join(replaced, ["docname", "run"], "left_anti").select("docname", "text")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page table, or a folder of HTML files when ``path`` does not hold Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema.PAGE).parquet(path)
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.xxhash64("_metadata.file_path").alias("page_id"),
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"),
    )


def read_index_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.INDEX_DOCUMENT).option("mode", "FAILFAST").json(path)


def read_topic_bags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TOPIC_BAG).option("mode", "FAILFAST").json(path)


def response_hits(responses: DataFrame, json: str = "json") -> DataFrame:
    """Hits of search responses as rows, ``order`` from 1; other columns are kept.

    Missing topics are the empty text, as in ``search.hit_rows``.
    """
    keep = [c for c in responses.columns if c != json]
    parsed = responses.select(*keep, F.from_json(json, schema.SEARCH_RESPONSE).alias("r"))
    hits = parsed.select(*keep, F.posexplode("r.hits.hit").alias("at", "h"))
    return hits.select(
        *keep,
        (F.col("at") + 1).alias("order"),
        "h.id",
        "h.fields.title",
        "h.fields.abstract",
        "h.fields.article_type",
        F.coalesce(F.to_json("h.fields.topics"), F.lit("")).alias("topics"),
    )
