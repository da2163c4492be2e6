"""The given tables seen as the engine's tables.

Everything is derived from whole tables and whole texts; the oracle states the same
expressions in its own SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import request_text, topic_id
from corpusloom.operators.documents import enrich
from corpusloom.operators.increment import corpus_text
from corpusloom.operators.topics import group_topic_terms, term_doc_topics, topic_bags
from corpusloom.session import spread, stage

FIRST_UPDATE = 1528119650
RUN_TS = 1530002937


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts or pages, which are heavy per row.

    Its splits are those of its files, unless the session names a number of them in
    ``spark.corpusloom.textSplits`` (a table of one small file is one split else).
    """
    splits = spark.conf.get("spark.corpusloom.textSplits", None)
    return spread(table(spark, sf_dir, name), int(splits)) if splits else table(spark, sf_dir, name)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles. A text of one paragraph is an abstract without full text;
    otherwise the abstract is the first paragraph and the full text is the whole text."""
    one_paragraph = F.instr("text", "\n") == 0
    return texts(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"),
        F.array("source").alias("authors"),
        F.substring_index("text", "\n", 1).alias("abstract"),
        (1990 + F.col("doc_id") % 30).cast("string").alias("release_date"),
        F.col("lang").alias("article_type"),
        F.when(~one_paragraph, F.col("text")).alias("fulltext"),
        F.when(F.col("lang") != "es", F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("file_url"),
        F.when(F.col("n_chars") >= 200, F.array("lang", "source")).alias("keywords"),
        (FIRST_UPDATE + F.col("doc_id") * 60).alias("last_update"),
    )


def later_copies(rows: DataFrame) -> DataFrame:
    """The same articles once more, fetched an hour later with an edited abstract."""
    return rows.withColumn("last_update", F.col("last_update") + 3600).withColumn(
        "abstract", F.concat("abstract", F.lit(" (edited)"))
    )


def stored_articles(rows: DataFrame) -> DataFrame:
    """The part of the articles taken as stored before: those in English."""
    return rows.where(F.col("article_type") == "en")


def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted topic terms of ``documents`` by source, staged as a small table."""
    by_source = texts(spark, sf_dir, "documents").select(
        topic_id(F.regexp_extract("source", r"(\d+)", 1)).alias("topic"), "text"
    )
    return stage(group_topic_terms(by_source, "topic"), "topic-terms")


def doc_topics(spark: SparkSession, sf_dir: str, terms: DataFrame) -> DataFrame:
    return term_doc_topics(corpus_text(articles(spark, sf_dir)), terms)


def enriched_articles(spark: SparkSession, sf_dir: str, terms: DataFrame, how: str = "inner") -> DataFrame:
    """The articles with their topics. The topics are staged, since a load reads its rows more than once."""
    return enrich(articles(spark, sf_dir), stage(topic_bags(doc_topics(spark, sf_dir, terms)), "topic-bags"), how)


def term_requests(terms: DataFrame) -> DataFrame:
    """A request per topic: its two first terms."""
    place = F.col("rank") % 10
    return (
        terms.where(place < 2)
        .groupBy(F.col("topic").cast("bigint").alias("request_id"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("w"))
        .select("request_id", request_text(F.col("w.term")).alias("request"))
    )


def turn_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a request."""
    return texts(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.lower("text").alias("request")
    )


def passage_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a request."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("request"))


def title_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article title as a request."""
    return articles(spark, sf_dir).select(F.col("id").cast("bigint").alias("request_id"), F.col("title").alias("request"))
