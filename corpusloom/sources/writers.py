"""File sinks. All of them write from the executors; none orders or gathers the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.documents import BATCH_SIZE, batch_numbers, index_documents, topic_bag_documents
from corpusloom.operators.increment import DAY_COLUMN, corpus_text, with_update_day
from corpusloom.operators.store import insert_if_absent, keep_first, latest
from corpusloom.sources.readers import read_articles


def append_new(new: DataFrame, path: str, create: bool = False) -> None:
    """Append the rows of ``new`` the article table at ``path`` does not hold yet.

    ``create`` starts a table and fails where there is one already. Safe for one writer per
    table. ``rebalance`` evens out the files per day: small days
    share a task, and a day with a third of all rows is split over several.
    """
    spark = new.sparkSession
    rows = keep_first(new, staged=True) if create else insert_if_absent(new, read_articles(spark, path))
    with_update_day(rows).hint("rebalance", DAY_COLUMN).write.mode("errorifexists" if create else "append").partitionBy(DAY_COLUMN).parquet(path)


def export_corpus(articles: DataFrame, path: str) -> None:
    """Corpus text keyed by document name."""
    corpus_text(articles).write.mode("overwrite").parquet(path)


def write_index_batches(
    articles: DataFrame, path: str, with_topics: bool = False, n: int = BATCH_SIZE, exact: bool = False
) -> None:
    """Index documents as JSON lines, at most ``n`` per file, without a shuffle.

    With ``exact`` every file but the last holds ``n`` documents: they are numbered
    (``batch_numbers``, so ids must be unique) and shuffled into a folder ``batch=...`` each.
    """
    docs = index_documents(articles, with_topics)
    if exact:
        batch_numbers(docs, size=n).repartition("batch").write.mode("overwrite").partitionBy("batch").json(path)
    else:
        docs.write.mode("overwrite").option("maxRecordsPerFile", n).json(path)


def append_corpus(articles: DataFrame, path: str, run: int) -> None:
    """The texts of a run as a part of the corpus; what is there stays. Repeating a run replaces its part."""
    corpus_text(latest(articles)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def write_topic_bags(bags: DataFrame, path: str) -> None:
    topic_bag_documents(bags).write.mode("overwrite").json(path)


def write_docs(articles: DataFrame, path: str) -> None:
    index_documents(articles).write.mode("overwrite").json(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """Ranked hits as CSV, one folder per request, columns in fixed order."""
    columns = ["request_id", "title", "abstract", "article_type", "topics", "id", "order"]
    (
        hits.select(*columns)
        .repartition("request_id")
        .sortWithinPartitions("request_id", "order")
        .write.mode("overwrite").partitionBy("request_id").option("header", True).option("escape", '"').csv(path)
    )


def write_queries(expanded: DataFrame, path: str) -> None:
    """One query per line; requests without a query are left out."""
    expanded.where(F.col("query").isNotNull()).select("query").write.mode("overwrite").text(path)


def write_topic_terms(topic_terms: DataFrame, path: str) -> None:
    topic_terms.select("topic", "term", "weight").write.mode("overwrite").option("header", True).csv(path)


def write_doc_topics(doc_topics: DataFrame, path: str) -> None:
    doc_topics.select("docname", "topic", "proportion").write.mode("overwrite").option("header", True).csv(path)


def export_feed(articles: DataFrame, path: str) -> None:
    """Articles as UTF-8 JSON lines."""
    articles.write.mode("overwrite").option("encoding", "UTF-8").json(path)
