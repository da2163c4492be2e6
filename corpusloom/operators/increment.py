"""Incremental reading by high-water mark, and corpus text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_COLUMN = "update_day"


def day_of(ts: Column) -> Column:
    """UTC day of epoch seconds, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(ts / 86_400).cast("int"))


def with_update_day(articles: DataFrame) -> DataFrame:
    """Articles with the partition column of their table: the day of ``last_update``."""
    return articles.withColumn(DAY_COLUMN, day_of(F.col("last_update")))


def increment(articles: DataFrame, mark: int, now: int) -> DataFrame:
    """Rows with ``mark <= last_update <= now``, both ends included.

    When the table is partitioned by day, the day range is stated too, so only the
    partitions in range are listed and read.
    """
    rows = articles.where(F.col("last_update").between(mark, now))
    if DAY_COLUMN in articles.columns:
        rows = rows.where(F.col(DAY_COLUMN).between(day_of(F.lit(mark)), day_of(F.lit(now))))
    return rows


def corpus_text(articles: DataFrame) -> DataFrame:
    """Text to model: full text, or the abstract where there is none (an empty text counts)."""
    return articles.select(
        F.col("id").alias("docname"), F.coalesce("fulltext", "abstract").alias("text")
    )
