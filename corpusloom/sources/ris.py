"""RIS bibliography files as article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_identifier

RECORD_END = "\nER  -"

# Tags of the public RIS format.
IDENTIFIER = "AN"
TITLE = "TI"
TRANSLATED_TITLE = "TT"
AUTHOR = "AU"
ABSTRACT = "AB"
YEAR = "PY"
KIND = "TY"
KEYWORD = "KW"


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; splitting is done by the text reader, so big files stay splittable."""
    records = spark.read.option("lineSep", RECORD_END).text(path)
    return records.where(F.col("value").rlike(r"(?m)^[A-Z][A-Z0-9]  - "))


def _values(record: Column, tag: str) -> Column:
    """All values of a tag; a value runs on over untagged lines."""
    pattern = rf"(?s)(?:^|\n){tag}  - (.*?)(?=\r?\n[A-Z][A-Z0-9]  -|\s*$)"
    raw = F.regexp_extract_all(record, F.lit(pattern), F.lit(1))
    return F.array_remove(F.transform(raw, lambda v: F.trim(F.regexp_replace(v, r"\s*\n\s*", " "))), "")


def _value(record: Column, tag: str) -> Column:
    return F.try_element_at(_values(record, tag), F.lit(1))


def _list(record: Column, tag: str) -> Column:
    values = _values(record, tag)
    return F.when(F.size(values) > 0, values)


def ris_articles(records: DataFrame, run_ts: int) -> DataFrame:
    """Article rows of RIS records; every row carries the same run stamp."""
    r = F.col("value")
    return records.select(
        clean_identifier(_value(r, IDENTIFIER)).alias("id"),
        F.coalesce(_value(r, TRANSLATED_TITLE), _value(r, TITLE)).alias("title"),
        _list(r, AUTHOR).alias("authors"),
        _value(r, ABSTRACT).alias("abstract"),
        _value(r, YEAR).alias("release_date"),
        _value(r, KIND).alias("article_type"),
        F.lit(None).cast("string").alias("fulltext"),
        F.lit(None).cast("string").alias("file_url"),
        _list(r, KEYWORD).alias("keywords"),
        F.lit(run_ts).cast("bigint").alias("last_update"),
    )
