"""Tokenising and small string builders, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """White-space words in order, case kept; no words for blank text."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def clean_identifier(identifier: Column) -> Column:
    """Identifier without white space and without plus signs."""
    return F.regexp_replace(identifier, r"[\s+]", "")


def strip_doi_prefix(doi: Column, prefix: str) -> Column:
    """Identifier left of a DOI link; ``prefix`` is removed wherever it stands. NULL stays NULL."""
    return F.replace(doi, F.lit(prefix), F.lit(""))


def absolute_url(base: Column, path: Column) -> Column:
    return F.concat(base, path)


def topic_id(number: Column) -> Column:
    """Topic numbers are strings of at least three digits."""
    text = number.cast("string")
    return F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)


def request_text(parts: Column) -> Column:
    """One request from an array of words."""
    return F.concat_ws(" ", parts)


def suggestion_text(topic: Column, term: Column) -> Column:
    return F.concat(topic, F.lit(" : "), term)


def release_year(release_date: Column) -> Column:
    """First four-digit run of a raw date text."""
    return F.nullif(F.regexp_extract(release_date, r"(\d{4})", 1), F.lit("")).cast("int")
