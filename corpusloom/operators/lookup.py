"""Request words, their forms, and the topics they match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stemming import stem
from corpusloom.functions.text import words
from corpusloom.session import stage

RAW, STEMMED = 0, 1


def request_words(requests: DataFrame) -> DataFrame:
    """``(request_id, pos, word)``: words in order. The text itself stays behind: it is not
    copied into the row of each word."""
    return requests.select("request_id", F.posexplode(words(F.col("request"))).alias("pos", "word"))


def word_forms(rows: DataFrame) -> DataFrame:
    """``rows`` of a ``word``, once as it stands (form 0) and once as its stem (form 1), as
    ``term``. Equal forms are both kept."""
    forms = F.posexplode(F.array(F.col("word"), stem("word"))).alias("form", "term")
    return rows.select(*rows.columns, forms)


def match_topics(requests: DataFrame, topic_terms: DataFrame) -> DataFrame:
    """``(request_id, pos, word, form, term, topic, weight, rank, ...)``: one row per match of a
    word form with a topic row.

    Each distinct word is stemmed and looked up once. The words that match anything are a
    small table, no larger than the topic terms and the words that share their stems; it is
    staged, so the words of the requests meet it without moving when its size allows.
    """
    words = request_words(requests)
    matched = word_forms(words.select("word").distinct()).join(topic_terms, "term")
    return words.join(stage(matched, "matched-words"), "word")
