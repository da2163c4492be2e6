"""Query expansion for a whole table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rendering import query_text
from corpusloom.functions.text import words
from corpusloom.operators.lookup import match_topics
from corpusloom.operators.topics import eligible_topics

# Fixed value: weight a topic row must exceed to join the query.
SEARCH_THRESHOLD = 0.0


def request_clauses(
    requests: DataFrame, topic_terms: DataFrame, threshold: float = SEARCH_THRESHOLD
) -> DataFrame:
    """``(request_id, request, words, topics)``: the words of a request, and its topics in the
    order word, raw before stem, rank. A topic is listed as often as it is matched; a request
    without a match has an empty list. ``request_id`` is unique.

    Only matches move, and each request text moves once.
    """
    matched = match_topics(requests, eligible_topics(topic_terms, threshold, fallback=True))
    listed = matched.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "form", "rank", "topic"))).alias("c")
    )
    return requests.join(listed, "request_id", "left").select(
        "request_id",
        "request",
        words(F.col("request")).alias("words"),
        F.coalesce(F.col("c.topic"), F.array().cast("array<string>")).alias("topics"),
    )


def expand(
    requests: DataFrame,
    topic_terms: DataFrame,
    threshold: float = SEARCH_THRESHOLD,
    mode: str = "boosted",
) -> DataFrame:
    """``(request_id, request, n_words, query)``; a request of no words has a NULL query."""
    clauses = request_clauses(requests, topic_terms, threshold)
    return clauses.select(
        "request_id",
        "request",
        F.size("words").alias("n_words"),
        query_text(F.col("words"), F.col("topics"), mode).alias("query"),
    )
