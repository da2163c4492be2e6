"""Term suggestion for a whole table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import suggestion_text
from corpusloom.operators.lookup import match_topics
from corpusloom.operators.topics import eligible_topics, top_term_of_topic

# Fixed value: weight a topic row must exceed to suggest its topic.
SUGGEST_THRESHOLD = 0.015


def suggestion_lists(
    requests: DataFrame,
    topic_terms: DataFrame,
    threshold: float = SUGGEST_THRESHOLD,
    fallback: bool = False,
) -> DataFrame:
    """``(request_id, found)``: suggestions of a request in the order word, raw before stem,
    rank, duplicates kept. Requests without any are left out.

    The top term of each topic is settled on the topic table, so the requests meet one
    small table and are grouped once.
    """
    advice = eligible_topics(topic_terms, threshold, fallback).join(top_term_of_topic(topic_terms), "topic")
    item = F.struct(
        "pos", "form", "rank", "topic", F.col("top_term").alias("term"),
        suggestion_text(F.col("topic"), F.col("top_term")).alias("suggestion"),
    )
    return (
        match_topics(requests, advice.select("term", "topic", "rank", "top_term"))
        .groupBy("request_id")
        .agg(F.sort_array(F.collect_list(item)).alias("found"))
    )


def suggest(
    requests: DataFrame,
    topic_terms: DataFrame,
    threshold: float = SUGGEST_THRESHOLD,
    fallback: bool = False,
) -> DataFrame:
    """``(request_id, pos, topic, term, suggestion)``, ``pos`` from 1 within a request."""
    lists = suggestion_lists(requests, topic_terms, threshold, fallback)
    return lists.select("request_id", F.posexplode("found").alias("at", "s")).select(
        "request_id", (F.col("at") + 1).alias("pos"), "s.topic", "s.term", "s.suggestion"
    )
