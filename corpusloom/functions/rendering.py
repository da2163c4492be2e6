"""Request text of the structured search language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rendered query must equal the established form character by character.
NEAR_DISTANCE = 3
NEAR_BOOST = 2
TOPIC_BOOST = 1.5
RESULT_SIZE = 30
RETURN_FIELDS = ("title", "abstract", "article_type", "topics")
SEARCH_PATH = "/2013-01-01/search?q="
QUERY_TAIL = "&q.parser=structured&return=" + ",".join(RETURN_FIELDS) + f"&size={RESULT_SIZE}"

MODES = ("words", "topics", "boosted")


def _clause(head: str, boost: str, value: Column) -> Column:
    return F.concat(F.lit(f"({head}{boost}+'"), value, F.lit("')"))


def near_clause(word: Column, boosted: bool = True) -> Column:
    boost = f"+boost%3D{NEAR_BOOST}" if boosted else ""
    return _clause(f"near+distance%3D{NEAR_DISTANCE}", boost, word)


def topic_clause(topic: Column, boosted: bool = True) -> Column:
    boost = f"+boost%3D{TOPIC_BOOST}" if boosted else ""
    return _clause("term+field%3Dtopics", boost, topic)


def query_text(words: Column, topics: Column, mode: str = "boosted") -> Column:
    """Whole query of a request: ``or`` of its topics and the ``and`` of its words.

    ``mode`` is ``words`` (words only), ``topics`` (no boosts) or ``boosted``.
    A request without words has no query.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    boosted = mode == "boosted"
    near = F.concat_ws("", F.transform(words, lambda w: near_clause(w, boosted)))
    group = F.concat(F.lit("(and"), near, F.lit(")"))
    if mode == "words":
        body = group
    else:
        terms = F.concat_ws("", F.transform(topics, lambda t: topic_clause(t, boosted)))
        body = F.concat(F.lit("(or+"), terms, group, F.lit(")"))
    return F.when(F.size(words) > 0, F.concat(F.lit(SEARCH_PATH), body, F.lit(QUERY_TAIL)))
