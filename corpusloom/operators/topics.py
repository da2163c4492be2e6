"""Topic tables: bags per document, best topics and terms, counted topic terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.session import stage

# Thresholds of the established flow.
STRONG_PROPORTION = 0.1
TERMS_PER_TOPIC = 10


def strong_topics(doc_topics: DataFrame, threshold: float = STRONG_PROPORTION) -> DataFrame:
    """Rows strictly above the share."""
    return doc_topics.where(F.col("proportion") > threshold)


def topic_bags(doc_topics: DataFrame, threshold: float = STRONG_PROPORTION) -> DataFrame:
    """``(id, topics)``: strong topics of each document, largest share first, then topic.

    Shares of a document sum to one, so a bag holds fewer than ``1 / threshold`` topics.
    """
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("proportion")).alias("p"), "topic")))
    return (
        strong_topics(doc_topics, threshold)
        .groupBy(F.col("docname").alias("id"))
        .agg(ordered.alias("bag"))
        .select("id", F.col("bag.topic").alias("topics"))
    )


def best_topic_of_term(topic_terms: DataFrame) -> DataFrame:
    """Topic of the greatest weight per term; the earlier rank wins a tie."""
    best = F.max_by(F.struct("topic", "weight", "rank"), F.struct("weight", -F.col("rank")))
    return topic_terms.groupBy("term").agg(best.alias("b")).select("term", "b.topic", "b.weight", "b.rank")


def top_term_of_topic(topic_terms: DataFrame) -> DataFrame:
    """Term of the greatest weight per topic; the earlier rank, then the term, settles a tie."""
    best = F.min_by("term", F.struct(-F.col("weight"), "rank", "term"))
    return topic_terms.groupBy("topic").agg(best.alias("top_term"))


def eligible_topics(topic_terms: DataFrame, threshold: float, fallback: bool) -> DataFrame:
    """Term rows strictly above ``threshold``; with ``fallback`` a term that has none keeps
    its best row.

    Decided once per term on the topic table, not once per request.
    """
    above = F.col("weight") > threshold
    if not fallback:
        return topic_terms.where(above)
    per_term = Window.partitionBy("term")
    place = F.row_number().over(per_term.orderBy(F.desc("weight"), "rank"))
    ranked = topic_terms.withColumn("_place", place).withColumn("_most", F.max("weight").over(per_term))
    kept = above | ((F.col("_most") <= threshold) & (F.col("_place") == 1))
    return ranked.where(kept).drop("_place", "_most")


def distinct_terms(topic_terms: DataFrame) -> DataFrame:
    """Distinct terms in the order they are first seen by rank."""
    return topic_terms.groupBy("term").agg(F.min("rank").alias("first_rank"))


def group_topic_terms(
    texts: DataFrame, group: str, text: str = "text", terms: int = TERMS_PER_TOPIC
) -> DataFrame:
    """Topic terms without a model: a topic is a group of documents.

    Terms found in more than half of the groups are dropped; weight is the share of the
    term among all words of its group; the ``terms`` most frequent (then by term) stay.
    ``rank`` numbers the rows by topic and place.

    All counting is grouped on (group, term), so a group or a common word that owns a
    third of all rows is reduced within each input split before it moves. The counted
    table is staged: the aggregates read it instead of the texts. A term has at most one row
    per group by then, so its window is no larger than the number of groups.
    """
    counted = stage(
        texts.select(F.col(group).alias("topic"), F.explode(tokens(F.col(text))).alias("term"))
        .groupBy("topic", "term")
        .agg(F.count("*").alias("n")),
        "term-counts",
    )
    sizes = counted.groupBy("topic").agg(F.sum("n").alias("total"))
    n_groups = counted.select("topic").distinct().agg(F.count("*").alias("g")).scalar()
    groups_of_term = F.count("*").over(Window.partitionBy("term"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "term"))
    top = (
        counted.withColumn("groups", groups_of_term)
        .where(F.col("groups") * 2 <= n_groups)
        .withColumn("place", place)
        .where(F.col("place") <= terms)
    )
    return top.join(sizes, "topic").select(
        "topic",
        "term",
        F.round(F.col("n") / F.col("total"), 6).alias("weight"),
        (F.col("topic").cast("int") * terms + F.col("place") - 1).alias("rank"),
    )


def term_doc_topics(corpus: DataFrame, topic_terms: DataFrame) -> DataFrame:
    """Share of each topic among the topic-term words of a document.

    Words are joined inside each split when the staged topic table is small enough to
    broadcast; only (document, topic) counts move.
    """
    hits = (
        corpus.select("docname", F.explode(tokens(F.col("text"))).alias("term"))
        .join(topic_terms.select("term", "topic"), "term")
        .groupBy("docname", "topic")
        .agg(F.count("*").alias("n"))
    )
    per_document = Window.partitionBy("docname")
    share = F.col("n") / F.sum("n").over(per_document)
    return hits.select("docname", "topic", F.round(share, 6).alias("proportion"))


