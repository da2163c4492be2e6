"""Scores by term frequency, and the best k by them without meeting every match.

The weight of a word in a document is ``tf * (K1 + 1) / (tf + K1)``, where tf sums the counts of its fields, each times the boost
of its field and divided by ``1 - B + B * length / mean length``: it grows with every
occurrence, never beyond ``K1 + 1``, and a long field counts for less. A document with all words of a query scores

    1.5 * (matched topic clauses) + 2 * sum over words of rarity * weight

Lengths and counts of documents are sums over the settled documents. The best k are found in two phases:

1. The postings of a word are dealt to ``LEVELS`` blocks by weight, and each block keeps its greatest weight. No document of a block
   of the query's rarest word can score more than that weight and the greatest weights of the other words allow: its bound.
   Blocks of the highest bounds that hold ``FIRST`` times k documents are met, and the k-th score found is the threshold.
2. Of the other blocks those are met whose bound reaches the threshold. What is left out can't be among the best k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.rendering import NEAR_BOOST, RESULT_SIZE, TOPIC_BOOST
from corpusloom.operators.search import SCORE_DIGITS, PreparedSearch, rank, topic_score
from corpusloom.session import stage
from corpusloom.sources.postings_store import FIELDS

K1, B = 1.2, 0.75
FIELD_BOOST = {"title": 3.0, "abstract": 1.5, "fulltext": 1.0}
LEVELS, FIRST = 1024, 4


def frequency_weights(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(word, id, weight)`` of postings ``found``; ``lengths`` are those of all settled documents, missing ones are 0."""
    none = F.array().cast("array<int>")
    tf = F.lit(0.0)
    for f in FIELDS:
        mean = F.coalesce(lengths.agg(F.avg(f).alias("m")).scalar(), F.lit(0.0))
        relative = F.when(mean > 0, F.col(f"n_{f}") / mean).otherwise(F.lit(0.0))
        tf = tf + F.lit(FIELD_BOOST[f]) * F.size(F.coalesce(F.col(f), none)) / (F.lit(1 - B) + F.lit(B) * relative)
    known = found.join(lengths.select("id", *[F.col(f).alias(f"n_{f}") for f in FIELDS]), "id")
    return known.select("word", "id", (tf * F.lit(K1 + 1) / (tf + F.lit(K1))).alias("weight"))


class FrequencyRanking:
    """Ranks the word matches of a prepared search (of words, not of near clauses) by ``weights`` (word, id, weight)."""

    def __init__(self, prepared: PreparedSearch, weights: DataFrame, k: int = RESULT_SIZE):
        self.k = k
        level = F.floor(F.col("weight") * LEVELS / (K1 + 1)).cast("int")
        self.weights = stage(weights.withColumn("level", level), "word-weights")
        table = prepared.table.where("anchor is not null")
        self.asked = table.select("query", F.explode("rarities").alias("word", "rarity"))
        self.topics = table.select("query", "topic_counts", F.size("rarities").alias("n_words"))
        self.bags = prepared.bags
        self.blocks = stage(self._bounds(table), "block-bounds")
        first = self.blocks.where(F.col("ahead") < FIRST * k)
        scored = stage(self._scores(first), "first-scores")
        kth = rank(scored, k).where(F.col("order") == k).select("query", F.col("score").alias("threshold"))
        rest = self.blocks.where(F.col("ahead") >= FIRST * k).join(kth, "query", "left")
        # scores are rounded, so a bound may be half a digit below its block's best score
        self.second = stage(rest.where(F.col("threshold").isNull() | (F.col("bound") + 10.0 ** -SCORE_DIGITS >= F.col("threshold"))), "second-blocks")
        self.met = first.select("query", "n").unionByName(self.second.select("query", "n")).groupBy("query").agg(F.sum("n").alias("met"))
        self.scored = scored.unionByName(self._scores(self.second))

    def _bounds(self, table: DataFrame) -> DataFrame:
        """``(query, word, level, n, bound, ahead)`` of the blocks of each query's rarest word; ``ahead`` counts documents of blocks of higher bounds."""
        peaks = self.weights.groupBy("word").agg(F.max("weight").alias("peak"))
        most = self.asked.join(peaks, "word").groupBy("query").agg(F.sum(F.col("rarity") * F.col("peak")).alias("most"))
        blocks = self.weights.groupBy("word", "level").agg(F.max("weight").alias("block_peak"), F.count("*").alias("n"))
        queries = table.select("query", F.col("anchor").alias("word"), F.col("rarities")[F.col("anchor")].alias("rarity"), F.size("listed").alias("n_topics"))
        met = queries.join(most, "query").join(blocks, "word").join(peaks, "word")
        bound = F.lit(float(NEAR_BOOST)) * (F.col("most") - F.col("rarity") * (F.col("peak") - F.col("block_peak"))) + F.lit(TOPIC_BOOST) * F.col("n_topics")
        met = met.select("query", "word", "level", "n", bound.alias("bound"))
        higher = Window.partitionBy("query").orderBy(F.desc("bound"), F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
        return met.withColumn("ahead", F.coalesce(F.sum("n").over(higher), F.lit(0)))

    def _scores(self, blocks: DataFrame) -> DataFrame:
        """``(query, id, score)`` of the documents of the blocks that have all words of their query."""
        documents = blocks.select("query", "word", "level").join(self.weights, ["word", "level"]).select("query", "id")
        words = documents.join(self.asked, "query").join(self.weights.drop("level"), ["word", "id"])
        whole = words.groupBy("query", "id").agg(F.count("*").alias("held"), F.sum(F.col("rarity") * F.col("weight")).alias("by_words"))
        whole = whole.join(self.topics, "query").where("held = n_words").join(self.bags, "id", "left")
        score = F.lit(float(NEAR_BOOST)) * F.col("by_words") + topic_score(F.col("topics"), F.col("topic_counts"))
        return whole.select("query", "id", F.round(score, SCORE_DIGITS).alias("score"))

    def top(self) -> DataFrame:
        """``(query, id, score, order)``: the best k of each query."""
        return rank(self.scored, self.k)
