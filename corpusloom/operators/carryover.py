"""Topics carried over between fits: topics of a former fit, and the topics of a new one they live on as.

Topic numbers of different fits have nothing to do with each other. Two topics are alike as far as they share the weight
of their terms, and the former topics are paired with the new ones one to one so that the shared weight of all pairs is
greatest. Links are a table of (former version, topic, carried), so what was loaded with topics of any former version
is searched by the current ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINKS = "model_version string, topic string, carried string"


def _shares(terms: DataFrame) -> DataFrame:
    """``(topic, term, share)``: what a term has of the weight of its topic's terms; a term said twice counts once, at its heaviest."""
    once = terms.where("topic is not null and term is not null and weight > 0").groupBy("topic", "term").agg(F.max("weight").alias("weight"))
    return once.select("topic", "term", (F.col("weight") / F.sum("weight").over(Window.partitionBy("topic"))).alias("share"))


def topic_overlaps(former: DataFrame, new: DataFrame) -> DataFrame:
    """``(topic, carried, overlap)`` of each former and new topic that share a term: the weight they share, 0 to 1.

    Both are topic-terms tables (topic, term, weight), so a few terms per topic. Null topics and terms, and terms without
    weight, are left out; an empty table overlaps with nothing.
    """
    a, b = _shares(former), _shares(new).withColumnsRenamed({"topic": "carried", "share": "other"})
    return a.join(b, "term").groupBy("topic", "carried").agg(F.sum(F.least("share", "other")).alias("overlap"))


def best_pairs(gain: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column), none used twice, of the greatest total gain, without pairs of no gain.

    Rows enter one by one along the cheapest path that makes room for them, with prices on rows and columns.
    """
    if gain.shape[0] > gain.shape[1]:
        return sorted((i, j) for j, i in best_pairs(gain.T))
    rows, columns = gain.shape
    row_price, column_price = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for entering in range(rows):
        reach, came_from = np.full(columns, np.inf), np.full(columns, -1)
        settled = np.zeros(columns, bool)
        row, column, length = entering, -1, 0.0
        while row >= 0:
            over_row = length - gain[row] - row_price[row] - column_price
            nearer = ~settled & (over_row < reach)
            reach[nearer], came_from[nearer] = over_row[nearer], column
            column = int(np.argmin(np.where(settled, np.inf, reach)))
            settled[column], length = True, reach[column]
            row = owner[column]
        passed = settled & (owner >= 0)
        row_price[entering] += length
        row_price[owner[passed]] += length - reach[passed]
        column_price[settled] -= length - reach[settled]
        while column >= 0:
            before = came_from[column]
            owner[column] = owner[before] if before >= 0 else entering
            column = before
    return sorted((int(owner[j]), j) for j in range(columns) if owner[j] >= 0 and gain[owner[j], j] > 0)


def carried_topics(former: DataFrame, new: DataFrame, least: float = 0.0) -> DataFrame:
    """``(topic, carried, overlap)``: former topics and the new topic that each lives on as.

    The pairs are one to one and of the greatest total overlap; pairs that share ``least`` or less of their weight are
    no pairs. A former topic without a pair has no row. The overlaps of topics with topics come to the driver: numbers
    of topics, which a fit is given, and never of documents or words.
    """
    found = topic_overlaps(former, new).where(F.col("overlap") > least).orderBy("topic", "carried").collect()
    topics, carried = sorted({r["topic"] for r in found}), sorted({r["carried"] for r in found})
    gain = np.zeros((len(topics), len(carried)))
    for r in found:
        gain[topics.index(r["topic"]), carried.index(r["carried"])] = r["overlap"]
    pairs = [(topics[i], carried[j], float(gain[i, j])) for i, j in best_pairs(gain)]
    return former.sparkSession.createDataFrame(pairs, "topic string, carried string, overlap double")


def extend_links(links: DataFrame, pairs: DataFrame, former_version: str) -> DataFrame:
    """Links to the new topics: those of ``links`` (which lead to the topics of ``former_version``) led on by ``pairs``, and the pairs themselves."""
    on = pairs.select(F.col("topic").alias("via"), F.col("carried").alias("to"))
    led = links.join(on, links["carried"] == on["via"]).select("model_version", "topic", F.col("to").alias("carried"))
    return led.unionByName(pairs.select(F.lit(former_version).alias("model_version"), "topic", "carried"))


def with_carried_topics(index: DataFrame, links: DataFrame, version: str) -> DataFrame:
    """``index`` with its topics (array ``topics`` of ``model_version``) as topics of ``version``.

    Topics of that version stay, those of a former one are led on by ``links`` in their order, and what has no link goes;
    a document left without any has null. ``links`` is staged by the caller: a row per former version and topic.
    """
    leads = links.groupBy("model_version").agg(F.map_from_entries(F.collect_list(F.struct("topic", "carried"))).alias("_leads"))
    led = F.filter(F.transform("topics", lambda t: F.try_element_at("_leads", t)), lambda t: t.isNotNull())
    own = F.when(F.col("model_version") == version, F.col("topics")).when(F.size(led) > 0, led)
    return index.join(leads, "model_version", "left").select(*[own.alias(c) if c == "topics" else F.col(c) for c in index.columns])
