"""The whole flows: ingest, model, upload, update, search, suggest.

Each step with a mark takes the run stamp once at its start (or is given ``now``) and commits it
at its end, so a run that fails is repeated from the same mark. Every sink is safe to repeat.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.carryover import LINKS, carried_topics, extend_links, with_carried_topics
from corpusloom.operators.documents import enrich
from corpusloom.operators.expand import expand, request_clauses
from corpusloom.operators.increment import increment
from corpusloom.operators.modelling import (
    TopicModel, fit_topics, model_doc_topics, model_topic_terms, word_lists,
)
from corpusloom.operators.search import search
from corpusloom.operators.sharded_topics import ShardedTopics, fit_sharded_topics, sharded_doc_topics, sharded_topic_terms
from corpusloom.operators.store import rejected_items, typed_items, valid_items
from corpusloom.operators.suggest import suggest
from corpusloom.operators.topics import topic_bags
from corpusloom.session import folder_exists, stage, staging
from corpusloom.sources import index_store, marks, postings_store, readers, writers

TOPIC_MARK = "topics"
UPDATE_MARK = "update"
UPLOAD_WRITER, UPDATE_WRITER, REMOVE_WRITER = "upload", "update", "remove"


@dataclass(frozen=True)
class Places:
    """Where the tables of a corpus live. With ``postings`` the words of each index load are kept for all searches;
    with ``topic_links`` topics are carried over between fits, so documents stay searchable by topic after a refit."""

    articles: str
    corpus: str
    topic_terms: str
    doc_topics: str
    index: str
    marks: str
    postings: str | None = None
    topic_links: str | None = None


def ingest(items: DataFrame, places: Places, create: bool = False) -> DataFrame:
    """Append new valid items to the article table; returns the rejected ones with reasons."""
    typed = stage(typed_items(items), "items")  # read four times below; pages are parsed once
    writers.append_new(valid_items(typed), places.articles, create)
    return rejected_items(typed)


def _of_version(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/model_version={version}"


def model_topics(spark: SparkSession, places: Places, now: int | None = None, sharded: bool = False, **fit) -> TopicModel | ShardedTopics:
    """Append the increment to the corpus, fit topics on all of it, write both topic tables.

    With ``sharded`` the fit keeps its words as a table, for vocabularies beyond the driver's memory.

    The tables are folders of the run's version, which is its stamp, and so is the mark. The
    mark is committed last: until then readers see both tables of the former version, so
    terms and shares of different fits are never paired. A failed run is repeated from the
    mark; it leaves a part of the corpus that no mark names, and that nothing reads.
    """
    now = now or marks.run_stamp()
    mark = marks.get_mark(spark, places.marks, TOPIC_MARK)
    articles = readers.read_articles(spark, places.articles)
    writers.append_corpus(increment(articles, mark, now), places.corpus, now)
    with staging(spark):
        bags = word_lists(readers.read_corpus(spark, places.corpus, now))
        fitted = (fit_sharded_topics, sharded_topic_terms, sharded_doc_topics) if sharded else (fit_topics, model_topic_terms, model_doc_topics)
        fit_model, terms_of, shares_of = fitted
        model = fit_model(bags, version=str(now), **fit)
        writers.write_topic_terms(terms_of(model), _of_version(places.topic_terms, now))
        writers.write_doc_topics(shares_of(model), _of_version(places.doc_topics, now))
        if places.topic_links:
            _link_topics(spark, places, mark, now)
    marks.set_mark(spark, places.marks, TOPIC_MARK, now)
    return model


def _links(spark: SparkSession, places: Places, version: int) -> DataFrame:
    """The links to the topics of a version; none for a version fitted before links were kept."""
    path = _of_version(places.topic_links, version)
    return spark.read.schema(LINKS).parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], LINKS)


def _link_topics(spark: SparkSession, places: Places, former: int, now: int) -> None:
    """Write the links of all former versions to the topics just written; the first fit has none."""
    links = _links(spark, places, former)
    if former:
        read = lambda version: readers.read_topic_terms(spark, _of_version(places.topic_terms, version))
        links = extend_links(links, carried_topics(read(former), read(now)), str(former))
    links.write.mode("overwrite").parquet(_of_version(places.topic_links, now))


def upload_documents(spark: SparkSession, places: Places, batches: str, how: str = "inner") -> None:
    """Articles with their strong topics as a load of the index table, and JSON batches of that load."""
    version = marks.get_mark(spark, places.marks, TOPIC_MARK)
    bags = topic_bags(readers.read_doc_topics(spark, _of_version(places.doc_topics, version)))
    articles = readers.read_articles(spark, places.articles)
    enriched = enrich(articles, bags, how).withColumn("model_version", F.lit(str(version)))
    writers.write_index_batches(_load(enriched, places, UPLOAD_WRITER, time.time_ns()), batches, with_topics=True)


def _load(docs: DataFrame, places: Places, writer: str, number: int) -> DataFrame:
    """A load of the index and, where they are kept, of its postings; returns the load as written."""
    index_store.load_index(docs, places.index, writer, number)
    loaded = index_store.one_load(docs.sparkSession, places.index, writer, number)
    if places.postings:
        postings_store.add_postings(loaded, places.postings, writer, number)
    return loaded


def remove_documents(ids: DataFrame, places: Places) -> None:
    """Take documents out of the index by ``id``; their postings are no longer settled on."""
    index_store.remove_documents(ids, places.index, REMOVE_WRITER, time.time_ns())


def update_index(spark: SparkSession, places: Places, batches: str, now: int | None = None) -> None:
    """Articles updated since the mark as JSON batches and as a load, without topics."""
    now = now or marks.run_stamp()
    mark = marks.get_mark(spark, places.marks, UPDATE_MARK)
    fresh = increment(readers.read_articles(spark, places.articles), mark, now)
    writers.write_index_batches(fresh, batches)
    _load(fresh, places, UPDATE_WRITER, now)
    marks.set_mark(spark, places.marks, UPDATE_MARK, now)


def topic_terms(spark: SparkSession, places: Places) -> DataFrame:
    """The topic terms of the version that the mark names."""
    version = marks.get_mark(spark, places.marks, TOPIC_MARK)
    return readers.with_rank(readers.read_topic_terms(spark, _of_version(places.topic_terms, version)))


def current_index(spark: SparkSession, places: Places) -> DataFrame:
    """The index as the current topics see it: topics of another version than theirs are carried over where links are kept, and left out else."""
    mark = marks.get_mark(spark, places.marks, TOPIC_MARK)
    version = str(mark)
    index = index_store.read_index(spark, places.index, keep_topics=True, with_load=True)
    if places.topic_links:
        return with_carried_topics(index, stage(_links(spark, places, mark), "topic-links"), version)
    return index.withColumn("topics", F.when(F.col("model_version") == version, F.col("topics")))


def run_searches(requests: DataFrame, places: Places, queries: str, hits: str) -> None:
    """Write the query log and one ranked CSV per request."""
    spark = requests.sparkSession
    with staging(spark):
        terms = stage(topic_terms(spark, places), "topic-terms")
        expanded = expand(requests, terms).repartition("request_id").sortWithinPartitions("request_id")
        writers.write_queries(expanded, queries)
        kept = postings_store.read_postings(spark, places.postings) if places.postings else None
        writers.write_hits(search(current_index(spark, places), request_clauses(requests, terms), kept=kept), hits)


def suggest_terms(requests: DataFrame, places: Places, **options) -> DataFrame:
    return suggest(requests, stage(topic_terms(requests.sparkSession, places), "topic-terms"), **options)
