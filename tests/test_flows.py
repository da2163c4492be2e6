"""Whole flows, the stream, and the topic model."""

import glob

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.modelling import fit_topics, model_doc_topics, model_topic_terms, word_lists
from corpusloom.operators.topics import group_topic_terms
from corpusloom.plans import flows
from corpusloom.session import stage, staged_path
from corpusloom.sources import index_store, marks, readers, writers
from corpusloom.streaming import sync
from tests.test_store import article, articles


def texts(spark):
    return spark.createDataFrame(
        [(str(i), " ".join(f"{'metal' if i % 2 else 'glass'}{(i * j) % 7}" for j in range(1, 30))) for i in range(40)],
        "docname string, text string")


@pytest.fixture(scope="module")
def fitted(spark):
    bags = stage(word_lists(texts(spark)), "bags")
    return fit_topics(bags, "v1", k=4, iterations=5, max_document_share=1.0)


def test_shares_of_a_document_sum_to_one(fitted):
    sums = model_doc_topics(fitted).groupBy("docname").agg(F.sum("proportion").alias("s")).collect()
    assert len(sums) == 40 and all(abs(r["s"] - 1) < 1e-6 for r in sums)


def test_topic_terms_are_ranked_by_weight(fitted):
    rows = model_topic_terms(fitted, 5).orderBy("rank").collect()
    assert [r["topic"] for r in rows] == [t for t in ("000", "001", "002", "003") for _ in range(5)]
    for a, b in zip(rows, rows[1:]):
        assert a["topic"] != b["topic"] or a["weight"] >= b["weight"]
    assert {r["model_version"] for r in rows} == {"v1"}


def test_every_document_and_word_enters_the_fit(spark, fitted):
    rows = {r["docname"]: r["features"] for r in fitted.vectors.collect()}
    words = {r["index"]: r["word"] for r in fitted.words.collect()}
    assert sorted(words) == list(range(14)) and fitted.dropped == {"in too few documents": 0, "in too many documents": 0}
    for r in texts(spark).collect():
        counts = {w: r["text"].split().count(w) for w in set(r["text"].split())}
        vector = rows[r["docname"]]
        assert vector.size == 14 and {words[i]: int(vector[int(i)]) for i in vector.indices} == counts
    assert fitted.lda.vocabSize() == 14


def test_dropped_words_are_reported(spark):
    bags = stage(word_lists(spark.createDataFrame([("1", "a b c"), ("2", "a b d"), ("3", "a e")], "docname string, text string")), "bags")
    model = fit_topics(bags, "v", k=2, iterations=1, max_document_share=0.7)
    assert model.dropped == {"in too few documents": 3, "in too many documents": 1} and [r["word"] for r in model.words.collect()] == ["b"]


def test_stop_words(spark):
    rows = word_lists(texts(spark), ["metal1"]).select(F.explode("words").alias("w"))
    assert rows.where("w = 'metal1'").count() == 0 and rows.where("w = 'metal2'").count() > 0


def test_counted_terms_drop_words_of_more_than_half_of_the_groups(spark):
    rows = spark.createDataFrame(
        [("000", "the zinc zinc"), ("001", "the tin lead"), ("002", "the gold zinc"), ("003", "the")], "topic string, text string")
    got = [(r["topic"], r["term"], r["weight"], r["rank"]) for r in group_topic_terms(rows, "topic").orderBy("rank").collect()]
    assert got == [("000", "zinc", 0.666667, 0), ("001", "lead", 0.333333, 10), ("001", "tin", 0.333333, 11),
                   ("002", "gold", 0.333333, 20), ("002", "zinc", 0.333333, 21)]


def index_of(spark, path):
    return {r["id"]: (r["abstract"], r["topics"]) for r in index_store.read_index(spark, path, keep_topics=True).collect()}


def test_stream_loads_each_article_once_and_keeps_topics(spark):
    table, index, checkpoint = (staged_path(spark, n) for n in ("table", "index", "checkpoint"))
    index_store.load_index(articles(spark, article("1")).withColumn("topics", F.array(F.lit("001"))), index, "upload", 0)
    writers.append_new(articles(spark, article("1", abstract="new", last_update=9), article("2")), table, create=True)
    for extra in ("3", "4", None):
        if extra:
            writers.append_new(articles(spark, article(extra)), table)
        sync.sync_index_stream(sync.article_stream(spark, table), index, checkpoint).awaitTermination()
    loaded = index_store.loads(spark, index)
    assert sorted((r["id"], r["writer"] == "upload", r["number"]) for r in loaded.collect()) == [
        ("1", False, 0), ("1", True, 0), ("2", False, 0), ("3", False, 0), ("4", False, 1)]
    assert index_of(spark, index) == {"1": ("new", ["001"]), "2": ("a", None), "3": ("a", None), "4": ("a", None)}


def test_a_restarted_stream_and_another_writer_lose_nothing(spark):
    table, index = staged_path(spark, "table"), staged_path(spark, "index")
    index_store.load_index(articles(spark, *[article(str(i)) for i in range(20)]), index, "upload", 0)
    writers.append_new(articles(spark, article("20"), article("1", abstract="new")), table, create=True)
    for checkpoint in (staged_path(spark, "one"), staged_path(spark, "two")):
        sync.sync_index_stream(sync.article_stream(spark, table), index, checkpoint).awaitTermination()
    index_store.load_index(articles(spark, article("21")), index, "update", 0)
    found = index_of(spark, index)
    assert len(found) == 22 and found["1"] == ("new", None)


def test_the_last_commit_wins_and_a_repeated_load_replaces_itself(spark):
    index, compact = staged_path(spark, "index"), staged_path(spark, "compact")
    topics = F.array(F.lit("007"))
    index_store.load_index(articles(spark, article("1", abstract="update")), index, "update", 9)
    index_store.load_index(articles(spark, article("1", abstract="upload"), article("2")).withColumn("topics", topics), index, "upload", 1)
    assert index_of(spark, index) == {"1": ("upload", ["007"]), "2": ("a", ["007"])}
    for _ in range(2):
        index_store.load_index(articles(spark, article("1", abstract="again")), index, "update", 10)
    assert index_store.loads(spark, index).count() == 4
    assert index_of(spark, index) == {"1": ("again", ["007"]), "2": ("a", ["007"])}
    index_store.compact_index(spark, index, compact)
    assert index_of(spark, compact) == index_of(spark, index) and index_store.loads(spark, compact).count() == 2


def test_a_repeated_load_does_not_beat_loads_that_came_between(spark):
    index = staged_path(spark, "index")
    index_store.load_index(articles(spark, article("1", abstract="first"), article("2")), index, "update", 1)
    index_store.load_index(articles(spark, article("1", abstract="second")), index, "update", 2)
    index_store.remove_documents(spark.createDataFrame([("2",)], "id string"), index, "remove", 1)
    index_store.load_index(articles(spark, article("1", abstract="first"), article("2")), index, "update", 1)
    assert index_of(spark, index) == {"1": ("second", None)}


def test_removed_documents_come_back_without_topics(spark):
    index = staged_path(spark, "index")
    index_store.load_index(articles(spark, article("1"), article("2")).withColumn("topics", F.array(F.lit("001"))), index, "upload", 1)
    index_store.remove_documents(spark.createDataFrame([("1",)], "id string"), index, "remove", 1)
    assert index_of(spark, index) == {"2": ("a", ["001"])}
    index_store.load_index(articles(spark, article("1", abstract="back"), article("2", abstract="new")), index, "update", 1)
    assert index_of(spark, index) == {"1": ("back", None), "2": ("new", ["001"])}


def test_items_are_read_once(spark):
    """Pages are parsed by Python; an ingest evaluates them once, though it looks at them four times."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(value):
        seen.add(1)
        return value

    places = flows.Places(*[staged_path(spark, n) for n in ("articles", "corpus", "terms", "shares", "index", "marks")])
    items = articles(spark, *[article(str(i % 15)) for i in range(20)]).withColumn("abstract", watched("abstract"))
    assert flows.ingest(items, places, create=True).count() == 0
    assert seen.value == 20 and readers.read_articles(spark, places.articles).count() == 15


def test_an_old_stamp_of_the_corpus_never_returns(spark):
    path = staged_path(spark, "corpus")
    writers.append_corpus(articles(spark, article("1", abstract="old"), article("2")), path, 1)
    writers.append_corpus(articles(spark, article("1", abstract="new")), path, 2)
    writers.append_corpus(articles(spark, article("1", abstract="failed")), path, 3)
    read = lambda upto: sorted((r["docname"], r["text"]) for r in readers.read_corpus(spark, path, upto).collect())
    assert read(2) == [("1", "new"), ("2", "a")] and read(1) == [("1", "old"), ("2", "a")]


def test_all_flows(spark):
    places = flows.Places(*[staged_path(spark, n) for n in ("articles", "corpus", "terms", "shares", "index", "marks")])
    rows = [article(str(i), abstract=t, last_update=i + 1) for i, t in
            enumerate(r["text"] for r in texts(spark).orderBy(F.col("docname").cast("int")).collect())]
    rejects = flows.ingest(articles(spark, *rows[:30], article(None)), places, create=True)
    assert [r["reason"] for r in rejects.collect()] == ["id missing"]
    fit = {"k": 4, "iterations": 3, "max_document_share": 1.0}
    flows.model_topics(spark, places, 30, **fit)
    first = flows.topic_terms(spark, places).count()
    flows.ingest(articles(spark, *rows), places)
    # a run that fails between its two tables leaves readers with both tables of the former version
    writers.write_topic_terms(flows.topic_terms(spark, places).limit(1), flows._of_version(places.topic_terms, 35))
    assert flows.topic_terms(spark, places).count() == first
    flows.upload_documents(spark, places, staged_path(spark, "batches"))
    flows.model_topics(spark, places, 40, **fit)
    assert readers.read_corpus(spark, places.corpus, 40).count() == 40
    assert marks.get_mark(spark, places.marks, flows.TOPIC_MARK) == 40
    # topics of the former fit are told apart
    assert flows.current_index(spark, places).where("size(topics) > 0").count() == 0
    batches, again = staged_path(spark, "batches"), staged_path(spark, "batches")
    flows.upload_documents(spark, places, batches)
    index = flows.current_index(spark, places)
    assert index.count() == 40 and index.where("size(topics) > 0").count() == 40
    assert readers.read_index_documents(spark, batches).count() == 40
    flows.update_index(spark, places, again, now=45)
    assert readers.read_index_documents(spark, again).count() == 40
    assert marks.get_mark(spark, places.marks, flows.UPDATE_MARK) == 45
    assert flows.current_index(spark, places).where("size(topics) > 0").count() == 40
    before = marks.run_stamp()
    flows.update_index(spark, places, staged_path(spark, "batches"))
    assert marks.get_mark(spark, places.marks, flows.UPDATE_MARK) >= before
    requests = spark.createDataFrame([(1, "metal1"), (2, "nothing")], "request_id long, request string")
    log, hits = staged_path(spark, "log"), staged_path(spark, "hits")
    flows.run_searches(requests, places, log, hits)
    assert spark.read.text(log).count() == 2
    assert len(glob.glob(f"{hits.removeprefix('file:')}/request_id=1/*.csv")) == 1
    suggested = flows.suggest_terms(requests, places).collect()
    assert suggested and {r["request_id"] for r in suggested} == {1}
