import csv
import glob

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.numbers import as_double, as_integer, number_json
from corpusloom.operators.documents import batch_counts, batch_numbers, flatten, unflatten
from corpusloom.operators.expand import expand
from corpusloom.operators.topics import (
    best_topic_of_term, distinct_terms, eligible_topics, strong_topics, topic_bags, top_term_of_topic,
)
from corpusloom.operators.documents import enrich
from corpusloom.operators.store import typed_items
from corpusloom.session import staged_path
from corpusloom.sources import readers, writers
from tests.test_store import article, articles


def local(path):
    return path.removeprefix("file:")


def docs(spark, n):
    return typed_items(spark.range(0, n, 1, 1).select(
        F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit(1).alias("last_update")))


def test_batches_hold_4001_documents(spark):
    for n, want in ((4001, [4001]), (4002, [1, 4001])):
        path = staged_path(spark, "batches")
        one_split = docs(spark, n).coalesce(1)
        writers.write_index_batches(one_split, path)
        sizes = sorted(sum(1 for _ in open(f)) for f in glob.glob(f"{local(path)}/part-*.json"))
        assert sizes == want


def test_exact_batches_are_filled(spark):
    path = staged_path(spark, "batches")
    writers.write_index_batches(docs(spark, 9000).repartition(5), path, exact=True)
    sizes = [sum(1 for _ in open(f)) for f in sorted(glob.glob(f"{local(path)}/batch=*/part-*.json"))]
    assert sizes == [4001, 4001, 998]


def test_bad_rows_of_outside_files_are_told_apart(spark):
    path = staged_path(spark, "outside")
    spark.createDataFrame([("topic,term,weight\n002,b,0.5\n001,a,x\n001,c,0.5",)], "value string").coalesce(1).write.text(path)
    table = readers.read_topic_terms(spark, path, outside=True)
    assert [r[readers.CORRUPT] for r in readers.bad_rows(table).collect()] == ["001,a,x"]
    ranked = readers.in_file_order(readers.good_rows(table)).orderBy("rank").collect()
    assert [r["term"] for r in ranked] == ["b", "c"]


def test_create_refuses_a_table_that_exists(spark):
    path = staged_path(spark, "store")
    writers.append_new(articles(spark, article("1")), path, create=True)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        writers.append_new(articles(spark, article("1")), path, create=True)


def test_batch_numbers(spark):
    numbered = batch_numbers(docs(spark, 9000), size=4001)
    got = {r["batch"]: r["n_documents"] for r in batch_counts(numbered).collect()}
    assert got == {0: 4001, 1: 4001, 2: 998}
    assert numbered.select("id").distinct().count() == 9000


def test_hits_csv_and_query_log(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b", "second", "x, \"quoted\"", "k", "", 1.0), (1, 1, "a", "first", "line", "k", '["001"]', 2.0),
         (2, 1, "c", "third", None, "k", "", 1.0)],
        "request_id long, order int, id string, title string, abstract string, article_type string, topics string, score double")
    path = staged_path(spark, "hits")
    writers.write_hits(hits, path)
    files = glob.glob(f"{local(path)}/request_id=1/*.csv")
    assert len(files) == 1
    rows = list(csv.DictReader(open(files[0], newline="")))
    assert list(rows[0]) == ["title", "abstract", "article_type", "topics", "id", "order"]
    assert [(r["order"], r["id"]) for r in rows] == [("1", "a"), ("2", "b")]
    assert rows[1]["abstract"] == 'x, "quoted"' and rows[0]["topics"] == '["001"]'

    terms = spark.createDataFrame([], "topic string, term string, weight double, rank long")
    requests = spark.createDataFrame([(1, "patina"), (2, "  "), (3, "")], "request_id long, request string")
    expanded = expand(requests, terms)
    assert {r["request_id"]: r["n_words"] for r in expanded.collect()} == {1: 1, 2: 0, 3: 0}
    log = staged_path(spark, "log")
    writers.write_queries(expanded, log)
    lines = [r["value"] for r in spark.read.text(log).collect()]
    # fixed value: the query of one word, as captured
    assert lines == ["/2013-01-01/search?q=(or+(and(near+distance%3D3+boost%3D2+'patina')))"
                     "&q.parser=structured&return=title,abstract,article_type,topics&size=30"]


def test_modes(spark):
    terms = spark.createDataFrame([("001", "a", 0.5, 1)], "topic string, term string, weight double, rank long")
    requests = spark.createDataFrame([(1, "a")], "request_id long, request string")
    tail = "&q.parser=structured&return=title,abstract,article_type,topics&size=30"
    # fixed values: the clauses of the modes
    got = {m: expand(requests, terms, mode=m).collect()[0]["query"] for m in ("words", "topics")}
    assert got["words"] == "/2013-01-01/search?q=(and(near+distance%3D3+'a'))" + tail
    topic = "(term+field%3Dtopics+'001')"
    assert got["topics"] == f"/2013-01-01/search?q=(or+{topic * 2}(and(near+distance%3D3+'a')))" + tail


def test_csv_topics_stay_strings(spark):
    path = staged_path(spark, "terms")
    terms = spark.createDataFrame([("000", "a", 0.5), ("095", "b", 0.25)], "topic string, term string, weight double")
    writers.write_topic_terms(terms, path)
    assert sorted(map(tuple, readers.read_topic_terms(spark, path).collect())) == [("000", "a", 0.5), ("095", "b", 0.25)]


def test_thresholds_are_strict(spark):
    shares = spark.createDataFrame([("d", "001", 0.1), ("d", "002", 0.1000001)], "docname string, topic string, proportion double")
    assert [r["topic"] for r in strong_topics(shares).collect()] == ["002"]
    terms = spark.createDataFrame(
        [("000", "a", 0.015, 0), ("001", "a", 0.0150001, 1), ("000", "b", 0.01, 2), ("001", "b", 0.012, 3)],
        "topic string, term string, weight double, rank long")
    assert [r["rank"] for r in eligible_topics(terms, 0.015, False).collect()] == [1]
    assert sorted(r["rank"] for r in eligible_topics(terms, 0.015, True).collect()) == [1, 3]


def test_ties_go_to_the_lower_rank(spark):
    terms = spark.createDataFrame(
        [("000", "b", 0.5, 0), ("000", "a", 0.5, 1), ("001", "b", 0.5, 2)],
        "topic string, term string, weight double, rank long")
    assert {r["topic"]: r["top_term"] for r in top_term_of_topic(terms).collect()} == {"000": "b", "001": "b"}
    assert {r["term"]: r["topic"] for r in best_topic_of_term(terms).collect()} == {"a": "000", "b": "000"}
    seen = [r["term"] for r in distinct_terms(terms).orderBy("first_rank").collect()]
    assert seen == ["b", "a"]


def test_articles_without_a_strong_topic(spark):
    shares = spark.createDataFrame([("1", "002", 0.3), ("1", "001", 0.3), ("1", "003", 0.4), ("2", "001", 0.1)],
                                   "docname string, topic string, proportion double")
    bags = topic_bags(shares)
    rows = articles(spark, article("1"), article("2"))
    assert {r["id"]: r["topics"] for r in enrich(rows, bags).collect()} == {"1": ["003", "001", "002"]}
    assert {r["id"]: r["topics"] for r in enrich(rows, bags, "left").collect()} == {"1": ["003", "001", "002"], "2": None}


def test_flatten_and_back(spark):
    df = spark.sql("SELECT '1' AS id, struct('t' AS title, struct(1 AS x) AS deep) AS fields")
    flat = flatten(df)
    assert flat.columns == ["id", "fields.title", "fields.deep.x"]
    assert unflatten(flat).collect() == df.collect()


def test_numbers(spark):
    rows = spark.sql("SELECT CAST(v AS DECIMAL(5,1)) AS v FROM VALUES (-1.5), (1.5), (2.0), (-3.0) AS t(v)")
    got = rows.select("v", as_integer(F.col("v")), as_double(F.col("v")), number_json(F.col("v"))).collect()
    assert [tuple(r)[1:] for r in got] == [(-1, None, "-1"), (None, 1.5, "1.5"), (2, None, "2"), (-3, None, "-3")]


def test_response_json(spark):
    json = ('{"status":{},"hits":{"found":2,"hit":[{"id":"a","fields":{"title":"t","abstract":"s","article_type":"k",'
            '"topics":["001","002"]}},{"id":"b","fields":{"title":"u"}}]}}')
    rows = readers.response_hits(spark.createDataFrame([("r", json)], "request string, json string")).collect()
    assert [(r["request"], r["order"], r["id"], r["title"], r["topics"]) for r in rows] == [
        ("r", 1, "a", "t", '["001","002"]'), ("r", 2, "b", "u", "")]
