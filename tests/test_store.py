import pytest
from pyspark.sql import functions as F

from corpusloom.operators import store
from corpusloom.operators.documents import index_documents, document_json
from corpusloom.operators.increment import corpus_text, increment
from corpusloom.schema import ARTICLE
from corpusloom.session import stage, staged_path
from corpusloom.sources import index_store, marks, readers, writers


def article(i, title="t", abstract="a", last_update=1, **other):
    row = {"id": i, "title": title, "authors": ["x"], "abstract": abstract, "release_date": "2000",
           "article_type": "k", "fulltext": None, "file_url": None, "keywords": None, "last_update": last_update}
    return tuple({**row, **other}[f.name] for f in ARTICLE.fields)


def articles(spark, *rows):
    return spark.createDataFrame(list(rows), ARTICLE)


def test_rejects_name_their_reason(spark):
    items = articles(spark, article(None), article("1", title=None), article(None, title=None), article("2"))
    got = {(r["id"], r["title"], r["reason"]) for r in store.rejected_items(items).collect()}
    assert got == {(None, "t", "id missing"), ("1", None, "title missing"), (None, None, "id and title missing")}
    assert [r["id"] for r in store.valid_items(items).collect()] == ["2"]


def test_null_stays_null_and_missing_columns_are_null(spark):
    items = spark.createDataFrame([(7, "t", None, "5")], "id int, title string, abstract string, last_update string")
    row = store.typed_items(items).collect()[0]
    assert row["abstract"] is None and row["keywords"] is None
    assert (row["id"], row["last_update"]) == ("7", 5)


def test_keep_first_and_insert_if_absent(spark):
    new = articles(spark, article("1", abstract="late", last_update=9), article("1", abstract="early", last_update=2),
                   article("1", title="other"), article("2", abstract="new"))
    held = articles(spark, article("2", abstract="stored"))
    first = store.keep_first(new)
    assert {(r["id"], r["title"], r["abstract"]) for r in first.collect()} == {("1", "t", "early"), ("1", "other", "a"), ("2", "t", "new")}
    assert sorted(map(str, store.keep_first(first).collect())) == sorted(map(str, first.collect()))
    assert {(r["id"], r["title"]) for r in store.insert_if_absent(new, held).collect()} == {("1", "t"), ("1", "other")}


def test_stored_row_stays_on_append(spark):
    path = staged_path(spark, "store")
    writers.append_new(articles(spark, article("1", abstract="stored", last_update=100)), path, create=True)
    writers.append_new(articles(spark, article("1", abstract="x"), article("2"), article("2", last_update=50)), path)
    writers.append_new(articles(spark, article("1", abstract="x"), article("2")), path)
    got = sorted((r["id"], r["abstract"], r["last_update"]) for r in readers.read_articles(spark, path).collect())
    assert got == [("1", "stored", 100), ("2", "a", 1)]


def test_a_hot_key_reaches_the_reducer_as_one_row_per_split(spark):
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.lit("t").alias("title"), F.col("id").alias("last_update"), F.lit("text").alias("abstract"))
    first = store.keep_first(rows)
    assert first.where("id = 'hot'").collect()[0]["last_update"] == 0
    assert first.count() == 40_001
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_min" in plan


def test_keys_of_one_row_are_not_grouped_by_content(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit(1).alias("last_update"), F.lit("text").alias("abstract"))
    optimized = store.keep_first(rows)._jdf.queryExecution().optimizedPlan().toString()
    single, contested = optimized.split("LeftAnti")[1].split("Aggregate", 1)[0], optimized.count("Aggregate")
    assert "abstract" in single and contested >= 2  # the wide side of the anti join meets no aggregate
    at_once = articles(spark, article("1", abstract="b"), article("1", abstract="a"), article(None, abstract="c"), article(None, abstract="d"), article("2"))
    assert sorted((r["id"] or "", r["abstract"]) for r in store.keep_first(at_once).collect()) == [("", "c"), ("1", "a"), ("2", "a")]
    assert sorted((r["id"] or "", r["abstract"]) for r in store.latest(at_once).collect()) == [("", "d"), ("1", "b"), ("2", "a")]


def test_stored_keys_are_left_out_before_the_first_is_looked_for(spark):
    held, new = articles(spark, article("1")), articles(spark, article("1", abstract="x"), article("2"), article("2", abstract="b"))
    plan = store.insert_if_absent(new, held)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate"):]
    assert "LeftAnti" in below
    assert [(r["id"], r["abstract"]) for r in store.insert_if_absent(new, held).collect()] == [("2", "a")]


def test_increment_is_closed(spark):
    rows = articles(spark, *[article(str(ts), last_update=ts) for ts in (99, 100, 200, 201)])
    assert {r["id"] for r in increment(rows, 100, 200).collect()} == {"100", "200"}


def test_increment_prunes_days(spark):
    path = staged_path(spark, "days")
    day = 86_400
    writers.append_new(articles(spark, *[article(str(d), last_update=d * day) for d in range(10)]), path, create=True)
    found = increment(readers.read_articles(spark, path), 3 * day, 4 * day).select("id")
    assert {r["id"] for r in found.collect()} == {"3", "4"}
    plan = found._jdf.queryExecution().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "update_day" in filters
    assert "GreaterThanOrEqual(last_update" in plan and "fulltext" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("fulltext, want", [(None, "a"), ("", ""), ("full", "full")])
def test_corpus_text(spark, fulltext, want):
    assert corpus_text(articles(spark, article("1", fulltext=fulltext))).collect()[0]["text"] == want


def test_upsert_replaces_and_keeps_topics_when_asked(spark):
    held = articles(spark, article("1"), article("2")).withColumn("topics", F.array(F.lit("001")))
    new = articles(spark, article("1", abstract="v1", last_update=1), article("1", abstract="v2", last_update=2),
                   article("3")).withColumn("topics", F.lit(None).cast("array<string>"))
    kept = {r["id"]: (r["abstract"], r["topics"]) for r in store.upsert(held, new, keep_columns=["topics"]).collect()}
    plain = {r["id"]: (r["abstract"], r["topics"]) for r in store.upsert(held, new).collect()}
    assert kept == {"1": ("v2", ["001"]), "2": ("a", ["001"]), "3": ("a", None)}
    assert plain == {"1": ("v2", None), "2": ("a", ["001"]), "3": ("a", None)}


def test_index_loads(spark):
    path, target = staged_path(spark, "index"), staged_path(spark, "index")
    with_topics = articles(spark, article("1"), article("2")).withColumn("topics", F.array(F.lit("001")))
    index_store.load_index(with_topics, path, "upload", 0)
    for _ in range(2):  # a repeated load replaces itself
        index_store.load_index(articles(spark, article("2", abstract="v2"), article("3")), path, "update", 1)
    index_store.load_index(articles(spark, article("3", abstract="v3")), path, "stream", 0)
    want = [("1", "a", ["001"]), ("2", "v2", ["001"]), ("3", "v3", None)]
    show = lambda df: sorted((r["id"], r["abstract"], r["topics"]) for r in df.collect())
    assert show(index_store.read_index(spark, path, keep_topics=True)) == want
    assert show(index_store.read_index(spark, path)) == [("1", "a", ["001"]), ("2", "v2", None), ("3", "v3", None)]
    index_store.compact_index(spark, path, target)
    assert show(index_store.read_index(spark, target)) == want
    with pytest.raises(ValueError):
        index_store.load_index(with_topics, path, "a/b", 0)


def test_marks(spark):
    path = staged_path(spark, "marks")
    assert marks.get_mark(spark, path, "update") == 0
    for ts in (1528119650, 1530002937, 1529000000):
        marks.set_mark(spark, path, "update", ts)
    marks.set_mark(spark, path, "topics", 5)
    assert (marks.get_mark(spark, path, "update"), marks.get_mark(spark, path, "topics")) == (1529000000, 5)


def test_null_fields_are_left_out_of_json(spark):
    json = document_json(index_documents(articles(spark, article("1")))).collect()[0]["json"]
    assert json == ('{"id":"1","type":"add","fields":{"title":"t","authors":["x"],"abstract":"a",'
                    '"release_date":"2000","article_type":"k","last_update":1}}')


def test_staged_contested_keys_move_no_wide_row(spark):
    rows = articles(spark, *[article(str(i // 2 if i < 6 else i), abstract=f"a{i}", last_update=i // 4) for i in range(200)], article(None, abstract="c"), article(None, abstract="d"))
    assert sorted(map(str, store.latest(rows, staged=True).collect())) == sorted(map(str, store.latest(rows).collect()))
    assert sorted(map(str, store.keep_first(rows, staged=True).collect())) == sorted(map(str, store.keep_first(rows).collect()))
    plan = store.keep_first(rows, staged=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_a_load_shuffles_keys_alone(spark, monkeypatch):
    """The sinks stage the contested keys."""
    from corpusloom.sources import index_store

    said = []
    monkeypatch.setattr(store, "stage", lambda df, name: said.append((name, df.columns)) or stage(df, name))
    index_store.load_index(articles(spark, article("1"), article("1", abstract="x", last_update=2)), staged_path(spark, "index"), "upload", 0)
    writers.append_new(articles(spark, article("1"), article("1", last_update=2)), staged_path(spark, "table"), create=True)
    assert said == [("contested-keys", ["_id", "_stamp"]), ("contested-keys", ["_id", "_title", "_stamp"])]
