"""Keep-first inside a stream."""

from corpusloom.operators.store import keep_first
from corpusloom.schema import ARTICLE
from corpusloom.session import staged_path
from corpusloom.sources import index_store
from corpusloom.streaming import first_seen
from tests.test_store import article, articles


class Raw:
    """A folder of raw items, files of which a stream reads one micro-batch after the other."""

    def __init__(self, spark):
        self.spark, self.path, self.index, self.checkpoint = spark, *(staged_path(spark, n) for n in ("raw", "index", "checkpoint"))

    def add(self, *rows):
        articles(self.spark, *rows).coalesce(1).write.mode("append").parquet(self.path)

    def run(self, **options):
        items = self.spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", 1).parquet(self.path)
        first_seen.load_first_seen(items, self.index, self.checkpoint, **options).awaitTermination()
        return sorted((r["id"], r["abstract"], r["last_update"]) for r in index_store.loads(self.spark, self.index).collect())


def test_the_first_stays_over_restarts(spark):
    raw = Raw(spark)
    raw.add(article("1", abstract="first", last_update=5), article("1", abstract="later", last_update=6), article("2", last_update=9))
    assert raw.run() == [("1", "first", 5), ("2", "a", 9)]
    raw.add(article("1", abstract="older, but it came second", last_update=1), article("3", last_update=2))
    raw.add(article("3", abstract="again", last_update=1), article("2", last_update=9))
    assert raw.run() == [("1", "first", 5), ("2", "a", 9), ("3", "a", 2)]
    assert raw.run() == [("1", "first", 5), ("2", "a", 9), ("3", "a", 2)]


def test_one_micro_batch_equals_the_batch(spark):
    raw = Raw(spark)
    rows = [article(str(i % 7), title=f"t{i % 2}" if i % 5 else None, abstract=f"a{i % 11}" if i % 4 else None, last_update=i % 3 if i % 13 else None) for i in range(200)]
    rows += [article("hot", abstract=f"a{i % 9}", last_update=2) for i in range(300)]
    raw.add(*rows)
    items = raw.spark.readStream.schema(ARTICLE).parquet(raw.path)
    out = staged_path(spark, "out")
    with first_seen.state_store(spark):
        first_seen.first_seen(items).writeStream.trigger(availableNow=True).option("checkpointLocation", raw.checkpoint).format("parquet").start(out).awaitTermination()
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(spark.read.schema(ARTICLE).parquet(out)) == shown(keep_first(articles(spark, *rows)))


def test_a_key_is_forgotten_after_the_horizon_and_late_items_go(spark):
    raw = Raw(spark)
    raw.add(article("1", abstract="first", last_update=1_000), article("x", last_update=None))
    raw.add(article("1", abstract="within", last_update=1_090), article("2", last_update=1_050))
    raw.add(article("3", last_update=2_000))
    raw.add(article("4", last_update=1_950))
    raw.add(article("5", abstract="late", last_update=1_500))
    raw.add(article("1", abstract="anew", last_update=2_010))
    assert raw.run(horizon=100) == [("1", "anew", 2_010), ("1", "first", 1_000), ("2", "a", 1_050), ("3", "a", 2_000), ("4", "a", 1_950)]


def test_no_items(spark):
    raw = Raw(spark)
    raw.add(article("1"))
    spark.createDataFrame([], ARTICLE).write.mode("append").parquet(raw.path)
    assert raw.run() == [("1", "a", articles(spark, article("1")).first()["last_update"])]


def test_the_session_keeps_its_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with first_seen.state_store(spark):
        assert spark.conf.get(name).endswith("RocksDBStateStoreProvider")
    assert spark.conf.get(name, None) == before


def test_values_are_ordered_as_spark_does(spark):
    rows = [(None, "a", [1]), (1, None, [1]), (1, "ä", [2]), (1, "z", None), (1, "z", [10]), (1, "z", [9]), (1, "z", [None]), (1, "z", []), (10, "", [0]), (9, "", [0])]
    found = [tuple(r) for r in spark.createDataFrame(rows, "a long, b string, c array<long>").orderBy("a", "b", "c").collect()]
    assert sorted(rows, key=first_seen._order) == found


def test_a_batch_keeps_all_rows_of_the_first_stamp():
    import pyarrow as pa

    batch = pa.record_batch({"k": ["a", "a", None, "a", None, "b"], "t": [2, 1, 3, 1, None, None], "v": [1, 2, 3, 4, 5, 6]})
    found = pa.Table.from_batches(first_seen._first_of_batches(iter([batch]), ["k"], "t"))
    assert found["v"].to_pylist() == [2, 4, 5, 6]


def test_a_load_goes_through_the_state_once(spark, monkeypatch):
    """A load reads its rows several times; the stateful stage of a micro-batch ran as often before."""
    raw, done = Raw(spark), spark.sparkContext.accumulator(0)
    raw.add(*[article(str(i), last_update=i) for i in range(5)], article("1", abstract="later", last_update=9))

    def counted(batches):
        for batch in batches:
            done.add(batch.num_rows)
            yield batch

    passed = first_seen.first_seen
    monkeypatch.setattr(first_seen, "first_seen", lambda items, **how: passed(items, **how).mapInArrow(counted, ARTICLE))
    raw.run()
    assert done.value == 5
    assert index_store.loads(spark, raw.index).count() == 5
