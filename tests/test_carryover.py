"""Topics carried over between fits."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import carryover
from corpusloom.plans import flows
from corpusloom.session import staged_path
from tests.test_flows import texts
from tests.test_store import article, articles

TERMS = "topic string, term string, weight double"


def rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_pairs_are_those_of_greatest_gain(n, m, data):
    gain = np.array(data.draw(st.lists(st.lists(st.sampled_from([0, 0, 1, 2, 3, 7]), min_size=m, max_size=m), min_size=n, max_size=n)), float)
    pairs = carryover.best_pairs(gain)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) and all(gain[i, j] > 0 for i, j in pairs)
    short, long = (gain, m) if n <= m else (gain.T, n)
    most = max(sum(short[i, j] for i, j in enumerate(order)) for order in itertools.permutations(range(long), min(n, m)))
    assert sum(gain[i, j] for i, j in pairs) == most


def test_pairs_of_many_topics():
    gain = np.random.default_rng(5).random((60, 60)) * 0.1
    order = np.random.default_rng(6).permutation(60)
    gain[np.arange(60), order] += 0.5
    assert carryover.best_pairs(gain) == list(enumerate(order))
    assert carryover.best_pairs(np.zeros((0, 0))) == [] and carryover.best_pairs(np.zeros((3, 2))) == []


def test_overlap_is_the_weight_shared(spark):
    former = spark.createDataFrame([("0", "zinc", 3.0), ("0", "tin", 1.0), ("0", "tin", 0.5), ("1", "gold", 2.0), ("1", None, 9.0), (None, "tin", 9.0), ("2", "lead", 0.0)], TERMS)
    new = spark.createDataFrame([("7", "zinc", 1.0), ("7", "tin", 1.0), ("8", "tin", 5.0)], TERMS).withColumn("overlap", F.lit("x")).withColumn("share", F.lit(1))
    assert rows(carryover.topic_overlaps(former, new), "topic", "carried", "overlap") == [("0", "7", 0.75), ("0", "8", 0.25)]
    assert rows(carryover.carried_topics(former, new), "topic", "carried", "overlap") == [("0", "7", 0.75)]
    assert carryover.carried_topics(former, new, least=0.75).count() == 0
    assert carryover.carried_topics(former.limit(0), new).count() == carryover.carried_topics(former, new.limit(0)).count() == 0


def test_a_pair_gives_way_where_both_gain(spark):
    """Topic 0 is nearest to 7, but 1 has nothing besides 7 and both together keep more."""
    former = spark.createDataFrame([("0", "a", 0.6), ("0", "b", 0.4), ("1", "a", 1.0)], TERMS)
    new = spark.createDataFrame([("7", "a", 1.0), ("8", "b", 1.0)], TERMS)
    assert rows(carryover.carried_topics(former, new), "topic", "carried", "overlap") == [("0", "8", 0.4), ("1", "7", 1.0)]


def test_equal_fits_map_every_topic_to_itself(spark):
    terms = spark.createDataFrame([(f"{t:03d}", f"w{(t * 7 + i) % 40}", 1.0 / (1 + i)) for t in range(25) for i in range(10)], TERMS)
    assert rows(carryover.carried_topics(terms, terms), "topic", "carried", "overlap") == [(f"{t:03d}", f"{t:03d}", 1.0) for t in range(25)]


def test_links_lead_over_several_fits(spark):
    pairs = lambda *found: spark.createDataFrame([(a, b, 1.0) for a, b in found], "topic string, carried string, overlap double")
    none = spark.createDataFrame([], carryover.LINKS)
    second = carryover.extend_links(none, pairs(("0", "5"), ("1", "6")), "10")
    third = carryover.extend_links(second, pairs(("5", "9"), ("7", "8")), "20")
    assert rows(third, "model_version", "topic", "carried") == [("10", "0", "9"), ("20", "5", "9"), ("20", "7", "8")]
    index = spark.createDataFrame(
        [("a", ["1", "0"], "10"), ("b", ["7", "5", "6"], "20"), ("c", ["0", "1"], "30"), ("d", ["1"], "10"), ("e", None, "10"), ("f", ["0"], None), ("g", ["0"], "5"), ("h", ["0", None], "10")],
        "id string, topics array<string>, model_version string").withColumn("_other", F.lit(1))
    found = carryover.with_carried_topics(index, third, "30")
    assert found.columns == index.columns
    assert {r["id"]: r["topics"] for r in found.collect()} == {"a": ["9"], "b": ["8", "9"], "c": ["0", "1"], "d": None, "e": None, "f": None, "g": None, "h": ["9"]}
    assert carryover.with_carried_topics(index.limit(0), third, "30").count() == 0


@pytest.fixture(scope="module")
def refitted(spark):
    """Two fits on equal texts of different seeds, and an upload between them."""
    places = flows.Places(*[staged_path(spark, n) for n in ("articles", "corpus", "terms", "shares", "index", "marks")], topic_links=staged_path(spark, "links"))
    data = [article(str(i), abstract=r["text"], last_update=i + 1) for i, r in enumerate(texts(spark).collect())]
    flows.ingest(articles(spark, *data), places, create=True)
    flows.model_topics(spark, places, 50, k=4, iterations=3, max_document_share=1.0, seed=1)
    flows.upload_documents(spark, places, staged_path(spark, "batches"))
    before = {r["id"]: r["topics"] for r in flows.current_index(spark, places).collect()}
    former = flows.topic_terms(spark, places)
    flows.model_topics(spark, places, 60, k=4, iterations=3, max_document_share=1.0, seed=2)
    return places, before, former


def test_documents_stay_searchable_after_a_refit(spark, refitted):
    places, before, former = refitted
    led = {r["topic"]: r["carried"] for r in carryover.carried_topics(former, flows.topic_terms(spark, places)).collect()}
    after = {r["id"]: r["topics"] for r in flows.current_index(spark, places).collect()}
    assert led and before.keys() == after.keys() and any(after.values())
    assert after == {i: [led[t] for t in topics if t in led] or None for i, topics in before.items()}
    # the third fit is that of the second, so it leads all links on to the same topics
    flows.model_topics(spark, places, 70, k=4, iterations=3, max_document_share=1.0, seed=2)
    assert {r["id"]: r["topics"] for r in flows.current_index(spark, places).collect()} == after
    # an upload after that replaces them by topics of its own version
    flows.upload_documents(spark, places, staged_path(spark, "batches"))
    assert flows.current_index(spark, places).where("model_version = '70' and size(topics) > 0").count() == len(after)
