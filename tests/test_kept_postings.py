"""Kept postings, near clauses and term frequency against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.frequency import B, FIELD_BOOST, K1, FrequencyRanking, frequency_weights
from corpusloom.operators.search import PreparedSearch, match_all, search
from corpusloom.plans import flows
from corpusloom.session import stage, staged_path
from corpusloom.sources import index_store, marks, postings_store
from tests.test_search import CLAUSE, DOC, brute, corpus, requests

FIELDS = postings_store.FIELDS
ROW = "id string, title string, abstract string, fulltext string, article_type string, topics array<string>, last_update long"


def rows_of(spark, rows, stamp):
    frame = spark.createDataFrame([(*r, stamp) for r in rows], ROW)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in index_store.ROW.fields if f.name not in frame.columns}
    return frame.withColumns(missing).select(*index_store.ROW.names)


class Index:
    """An index and its kept postings, and what they should hold."""

    def __init__(self, spark):
        self.spark, self.path, self.kept, self.rows = spark, staged_path(spark, "index"), staged_path(spark, "kept"), {}

    def load(self, rows, writer, number):
        index_store.load_index(rows_of(self.spark, rows, number), self.path, writer, number)
        postings_store.add_postings(index_store.one_load(self.spark, self.path, writer, number), self.kept, writer, number)
        self.rows.update({r[0]: r for r in rows})

    def remove(self, ids, number):
        index_store.remove_documents(self.spark.createDataFrame([(i,) for i in ids], "id string"), self.path, "remove", number)
        for i in ids:
            self.rows.pop(i, None)

    def docs(self):
        return index_store.read_index(self.spark, self.path, with_load=True)

    def postings(self):
        return postings_store.read_postings(self.spark, self.kept)


@pytest.fixture(scope="module")
def index(spark):
    rng, made = random.Random(5), Index(spark)
    docs = corpus(rng, 120)
    made.load(docs, "upload", 0)
    made.load([(i, *d[1:]) for (i, *_), d in zip(docs[:40], corpus(rng, 40))], "update", 0)
    made.remove([str(i) for i in range(0, 120, 11)] + ["none"], 0)
    made.load([("11", "of w1 w2", None, None, "k", None), ("500", "w3 the", "", None, "k", ["001"])], "update", 1)
    made.load([("11", "of w1 w2", None, None, "k", None), ("500", "w3 the", "", None, "k", ["001"])], "update", 1)  # repeated after a failure
    return made


def test_a_batch_over_kept_postings_equals_one_over_texts_and_reads_none(spark, index):
    clauses = spark.createDataFrame(requests(random.Random(6), 25), CLAUSE)
    docs = index.docs()
    assert {r["id"] for r in docs.select("id").collect()} == set(index.rows)
    want = brute(list(index.rows.values()), [tuple(r) for r in clauses.collect()])
    found = match_all(docs.drop("title", "abstract", "fulltext"), clauses, kept=index.postings())
    got = {(r["request_id"], r["id"]): r["score"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    shown = lambda **how: sorted(tuple(r) for r in search(docs, clauses, 7, **how).select("request_id", "order", "id", "title", "score").collect())
    assert shown(kept=index.postings()) == shown()


def test_only_buckets_of_asked_words_are_read(spark, index):
    few = postings_store.of_words(index.postings(), spark.createDataFrame([("w1",)], "word string"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert {r["word"] for r in few.collect()} == {"w1"}


def test_places_and_lengths(spark):
    docs = spark.createDataFrame([("1", "A b-a", None, "b, B"), ("2", "", " ", None), ("3", None, None, None)], "id string, title string, abstract string, fulltext string")
    got = sorted(tuple(r) for r in postings_store.token_postings(docs).collect())
    assert got == [("1", "a", [0, 2], None, None), ("1", "b", [1], None, [0, 1])]
    assert sorted(tuple(r) for r in postings_store.field_lengths(docs).collect()) == [("1", 3, 0, 2), ("2", 0, 0, 0), ("3", 0, 0, 0)]
    assert postings_store.token_postings(docs.limit(0)).count() == 0


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def near(doc, unit, distance):
    for text in doc[1:4]:
        said = tokens(text)
        at = [[i for i, w in enumerate(said) if w == u] for u in unit]
        if all(at) and any(max(c) - min(c) <= len(unit) - 1 + distance for c in itertools.product(*at)):
            return True
    return False


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_near_clauses_against_brute_force(spark, distance):
    rng = random.Random(distance)
    vocabulary = ["the", "of"] + [f"w{i}" for i in range(6)]
    text = lambda: " ".join(rng.choices(vocabulary, [8, 4] + [1] * 6, k=rng.randint(0, 14)))
    docs = [(str(i), text(), text() if rng.random() < 0.7 else None, text(), "k", None) for i in range(90)]
    docs += [(str(100 + i), "the w1", "w2 of the x w3", None, "k", None) for i in range(30)]
    asked = [(i, "", [" ".join(rng.choices(vocabulary + ["absent"] * (i % 9 == 0), k=rng.randint(1, 3))) for _ in range(rng.randint(1, 2))], []) for i in range(40)]
    asked += [(90, "", ["...", "w1-w2"], []), (91, "", ["?"], [])]
    clauses = spark.createDataFrame(asked, CLAUSE)
    frame = stage(spark.createDataFrame(docs, DOC), "docs")
    units = {r[0]: Counter(tuple(sorted(set(tokens(c)))) for c in r[2] if tokens(c)) for r in asked}
    holds = {u: {d[0] for d in docs if near(d, u, distance)} for us in units.values() for u in us}
    rarity = {u: math.log(1 + (len(docs) - len(h) + 0.5) / (len(h) + 0.5)) for u, h in holds.items()}
    want = {(r, i): 2 * sum(n * rarity[u] for u, n in us.items()) for r, us in units.items() if us for i in set.intersection(*(holds[u] for u in us))}
    got = {(r["request_id"], r["id"]): r["score"] for r in match_all(frame, clauses, distance=distance).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert len(want) > 100 and any(len(u) > 1 for u in holds)


def test_one_word_clauses_stay_as_they_are(spark, index):
    rows = [(i, "", ws, ts) for i, _, ws, ts in requests(random.Random(8), 25) if all(len(tokens(w)) == 1 for w in ws)]
    clauses = spark.createDataFrame(rows, CLAUSE)
    of = lambda **how: sorted(tuple(r) for r in match_all(index.docs(), clauses, kept=index.postings(), **how).collect())
    assert of() == of(distance=3)


def brute_frequency(docs, clauses):
    n = len(docs)
    said = {d[0]: [Counter(tokens(t)) for t in d[1:4]] for d in docs}
    mean = [sum(sum(said[i][f].values()) for i in said) / n for f in range(3)]
    df = Counter(w for fields in said.values() for w in set().union(*fields))
    out = {}
    for request, _, words, listed in clauses:
        asked = Counter(tokens(" ".join(words)))
        for d in docs:
            if not asked or any(not any(c[w] for c in said[d[0]]) for w in asked):
                continue
            score = 1.5 * sum(listed.count(t) for t in d[5] or [])
            for w, times in asked.items():
                tf = sum(FIELD_BOOST[FIELDS[f]] * c[w] / (1 - B + B * (sum(c.values()) / mean[f] if mean[f] else 0)) for f, c in enumerate(said[d[0]]))
                score += 2 * times * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1)
            out[request, d[0]] = round(score, 6)
    return out


def ranking(spark, made, clauses, k):
    prepared = PreparedSearch(made.docs(), clauses, kept=made.postings())
    lengths = postings_store.settled(postings_store.read_lengths(spark, made.kept), prepared.narrow)
    return prepared, FrequencyRanking(prepared, frequency_weights(prepared.found, lengths), k)


@pytest.mark.parametrize("k", [1, 5])
def test_best_by_frequency_equal_brute_force(spark, index, k):
    rows = requests(random.Random(7), 25)
    prepared, ranked = ranking(spark, index, spark.createDataFrame(rows, CLAUSE), k)
    want = {}
    for (request, i), score in brute_frequency(list(index.rows.values()), rows).items():
        want.setdefault(request, []).append((-score, i))
    got = {}
    for r in prepared.per_request(ranked.top()).collect():
        got.setdefault(r["request_id"], []).append((r["order"], r["id"], r["score"]))
    assert {r: [i for _, i, _ in sorted(v)] for r, v in got.items()} == {r: [i for _, i in sorted(v)[:k]] for r, v in want.items()}
    assert all(abs(s + sorted(want[r])[o - 1][0]) < 2e-6 for r, v in got.items() for o, _, s in v)


def test_blocks_that_cannot_reach_the_threshold_are_not_met(spark):
    """A word of all documents: of four times as many documents far fewer than four times as many are met."""
    rng, met = random.Random(4), []
    for n in (1000, 4000):
        made = Index(spark)
        made.load([(str(i), "x " * rng.randint(1, 30) + "y " * (i % 3 == 0) + "z " * rng.randint(0, 300), None, None, "k", None) for i in range(n)], "upload", 0)
        _, ranked = ranking(spark, made, spark.createDataFrame([(1, "", ["x"], []), (2, "", ["x", "y"], [])], CLAUSE), 10)
        met.append(sorted((r["of"], r["met"]) for r in ranked.blocks.groupBy("query").agg(F.sum("n").alias("of")).join(ranked.met, "query").collect()))
        assert ranked.top().groupBy("query").count().where("count = 10").count() == 2
    assert [of for of, _ in met[0]] == [334, 1000] and [of for of, _ in met[1]] == [1334, 4000]
    assert all(m < of / 2 for of, m in met[0] + met[1])
    assert met[1][1][1] < 3 * met[0][1][1] and met[1][1][1] < 4000 / 20


def test_flows_keep_postings(spark):
    places = flows.Places(*[staged_path(spark, n) for n in ("articles", "corpus", "terms", "shares", "index", "marks")], postings=staged_path(spark, "kept"))
    rows = [(str(i), f"title{i} common", f"text {i % 3}", None, "k", None) for i in range(12)]
    flows.ingest(rows_of(spark, rows, 5).drop("topics", "model_version"), places, create=True)
    flows.update_index(spark, places, staged_path(spark, "batches"), now=10)
    flows.remove_documents(spark.createDataFrame([("3",)], "id string"), places)
    marks.set_mark(spark, places.marks, flows.TOPIC_MARK, 1)
    kept = postings_store.read_postings(spark, places.postings)
    clauses = spark.createDataFrame([(1, "", ["common"], []), (2, "", ["title3"], []), (3, "", ["title4", "1"], [])], CLAUSE)
    found = search(flows.current_index(spark, places), clauses, 30, kept=kept).collect()
    assert Counter(r["request_id"] for r in found) == {1: 11, 3: 1}


def test_places_are_grouped_a_bounded_number_of_words_at_once(spark, monkeypatch):
    assert list(postings_store.runs_of_rows(np.array([3, 3, 0, 9, 1, 1, 4]), 6)) == [(0, 3), (3, 1), (4, 3)]
    assert list(postings_store.runs_of_rows(np.array([], int), 6)) == []
    rows = [(str(i), f"w{i} common", None if i % 2 else "common a b a", "long " * i or None) for i in range(9)]
    docs = spark.createDataFrame(rows, "id string, title string, abstract string, fulltext string").coalesce(1)
    whole = postings_store.token_postings(docs).collect()
    monkeypatch.setattr(postings_store, "WORDS", 5)
    assert sorted(map(str, postings_store.token_postings(docs).collect())) == sorted(map(str, whole))


def test_a_word_moves_as_one_row_of_a_run_of_documents(spark):
    docs = spark.createDataFrame([(str(i), "common", None, f"b common w{i}") for i in range(50)] + [("none", None, None, None)], "id string, title string, abstract string, fulltext string").coalesce(1)
    blocks = postings_store.posting_blocks(docs)
    assert blocks.where("word is not null").groupBy("word").agg(F.sum(F.size("docs")).alias("n"), F.count("*").alias("rows")).where("word in ('b', 'common')").select("n", "rows").collect() == [(50, 1)] * 2
    path = staged_path(spark, "kept")
    postings_store.add_postings(docs, path, "upload", 0)
    kept = postings_store.read_postings(spark, path)
    assert kept.where("word is not null").count() == 52
    found = postings_store.of_words(kept, spark.createDataFrame([("common",), ("w7",)], "word string"))
    assert sorted(tuple(r) for r in found.where("id = '7'").select("word", "title", "fulltext", "writer").collect()) == [("common", [0], [1], "upload"), ("w7", None, [2], "upload")]
    assert sorted(postings_store.read_lengths(spark, path).where("id in ('7', 'none')").select("id", "title", "abstract", "fulltext").collect()) == [("7", 1, 0, 3), ("none", 0, 0, 0)]


def test_near_rows_are_judged_together():
    """Rows of clauses of two and three words at once: words of one row, places of other fields and repeats don't help another."""
    from corpusloom.operators import proximity

    gap = proximity._FIELD_GAP
    rows = [(2, [(0, 0), (4, 1)]), (2, [(0, 0), (5, 1)]), (3, [(0, 2), (1, 1), (2, 1), (6, 0)]), (3, [(0, 2), (1, 1), (5, 0)]), (2, [(9, 0), (gap, 1)]), (2, [(3, 1), (20, 1), (21, 0)])]
    events = [[place * size + nth for place, nth in said] for size, said in rows]
    got = proximity._held(np.array([size for size, _ in rows]), np.array([len(e) for e in events]), np.concatenate(events), 3)
    assert got.tolist() == [True, False, False, True, False, True]
    assert proximity._held(np.array([], int), np.array([], int), np.array([], int), 3).tolist() == []
