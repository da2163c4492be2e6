"""Search against brute force, on corpora with heavy copies and hot words."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search as search_module
from corpusloom.operators.search import PreparedSearch, match_all, search
from corpusloom.session import stage

DOC = "id string, title string, abstract string, fulltext string, article_type string, topics array<string>"
CLAUSE = "request_id long, request string, words array<string>, topics array<string>"


def tokens(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def brute(docs, clauses):
    held = {d[0]: set(tokens(" ".join(x or "" for x in d[1:4]))) for d in docs}
    topics = {d[0]: d[5] or [] for d in docs}
    n, df = len(docs), Counter(w for ws in held.values() for w in ws)
    out = {}
    for request, _, words, listed in clauses:
        asked = Counter(tokens(" ".join(words)))
        rarity = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w, c in asked.items())
        for i in held:
            by_topic = 1.5 * sum(listed.count(t) for t in topics[i])
            every = bool(asked) and all(w in held[i] for w in asked)
            if every or by_topic:
                out[request, i] = round(by_topic + (2 * rarity if every else 0), 6)
    return out


def brute_top(matches, k):
    per = {}
    for (request, i), score in matches.items():
        per.setdefault(request, []).append((-score, i))
    return {r: [(i, -s) for s, i in sorted(v)[:k]] for r, v in per.items()}


def corpus(rng, n):
    vocabulary = ["the", "of"] + [f"w{i}" for i in range(12)]
    weights = [20, 10] + [1] * 12
    copy = (None, "the of w1", None, "w2 the w3", "k", ["001", "002"])
    docs = []
    for i in range(n):
        if rng.random() < 0.4:
            docs.append((str(i), *copy[1:]))
            continue
        text = lambda: " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 6)))
        bag = rng.sample(["001", "002", "003", "004"], rng.randint(0, 3))
        docs.append((str(i), text(), text() if rng.random() < 0.8 else None, text() if rng.random() < 0.5 else None, "k", bag or None))
    return docs


def requests(rng, n):
    vocabulary = ["The", "of"] + [f"w{i}" for i in range(12)] + ["absent", "w1-w2"]
    rows = []
    for i in range(n):
        words = ["The"] if rng.random() < 0.3 else rng.choices(vocabulary, k=rng.randint(0, 3))
        listed = [] if rng.random() < 0.3 else rng.choices(["001", "002", "003", "009"], k=rng.randint(1, 4))
        rows.append((i, " ".join(words), words, listed))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    doc_rows, clause_rows = corpus(rng, 150), requests(rng, 25)
    docs = stage(spark.createDataFrame(doc_rows, DOC), "docs")
    clauses = spark.createDataFrame(clause_rows, CLAUSE)
    want = brute(doc_rows, clause_rows)
    got = {(r["request_id"], r["id"]): r["score"] for r in match_all(docs, clauses).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
    top = {}
    for r in search(docs, clauses, 7).orderBy("request_id", "order").collect():
        top.setdefault(r["request_id"], []).append((r["order"], r["id"], r["score"]))
    expect = brute_top(got, 7)
    assert top == {r: [(n + 1, i, s) for n, (i, s) in enumerate(v)] for r, v in expect.items()}


def test_copies_are_one_group_and_equal_requests_one_query(spark):
    """A third of the documents are one text and all requests ask the same: no pairs of them are made."""
    docs = stage(spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "same words here").otherwise(F.concat(F.lit("other"), F.col("id").cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("abstract"), F.lit(None).cast("string").alias("fulltext"),
        F.lit("k").alias("article_type"), F.array(F.lit("001")).alias("topics")), "docs")
    clauses = spark.range(1000).select(
        F.col("id").alias("request_id"), F.lit("same words").alias("request"),
        F.array(F.lit("same"), F.lit("words")).alias("words"), F.array(F.lit("001")).alias("topics"))
    prepared = PreparedSearch(docs, clauses)
    assert prepared.table.count() == 1
    assert prepared.top(30).count() == 30
    hits = search(docs, clauses, 30)
    assert hits.count() == 30_000
    first = [r["id"] for r in hits.where("request_id = 5").orderBy("order").collect()]
    assert first == sorted(str(i) for i in range(0, 3000, 3))[:30]


def test_plan_cuts_before_it_moves(spark):
    rng = random.Random(9)
    docs = stage(spark.createDataFrame(corpus(rng, 50), DOC), "docs")
    prepared = PreparedSearch(docs, spark.createDataFrame(requests(rng, 5), CLAUSE))
    plan = prepared.top(30)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 30, Partial" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "fulltext" not in plan and "abstract" not in plan


def test_rows_with_many_anchors_move_once(spark):
    """A document that holds the anchors of many queries isn't repeated with all its words for each of them."""
    words = [f"word{i:03d}" for i in range(60)]
    docs = spark.createDataFrame([("1", " ".join(words), None, None, "en", ["001"]), ("2", "word000 other", None, None, "en", None)],
                                 "id string, title string, abstract string, fulltext string, article_type string, topics array<string>")
    clauses = spark.createDataFrame([(i, w, [w, words[0]], ["001"]) for i, w in enumerate(words)] + [(99, "missing", ["word001", "other"], [])],
                                    "request_id long, request string, words array<string>, topics array<string>")
    prepared = PreparedSearch(docs, clauses)
    found = prepared.by_words()
    assert prepared.per_request(found).count() == 61  # of each word document 1, of the first also 2
    lines = found._jdf.queryExecution().analyzed().toString().split("\n")
    exploded = [i for i, line in enumerate(lines) if "explode(anchors" in line]
    assert exploded and all("Project [row" in lines[i - 1] and "held" not in lines[i - 1] for i in exploded)


def test_word_matches_are_met_from_the_best_on(spark, monkeypatch):
    """The best by words equal brute force whatever the blocks, and a query with many matches meets few of them."""
    rng = random.Random(9)
    docs = [(f"{i:04d}", f"the own{i} {rng.choice(['red', 'blue'])}", None, f"odd{i % 2}", "k", rng.choice([["001"], ["002"], ["001", "002"], None])) for i in range(900)]
    clauses = [(1, "", ["the"], ["001"]), (2, "", ["the", "red"], []), (3, "", ["odd1", "blue", "the"], ["002", "002"]), (4, "", ["own17"], ["001"]), (5, "", ["own17", "own18"], [])]
    others = [(10 + i, "", [f"own{i}"], []) for i in range(900)]  # so that no two documents hold the same
    prepared = PreparedSearch(spark.createDataFrame(docs, DOC), stage(spark.createDataFrame(clauses + others, CLAUSE), "clauses"))
    groups = search_module.first_ids(prepared.held(), ("held", "anchors", "topics"), 5)
    monkeypatch.setattr(search_module, "BLOCK_BITS", 3)
    ranking = search_module.WordRanking(groups, prepared.table, 5)
    found = brute_top({(r, i): s for (r, i), s in brute(docs, clauses).items() if all(w in docs[int(i)][1].split() + [docs[int(i)][3]] for w in clauses[r - 1][2])}, 5)
    names = {r["query"]: r["request_id"] for r in prepared.requests.collect()}
    rows = {}
    for r in ranking.top().collect():
        rows.setdefault(names[r["query"]], []).append((-r["score"], r["id"]))
    assert {r: [(i, -s) for s, i in sorted(v)] for r, v in rows.items() if r < 10} == found and len(rows) == 904
    met = {names[r["query"]]: r["met"] for r in ranking.met.collect()}
    assert met[4] == 1 and 5 <= met[1] <= 40 and 5 <= met[2] <= 60 and 5 <= met[3] <= 60


def test_shown_fields_move_once(spark):
    """Titles and abstracts meet the hits last: no step after that join moves or joins them again."""
    docs = stage(spark.createDataFrame([(str(i), "the title", "an abstract", None, "k", ["001"]) for i in range(20)], DOC), "docs")
    clauses = spark.createDataFrame([(i, "", ["title"], ["001"]) for i in range(4)] + [(9, "", ["abstract"], [])], CLAUSE)
    hits = search(docs, clauses, 3)
    assert hits.count() == 15 and hits.columns == ["request_id", "order", "id", "title", "abstract", "article_type", "topics", "score"]
    joins = [line for line in hits._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
    assert "(id#" in joins[0] and "query#" not in joins[0]
