"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from corpusloom.llm import bpe, chat, licenses, lines, mixing, neighbours, outliers, sharding, simhash, toxicity

CLASHING = ("size key shard part passes carried target n line h1 halves fp component_id root least x cell own distance hits votes score toxic "
            "range base deal heavy license n_words ids token_ends n_lines exact near first drops kept text_crc32 slot").split()
TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.lit(7).alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    said = lambda n: " ".join(rng.choices(words, k=n))
    copy = said(40)
    rows = [(i, said(30) + "\n" + said(12), rng.choice(["en", "de"]), rng.choice(["a", "b"]), 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \t\n ", None, "b", 3), (None, said(25), "en", None, 5), (None, None, None, None, None)]
    rows += [(103, " ".join(rng.choices(words, k=150_000)), "en", "a", 1), (104, "x" * 300_000, "en", "a", 1)]
    rows += [(200 + i, copy, "en", "a", 1) for i in range(15)] + [(300, said(30), "en", "b", 1)] * 3
    return documents(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 1), (4, 0), (5, 9)], "doc_id long, toxic int").withColumn("text", F.lit("x"))


def test_a_labelled_document_teaches_once_however_often_it_is_repeated(spark, labels, monkeypatch):
    sampled = []
    fit = toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda hits, *rest: sampled.append(len(hits)) or fit(hits, *rest))
    rows = [(i, f"{'vile' if i % 2 else 'calm'} words of {i}", "en", "a", 1) for i in range(60)]
    usable = toxicity._sampled_labels(labels, toxicity.MAX_LABELLED).count()
    once = {(r.doc_id, r.score) for r in toxicity.judge(documents(spark, rows), labels).collect()}
    often = toxicity.judge(documents(spark, rows + rows[1:2] * 3000 + [(7, None, "en", "a", 1)]), labels).collect()
    assert sampled == [usable, usable] and len(often) == 3061
    assert {i for i, s in once if s >= 0.5} == {r.doc_id for r in often if r.predicted}


def test_toxicity(docs, nothing, labels):
    found = toxicity.judge(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    empty = [r.score for r in found if r.doc_id in (100, 101, 102)]
    assert len(set(empty)) == 1
    assert toxicity.judge(nothing, labels).count() == 0
    assert len(toxicity.judge(docs, labels.limit(0)).collect()) == docs.count()
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_simhash(docs, nothing):
    found = {}
    for r in simhash.near_duplicates(docs).collect():
        found.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert found[100] == found[101] == found[102] == {(0, 100)}
    assert (0, 100) in found[None]
    assert {c for i in range(200, 215) for _, c in found[i]} == {200}
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) == len({c for of in found.values() for _, c in of}) and {100, 200, 300} <= set(kept) and 101 not in kept
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [None, 1.0, 0.0]), (4, [nan, 1.0, 0.0]), (5, [inf, 1.0, 0.0]), (6, []), (None, [1.0, 0.0, 0.0]),
            (7, [1.0, 0.0, 0.0]), (8, [0.0, 1.0, 0.0]), (9, [0.0, -1.0, 0.0]), (9, [0.0, -1.0, 0.0]), (10, [1.0, 0.0]), (100, [2.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, vector array<float>").withColumn("cells", F.lit(1)).withColumn("query_id", F.lit(1))
    found = [tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    root = 2 ** 0.5
    assert found == [(0, 1, 7, 0.0), (0, 2, 8, root), (0, 3, 9, root), (100, 1, 10, 1.0)]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(50 + i, [1.0, 2.0 + i]) for i in range(1, 9)]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = [(r.vec_id, r.score) for r in neighbours.nearest(table, F.col("vec_id") == 3).orderBy("rank").collect()]
    assert found == [(i, 0.0) for i in range(11) if i != 3]


def test_outliers(docs, nothing):
    found = outliers.judge(docs, min_group=20).collect()
    assert len(found) == docs.count()
    by_id = {r.doc_id: r for r in found}
    for i in (100, 101, 102):
        assert by_id[i].n_words == 0 and by_id[i].base_failed and not by_id[i].kept
    assert by_id[103].n_words == 150_000 and by_id[104].n_words == 1
    assert outliers.judge(nothing).count() == 0


def test_outliers_of_a_rare_source_are_judged_beside_the_language(spark):
    """50 documents of junk in a source and language too small for estimates of their own."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    junk = lambda: " ".join("".join(rng.choices("#*$%&|<>A0", k=rng.randint(3, 9))) for _ in range(60))
    rows = [(i, " ".join(rng.choices(words, k=60)), "en", "big", 1) for i in range(300)]
    rows += [(1000 + i, junk(), "en", "rare", 1) for i in range(50)] + [(1100 + i, " ".join(rng.choices(words, k=60)), "en", None, 1) for i in range(10)]
    rows += [(2000 + i, junk(), None, "other", 1) for i in range(30)]  # judged by the table
    found = {r.doc_id: r for r in outliers.judge(documents(spark, rows)).collect()}
    assert len(found) == len(rows) and all(r.distance is not None for r in found.values())
    assert not any(found[i].kept for i in [*range(1000, 1050), *range(2000, 2030)])
    assert sum(found[i].kept for i in [*range(300), *range(1100, 1110)]) >= 305
    # a table too small for any estimate is kept
    assert all(r.kept and r.distance is None for r in outliers.judge(documents(spark, rows[:60])).collect())


def test_mixing_deals_repeated_rows_over_the_shards(spark):
    """A third of all rows are one row, another third have no id and one size."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") + 10).alias("doc_id"), F.lit("a b c d").alias("text"),
        F.when(F.col("id") % 2 == 0, "x").alias("source"))
    found = mixing.mix_sources(rows, shard_docs=300).collect()
    per_shard, taken = Counter(r.shard for r in found), Counter()
    assert len(found) == 3000 and set(per_shard) == set(range(10)) and max(per_shard.values()) < 400
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target] += r.taken
    assert all(abs(words - target) <= 16 * 10 for target, words in taken.items())
    again = mixing.mix_sources(rows.repartition(5), shard_docs=300).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    mixed = mixing.mixed_documents(rows, shard_docs=300).select("doc_id", "text").collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(taken.values())


def test_mixing(docs, nothing):
    found = mixing.mix_sources(docs).collect()
    assert len(found) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in found)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in found:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.taken
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + len(r.text.split())
    assert seen == {i: n for i, n in words.items() if n}
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    blank = docs.where("doc_id in (100, 101, 102)")
    assert [(r.size, r.taken, r.target) for r in mixing.mix_sources(blank).collect()] == [(0, 0, 0.0)] * 3


def test_bpe(docs, nothing):
    found = {r.doc_id: r.n_tokens for r in bpe.digest(docs, TOKENIZER).collect()}
    assert found[100] == found[101] == 0 and found[102] > 0 and found[104] > 0
    coded = bpe.encode(docs, TOKENIZER)
    assert set(docs.columns) - {"text", "n_tokens", "ids", "token_ends"} < set(coded.columns)
    assert bpe.encode(nothing, TOKENIZER).count() == 0 and bpe.decode(bpe.encode(nothing, TOKENIZER), TOKENIZER).count() == 0


def test_licenses(spark, docs, nothing):
    assert licenses.scan(docs).count() == 0 and licenses.scan(nothing).count() == 0
    some = documents(spark, [(1, "x RELEASED under the (MIT) License!", None, None, None), (1, "x RELEASED under the (MIT) License!", None, None, None), (2, None, None, None, None)])
    assert sorted(tuple(r) for r in licenses.scan(some).collect()) == [(1, "mit", 1, 5, 1.0)] * 2
    assert licenses.scan(some, {"none": " ...", "own": "x released"}).count() == 2


def test_lines(docs, nothing):
    done = lines.dedup_lines(docs)
    assert set(done.columns) == set(docs.columns) | {"n_exact", "n_near"}
    found = {}
    for r in done.collect():
        found.setdefault(r.doc_id, []).append(r)
    assert found[100][0].text is None and found[101][0].text == "" and found[102][0].text == " \t\n "
    assert [found[200 + i][0].text == "" for i in range(15)] == [False] + [True] * 14
    assert len({r.text for r in found[300]}) == 1 and found[300][0].text != ""
    kept = lines.keep_new_text(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {100, 101, 102, 103, 104, 200, 300}
    assert kept.where("doc_id between 201 and 214").count() == 0
    assert lines.dedup_lines(nothing).count() == 0 and lines.keep_new_text(nothing).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, None, None, None), (2, 0, "sys\ntem", "<|end|>\n")],
                                  "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("kind", F.lit("delta"))
    found = {r.conv_id: r for r in chat.digest(turns).collect()}
    assert (found[1].n_turns, found[None].n_turns, found[2].n_turns) == (4, 1, 1) and found[1].loss_chars == 2
    read = chat.format_log(chat.conversation_events(turns)).select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()
    assert {r.conv_id: [tuple(t) for t in r.t] for r in read} == {
        1: [("user", ""), ("", "b"), ("assistant", "a"), ("assistant", "a")], None: [("", "")], 2: [("sys\ntem", "<|end|>\n")]}
    assert chat.digest(turns.limit(0)).count() == 0


def test_sharding(docs, nothing):
    found = sharding.assign_shards(docs).collect()
    assert len(found) == docs.count()
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < 24 for s in slots)
    assert {(r["size"], r.text_crc32) for r in found if r.doc_id in (100, 101)} == {(8, 0)}
    assert sharding.assign_shards(nothing).count() == 0
