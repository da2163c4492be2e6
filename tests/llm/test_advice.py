"""Cases in which the operators once did less than the whole job."""

import random

from corpusloom.llm import lines, outliers, sharding, simhash


def test_near_dedup_keeps_rows_without_id(spark):
    rows = [(1, "a b c d e f g"), (None, "A b c d e f g"), (None, "h i j k l m n"), (None, "h i j k l m n"), (5, "one two"), (5, "three four"), (6, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in simhash.keep_one(docs).collect()), key=str)
    assert found == sorted([(1, "a b c d e f g"), (None, "h i j k l m n"), (5, "one two"), (5, "three four"), (6, None)], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_outliers_reject_a_third_of_junk_copies(spark):
    rng = random.Random(22)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    clean = [(i, "\n".join(" ".join(rng.choices(words, k=12)) + "." for _ in range(rng.randint(5, 20))), "en", "a") for i in range(600)]
    junk = " ".join(rng.choice(words).upper() + rng.choice(["##", "$%", "!!"]) for _ in range(80))
    rows = clean + [(1000 + i, junk, "en", "a") for i in range(300)]
    found = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in found)
    assert not any(r.kept for r in found if r.doc_id >= 1000)
    assert sum(r.kept for r in found if r.doc_id < 1000) > 590


def test_lines_of_rows_without_or_of_one_id(spark):
    one, two, three = "a b c d", "e f g h", "one two three four five six seven eight nine"
    rows = [(1, f"{one}\n{two}"), (None, one), (None, f"i j k l\nm n o p\n{three}"), (None, None), (None, three.replace("five", "5")), (None, "u v w"), (None, "u v w"), (7, f"q r s t\n{two}"), (7, "x y z a\nb c d e")]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = [(1, f"{one}\n{two}"), (None, ""), (None, f"i j k l\nm n o p\n{three}"), (None, None), (None, ""), (None, "u v w"), (None, ""), (7, "q r s t"), (7, "x y z a\nb c d e")]
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(want, key=str)


def test_shards_of_repeated_rows_are_near_equal(spark):
    rows = [(None, "same " * 20)] * 2000 + [(i, f"text {i} " * 12) for i in range(4000)]
    size = {}
    for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), ranges_per_shard=8).collect():
        size[r.shard] = size.get(r.shard, 0) + r["size"]
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean
