"""Periodic runs, passages by positional postings and collocations against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import collocations, periods, postings, queries

SMALL = "/root/testdata/sf0.001"
BLANK = r"[^\x20\x09-\x0D]+"


# -- periodic runs

def brute_runs(x):
    found = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(x[t] == x[t + p] for t in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def caught(pieces):
    catcher = periods.SquareCatcher()
    for piece in pieces:
        catcher.append(np.array(piece, np.int64))
    return sorted((tuple(r) for r in catcher.runs().tolist()), key=lambda r: (r[0], r[2]))


periodic = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 7)), max_size=6).map(
    lambda parts: [w for part, n in parts for w in part * n])


@settings(max_examples=400, deadline=None)
@given(periodic, st.integers(1, 9))
def test_runs_equal_brute_force_however_words_arrive(x, step):
    want = brute_runs(x)
    assert caught([x]) == want
    assert caught([x[i:i + step] for i in range(0, len(x), step)]) == want


def test_a_batch_keeps_texts_apart_and_levels_in_proportion():
    texts = [[1] * 5, [1] * 3, [], [1, 2] * 4, [2] * 6]
    runs = periods.batch_runs(np.concatenate([np.array(t, np.int64) for t in texts]), np.cumsum([0, *map(len, texts)]))
    assert [r.tolist() for r in runs] == [[], [], [], [[0, 8, 2]], [[0, 6, 1]]]
    catcher = periods.SquareCatcher()
    for _ in range(20):
        catcher.append(np.zeros(5000, np.int64))
    assert catcher.runs().tolist() == [[0, 100_000, 1]]
    assert sum(len(level.hashes) for level in catcher.levels) < 8 * 100_000


def brute_digest(doc_id, text):
    x = re.findall(BLANK, text or "")
    n, h = len(x), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(x)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    said = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(x) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_op11_equals_brute_force_on_whole_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(brute_digest(*d) for d in docs)
    got = sorted(tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, SMALL).collect())
    assert got == want and sum(r[1] > 0 for r in got) >= 5


def test_runs_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (1, " \n\t", 3), (2, "no no no no no no yes", 4), (2, "no no no no no no yes", 4), (3, "a b " * 30_000, 5), (None, "é é  é é é é é", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = sorted((tuple(r) for r in periods.collapse_runs(docs).collect()), key=str)
    assert [r[6][:6] for r in got if r[0] == 2] == ["no yes"] * 2 and [r[2:6] for r in got if r[0] == 2] == [(0, 6, 1, 6000)] * 2
    assert [(r[2:6], r[6]) for r in got if r[0] == 3] == [((0, 60_000, 2, 30_000_000), "a b")]
    assert [r[1:7] for r in got if r[0] == 1] == [(0, None, None, None, None, "")] * 2
    assert len(got) == 7 and periods.collapse_runs(docs.limit(0)).count() == 0


# -- passages

def words_of(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(text, items, width=10):
    x = words_of(text)
    hit, met = set(), set()
    for item_id, said in items:
        y = words_of(said)
        size = min(width, len(y))
        for i in range(len(y) - size + 1) if y else ():
            for p in range(len(x) - size + 1):
                if x[p:p + size] == y[i:i + size]:
                    hit.update(range(p, p + size))
                    met.add(item_id)
    return len(x), len(hit), sorted(str(m) for m in met if m is not None)


CASES = [
    (7, "One two, three four five six seven eight nine TEN eleven twelve"), (8, "short item"), (8, "ÉTÉ"), (9, "a a a a a a a a a a a"), (10, "..."), (11, None),
    (None, "nobody asked for these ten words here or there now"), (70, "two three four five six seven eight nine ten eleven twelve thirteen"),
]
TEXTS = [
    "so one two three four five six seven eight nine ten eleven and SHORT-item, short x item", "one two three four five six seven eight nine", "", None, " \n",
    "a " * 25, "a " * 9, "ÉTÉ été ÉTÉ", "nobody asked for these ten words here or there now!", "two three four five six seven eight nine ten eleven twelve thirteen " * 3, "x" * 5000,
]


@pytest.mark.parametrize("n_bits", [64, 1 << 23])
def test_contamination_equals_brute_force(spark, n_bits):
    items = spark.createDataFrame(CASES, "item_id long, text string")
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(5, "a " * 25, 0), (None, "short item", 0), (None, "short item", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit int")
    got = sorted(tuple(r) for r in postings.contamination(docs, items, n_bits=n_bits).select(
        *(c for c in ("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated"))).na.fill(-1, ["doc_id"]).collect())
    want = sorted((-1 if i is None else i, n, hit, len(met), met, hit > 0) for i, t, _ in rows for n, hit, met in [brute_contamination(t, CASES)])
    assert got == want
    assert postings.contamination(docs.limit(0), items).count() == 0
    assert postings.contamination(docs, items.limit(0)).where("contaminated or n_hit > 0 or size(item_ids) > 0").count() == 0


def brute_near(x, y, width, slop, seen):
    """Matches (item_word, n_words) of a passage, a window of it laid with its rarest word on a place of it, each word within the slop."""
    size = min(width, len(y))
    at = defaultdict(list)
    for p, w in enumerate(x):
        at[w].append(p)
    starts, found = set(), []
    for i in range(len(y) - size + 1):
        rare = sorted((seen[w], xxhash.xxh3_64_intdigest(w) + (1 << 63) & (1 << 64) - 1, i + k, w) for k, w in enumerate(y[i:i + size]))[:2]
        starts |= {p - rare[0][2] for p in at[rare[0][3]] if any(abs(p - rare[0][2] + rare[1][2] - o) <= slop for o in at[rare[1][3]])}
    for d in starts:
        k = 0
        for ok, group in itertools.groupby(any(abs(p - d - k) <= slop for p in at[w]) for k, w in enumerate(y)):
            n = len(list(group))
            if ok and n >= size:
                found.append((k, n))
            k += n
    return found


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_matches_equal_brute_force(spark, slop):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(12)]
    texts = []
    for _ in range(40):
        t = [f"w{i}" for i in rng.integers(0, 14, 30)]
        moved = list(base)
        for i in rng.integers(0, 11, int(rng.integers(0, 4))):
            moved[i], moved[i + 1] = moved[i + 1], moved[i]
        texts.append(" ".join(t[:10] + moved + t[10:]))
    asked = [(1, base), (2, ["w3", "w4"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in asked], "item_id long, text string")
    got = Counter(tuple(r) for r in postings.phrase_matches(docs, items, 6, slop).select("doc_id", "item_id", "item_word", "n_words").collect())
    seen = Counter(w for t in texts for w in t.split(" ") if w in base)
    want = Counter((d, i, *m) for d, t in enumerate(texts) for i, w in asked for m in brute_near(t.split(" "), w, 6, slop, seen))
    assert got == want and want


def test_only_places_that_can_hold_a_window_are_stored(spark):
    docs = spark.createDataFrame([(1, "a b c x a b x c d e f"), (2, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "c d e f g")], "item_id long, text string")
    said = postings.passages(items, 3)
    bits = postings.word_bits(said.selectExpr("size", "explode(words) as word"))
    stored = postings.store(docs, bits).where("part >= 0")
    assert sorted(p for r in stored.collect() for p in r.places) == [0, 1, 2, 7, 8, 9, 10]
    everything = postings.store(docs).where("part >= 0")
    assert sorted(len(r.words) for r in everything.collect()) == [3, 11]


# -- collocations

def brute_collocations(docs, least, longest, top, absorbed=100):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    rows = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and 100 * b >= absorbed * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(rows)


@pytest.mark.parametrize("n_bits", [64, 1 << 26])
def test_collocations_equal_brute_force(spark, n_bits):
    rng = np.random.default_rng(8)
    docs = [(None, None), ("en", ""), ("", "A b. a B"), ("en", " \t.. ,")]
    for i in range(60):
        words = [["the", "of", "Ünder", " x", "new york", "a"][j] for j in rng.zipf(1.5, 80) % 6]
        text = "".join(w + [" ", " ", "  ", "\t", ". ", "\n", "\r\n"][rng.integers(0, 7)] for w in words)
        docs.append((["en", "de", None][i % 3], text))
    docs += docs[-2:] * 3
    table = spark.createDataFrame([(lang, t, 1) for lang, t in docs], "lang string, text string, n int")
    for least, top, absorbed in ((3, None, 100), (5, 7, 60)):
        got = sorted(tuple(r) for r in collocations.collocations(table, least, 5, top, absorbed, n_bits).collect())
        assert got == brute_collocations(docs, least, 5, top, absorbed)
    assert collocations.collocations(table.limit(0), 2).count() == 0


def test_scores_beyond_64_bits(spark):
    assert spark.sql("select cast(1000 * cast(900000000000 as decimal(17,0)) * cast(9000000000000 as decimal(17,0)) as decimal(38,0)) div (cast(900000000007 as decimal(19,0)) * cast(1000000000 as decimal(19,0))) as x").first().x \
        == 1000 * 900000000000 * 9000000000000 // (900000000007 * 1000000000)


def test_counts_add_up_over_tasks(spark):
    docs = spark.createDataFrame([("en", "rare pair")] * 40, "lang string, text string").repartition(8)
    bits, totals = collocations.frequent_bits(docs, 40, 1 << 12)
    assert sum(bin(b).count("1") for b in bits) == 3 and totals.collect()[0].n == 80
    assert {tuple(r.words): r.f for r in collocations.phrase_counts(docs, bits, 40).collect()} == {("rare",): 40, ("pair",): 40, ("rare", "pair"): 40}
