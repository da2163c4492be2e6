"""The operators against brute force, simulated truth and exact round trips."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat, licenses, lines, mixing, neighbours, outliers, queries, sharding, simhash, toxicity
from corpusloom.llm.components import components

SF = "/root/testdata/sf0.01"


# -- toxicity

def test_label_model_recovers_accuracies_with_correlated_voters():
    rng = np.random.default_rng(4)
    label = rng.random(40_000) < 0.2
    hit, noise = np.array([0.8, 0.8, 0.6, 0.5, 0.7]), np.array([0.05, 0.05, 0.02, 0.1, 0.03])
    votes = (rng.random((len(label), 5)) < np.where(label[:, None], hit, noise)).astype(np.int64)
    votes[:, 1] = np.where(rng.random(len(label)) < 0.9, votes[:, 0], votes[:, 1])  # one voter mostly repeats another
    patterns, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    labelled = np.zeros((len(patterns), 2))
    np.add.at(labelled, (at[:500], label[:500].astype(int)), 1)
    model = toxicity.LabelModel(5).fit(patterns, count - labelled.sum(1), labelled)
    assert model.parent[1] == 0 or model.parent[0] == 1
    truth = (votes == label[:, None]).mean(0)
    assert np.abs(model.accuracies(patterns, count) - truth).max() < 0.05
    assert abs(model.prior - 0.2) < 0.03


def test_linear_classifier_separates():
    rng = np.random.default_rng(5)
    hits = [np.flatnonzero(rng.random(20) < (0.4 if i % 2 else 0.05)) for i in range(2000)]
    weights, bias = toxicity.fit_linear(hits, np.arange(2000) % 2 * 1.0, 20)
    p = np.array([weights[h].sum() + bias for h in hits])
    assert ((p > 0) == (np.arange(2000) % 2 == 1)).mean() > 0.9


def test_toxicity_held_out(spark):
    found = queries.QUERIES["op1_weak_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = found.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    toxic = np.array([r.score for r in rows if r.held_out and r.toxic == 1])
    clean = np.array([r.score for r in rows if r.held_out and r.toxic == 0])
    auc = (toxic[:, None] > clean[None]).mean() + 0.5 * (toxic[:, None] == clean[None]).mean()
    assert auc > 0.97 and (clean >= 0.5).mean() < 0.01


# -- near duplicates

def groups_of(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("bits,blocks", [(4, 16), (3, 16), (4, 8), (2, 32)])
def test_tries_find_every_link(bits, blocks):
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:150]:  # neighbours at all distances, and chains
        for _ in range(4):
            w = v
            for b in rng.sample(range(64), rng.randint(1, bits + 2)):
                w ^= 1 << b
            values.add(w)
            v = w
    values = sorted(values)
    want = groups_of([(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= bits], len(values))
    pairs, at = [], {v: i for i, v in enumerate(values)}
    for r in range(blocks):
        by = r * (64 // blocks)
        turned = sorted((((v << by) | (v >> (64 - by))) & (2**64 - 1), at[v]) for v in values)
        array = np.array([t[0] for t in turned], np.uint64)
        root = simhash.trie_groups(array, bits, blocks, chunk=64)
        pairs += [(turned[i][1], turned[j][1]) for i, j in enumerate(root.tolist())]
    assert groups_of(pairs, len(values)) == want


def plain_fingerprint(text):
    import re
    import xxhash
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="abÀÉ \t\x0b\x1c\x85 \nZ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_query_against_brute_force(spark):
    found = queries.QUERIES["op2_simhash_trie"](spark, SF).orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert [r.doc_id for r in found] == sorted(texts)
    prints = [plain_fingerprint(texts[r.doc_id]) for r in found]
    assert [r.fingerprint for r in found] == [f"{p:016x}" for p in prints]
    root = groups_of([(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4], len(prints))
    assert [r.component_id for r in found] == [found[i].doc_id for i in root]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500), (7, None)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)]
    rng.shuffle(links)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = groups_of([(a, b) for a, b in links if b is not None], 1300)
    linked = {x for a, b in links if b is not None and a != b for x in (a, b)}
    assert found == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- nearest neighbours

def test_neighbours_recall_and_exact_scores(spark):
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    vectors = dict(rows)
    found = defaultdict(list)
    for r in queries.QUERIES["op3_cross_polytope"](spark, SF).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hit = 0
    asked = [i for i in vectors if i % 100 == 0]
    for q in asked:
        far = {i: math.sqrt(((v - vectors[q]) ** 2).sum()) for i, v in rows if i != q}
        assert len(found[q]) == 10 and all(abs(far[i] - s) < 1e-12 for i, s in found[q])
        assert found[q] == sorted(found[q], key=lambda x: (x[1], x[0]))
        hit += len({i for i, _ in found[q]} & set(sorted(far, key=lambda i: (far[i], i))[:10]))
    assert hit / (10 * len(asked)) >= 0.9


# -- quality rules

def plain_counts(text):
    import re
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def test_counts(spark):
    import pyarrow as pa
    rng = random.Random(8)
    texts = ["", "a", "\n\n", "a\x1cb é c #$", "x y\nx y\n x y\nx y"] + [
        "".join(rng.choice(["a ", "b ", "c\n", "é|", " ", "a b c d e f g h ", "\x0b"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    found = outliers.count_batch(pa.array(texts))
    for i, text in enumerate(texts):
        assert tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(text), repr(text)


def test_chi_square():
    # textbook values
    assert abs(outliers.chi_square_quantile(0.95, 1) - 3.8415) < 1e-3 and abs(outliers.chi_square_quantile(0.975, 7) - 16.0128) < 1e-3
    assert abs(outliers.chi_square_quantile(0.99, 4) - 13.2767) < 1e-3


def test_outliers_reject_junk_and_keep_clean(spark):
    found = queries.QUERIES["op4_robust_outliers"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [r for r in found if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) / len(good) > 0.995
    junk = [r for r in found if r.quality == 0]
    assert sum(not r.kept for r in junk) / len(junk) > 0.9


# -- mixing

def test_quotas_are_sainte_lague(spark):
    rng = random.Random(9)
    cells = [(s, chr(97 + c), rng.choice([0.0, rng.random() * 10, rng.random() * 3000, 16.0])) for s in range(12) for c in range(rng.randint(1, 9))]
    found = defaultdict(dict)
    for r in mixing.shard_quotas(spark.createDataFrame(cells, "shard long, of_source string, votes double"), 16).collect():
        found[r.shard][r.of_source] = r.quota
    for shard in range(12):
        votes = {c: v for s, c, v in cells if s == shard}
        seats = dict.fromkeys(votes, 0)
        for _ in range(math.floor(sum(votes.values()) / 16 + 0.5)):
            best = max(sorted(votes), key=lambda c: votes[c] / (2 * seats[c] + 1))
            seats[best] += 1
        assert found[shard] == seats


def test_mix_meets_its_targets(spark):
    found = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    again = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet").repartition(7)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    taken, target, size = Counter(), {}, {}
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[docs[r.doc_id]] += r.taken
        target[docs[r.doc_id]], size[docs[r.doc_id]] = r.target, r.source_size
    total = sum(size.values())
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    level = max(target[s] / weight[s] for s in size if target[s] < 2 * size[s] - 1e-6)
    for s in size:
        assert abs(target[s] - min(2 * size[s], level * weight[s])) < 1e-6 * total
        assert abs(taken[s] - target[s]) <= 32


# -- licenses

def test_altered_licenses_are_found(spark):
    rng = random.Random(10)
    rows = []
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items()) * 20):
        words = text.split()
        if len(words) > 40:
            words[rng.randrange(len(words))] = "zzz"
        before, after = ([f"w{rng.randrange(9999)}" for _ in range(rng.randint(0, 300))] for _ in range(2))
        rows.append((i, name, " ".join(before + words + after)))
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert all((i, name) in found for i, name, _ in rows)
    assert licenses.scan(docs.select("doc_id", F.translate("text", "aeiou", "").alias("text"))).count() == 0


# -- lines

def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_lines(a, b):
    """Words from eight of them on, else characters from twenty on."""
    if len(a) >= 8 or len(b) >= 8:
        return len(a) >= 8 and len(b) >= 8 and word_edits(a, b) <= 1
    a, b = " ".join(a), " ".join(b)
    return len(a) >= 20 and len(b) >= 20 and word_edits(a, b) <= 1


def test_lines_against_all_pairs(spark):
    rng = random.Random(11)
    base = [[rng.choice("abcdefghij") for _ in range(rng.randint(1, 14))] for _ in range(25)]
    base += [["".join(rng.choices("行重複テ", k=rng.randint(19, 24)))] for _ in range(3)] + [["chapter", "twelve", "of", "the", "book"], ["page", "3"]]
    rows = []
    for d in range(90):
        said = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, kind = rng.randrange(len(line) + 1), rng.randrange(3)
                if len(line) < 6 and line and rng.random() < 0.7:
                    word = rng.randrange(len(line))
                    at = rng.randrange(len(line[word]) + 1)
                    line[word] = line[word][:at] + (rng.choice("行x") if kind != 1 else "") + line[word][at + (kind != 0):] or "x"
                else:
                    line[at:at + (kind != 0)] = [rng.choice("abxyz")] if kind != 1 else []
            said.append(rng.choice([" ", "  ", ""]) + rng.choice([" ", "\t"]).join(line))
        rows.append((d, "\n".join(said)))
    found = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    earlier, n_near = [], 0
    for d, text in rows:
        kept, exact, near = [], 0, 0
        for line in text.split("\n"):
            words = line.split()
            same = bool(words) and words in earlier
            close = bool(words) and not same and any(near_lines(words, e) for e in earlier)
            exact, near = exact + same, near + close
            if not same and not close:
                kept.append(line)
            earlier.append(words)
        n_near += near
        assert (found[d].text, found[d].n_exact, found[d].n_near) == ("\n".join(kept), exact, near)
    assert n_near > 10


def test_variant_keys_are_those_of_the_shorter_line():
    rng = random.Random(14)
    for n in (8, 9, 40):
        words = [rng.choice([b"a", b"b", b"cc"]) for _ in range(n)]
        keys = lines.variant_keys(words)
        assert [int(lines.variant_keys(words[:p] + words[p + 1:])[0]) for p in range(n)] == keys[1:].tolist()
    assert len(lines.variant_keys([b"x"] * 300_000)) == 300_001


@given(st.lists(st.sampled_from("ab c".split()), max_size=6), st.lists(st.sampled_from("ab c".split()), max_size=6))
@settings(max_examples=300, deadline=None)
def test_one_edit(a, b):
    if a and b:
        assert lines.one_edit_apart(a, b) == (word_edits(a, b) <= 1)


def test_lines_of_repeated_rows_and_short_lines(spark):
    far, near = "one two three four five six seven eight nine", "one two three four 5 six seven eight nine"
    rows = [(1, f"Contents\n{far}\n第一章は短い行ですが文字は二十を超えています", 77, "a")] + [(2, f"Contents\n{near}", 88, "b")] * 40 + [(3, "第一章は短い行ですが文字は二十を越えています", 99, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, exact_lines string").repartition(8)
    found = Counter((r.doc_id, r.text, r.n_lines, r.n_exact, r.n_near) for r in lines.dedup_lines(docs).collect())
    assert found == {(1, rows[0][1], 3, 0, 0): 1, (2, "", 2, 1, 1): 40, (3, "", 1, 0, 1): 1}
    assert [tuple(r) for r in lines.keep_new_text(docs).collect()] == [rows[0]]


# -- chat

def folded(events):
    turns = {}
    for _, turn, kind, role, text in events:
        if kind == "regenerate":
            turns = {t: v for t, v in turns.items() if t < turn}
        if kind == "delta" and turn in turns:
            turns[turn] = (role or turns[turn][0], turns[turn][1] + (text or ""))
        else:
            turns[turn] = (role or turns.get(turn, ("",))[0], text or "")
    return [turns[t] for t in sorted(turns)]


def test_event_logs_fold_in_order(spark):
    rng = random.Random(12)
    logs = {c: [(s, rng.randint(0, 4), rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice([None, "user", "assistant"]), rng.choice([None, "x", "yy<s>", "[INST]"]))
                for s in range(rng.randint(1, 25))] for c in range(60)}
    rows = [(c, *e) for c, log in logs.items() for e in log]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")
    read = chat.format_log(events).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in read:
        want = folded(logs[r.conv_id])
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")


def test_escapes_are_reversible(spark):
    rng = random.Random(13)
    parts = [*chat.CONTROLS, "\\", "<", "[", "|", "s>", "/INST]", "😀", "\n", "&", "$1", "a"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t for r in rows) and not any(c in r.e for r in rows for c in chat.CONTROLS)


# -- sharding

def test_shards_are_near_equal_and_keep_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = queries.QUERIES["op10_sampled_splitters"](spark, "/root/testdata/sf0.1").collect()
    size, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        assert r["size"] == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        shards[texts[r.doc_id]].add(r.shard)
    assert len(found) == len(texts) and sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 24
    assert max(abs(s - mean) for s in size.values()) < 0.05 * mean
    assert sum(len(s) > 1 for s in shards.values()) <= 1


def test_a_text_of_half_the_rows_is_cut(spark):
    rows = [(i, "same " * 20) for i in range(3000)] + [(3000 + i, f"text {i} " * 12) for i in range(3000)]
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), ranges_per_shard=8).collect()
    size = Counter()
    for r in found:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 24
    assert max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    sharding.write_shards(docs, sharding.assign_shards(docs, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(i, f"text {i % 7}") for i in range(50)]


# -- pipeline

def test_pipeline_stages(spark, tmp_path):
    """Every stage against brute force or SQL on its own input."""
    import base64
    import hashlib

    import duckdb
    import public_tokenizers as public
    import tiktoken

    import corpus_pipeline
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    rows = [t.collect() for t in tables]

    def said(statement, i):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{i}/*.parquet'")
        cursor = con.execute(statement)
        names = [d[0] for d in cursor.description]
        return [dict(zip(names, r)) for r in cursor.fetchall()]

    # toxicity: what the operator predicts goes, nothing else does
    toxic = {r.doc_id for r in toxicity.judge(tables[0], spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert toxic and [r for r in sorted(rows[0]) if r.doc_id not in toxic] == sorted(rows[1])
    # line dedup: texts as SQL has them; documents without a word left go
    want = {r["doc_id"]: r for r in said(queries.ORACLE["op8_line_dedup"], 0)}
    kept = {r.doc_id: r.text for r in rows[2]}
    for i, r in want.items():
        if i in kept:
            assert hashlib.md5(kept[i].encode()).hexdigest() == r["text_md5"]
        else:
            assert r["n_exact"] + r["n_near"] > 0
    assert all(t.split() for i, t in kept.items() if want[i]["n_exact"] + want[i]["n_near"])
    # near duplicates: the smallest id of every component
    docs = sorted(rows[2])
    prints = [plain_fingerprint(r.text) for r in docs]
    root = groups_of([(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4], len(docs))
    assert sorted(r.doc_id for r in rows[3]) == sorted({docs[i].doc_id for i in root})
    # mixing: each document as often as SQL takes its words
    words = Counter()
    for r in rows[4]:
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({r["doc_id"]: r["taken"] for r in said(queries.ORACLE["op5_mix_sources"], 2) if r["taken"]})
    # tokens: as the library makes them
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.TOKENIZER, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, r.n_tokens, r.ids) for r in rows[5]) == sorted((r.doc_id, len(t), t) for r in rows[4] for t in [library.encode_ordinary(r.text)])
