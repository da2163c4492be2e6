"""Toxicity by weak supervision.

1. Lexicons and patterns are mined from a bounded sample of labelled documents: words, and
   beginnings of words, that toxic documents hold far more often than others.
2. They are dealt to many voters (kind by fold). A voter votes for a document that holds one
   of its entries. Every whole text of the corpus is voted on.
3. A generative label model is fitted on the vote patterns of the whole corpus, counted by
   pattern: a latent label, the accuracy of each voter, and the correlations of voters as a
   tree of the strongest dependences given the label, by expectation maximisation. Labelled
   documents of the sample keep their label in it.
4. A linear classifier on the entries is trained on the posterior labels of the sample and
   scores every document.

Only models come to the driver: at most ``MAX_ENTRIES`` entries, ``2 ** voters`` pattern counts
and the entry lists of ``MAX_LABELLED`` sampled documents, one row each however often a doc_id is
repeated.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import bounded, split_words, stage

MAX_LABELLED = 20_000
MAX_ENTRIES = 4096
#: Of the documents that hold an entry this share is toxic at least, and the likelihood ratio is so large that chance
#: doesn't explain it among a million candidates.
MIN_PRECISION, MIN_EVIDENCE = 0.95, 16.0
KINDS, FOLDS = (0, 4, 5, 6), 3  # whole words, and their first 4, 5 and 6 letters
STEPS, RIDGE = 25, 0.01
#: A toxic document that passes costs as much as this many clean ones that are rejected.
MISS_COST = 2.0
#: How far the label of a sampled document is trusted, as one more vote on its posterior.
LABEL_ACCURACY = 0.98
CACHE_SIZE = 150_000
_EDGES = string.punctuation


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _entries_of(word: str) -> list[tuple[int, str]]:
    """(kind, entry) of a word: itself without punctuation around it, lower-cased, and its beginnings."""
    word = word.lower().strip(_EDGES)
    return [(k, word[:k] if k else word) for k in KINDS if (len(word) >= k if k else word)]


def _doc_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a batch, and the distinct (text, word) pairs."""
    words, offsets = split_words(texts)
    if not len(words):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    n = len(coded.dictionary)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    pairs = np.unique(text * n + coded.indices.to_numpy(zero_copy_only=False))
    return coded.dictionary.to_pylist(), pairs // n, pairs % n


def entry_counts(docs: DataFrame) -> DataFrame:
    """(kind, entry, toxic, clean): documents of either label (doc_id, text, toxic) that hold an entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            words, text, word = _doc_words(batch.column("text"))
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            for k in KINDS:
                found = pd.factorize(np.array([next((e for kind, e in _entries_of(w) if kind == k), "") for w in words], object))
                codes, entries = found[0].astype(np.int64), found[1]
                if not len(entries):
                    continue
                pairs = np.unique(text * len(entries) + codes[word])
                toxic = np.bincount(pairs % len(entries), label[pairs // len(entries)], len(entries)).astype(np.int64)
                clean = np.bincount(pairs % len(entries), minlength=len(entries)) - toxic
                real = entries != ""
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(int(real.sum()), k, np.int32)), pa.array(entries[real], pa.string()), pa.array(toxic[real]), pa.array(clean[real]),
                ], names=["kind", "entry", "toxic", "clean"])

    counted = docs.select("text", "toxic").mapInArrow(run, "kind int, entry string, toxic long, clean long")
    return counted.groupBy("kind", "entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class LabelModel:
    """Votes given a latent label: a tree of voters, each depending on the label and its parent's vote."""

    voters: int
    order: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    prior: float = 0.5
    #: chance of a vote by (voter, label, vote of the parent); without parent both are the same
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _tree(self, votes: np.ndarray, weight: np.ndarray) -> None:
        """Maximum spanning tree of the mutual information of voters given the label. weight: (pattern, label)."""
        m = self.voters
        gain = np.zeros((m, m))
        total = max(weight.sum(), 1e-9)
        for y in range(2):
            w = weight[:, y]
            for a in range(m):
                for b in range(a):
                    joint = np.array([[w[(votes[:, a] == i) & (votes[:, b] == j)].sum() for j in range(2)] for i in range(2)]) + 0.1
                    joint = joint / joint.sum()
                    gain[a, b] += w.sum() / total * (joint * np.log(joint / np.outer(joint.sum(1), joint.sum(0)))).sum()
        gain += gain.T
        self.order, self.parent = [0], [-1] * m
        while len(self.order) < m:
            rest = [j for j in range(m) if j not in self.order]
            i, j = max(((i, j) for i in self.order for j in rest), key=lambda p: (gain[p], -p[1]))
            self.parent[j] = i
            self.order.append(j)

    def _maximise(self, votes: np.ndarray, weight: np.ndarray) -> None:
        self.prior = float((weight[:, 1].sum() + 1) / (weight.sum() + 2))
        self.chance = np.zeros((self.voters, 2, 2))
        for j in range(self.voters):
            p = self.parent[j]
            for y in range(2):
                for q in range(2):
                    w = weight[:, y] * ((votes[:, p] == q) if p >= 0 else 1.0)
                    self.chance[j, y, q] = (w[votes[:, j] == 1].sum() + 0.1) / (w.sum() + 1.0 if y else w.sum() + 10.0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of label 1 by rows of votes."""
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(self.voters):
            q = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), np.int64)
            one, zero = self.chance[j, 1, q], self.chance[j, 0, q]
            odds += np.where(votes[:, j] == 1, np.log(one / zero), np.log((1 - one) / (1 - zero)))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def accuracies(self, votes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """For each voter the chance that its vote (or silence) agrees with the label."""
        p = self.posterior(votes)[:, None]
        return (count[:, None] * np.where(votes == 1, p, 1 - p)).sum(0) / count.sum()

    def fit(self, votes: np.ndarray, free: np.ndarray, labelled: np.ndarray, steps: int = STEPS) -> LabelModel:
        """votes: distinct patterns; free: unlabelled documents of each; labelled: (pattern, label) counts."""
        known = labelled.sum(1)
        start = (labelled[:, 1] + 0.5 * (votes.sum(1) > 0)) / (known + 1)
        weight = labelled + free[:, None] * np.stack([1 - start, start], axis=1)
        for step in range(steps):
            if step < 3:
                self._tree(votes, weight)
            self._maximise(votes, weight)
            p = self.posterior(votes)
            weight = labelled + free[:, None] * np.stack([1 - p, p], axis=1)
        return self


def fit_linear(hits: list[np.ndarray], target: np.ndarray, n: int, ridge: float = RIDGE, cost: float = MISS_COST, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of entries with soft targets, by accelerated gradient steps."""
    at = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    index = np.concatenate(hits).astype(np.int64) if len(hits) else np.zeros(0, np.int64)
    rate = np.clip(target.mean(), 1e-3, 1 - 1e-3) if len(target) else 0.5
    x = np.zeros(n + 1)
    x[n] = np.log(rate / (1 - rate))
    most = np.bincount(at, minlength=1).max() + 1 if len(at) else 1
    y, t, step = x.copy(), 1.0, 4.0 / most / cost
    for _ in range(steps if len(target) else 0):
        margin = y[n] + np.bincount(at, y[index], len(hits))
        p = 1 / (1 + np.exp(-margin))
        slope = p * (1 - target) - cost * target * (1 - p)
        gradient = np.append(np.bincount(index, slope[at], n), slope.sum()) / len(hits)
        gradient[:n] += ridge / len(hits) * y[:n]
        new, after = y - step * gradient, (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x[:n], float(x[n])


@dataclass
class Model:
    entries: dict[tuple[int, str], int]
    label_model: LabelModel
    weights: np.ndarray
    bias: float


def _voter(kind: int, entry: int) -> int:
    return KINDS.index(kind) * FOLDS + entry % FOLDS


def entry_hits(docs: DataFrame, entries: dict[tuple[int, str], int]) -> DataFrame:
    """(doc_id, hits, votes): the entries that each whole text holds, and the voters of these as bits."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("votes", T.LongType())])
    voter = np.zeros(max(1, len(entries)), np.int64)
    for (kind, _), i in entries.items():
        voter[i] = 1 << _voter(kind, i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in bounded(batches, "text"):
            words, text, word = _doc_words(batch.column("text"))
            if len(cache) > CACHE_SIZE:
                cache.clear()
            held = []
            for w in words:
                known = cache.get(w)
                if known is None:
                    known = cache[w] = tuple(entries[e] for e in _entries_of(w) if e in entries)
                held.append(known)
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            some = lengths[word] > 0 if len(words) else np.zeros(0, bool)
            size = max(1, len(entries))
            found = np.unique(np.array([t * size + e for t, w in zip(text[some].tolist(), word[some].tolist()) for e in held[w]], np.int64))
            texts, ids = found // size, found % size
            counts = np.bincount(texts, minlength=batch.num_rows)
            votes = np.zeros(batch.num_rows, np.int64)
            np.bitwise_or.at(votes, texts, voter[ids] if len(ids) else ids)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))), pa.array(votes)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sampled_labels(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic) of at most ``most`` labelled documents that aren't held out, drawn by a hash of the id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return stage(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labels")


def _one_text_each(known: DataFrame) -> DataFrame:
    """One row (doc_id, toxic, text) of each labelled doc_id, by a hash of the text: rows that repeat one don't outweigh the others, nor fill the driver."""
    first = known.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return stage(first.select("doc_id", "toxic", "first.text"), "labelled-texts")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_entries: int = MAX_ENTRIES) -> tuple[Model, DataFrame]:
    """The model, and the entry hits of all docs (doc_id, hits, votes), staged."""
    sample = _sampled_labels(labels, max_labelled)
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic_docs, clean_docs = n.get(1, 0), n.get(0, 0)
    known = _one_text_each(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))  # at most max_labelled pairs of numbers
    rate = (toxic_docs + 1) / (toxic_docs + clean_docs + 2)

    def evidence(count: Column, share: float) -> Column:
        return F.when(count > 0, 2 * count * F.log(count / ((F.col("toxic") + F.col("clean")) * F.lit(share)))).otherwise(F.lit(0.0))

    chosen = (
        entry_counts(known).select("kind", "entry", (F.col("toxic") / (F.col("toxic") + F.col("clean"))).alias("precision"), (evidence(F.col("toxic"), rate) + evidence(F.col("clean"), 1 - rate)).alias("evidence"))
        .where((F.col("precision") >= MIN_PRECISION) & (F.col("evidence") >= MIN_EVIDENCE))
        .orderBy(F.col("evidence").desc(), "kind", "entry").limit(max_entries)
    )
    entries = {(r.kind, r.entry): i for i, r in enumerate(chosen.select("kind", "entry").collect())}
    hits = stage(entry_hits(docs, entries), "entry-hits")

    patterns = hits.groupBy("votes").count().toPandas()
    of_sample = entry_hits(known, entries).join(F.broadcast(sample), "doc_id").select("votes", "toxic", "hits").toPandas()
    m = len(KINDS) * FOLDS
    place = {v: i for i, v in enumerate(patterns["votes"])}
    labelled = np.zeros((len(patterns), 2))
    np.add.at(labelled, (np.array([place[v] for v in of_sample["votes"]], np.int64), of_sample["toxic"].to_numpy().astype(np.int64)), 1)

    def bits(votes: np.ndarray) -> np.ndarray:
        return (votes.astype(np.int64)[:, None] >> np.arange(m)) & 1

    free = np.maximum(patterns["count"].to_numpy(np.float64) - labelled.sum(1), 0)
    label_model = LabelModel(m).fit(bits(patterns["votes"].to_numpy()), free, labelled)
    believed = label_model.posterior(bits(of_sample["votes"].to_numpy())) if len(of_sample) else np.zeros(0)
    said = np.where(of_sample["toxic"].to_numpy() == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    target = believed * said / (believed * said + (1 - believed) * (1 - said))
    weights, bias = fit_linear([np.asarray(h, np.int64) for h in of_sample["hits"]], target, len(entries))
    return Model(entries, label_model, weights, bias), hits


def score(hits: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) by the linear classifier."""
    schema = T.StructType([hits.schema["doc_id"], T.StructField("score", T.DoubleType())])
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hits")
            at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            margin = bias + np.bincount(at, weights[ids] if len(ids) else None, len(lists))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -40, 40))))], names=schema.names)

    return hits.select("doc_id", "hits").mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text).

    labels: (doc_id, toxic); rows that are null, held out or beyond the sample teach nothing,
    and of several labels of a document the highest counts, of several texts one. Null and empty texts hold no
    entry and get the score of such a text. Without any label of 1 every score is low; an
    empty table gives no rows. Repeated rows are scored each. Other columns are ignored.
    """
    model, hits = train(docs, labels, **options)
    scored = score(hits, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that are predicted toxic; documents without doc_id stay, rows of one doc_id go together."""
    bad = judge(docs, labels, **options).where(F.col("predicted") == 1).select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
