"""SimHash near duplicates by a binary trie self-join of fingerprints.

Texts of equal fingerprint are one node. Fingerprints within ``BITS`` differing bits are found
by walking a trie of all fingerprints in pairs of nodes: both go down together, differing bits
add up, and a pair that exceeds its error budget is dropped with everything below it.

So that budgets bite near the root, each fingerprint is in ``BLOCKS`` tries, rotated by one
block more in each. If two fingerprints differ in at most k bits, then in one of the rotations
the first i blocks differ in at most ``i * k / BLOCKS`` bits for every i (start after the block at
which the surplus over the mean is largest). Walking each trie with that rising budget finds
every link, and the budget is 0 for the first bits: these deal the tries out to tasks. In a
task a trie is a sorted array of 64-bit numbers, its nodes are slices, and a level of node
pairs is walked at once, in bounded chunks.

A task reports its links as a star per group found, so dense groups don't become all pairs;
components of the links are found with joins (see :mod:`components`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import bounded, free_names, stage
from corpusloom.llm.components import components

WORDS, BITS, BLOCKS = 4, 4, 16
SEED = 42
CHUNK = 1 << 18


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the shingles of a text; unsigned. ASCII letters are lower-cased; without words it is zero."""
    found = (text or "").encode().lower().split()  # bytes: just A-Z is lower-cased, just ASCII white space splits
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(first[:n].tolist(), ends[len(found) - n:].tolist())])
    counts = np.zeros(64, np.int64)
    table = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 8192):
        counts += np.unpackbits(table[at:at + 8192], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The columns of docs but its text, and fp, the fingerprint of the text as a signed long."""
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


class _Groups:
    """Union of indices, by the smallest."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_groups(values: np.ndarray, bits: int = BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> np.ndarray:
    """For sorted distinct 64-bit values of one rotation: the index of the first value of each one's group.

    Linked are values within ``bits`` differing bits whose prefixes keep to the rising budget.
    """
    n, step = len(values), 64 // blocks
    budget = [-(-d // step) * bits // blocks for d in range(65)]
    exact = max(d for d in range(65) if budget[d] == 0)
    groups = _Groups(n)
    prefix = values >> np.uint64(64 - exact) if exact else np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
    stops = np.append(starts[1:], n)
    several = stops - starts > 1
    starts, stops = starts[several], stops[several]
    # node pairs of one depth: slices u and v of the values, and the bits in which their prefixes differ
    todo = [(exact, starts[i:i + chunk], stops[i:i + chunk], starts[i:i + chunk], stops[i:i + chunk], np.zeros(len(starts[i:i + chunk]), np.int8)) for i in range(0, len(starts), chunk)]
    while todo:
        depth, a, b, c, d, gap = todo.pop()
        single = (b - a == 1) & (d - c == 1)
        if single.any():  # nothing branches below: compare the rest at once
            i, j = a[single], c[single]
            near = np.bitwise_count(values[i] ^ values[j]) <= bits
            groups.join(i[near], j[near])
            a, b, c, d, gap = (x[~single] for x in (a, b, c, d, gap))
        if depth == 64 or not len(a):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        above = ~(bit - np.uint64(1))  # bits down to this one

        def middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return np.clip(np.searchsorted(values, (values[lo] & above) | bit), lo, hi)

        m, k, same = middle(a, b), middle(c, d), a == c
        allowed = budget[depth + 1]
        children = (
            (a, m, c, k, gap, np.ones(len(a), bool)), (m, b, k, d, gap, np.ones(len(a), bool)),
            (a, m, k, d, gap + np.int8(1), gap + 1 <= allowed), (m, b, c, k, gap + np.int8(1), (gap + 1 <= allowed) & ~same),
        )
        parts = []
        for p, q, r, s, g, fits in children:
            alive = fits & (q > p) & (s > r) & ~((p == r) & (q - p == 1))
            parts.append([x[alive] for x in (p, q, r, s, g)])
        p, q, r, s, g = (np.concatenate(x) for x in zip(*parts))
        for i in range(0, len(p), chunk):
            todo.append((depth + 1, p[i:i + chunk], q[i:i + chunk], r[i:i + chunk], s[i:i + chunk], g[i:i + chunk]))
    return groups.root


def _rotated(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def trie_links(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` within ``bits`` differing bits (a star per group of a task)."""
    step = 64 // blocks
    exact = step * (-(-blocks // bits) - 1) if bits else 64
    turned = fps.select(F.explode(F.array(*(F.struct(F.lit(r).cast("byte").alias("r"), _rotated(F.col("fp"), r * step).alias("v")) for r in range(blocks)))).alias("t")).select("t.*")
    dealt = turned.repartition("r", F.shiftrightunsigned("v", 64 - exact) if exact else F.lit(0)).sortWithinPartitions("r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(r: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            values = np.unique(np.concatenate(parts).view(np.uint64))
            root = trie_groups(values, bits, blocks)
            at = np.flatnonzero(root != np.arange(len(values)))
            back = [(x >> np.uint64(r * step)) | (x << np.uint64(64 - r * step)) if r else x for x in (values[at], values[root[at]])]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in back], names=["a", "b"])

        now, parts = None, []
        for batch in batches:
            rs, vs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for r in np.unique(rs).tolist():
                if now is not None and r != now:
                    yield links(now, parts)
                    parts = []
                now = r
                parts.append(vs[rs == r])
        if parts:
            yield links(now, parts)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Per document (doc_id, text): doc_id, fp and component_id, the smallest doc_id reachable over links.

    Null, empty and blank texts have fingerprint zero, which links like any other. Repeated
    rows are documents of equal fingerprint. A component without any doc_id has a null id.
    No documents give no rows. Other columns are ignored.
    """
    prints = stage(fingerprints(docs.select("doc_id", "text"), words), "fingerprints")
    rooted = _rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), bits, blocks)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _rooted(nodes: DataFrame, bits: int, blocks: int) -> DataFrame:
    """nodes (fp, least) with the root of each one's component, staged."""
    nodes = stage(nodes, "fp-nodes")
    found = components(trie_links(nodes, bits, blocks))
    return stage(nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "fp-roots")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, words: int = WORDS, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """docs with one row of each component, the one of the smallest doc_id.

    A null doc_id comes after all others; among rows of one doc_id a hash of the text decides, and of equal
    rows one stays. Null, empty and blank texts have fingerprint zero, which links like any other.
    No documents give no rows; all columns stay, whatever their names.
    """
    one, two = free_names(docs.columns, "key_one", "key_two")
    keyed = docs.withColumns({one: F.xxhash64("doc_id", "text"), two: F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", "text")})
    prints = fingerprints(keyed.select("doc_id", F.col(one).alias("one"), F.col(two).alias("two"), "text"), words)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "one", "two"))
    rooted = _rooted(prints.groupBy("fp").agg(least.alias("least")), bits, blocks)
    kept = stage(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.one").alias(one), F.col("least.two").alias(two)), "kept-rows")
    # equal rows become one in each split before anything moves, and the join keeps to that partitioning
    return keyed.dropDuplicates([one, two]).join(kept, [one, two], "left_semi").select(*docs.columns)
