"""Approximate nearest neighbours by cross-polytope hashing.

A vector, scaled to length one and turned by a pseudo-rotation (three rounds of random signs
and a fast Hadamard transform), hashes to the nearest signed axis. ``TABLES`` independent
rotations make as many tables; a query probes the ``PROBES`` axes nearest to it in each, and all
vectors met there are ranked by their exact distance in double precision.

Equal vectors are one index row with its smallest ids, as many as a query can use, so a
vector that a third of all rows share costs one row. Cells are dealt to tasks by table, axis
and a salt; a task streams the vectors of a cell past its queries and keeps the best few per
query, so neither a crowded cell nor the pairs are ever held. A query that meets fewer
candidates than it needs probes all axes of one table: all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stage

TABLES, PROBES, SALTS = 8, 10, 2
SEED = 29


def _usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0)


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x


def axes(vectors: np.ndarray, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """For each vector the ``probes`` nearest signed axes of each table, as numbers over all tables."""
    n, dims = vectors.shape
    size = 1 << max(0, dims - 1).bit_length()
    unit = np.zeros((n, size))
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit[:, :dims] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, dims])
    probes, found = min(probes, 2 * size), []
    for t in range(tables):
        y = unit
        for _ in range(3):
            y = _hadamard(y * rng.choice([-1.0, 1.0], size))
        signed = np.concatenate([y, -y], axis=1)
        near = np.argpartition(-signed, probes - 1, axis=1)[:, :probes] if probes < 2 * size else np.tile(np.arange(2 * size), (n, 1))
        found.append(near + t * 2 * size)
    return np.concatenate(found, axis=1)


def _with_cells(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """Adds ``cells`` by the column ``vector``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cells array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            cells: list = [None] * len(vectors)
            lengths = np.array([len(v) for v in vectors])
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                for i, found in zip(at, axes(np.array([vectors[i] for i in at], np.float64), tables, probes)):
                    cells[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, schema)


class _Best:
    """The nearest ``most`` index rows of each query of one cell, ties to the smaller first id."""

    def __init__(self, ids: list, vectors: np.ndarray, most: int):
        self.ids, self.vectors, self.most = ids, vectors, most
        self.kept: list[list[tuple]] = [[] for _ in ids]

    def see(self, id_lists: list, vectors: np.ndarray) -> None:
        firsts = np.array([x[0] for x in id_lists])
        for q, query in enumerate(self.vectors):
            far = np.sqrt(((vectors - query) ** 2).sum(axis=1))
            if len(far) > self.most:
                limit = np.partition(far, self.most - 1)[self.most - 1]
                near = np.flatnonzero(far <= limit)
                near = near[np.lexsort((firsts[near], far[near]))[:self.most]]
            else:
                near = range(len(far))
            merged = self.kept[q] + [(float(far[i]), id_lists[i]) for i in near]
            self.kept[q] = sorted(merged, key=lambda x: (x[0], x[1][0]))[:self.most]


def _search(index: DataFrame, asked: DataFrame, k: int, tables: int, probes: int, salts: int) -> DataFrame:
    """(query_id, vec_id, score): for every query the k nearest of each cell that it probes."""
    salt = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(salts)).cast("int")
    entries = _with_cells(index, tables, 1).select(
        F.size("vector").alias("dims"), F.explode("cells").alias("cell"), salt.alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("query_id"), "ids", "vector")
    wanted = _with_cells(asked, tables, probes).select(F.size("vector").alias("dims"), F.explode("cells").alias("cell"), "query_id", "vector").select(
        "dims", "cell", F.explode(F.array(*(F.lit(i) for i in range(salts)))).alias("salt"), F.lit(0).alias("kind"), "query_id", F.lit(None).cast("array<long>").alias("ids"), "vector")
    dealt = entries.unionByName(wanted).repartition("dims", "cell", "salt").sortWithinPartitions("dims", "cell", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "ids", "scores"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]

        def result(best: _Best) -> pa.RecordBatch:
            rows = []
            for query, kept in zip(best.ids, best.kept):
                # of all ids behind the kept vectors the k nearest, without the query's own
                pairs = sorted((far, i) for far, ids in kept for i in ids if i != query)[:k]
                if pairs:
                    rows.append((query, [i for _, i in pairs], [far for far, _ in pairs]))
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

        now, best, waiting = None, None, ([], [])
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dims", "cell", "salt", "kind")], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                cell, kind = tuple(keys[a, :3].tolist()), keys[a, 3]
                if cell != now:
                    if best is not None:
                        yield result(best)
                    now, best, waiting = cell, None, ([], [])
                part = batch.slice(a, b - a)
                if kind == 0:
                    waiting[0].extend(part.column("query_id").to_pylist())
                    waiting[1].extend(part.column("vector").to_pylist())
                elif waiting[0]:
                    if best is None:
                        best = _Best(waiting[0], np.array(waiting[1], np.float64), k + 1)
                    lists = part.column("vector")
                    best.see(part.column("ids").to_pylist(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1))
        if best is not None:
            yield result(best)

    met = dealt.mapInArrow(run, "query_id long, ids array<long>, scores array<double>")
    pairs = met.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("query_id", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    return pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, probes: int = PROBES, salts: int = SALTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row of vectors (vec_id, vector) that ``is_query`` holds for.

    Nearness is Euclidean; ties go to the smaller vec_id. Rows without id and vectors that are
    null, empty, zero or hold null or non-finite parts take no part; vectors of different
    lengths never meet. Repeated ids are one candidate at the smallest distance. A query with
    fewer than k candidates gets all of them. Other columns are ignored.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("vector"))).select("vec_id", "vector")
    # a query uses at most k + 1 ids of a vector: k, and its own
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = usable.select("*", F.row_number().over(first).alias("n")).where(F.col("n") <= k + 1)
    index = stage(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "vector"), "vector-index")
    asked = stage(usable.where(is_query).select(F.col("vec_id").alias("query_id"), "vector"), "vector-queries")
    found = stage(_search(index, asked, k, tables, probes, salts), "vector-pairs")
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = asked.join(counts, "query_id", "left_anti")
    whole = _search(index, short, k, 1, 1 << 30, salts)
    every = found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(whole)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
