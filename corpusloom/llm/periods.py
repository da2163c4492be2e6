"""Periodic runs of words by online dyadic square catching.

A run is a stretch of words with smallest period q, at least ``max(6, 4 * q)`` words long, that
no neighbouring word extends. Words are appended; on each level k the text is cut into blocks
of ``B = 2 ** k`` words, and a completed block has a catcher. Each appended word completes one suffix
of B words on each level, whose catcher is the block before the one in which the suffix
begins: they are between B and 2B - 1 words apart, and if they are equal, a square of that period
is caught. So an appended word costs one comparison a level, and a period q belongs to
the level with ``B <= q < 2B``, on which a run of four periods holds at least two whole blocks that catch it.

* Blocks and suffixes are compared by hashes that double in length from level to level.
  Equal words have equal hashes, so nothing is missed; what is caught is compared word by word.
* Squares of one period caught by neighbouring blocks merge into a chain, so a long run is
  one chain a period and not one square a word.
* A chain whose first square lies in a run of a lower level has no smallest period of its
  own (by the periodicity lemma) and goes; a chain that stays is compared with its text and gives a run.
* Words arrive in pieces of any length, a level keeps the hashes of its last three blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.common import BLANK_BYTES, ByteWords, bounded

LEAST_WORDS, LEAST_PERIODS = 6, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _B
    return values ^ (values >> np.uint64(29))


class _Level:
    """Catchers of one length of block: the hashes of the last suffixes and the chains caught."""

    def __init__(self, block: int):
        self.block = block
        self.first = 0  # the first word of the first suffix kept
        self.hashes = np.zeros(0, np.uint64)
        self.chains = np.zeros((0, 3), np.int64)  # period, first and last block

    def append(self, fresh: np.ndarray) -> None:
        """The hashes of the suffixes completed by the new words, in order."""
        block, known = self.block, self.first + len(self.hashes)
        self.hashes = np.concatenate([self.hashes, fresh])
        end = self.first + len(self.hashes)
        if end > block:
            begin = max(known, block)
            at = np.arange(begin, end)
            catcher = (at // block - 1) * block
            hit = np.flatnonzero(self.hashes[begin - self.first:] == self.hashes[catcher - self.first])
            if len(hit):
                self._merge(at[hit] - catcher[hit], catcher[hit] // block)
        # the next suffix begins at ``end``; its catcher is a block before, and the next level looks one block back
        keep = max(self.first, (end // block - 2) * block)
        self.hashes = self.hashes[keep - self.first:].copy() if keep > self.first else self.hashes
        self.first = keep

    def _merge(self, periods: np.ndarray, blocks: np.ndarray) -> None:
        rows = np.concatenate([self.chains, np.stack([periods, blocks, blocks], 1)])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        begins = np.concatenate([[True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 2] + 1)])
        ends = np.append(np.flatnonzero(begins)[1:], len(rows)) - 1
        chains = np.stack([rows[begins, 0], rows[begins, 1], rows[ends, 2]], 1)
        # a chain that is over holds a run only if its blocks, and less than a block at each end, are enough
        growing = chains[:, 2] >= blocks.max() - 1
        self.chains = chains[growing | self._enough(chains)]

    def _enough(self, chains: np.ndarray) -> np.ndarray:
        need = np.maximum(LEAST_WORDS, LEAST_PERIODS * chains[:, 0]) - chains[:, 0]
        return (chains[:, 2] - chains[:, 1] + 1) * self.block + 2 * (self.block - 1) >= need


class SquareCatcher:
    """Runs of a growing text of numbered words. Equal numbers are equal words."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.n = 0
        self.levels: list[_Level] = []

    def append(self, words: np.ndarray, longest: int | None = None) -> SquareCatcher:
        """Words after those there are. Where no run is longer than ``longest`` words, the same in each call, longer blocks have no catchers."""
        words = np.asarray(words, np.int64)
        self.parts.append(words)
        self.n += len(words)
        fresh = _mixed((words.astype(np.uint64) + np.uint64(1)) * _A)
        k = 0
        while len(fresh) and (longest is None or LEAST_PERIODS << k <= longest):
            if k == len(self.levels):
                self.levels.append(_Level(1 << k))
            level = self.levels[k]
            # of the next level: each completed suffix of twice the length is two of this one
            after = level.first + len(level.hashes)
            level_before, first_before = level.hashes, level.first
            level.append(fresh)
            known = self.levels[k + 1].first + len(self.levels[k + 1].hashes) if k + 1 < len(self.levels) else 0
            # suffixes of this level from ``known`` on, of which the one a block later is there too
            both = np.concatenate([level_before, fresh])
            begin, end = known - first_before, after + len(fresh) - first_before - level.block
            if end > begin >= 0:
                fresh = _mixed(both[begin:end] * _A + both[begin + level.block:end + level.block])
            else:
                fresh = np.zeros(0, np.uint64)
            k += 1
        return self

    def runs(self) -> np.ndarray:
        """(start, length, period) of every run, in order of level."""
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        words = self.parts[0] if self.parts else np.zeros(0, np.int64)
        found = np.zeros((0, 3), np.int64)
        for level in self.levels:
            chains = level.chains[level._enough(level.chains)]
            if len(chains) and len(found):
                begins = chains[:, 1] * level.block
                order = np.argsort(found[:, 0], kind="stable")
                reach = np.maximum.accumulate((found[:, 0] + found[:, 1])[order])
                place = np.searchsorted(found[order, 0], begins, side="right")
                covered = np.where(place > 0, reach[np.maximum(place - 1, 0)], -1)
                chains = chains[covered < begins + chains[:, 0] + level.block]
            rows: dict[tuple[int, int], int] = {}
            for period, first, last in chains.tolist():
                low = max(0, first * level.block - level.block + 1)
                high = min(len(words) - period, (last + 2) * level.block - 1)
                same = np.concatenate([[False], words[low:high] == words[low + period:high + period], [False]])
                edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2) + low
                for begin, end in edges.tolist():
                    if end - begin + period >= max(LEAST_WORDS, LEAST_PERIODS * period):
                        rows[begin, period] = end - begin + period
            if rows:
                found = np.concatenate([found, np.array([(b, n, q) for (b, q), n in rows.items()], np.int64)])
        return found


def batch_runs(words: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The runs (start, length, period) of each text of a batch, by start, then period; starts count from the text's first word.

    The texts are one text with a word of its own between two of them, so no square reaches over.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    begins = offsets[:-1] + np.arange(n)
    joined = np.empty(len(words) + n, np.int64)
    joined[begins + lengths] = (words.max(initial=0) + 1) + np.arange(n)
    joined[np.repeat(np.arange(n), lengths) + np.arange(len(words))] = words
    found = SquareCatcher().append(joined, int(lengths.max(initial=0))).runs()
    of = np.searchsorted(begins, found[:, 0], side="right") - 1
    order = np.lexsort((found[:, 2], found[:, 0]))
    found, of = found[order], of[order]
    found[:, 0] -= begins[of]
    edges = np.searchsorted(of, np.arange(n + 1))
    return [found[edges[i]:edges[i + 1]] for i in range(n)]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Flags of the words that a run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of the periodic variant of a text of n words, or None where it stays as it is:
    texts whose h = crc32(doc_id) is a multiple of ten repeat, from word a on, their next p words."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _digest(docs: DataFrame, plant: bool, collapse: bool) -> DataFrame:
    kinds = [("n_runs", T.LongType()), *((c, T.LongType()) for c in ("start", "length", "period", "exponent_milli"))]
    kinds += [("collapsed", T.StringType()), ("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])))] if collapse else [
        ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType())]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, t) for c, t in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            split = ByteWords(batch.column("text"), BLANK_BYTES)
            words, dictionary = split.coded()
            if plant:
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    low, high = split.offsets[i], split.offsets[i + 1]
                    at = planted(doc_id, int(high - low))
                    if at is not None:
                        words[low:high] = words[low:high][at]
            found = batch_runs(words, split.offsets)
            columns: list[list] = [[] for _ in kinds]
            for i, runs in enumerate(found):
                own = words[split.offsets[i]:split.offsets[i + 1]]
                kept = own[~dropped(runs, len(own))] if len(runs) else own
                collapsed = " ".join(dictionary.take(pa.array(kept)).to_pylist()).encode()
                best = max(runs.tolist(), key=lambda r: (r[1], -r[0], -r[2])) if len(runs) else (None, None, None)
                values = [len(runs), *best, 1000 * best[1] // best[2] if len(runs) else None]
                if collapse:
                    values += [collapsed.decode(), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()]]
                else:
                    said = "".join("%d,%d,%d\n" % tuple(r) for r in runs.tolist())
                    values += [hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()]
                for column, value in zip(columns, values):
                    column.append(value)
            fields = pa.schema([(name, _arrow(kind)) for name, kind in kinds])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, fields))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    return pa.string() if isinstance(kind, T.StringType) else pa.int64()


def collapse_runs(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): n_runs, the longest run (start, length, period, exponent_milli), the text without what
    its runs repeat (``collapsed``, words joined by one space) and all runs (start, length, period) by start, then period.

    Starts are word numbers from 0. Of runs of equal length the first, then that of the smallest period is the longest;
    without runs its four columns are null and the words of the text stay. A null, empty or blank text has no words, no
    runs and an empty collapsed text. Texts may be of any length: memory is in proportion to the words of a batch, and a long
    text is a batch of its own. Repeated rows and rows without a doc_id are a document each, no documents give no rows,
    and other columns are ignored.
    """
    return _digest(docs, plant=False, collapse=True)


def digest(docs: DataFrame, plant: bool = True) -> DataFrame:
    """As ``collapse_runs``, with sha256 digests in place of the runs (a line ``start,length,period`` each) and of the
    collapsed text; with ``plant`` each tenth text is first made periodic (see ``planted``; texts without a doc_id stay)."""
    return _digest(docs, plant=plant, collapse=False)
