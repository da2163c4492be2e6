"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are cut into pieces as the pattern of the rank files does::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

but without a regular expression. All texts of a batch become one array of code points, a
table turns these into symbols (classes with what the pattern looks ahead for), and a small
automaton over the symbols says where pieces start. Its transition functions form a finite
monoid, so running it is an associative scan of table look-ups: blocks of the array are
scanned side by side, their totals are scanned by doubling, and every block then starts in
its true state. A text's first code point carries a symbol of its own that forgets the state.

The slices go through a dictionary per batch and a bounded cache per worker to the pair
merging; each distinct piece is merged once. Byte offsets of all tokens are kept, so any run
of tokens can be decoded to its place in the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import bounded, ranges

#: Symbols: letter, number, other, apostrophe before a suffix of one or two letters, white space that more follows
#: or that ends the text, and the last white space before something else: a space, or another.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, BLANK, LAST_SPACE, LAST_BLANK = range(8)
#: States: within a piece of a class, within white space, after a joining space, after a closed piece, before
#: the one letter or the two letters of a suffix.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, CLOSED, ONE_LEFT, TWO_LEFT = range(8)

# the suffixes of the pattern, fixed values
SUFFIXES1 = ("s", "t", "m", "d")
SUFFIXES2 = ("re", "ve", "ll")

BLOCK = 256
CACHE_SIZE = 200_000
LONG_PIECE = 64
BATCH_BYTES = 3 << 20


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this symbol."""
    if symbol == LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return CLOSED, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol in (OTHER, QUOTE1, QUOTE2):
        joined = state in (IN_OTHERS, AFTER_SPACE)
        if symbol == OTHER or joined:
            return IN_OTHERS, not joined
        return (ONE_LEFT if symbol == QUOTE1 else TWO_LEFT), True
    if symbol == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_SPACE if symbol == LAST_SPACE else CLOSED), True


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, ...]:
    """Tables: element after element and symbol, product of elements, state after element and state, start by state and
    symbol, and the elements of the symbols. Symbols 8 to 15 are 0 to 7 at the start of a text."""
    after = [[_step(q, s)[0] for q in range(8)] for s in range(8)]
    after += [[_step(CLOSED, s)[0]] * 8 for s in range(8)]
    starts = [[_step(q, s)[1] for s in range(8)] + [True] * 8 for q in range(8)]
    identity = tuple(range(8))
    elements, index = [identity], {identity: 0}
    for f in elements:  # grows until closed
        for g in after:
            h = tuple(g[q] for q in f)
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
    step = [[index[tuple(g[q] for q in f)] for g in after] for f in elements]
    product = [[index[tuple(g[q] for q in f)] for g in elements] for f in elements]
    kind = np.uint8 if len(elements) <= 256 else np.uint16
    return (np.array(step, kind).ravel(), np.array(product, kind), np.array(elements, np.uint8).ravel(), np.array(starts, bool).ravel(),
            np.array([index[tuple(g)] for g in after], kind))


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    # the white space of Unicode, fixed values
    blanks = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
    table[list(blanks)] = LAST_BLANK
    table[0x20] = LAST_SPACE
    return table


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of concatenated texts that end (exclusively) at the strictly rising ``ends``."""
    symbols = np.take(_classes(), points)
    blank = symbols >= LAST_SPACE
    more = np.empty_like(blank)
    more[:-1] = blank[1:]
    more[ends - 1] = True  # white space at the end of a text stays together
    symbols[blank & more] = BLANK
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        left = ends[np.searchsorted(ends, at, side="right")] - at
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        short = (left > 1) & np.isin(one, [ord(c) for c in SUFFIXES1])
        long = (left > 2) & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in SUFFIXES2])
        symbols[at[short]], symbols[at[long]] = QUOTE1, QUOTE2
    symbols[np.concatenate([[0], ends[:-1]])] += 8
    return symbols


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indices of the code points at which pieces start."""
    if not len(points):
        return np.zeros(0, np.int64)
    step, product, apply, starts, of_symbol = _automaton()
    symbols, n = _symbols(points, ends), len(points)
    n_blocks = -(-n // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(n_blocks, BLOCK).T)  # a block is a column
    seen = np.empty((BLOCK, n_blocks), step.dtype)
    seen[0] = of_symbol[columns[0]]
    for i in range(1, BLOCK):
        np.take(step, seen[i - 1].astype(np.intp) * 16 + columns[i], out=seen[i])
    # inclusive scan of the block totals by doubling
    totals, reach = seen[-1].copy(), 1
    while reach < n_blocks:
        totals[reach:] = product[totals[:-reach], totals[reach:]]
        reach *= 2
    enter = np.full(n_blocks, CLOSED, np.intp)
    enter[1:] = apply[totals[:-1].astype(np.intp) * 8 + CLOSED]
    flags = np.empty((BLOCK, n_blocks), bool)
    state = enter.astype(np.uint8)  # row by row, so that no array of wide indices is made
    for i in range(BLOCK):
        np.take(starts, state * np.uint8(16) + columns[i], out=flags[i])
        np.take(apply, seen[i].astype(np.intp) * 8 + enter, out=state)
    return np.flatnonzero(np.ascontiguousarray(flags.T).ravel()[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: the adjacent pair of the lowest rank is merged first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > LONG_PIECE:
        return _merge_long(piece, ranks)
    none = len(ranks)
    cuts = list(range(len(piece) + 1))
    pairs = [ranks.get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(piece[cuts[i]:cuts[i + 2]], none)
        if i:
            pairs[i - 1] = ranks.get(piece[cuts[i - 1]:cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, for pieces of any length."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [ranks.get(piece[i:i + 2]) if i + 1 < n else None for i in range(n)]
    heap = [(r, i) for i, r in enumerate(rank) if r is not None]
    heapq.heapify(heap)

    def renew(i: int) -> None:
        j = after[i]
        rank[i] = ranks.get(piece[i:after[j]]) if j < n else None
        if rank[i] is not None:
            heapq.heappush(heap, (rank[i], i))

    while heap:
        r, i = heapq.heappop(heap)
        if rank[i] != r:
            continue  # one of the two has been merged since
        gone = after[i]
        after[i], rank[gone] = after[gone], None
        if after[i] < n:
            before[after[i]] = i
        renew(i)
        if before[i] >= 0:
            renew(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class Coder:
    """Encodes and decodes batches of texts by a rank file (lines of base64 token and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and offsets: text i has ``ids[offsets[i]:offsets[i + 1]]``. Null texts are empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = bytes(whole[int(edges[0]):int(edges[-1])]) if whole is not None else b""
        edges = edges - edges[0]
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # the byte at which each code point starts
        point_edges = np.searchsorted(lead, edges)
        starts = piece_starts(points, np.unique(point_edges[1:][point_edges[1:] > 0]))
        cuts = np.append(lead[starts], len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        if len(self.cache) > CACHE_SIZE:
            self.cache.clear()
        cache, ranks, merged = self.cache, self.ranks, []
        for piece in coded.dictionary.to_pylist():
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(merge(piece, ranks))
                if len(piece) <= LONG_PIECE:
                    cache[piece] = ids
            merged.append(ids)
        lengths = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter(chain.from_iterable(merged), np.int64, int(lengths.sum()))
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = lengths[which]
        ids = flat[ranges((np.cumsum(lengths) - lengths)[which], counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(starts, point_edges)]

    def ends(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each token the byte of its text at which it ends."""
        total = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        return total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and their offsets."""
        lengths = self.lengths[ids]
        return self.bytes[ranges(self.starts[ids], lengths)], np.concatenate([[0], np.cumsum(lengths)])[offsets]


@lru_cache(2)
def coder(path: str) -> Coder:
    """One per worker and file."""
    return Coder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Replaces ``text`` by ``n_tokens``, ``ids`` and ``token_ends`` (the byte of the text at which each token ends).

    Other columns stay, but for those with one of these three names. Null and empty texts have no tokens.
    """
    own = ("text", "n_tokens", "ids", "token_ends")
    kept = [c for c in docs.columns if c not in own]
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("token_ends", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in bounded(batches, "text", BATCH_BYTES):
            ids, offsets = code.encode(batch.column("text"))
            at = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [
                    pa.array(np.diff(offsets)), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(at, pa.array(code.ends(ids, offsets).astype(np.int32))),
                ], names=schema.names)

    return docs.select(*kept, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Replaces ``ids`` by ``text``; null ids give an empty text. Bytes that are no UTF-8 (ids of a cut text) become U+FFFD."""
    kept = [c for c in encoded.columns if c not in ("ids", "text")]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = pc.fill_null(part.column("ids"), [])
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
                data, cuts = code.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets)
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*kept, "ids").mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encodes whole texts, decodes the ids, and returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

    Both happen batch by batch in the workers, so ids and texts don't travel.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def hashes(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        view = memoryview(np.ascontiguousarray(data)).cast("B")
        return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in bounded(batches, "text", BATCH_BYTES):
            ids, offsets = code.encode(batch.column("text"))
            data, cuts = code.decode(ids, offsets)
            words = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(offsets)),
                hashes(words, offsets * 4) if len(words) else pa.array([hashlib.sha256(b"").hexdigest()] * batch.num_rows, pa.string()),
                hashes(data, cuts) if len(data) else pa.array([hashlib.sha256(b"").hexdigest()] * batch.num_rows, pa.string()),
            ], names=schema.names)

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
