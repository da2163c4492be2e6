"""Words, bounded batches and staged tables shared by the operators of this subpackage.

A word is a run of characters other than ASCII white space (``[^\\x20\\x09-\\x0D]+``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import stage

__all__ = ["BLANKS", "count_words", "words_of", "stage", "table", "bounded", "split_words", "per_text", "ranges", "byte_classes", "BLANK_BYTES", "ByteWords",
           "packed_bits", "flagged", "free_names"]

BLANKS = "[\\x20\\x09-\\x0D]+"
_BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text, as a Spark expression; null and blank texts have none."""
    inner = F.btrim(text, F.lit(_BLANK_CHARS))
    return F.when(inner.isNull() | (inner == ""), F.array().cast("array<string>")).otherwise(F.split(inner, BLANKS))


def count_words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_BLANK_CHARS))
    return F.when(inner.isNull() | (inner == ""), F.lit(0)).otherwise(F.size(F.split(inner, BLANKS))).cast("long")


def bounded(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of about ``most`` bytes of text; a single longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            pa.default_memory_pool().release_unused()  # a worker lives on after its task
            start = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and offsets: the words of text i are ``words[offsets[i]:offsets[i + 1]]``."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    edges = np.concatenate([[0], np.cumsum(counts)])
    return words.filter(real), kept[edges]


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets; 0 for a text without values."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[0] .. starts[0] + lengths[0] - 1, starts[1] ..`` in one array."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) - np.repeat(ends - lengths - starts, lengths)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_classes(members: bytes) -> np.ndarray:
    """256 flags: the bytes that are in ``members``."""
    flags = np.zeros(256, bool)
    flags[np.frombuffer(members, np.uint8)] = True
    return flags


#: the bytes that are no part of a word of this subpackage: ASCII white space
BLANK_BYTES = byte_classes(_BLANK_CHARS.encode())


class ByteWords:
    """The words of a batch of texts, cut where a byte is flagged in ``gaps``; null texts have none.

    ``words`` holds all words in order, ``offsets[i]:offsets[i + 1]`` are those of text i and
    ``data`` the bytes of all texts, lower-cased (A-Z only) if asked. Bytes from 0x80 on are never gaps, so characters stay whole.
    """

    def __init__(self, texts: pa.Array, gaps: np.ndarray = BLANK_BYTES, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[edges[0]:edges[-1]] if raw is not None and len(edges) and edges[-1] > edges[0] else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        self.data = _LOWER[data] if lower else data
        inside = ~gaps[self.data]
        first = np.zeros(len(data) + 1, bool)  # whether a text begins at this byte
        first[edges] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends[:-1] &= ~inside[1:] | first[1:-1]
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        at = np.concatenate([[0], np.cumsum(self.stops - self.starts)])
        self.words = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(at), pa.py_buffer(self.data[inside]))
        self.offsets = np.searchsorted(self.starts, edges)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number per word, and the distinct words by number."""
        coded = self.words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


_BIT_BLOCK = 8 * 4096  # bits of a bitmap that Spark aggregates


def packed_bits(hashes: DataFrame, column: str, n_bits: int) -> bytes:
    """A bitmap of ``n_bits`` (a power of two) with the bits of the long ``column`` set: so many bits reach the driver, however many rows there are."""
    bit = F.pmod(column, F.lit(n_bits)) + 1
    blocks = hashes.select(F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("bit")).groupBy("block").agg(
        F.bitmap_construct_agg("bit").alias("bits"))
    bits = bytearray(max(n_bits, _BIT_BLOCK) // 8)
    for row in blocks.toLocalIterator():
        at = (row["block"] - 1) * _BIT_BLOCK // 8
        bits[at:at + _BIT_BLOCK // 8] = row["bits"]
    return bytes(bits[:n_bits // 8])


def flagged(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of unsigned hashes are set; false only if a hash isn't among those of ``packed_bits``."""
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).view(bool)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column has it."""
    taken, names = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names
