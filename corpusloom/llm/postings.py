"""Passages of one table found in the texts of another by a distributed positional inverted index.

The training texts are read once; what is kept of them are postings (word, text, position), and
what the test passages share with them is found by joins of postings alone.

1. Words of the passages, by length of their windows, set bits of fixed bitmaps (``BITS`` each).
   A place of a text can be part of a window of L words only if L flagged words stand there in a row; postings of
   such places are stored, in parts of ``PART`` postings. Bits that words share make more postings, never fewer.
2. Copies are one text: texts go by a hash of 128 bits, and a row finds its answer by that.
3. Counted postings give the rarest two words of each window. Their lists, each moved back by the
   word's offset in the passage, are intersected: what they share are candidates (text, passage, place).
4. The lists of all words of the passage are intersected at the candidates, and offsets that
   stand in a row there, as many as a window has, are a match. With ``slop`` a word may stand that many places off, with the rarest
   word of its window on its place: a proximity match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import ByteWords, bounded, byte_classes, stage

WIDTH = 10
#: Bits of a bitmap, and postings of a stored part.
BITS, PART = 1 << 23, 1 << 12
#: Words are runs of a-z, 0-9 and all beyond ASCII, after A-Z is lower-cased.
GAPS = byte_classes(bytes(b for b in range(128) if not chr(b).islower() and not chr(b).isdigit()))
_BLOCK = 8 * 4096  # bits of a bitmap that Spark aggregates


def _hashes(dictionary: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in dictionary.to_pylist()), np.uint64, len(dictionary))


def _key(data: bytes) -> tuple[int, int]:
    """128 bits as two signed numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), np.int64).tolist())


def passages(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, p1, p2, size, words) of items (item_id, text) that have words: the key of the words, the length of a window, hashed words."""
    schema = T.StructType([items.schema["item_id"], *T.StructType.fromDDL("p1 long, p2 long, size int, words array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            split = ByteWords(batch.column("text"), GAPS, lower=True)
            index, dictionary = split.coded()
            words = _hashes(dictionary).view(np.int64)[index]
            at = np.flatnonzero(np.diff(split.offsets))
            keys = [_key(words[split.offsets[i]:split.offsets[i + 1]].tobytes()) for i in at]
            yield pa.RecordBatch.from_arrays([
                batch.column("item_id").take(pa.array(at)), *(pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)),
                pa.array(np.minimum(np.diff(split.offsets)[at], width), pa.int32()),
                pa.ListArray.from_arrays(pa.array(split.offsets[np.append(at, len(split.offsets) - 1)], pa.int32()), pa.array(words)),
            ], names=schema.names)

    return items.select("item_id", "text").mapInArrow(run, schema)


def word_bits(words: DataFrame, n_bits: int = BITS) -> dict[int, bytes]:
    """By ``size``, a packed bitmap of the hashed ``word`` s: ``n_bits`` (a power of two) bits a size, whatever the number of words."""
    bit = F.pmod("word", F.lit(n_bits)) + 1
    blocks = words.select("size", F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("bit")).groupBy("size", "block").agg(
        F.bitmap_construct_agg("bit").alias("bits"))
    maps: dict[int, bytearray] = {}
    for row in blocks.collect():
        at = (row["block"] - 1) * _BLOCK // 8
        maps.setdefault(row["size"], bytearray(max(n_bits, _BLOCK) // 8))[at:at + _BLOCK // 8] = row["bits"]
    return {size: bytes(bits[:n_bits // 8]) for size, bits in maps.items()}


def in_rows(flags: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """The flags that stand in a row of ``least`` or more within their text."""
    edges = np.zeros(len(flags) + 1, bool)
    edges[offsets] = True
    begins = flags & (np.concatenate([[True], ~flags[:-1]]) | edges[:-1])
    stops = flags & (np.concatenate([~flags[1:], [True]]) | edges[1:]) if len(flags) else flags
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = ends - starts >= least
    steps = np.zeros(len(flags) + 1, np.int64)
    np.add.at(steps, starts[long], 1)
    np.add.at(steps, ends[long], -1)
    return np.cumsum(steps[:-1]) > 0


def store(docs: DataFrame, bits: dict[int, bytes] | None = None) -> DataFrame:
    """Postings of docs (doc_id, text), staged: (doc_id, n_words, k1, k2, part, words, places).

    Part -1 is the row itself, its number of words and its key; the other parts hold the
    hashed words and their places, of all words or of those that a window of flagged words can hold.
    """
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_words long, k1 long, k2 long, part int, words array<long>, places array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags_of = None if bits is None else {size: np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little").view(bool) for size, b in bits.items()}
        for batch in bounded(batches, "text"):
            split = ByteWords(batch.column("text"), GAPS, lower=True)
            index, dictionary = split.coded()
            distinct, offsets = _hashes(dictionary), split.offsets
            keep = np.ones(len(index), bool) if flags_of is None else np.zeros(len(index), bool)
            for size, flags in (flags_of or {}).items():
                flagged = flags[(distinct % np.uint64(len(flags))).astype(np.int64)]
                keep |= in_rows(flagged[index], offsets, size)
            kept = np.flatnonzero(keep)
            hashed = distinct[index[kept]].view(np.int64)
            edges = np.searchsorted(kept, offsets)
            counts = np.diff(edges)
            # a row per text, then its parts
            parts = -(-counts // PART)
            rows = np.repeat(np.arange(len(offsets) - 1), 1 + parts)
            first = np.cumsum(1 + parts) - 1 - parts
            part = np.arange(len(rows)) - first[rows] - 1
            bounds = np.concatenate([np.where(part < 0, edges[:-1][rows], edges[:-1][rows] + part * PART), edges[-1:]]).astype(np.int32)
            keys = [_key(t.as_buffer() if t.is_valid else b"") for t in batch.column("text")]
            lists = [pa.ListArray.from_arrays(pa.array(bounds), values) for values in (
                pa.array(hashed), pa.array((kept - np.repeat(offsets[:-1], counts)).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(rows)), pa.array(np.diff(offsets)[rows], pa.int64()),
                *(pa.array(np.array([k[j] for k in keys], np.int64)[rows]) for j in (0, 1)), pa.array(part, pa.int32()), *lists,
            ], names=schema.names)

    return stage(docs.select("doc_id", "text").mapInArrow(run, schema), "stored-postings")


def postings(stored: DataFrame) -> DataFrame:
    """(word, k1, k2, place) of every different text, staged."""
    parts = stored.where("part >= 0").select("k1", "k2", "part", "words", "places").dropDuplicates(["k1", "k2", "part"])
    flat = parts.select("k1", "k2", F.explode(F.arrays_zip("words", "places")).alias("at"))
    return stage(flat.select(F.col("at.words").alias("word"), "k1", "k2", F.col("at.places").alias("place")), "postings")


def anchors(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(p1, p2, offset, word, offset2, word2): the rarest two words of every window all words of which are in the postings.

    ``words`` is (p1, p2, size, n, offset, word). A window of one word has that word twice.
    """
    known = words.join(counts, "word", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    # windows have WIDTH words or are whole passages of fewer, which reach no further
    held = []
    for size in [r["size"] for r in words.select("size").distinct().collect()]:  # WIDTH sizes at most
        over = Window.partitionBy("p1", "p2").orderBy("offset").rowsBetween(0, size - 1)
        rare = F.sort_array(F.collect_list(F.struct("seen", "word", "offset")).over(over))
        held.append(known.where(F.col("size") == size).select("p1", "p2", rare.alias("rare")).where(F.size("rare") == size).select(
            "p1", "p2", F.col("rare")[0].alias("a"), F.col("rare")[min(1, size - 1)].alias("b")))
    whole = held[0]
    for more in held[1:]:
        whole = whole.unionByName(more)
    return whole.where("a.seen > 0").select(
        "p1", "p2", F.col("a.offset").alias("offset"), F.col("a.word").alias("word"), F.col("b.offset").alias("offset2"), F.col("b.word").alias("word2")).distinct()


def matches(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """(k1, k2, p1, p2, item_word, n_words, first, last): windows of phrases that the texts of an index hold.

    ``index`` is (word, k1, k2, place), ``phrases`` (p1, p2, size, words) without repeats. A match
    is a longest row of ``n_words`` words of a passage from its word ``item_word`` on, a window or more, that
    stands at the places ``first`` to ``last`` of the text; with ``slop`` each word may be that
    many places off where the rarest word of a window puts it. Empty tables give no rows.
    """
    spread = phrases.select("p1", "p2", "size", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word"))
    words = stage(spread, "passage-words")
    if not words.take(1):
        return index.sparkSession.createDataFrame([], "k1 long, k2 long, p1 long, p2 long, item_word int, n_words long, first int, last int")
    counts = index.groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    rare = stage(anchors(words, counts), "rarest-words")
    off = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    moved = index.join(rare, "word").select("k1", "k2", "p1", "p2", (F.col("place") - F.col("offset")).alias("at"), F.col("word2").alias("word"), "offset2")
    moved = moved.select("*", off.alias("off")).withColumn("place", F.col("at") + F.col("offset2") + F.col("off"))
    candidates = stage(moved.join(index, ["k1", "k2", "word", "place"], "left_semi").select("k1", "k2", "p1", "p2", "at").distinct(), "phrase-candidates")
    asked = candidates.join(words, ["p1", "p2"]).select("*", off.alias("off")).withColumn("place", F.col("at") + F.col("offset") + F.col("off")).where("place >= 0")
    by_place = ["k1", "k2", "p1", "p2", "at"]
    held = asked.join(index, ["k1", "k2", "word", "place"]).groupBy(*by_place, "size", "offset").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    island = F.col("offset") - F.row_number().over(Window.partitionBy(*by_place).orderBy("offset"))
    rows = held.withColumn("island", island).groupBy(*by_place, "size", "island").agg(
        F.min("offset").alias("item_word"), F.count(F.lit(1)).alias("n_words"), F.min("low").alias("first"), F.max("high").alias("last"))
    return rows.where(F.col("n_words") >= F.col("size")).select("k1", "k2", "p1", "p2", "item_word", "n_words", "first", "last")


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0, n_bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of docs (doc_id, n_words, k1, k2), the passages (item_id, p1, p2) and the matches between them."""
    said = stage(passages(items, width), "passages")
    phrases = said.select("p1", "p2", "size", "words").dropDuplicates(["p1", "p2"])
    # within the slop any word may stand at a place, so all flagged places are stored
    bits = word_bits(said.select(F.col("size") if not slop else F.lit(1).alias("size"), F.explode("words").alias("word")), n_bits)
    stored = store(docs, bits)
    index = postings(stored)
    rows = stored.where("part < 0").select("doc_id", "n_words", "k1", "k2")
    return rows, said.select("item_id", "p1", "p2").distinct(), matches(index, phrases, slop)


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0, n_bits: int = BITS) -> DataFrame:
    """(doc_id, item_id, item_word, n_words, first, last) of every exact (``slop`` 0) or proximity match.

    Passages of fewer than ``width`` words, but not none, are one window. Repeated rows of
    docs and items match each; rows without ids match with a null id; texts without words match nothing.
    """
    rows, said, found = find(docs, items, width, slop, n_bits)
    return rows.drop("n_words").join(found, ["k1", "k2"]).join(said, ["p1", "p2"]).select("doc_id", "item_id", "item_word", "n_words", "first", "last")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, n_bits: int = BITS) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_hit (words inside any occurrence of a window of items (item_id, text)),
    n_items and item_ids (items with such windows, as strings in order), contaminated (any word hit).

    Null, empty and wordless texts have no words; items without words have no windows, items without an
    item_id hit words but are not counted, ids that several items share count once. Texts and items may be
    of any length. Repeated rows and rows without a doc_id are answered each; no documents give no
    rows, no items hit nothing; other columns are ignored.
    """
    rows, said, found = find(docs, items, width, n_bits=n_bits)
    found = stage(found, "phrase-matches")
    # union of the places hit
    spans = found.select("k1", "k2", "first", (F.col("last") + 1).alias("stop")).distinct()
    before = F.max("stop").over(Window.partitionBy("k1", "k2").orderBy("first", "stop").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("first", F.coalesce(before, F.lit(0))))
    hit = spans.select("k1", "k2", new.alias("new")).groupBy("k1", "k2").agg(F.sum("new").alias("n_hit"))
    named = found.select("k1", "k2", "p1", "p2").distinct().join(said.where("item_id is not null"), ["p1", "p2"])
    named = named.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    answers = stage(hit.join(named, ["k1", "k2"], "left"), "phrase-answers")
    none = F.array().cast("array<string>")
    return rows.join(answers, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
