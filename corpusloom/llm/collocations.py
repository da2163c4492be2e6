"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: each word with the words that lead it, up to ``LONGEST``,
padded where its piece ends. A phrase stands where a window begins with it, so the sum over all windows
that begin with a phrase is its count, and one Spark ROLLUP over the window columns gives the counts
of all phrases of all lengths, in place of one explosion per length.

Most windows of a text are like no other, and a phrase below ``least`` occurrences is asked for by nobody. So
a first pass counts hashed words and pairs of neighbouring words, and those of ``least`` or more set bits of
a fixed bitmap; a window is padded from the first word or pair without its bit on, as at the
end of a piece. A phrase of ``least`` occurrences holds frequent pairs only, and so do its
parts: their counts stay exact, whatever hashes share a bit.

Leads are taken by position from the split text, since a window function would shuffle every word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ByteWords, bounded, byte_classes, flagged, packed_bits, stage

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bits of the bitmap of frequent words and pairs.
BITS = 1 << 26
_MOST = 1 << 20  # bytes of text of a batch
_PIECE_ENDS = byte_classes(b".,;:!?\n\x0b\x0c\r")
_GAPS = _PIECE_ENDS | byte_classes(b" \t")
_UNKNOWN = "und"
_A = np.uint64(0x9E3779B97F4A7C15)
_PAD = ""


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _A
    return values ^ (values >> np.uint64(29))


class _Batch:
    """The words of a batch: numbered, hashed with their language, and whether the next word is in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        split = ByteWords(batch.column("text"), _GAPS, lower=True)
        self.index, self.words = split.coded()
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(split.offsets)).astype(np.int64)
        piece = np.cumsum(_PIECE_ENDS[split.data], dtype=np.int64)[split.starts] if len(split.starts) else np.zeros(0, np.int64)
        self.leads = np.zeros(len(piece), bool)
        self.leads[:-1] = piece[1:] == piece[:-1]
        last = split.offsets[1:][np.diff(split.offsets) > 0] - 1
        self.leads[last] = False
        of_words = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in self.words.to_pylist()), np.uint64, len(self.words))
        of_langs = np.fromiter((xxhash.xxh3_64_intdigest(x.encode(), 1) for x in self.langs), np.uint64, len(self.langs))
        hashes = of_words[self.index] + (of_langs[self.lang] if len(self.lang) else np.zeros(0, np.uint64))
        self.one, self.two = _mixed(hashes), _mixed(hashes[:-1] * _A + _mixed(hashes[1:]))


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(_UNKNOWN)).alias("lang"), "text")


def frequent_bits(docs: DataFrame, least: int = LEAST, n_bits: int = BITS) -> tuple[bytes, DataFrame]:
    """A packed bitmap with the bits of the hashed words and pairs that occur ``least`` times or more, and the number of
    words of each language (lang, n). The driver receives ``n_bits`` (a power of two), however many there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", _MOST):
            of = _Batch(batch)
            hashes, n = np.unique(np.concatenate([of.one, of.two[of.leads[:-1]]]), return_counts=True)
            words = np.bincount(of.lang, minlength=len(of.langs))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.nulls(len(hashes), pa.string()), pa.array(of.langs, pa.string())]),
                pa.concat_arrays([pa.array(hashes.view(np.int64)), pa.nulls(len(words), pa.int64())]),
                pa.array(np.concatenate([n, words]).astype(np.int64)),
            ], names=["lang", "hash", "n"])

    counted = _read(docs).mapInArrow(count, "lang string, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"))
    counted = stage(counted.where(F.col("hash").isNull() | (F.col("n") >= least)), "frequent-hashes")
    return packed_bits(counted.where("hash is not null"), "hash", n_bits), counted.where("hash is null").select("lang", "n")


def _columns(longest: int) -> list[str]:
    return [f"w{i}" for i in range(1, longest + 1)]


def windows(docs: DataFrame, bits: bytes, longest: int = LONGEST) -> DataFrame:
    """(lang, w1, ..., n): the padded longest windows of every batch that begin with a frequent word, counted."""
    columns = _columns(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(bits, np.uint8)
        for batch in bounded(batches, "text", _MOST):
            of = _Batch(batch)
            if not len(of.index):
                continue
            pad = len(of.words)
            leads = np.append(flagged(packed, of.two) & of.leads[:-1], False)
            at = np.flatnonzero(flagged(packed, of.one))
            # numbered tuples: the language and first word, then one more column at a time
            rows = np.full((len(at), longest), pad, np.int64)
            alive = np.arange(len(at))
            code = of.lang[at] * (pad + 1) + of.index[at]
            rows[:, 0] = of.index[at]
            for k in range(1, longest):
                alive = alive[leads[at[alive] + k - 1]]
                rows[alive, k] = of.index[at[alive] + k]
                # windows that end here keep their code, the others get one above all there are
                _, place = np.unique(code[alive], return_inverse=True)
                code[alive] = code.max(initial=0) + 1 + place * (pad + 1) + rows[alive, k]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            words = pa.concat_arrays([of.words, pa.array([_PAD], of.words.type)])
            yield pa.RecordBatch.from_arrays([
                pa.array(of.langs, pa.string()).take(pa.array(of.lang[at[first]])),
                *(words.take(pa.array(rows[first, k])).cast(pa.string()) for k in range(longest)), pa.array(n.astype(np.int64)),
            ], names=["lang", *columns, "n"])

    ddl = ", ".join(["lang string", *(f"{c} string" for c in columns), "n long"])
    return _read(docs).mapInArrow(run, ddl)


def phrase_counts(docs: DataFrame, bits: bytes, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words, f): every phrase of 1 to ``longest`` words within a piece that occurs ``least`` times or more."""
    columns = _columns(longest)
    counted = windows(docs, bits, longest).groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    rolled = counted.rollup("lang", *columns).agg(F.sum("n").alias("f")).where((F.col("f") >= least) & F.col("w1").isNotNull())
    # a column that is rolled up is null, a pad is the empty text: prefixes that end with a pad are no phrases
    words = F.filter(F.array(*columns), lambda w: w.isNotNull())
    return rolled.select("lang", words.alias("words"), "f").where(F.element_at("words", -1) != _PAD)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, absorbed: int = 100, n_bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` (or all) phrases of 2 to ``longest`` words of each language of docs (text, lang).

    Words are lower-cased (A-Z) and parted by spaces and tabs, pieces by ``. , ; : ! ?`` and line ends.
    a counts all occurrences of a phrase, n all words of its language. A phrase is scored by its worst cut
    into two parts of l and r occurrences, ``floor(1000 * a * n / (l * r))``, of equal ones the first. A
    phrase goes where a longer one that holds it has ``absorbed`` per cent of its occurrences or more.
    Rank is by score, then a, then phrase.

    A null lang is ``und``; null and empty texts have no words; repeated rows count each; texts may be of any length. No
    documents give no rows; other columns are ignored. Products are decimals of 38 digits.
    """
    bits, totals = frequent_bits(docs, least, n_bits)
    counts = phrase_counts(docs, bits, least, longest)
    joined = F.array_join("words", " ")
    counts = stage(counts.select("lang", joined.alias("phrase"), "words", "f"), "phrase-counts")
    found = counts.where(F.size("words") > 1)
    cuts = found.select("lang", "phrase", "words", "f", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "f", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.expr("slice(words, k + 1, size(words) - k)"), " ").alias("tail"))
    single = counts.select("lang", "phrase", "f")
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang").withColumnRenamed("f", "a")
    score = F.expr("cast(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    worst = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    inner = F.expr("filter(flatten(transform(sequence(2, size(words)), m -> transform(sequence(1, size(words) - m + 1), i -> if(m < size(words), array_join(slice(words, i, m), ' '), null)))), x -> x is not null)")
    held = found.where(F.size("words") > 2).select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = worst.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(absorbed) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
