"""Kept postings of the index: the words of each load, written once and read by every search.

A load of the index has its postings beside it, in a folder of the same writer and number, as blocks: a row per word
and run of documents with the places of the word in each field of each document that holds it, dealt to buckets of
words. A search takes apart the blocks of the words it asks for. A row without a word has
the lengths of the fields of the run's documents, in a folder of its own. Nothing is rewritten when
documents are replaced or removed: a search takes the postings of those (id, writer, number) that the
index table has settled on, so both follow one order of commits.

A load is seen by topics at once and by words when its postings are written; a load that
fails between is repeated, and replaces both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.session import used_once

FIELDS = ("title", "abstract", "fulltext")
#: Folders a load's words are dealt to, and files of one folder at most; fixed, since folders are found by word.
BUCKETS, FILES = 64, 4
#: Words whose places are grouped at once; a longer document is beyond it alone.
WORDS = 1 << 18
BLOCK = "word string, docs array<struct<id: string, " + ", ".join(f"{f}: array<int>" for f in FIELDS) + ">>"
#: The bucket of lengths, beyond those of words.
_LENGTHS = BUCKETS
_LOAD = "writer string, number bigint"


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def runs_of_rows(words: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """``(first row, rows)`` of runs of rows with at most so many words together, or of one row."""
    first = total = 0
    for i, n in enumerate(words.tolist()):
        if i > first and total + n > most:
            yield first, i - first
            first = i
            total = 0
        total += n
    if len(words):
        yield first, len(words) - first


def _nested(values: np.ndarray, counts: np.ndarray, empty: bool) -> pa.Array:
    """Lists of so many values each; of none null, or an ``empty`` list."""
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32)), mask=None if empty else pa.array(counts == 0))


def _blocks(words: pa.Array, rows_of_word: np.ndarray, ids: pa.Array, fields: list[pa.Array]) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.cumsum(rows_of_word)]).astype(np.int32)
    docs = pa.StructArray.from_arrays([ids, *fields], names=["id", *FIELDS])
    return pa.RecordBatch.from_arrays([words, pa.ListArray.from_arrays(pa.array(bounds), docs)], names=["word", "docs"])


def posting_blocks(docs: DataFrame) -> DataFrame:
    """``(word, docs)``: of each run of documents those that hold a word, ``(id, title, abstract, fulltext)`` with its places in each
    field, from 0, null where it has none; and under the null word all of them with the lengths of their fields, in lists of one.

    Fields are split by Spark and grouped within runs of rows of a batch, so no word is shuffled.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = sum(batch.column(f).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in FIELDS)
            yield from (batch.slice(*part) for part in runs_of_rows(words, WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            parts, doc, field, place, lengths = [], [], [], [], []
            for f, name in enumerate(FIELDS):
                lists = batch.column(name)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                parts.append(lists.flatten())
                doc.append(np.repeat(np.arange(len(lists)), counts))
                field.append(np.full(counts.sum(), f, np.int8))
                place.append(np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
                lengths.append(_nested(counts, np.ones(len(counts), int), True))
            yield _blocks(pa.array([None], pa.string()), np.array([batch.num_rows]), batch.column("id"), lengths)
            coded = pa.concat_arrays(parts).dictionary_encode()
            word, doc, field, place = coded.indices.to_numpy(zero_copy_only=False), *(np.concatenate(x) for x in (doc, field, place))
            of = word.astype(np.int64) * batch.num_rows + doc
            order = np.argsort(of, kind="stable")  # fields and places are in order already
            of, doc, field, place = (x[order] for x in (of, doc, field, place))
            new = np.ones(len(of), bool)
            new[1:] = of[1:] != of[:-1]
            first, row = np.flatnonzero(new), np.cumsum(new) - 1
            columns = []
            for f in range(len(FIELDS)):
                mine = field == f
                columns.append(_nested(place[mine], np.bincount(row[mine], minlength=len(first)), False))
            held = np.bincount(of[first] // batch.num_rows, minlength=len(coded.dictionary))
            yield _blocks(coded.dictionary, held, batch.column("id").take(pa.array(doc[first])), columns)

    return docs.select("id", *[tokens(F.col(f)).alias(f) for f in FIELDS]).mapInArrow(run, BLOCK)


def of_documents(blocks: DataFrame) -> DataFrame:
    """Blocks as a row per word and document: ``(id, word, title, abstract, fulltext)`` and what else a block has."""
    return blocks.select(F.inline("docs"), *[c for c in blocks.columns if c != "docs"]).select("id", "word", *FIELDS, *[c for c in blocks.columns if c not in ("word", "docs")])


def token_postings(docs: DataFrame) -> DataFrame:
    """``(id, word, title, abstract, fulltext)``: the places of every word in each field of a document, from 0, null where it has none."""
    return of_documents(posting_blocks(docs).where("word is not null"))


def _lengths(blocks: DataFrame) -> DataFrame:
    rows = of_documents(blocks.where("word is null"))
    return rows.select("id", *[F.col(f)[0].alias(f) for f in FIELDS], *[c for c in rows.columns if c not in ("id", "word", *FIELDS)])


def field_lengths(docs: DataFrame) -> DataFrame:
    """``(id, title, abstract, fulltext)``: the number of words of each field; 0 where it is missing."""
    return _lengths(posting_blocks(docs))


def add_postings(docs: DataFrame, path: str, writer: str, number: int) -> None:
    """Keep the postings of the documents of an index load; a repeated load replaces its own."""
    rows = posting_blocks(docs).withColumn("bucket", F.when(F.col("word").isNull(), _LENGTHS).otherwise(bucket_of(F.col("word"))))
    # by the number alone, which Spark sorts without comparing rows
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(F.col("docs")[0]["id"]), F.lit(FILES))).sortWithinPartitions("bucket")
    with used_once(docs.sparkSession):
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/blocks/writer={writer}/number={number}")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all loads, with ``writer``, ``number`` and ``bucket``."""
    return spark.read.schema(f"{BLOCK}, {_LOAD}, bucket int").parquet(f"{path.rstrip('/')}/blocks")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """The lengths of all loads, with ``writer`` and ``number``."""
    return _lengths(read_postings(spark, path).where(F.col("bucket") == _LENGTHS).drop("bucket"))


def of_words(kept: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The postings of the words of ``vocabulary``: only their buckets' folders are read, and only their blocks are taken apart."""
    wanted = vocabulary.select("word").distinct().withColumn("bucket", bucket_of(F.col("word")))
    buckets = [row["bucket"] for row in wanted.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    return of_documents(kept.where(F.col("bucket").isin(buckets)).join(wanted, ["bucket", "word"]))


def settled(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of the loads that the index has settled on; ``winners`` is ``(id, writer, number, ...)``."""
    return rows.join(winners.select("id", "writer", "number"), ["id", "writer", "number"], "left_semi")
