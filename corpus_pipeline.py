"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents predicted toxic go; the labels of ``labels`` that aren't held out teach it.
2. line dedup: lines that an earlier line repeats or nearly repeats go, and documents that
   are nothing else.
3. near-dedup: of documents linked by fingerprints of four-word shingles that differ in four bits or
   fewer, as the operator has them, one stays, the one of the smallest doc_id.
4. mixing: documents are repeated, kept once, cut or left out so that sources meet their targets.
5. byte-level BPE: texts become ids, with the byte at which each token ends.

All stages but the last return the columns of ``documents``; a row that the mix repeats
keeps its doc_id. Null and empty texts pass the first two stages; of all texts without a word
one document stays after the third, and none after the fourth. No documents give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, lines, mixing, simhash, toxicity
from corpusloom.llm.common import stage, table

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.keep_new_text(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("byte_bpe", encode),
]
#: The classifier and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
