"""The index table: loads are kept side by side, reading settles on one row per id.

A load replaces documents by id. Rewriting a large table for each load is out of question,
so a load is one new folder, named by its writer and its number. A load that is repeated
after a failure replaces itself; loads of different writers never touch each other. Which of
two loads wins is their order of commit and not of their numbers. A removal is a load of ids. ``compact_index`` folds all
loads into one of a new table.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.schema import ARTICLE, STRINGS
from corpusloom.operators.store import latest
from corpusloom.session import stage, used_once

TOPICS = ("topics", "model_version")
LOAD = ("committed_at", "writer", "number")
ROW = T.StructType([*ARTICLE.fields, T.StructField("topics", STRINGS), T.StructField("model_version", T.StringType())])
_STORED = T.StructType([
    *ROW.fields, T.StructField("removed", T.BooleanType()), T.StructField("committed_at", T.LongType()), T.StructField("writer", T.StringType()), T.StructField("number", T.LongType()),
])


def _folder(path: str, writer: str, number: int) -> str:
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", writer):
        raise ValueError(f"not a name of a writer: {writer!r}")
    return f"{path.rstrip('/')}/writer={writer}/number={number}"


def _commit_stamp(spark: SparkSession, folder: str) -> int:
    """The time of a load's first commit: a repeated load keeps it, so it doesn't beat loads that came between."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    first = None
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")):
        first = spark.read.schema("committed_at long").parquet(folder).agg(F.min("committed_at")).first()[0]
    return first or time.time_ns()


def load_index(docs: DataFrame, path: str, writer: str, number: int) -> None:
    """Add or replace documents as load ``number`` of ``writer``; topics carry the version of their model."""
    folder, rows = _folder(path, writer, number), docs
    for field in ROW.fields[-2:]:
        if field.name not in docs.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    fresh = latest(rows.select(*ROW.names), staged=True).withColumn("committed_at", F.lit(_commit_stamp(docs.sparkSession, folder)))
    with used_once(docs.sparkSession):
        fresh.write.mode("overwrite").parquet(folder)


def remove_documents(ids: DataFrame, path: str, writer: str, number: int) -> None:
    """Remove documents by ``id`` as a load; a later load may add them again, without the topics they had."""
    folder = _folder(path, writer, number)
    stamp = F.lit(_commit_stamp(ids.sparkSession, folder)).alias("committed_at")
    ids.select("id").distinct().select(F.col("id").cast("string"), F.lit(True).alias("removed"), stamp).write.mode("overwrite").parquet(folder)


def one_load(spark: SparkSession, path: str, writer: str, number: int) -> DataFrame:
    """The documents of one load as they were written."""
    return loads(spark, path).where((F.col("writer") == writer) & (F.col("number") == number) & F.col("removed").isNull())


def loads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path)


def read_index(spark: SparkSession, path: str, keep_topics: bool = False, with_load: bool = False) -> DataFrame:
    """One row per id: that of the load committed last, unless it is a removal. With ``keep_topics`` a row without topics
    takes those, and their version, of the last load since a removal that had any. With ``with_load`` rows name their ``writer`` and ``number``.

    The loads are settled on ids and load names alone. What lost is a narrow table of the
    rows replaced, and filters the wide rows, which are not regrouped.
    """
    rows = loads(spark, path)
    this = F.struct(*LOAD)
    last = rows.groupBy("id").agg(F.max(this).alias("last"), F.count("*").alias("n")).where("n > 1").select("id", "last")
    last = stage(last, "replaced-ids")
    lost = stage(rows.select("id", this.alias("this")).join(last, "id").where(F.col("this") != F.col("last")).select("id", "this.*"), "lost-rows")
    named = LOAD[1:] if with_load else ()
    won = rows.join(lost, ["id", *LOAD], "left_anti").where("removed is null").select(*ROW.names, *named)
    if not keep_topics:
        return won
    # topics of loads that lost; ids that nothing replaced have no row here
    had = rows.where("topics is not null or removed").join(last.select("id"), "id", "left_semi").groupBy("id").agg(
        F.max(F.struct(*LOAD, *TOPICS)).alias("had")).select("id", "had")
    kept = [F.when(F.col("topics").isNull(), F.col(f"had.{c}")).otherwise(F.col(c)).alias(c) for c in TOPICS]
    return won.join(had, "id", "left").select(*ROW.names[:-2], *kept, *named)


def compact_index(spark: SparkSession, path: str, target: str) -> None:
    """All loads of ``path`` as one load of a new table at ``target``, topics kept."""
    load_index(read_index(spark, path, keep_topics=True), target, "compaction", 0)
