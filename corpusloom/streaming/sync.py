"""Index sync as a stream: new articles become index documents as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.increment import DAY_COLUMN
from corpusloom.schema import ARTICLE
from corpusloom.session import stage, staging
from corpusloom.sources.index_store import load_index


def article_stream(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """New files of the article table, as they are added."""
    fields = T.StructType([*ARTICLE.fields, T.StructField(DAY_COLUMN, T.DateType())])
    return (
        spark.readStream.schema(fields)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
        .drop(DAY_COLUMN)
    )


def sync_index_stream(articles: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Load every micro-batch into the index table, then stop when no input is left.

    The checkpoint is the high-water mark, and its name is that of the writer: a micro-batch
    is written as the load of its number, so a batch repeated after a failure replaces itself,
    while a stream with another checkpoint, or any other writer, never does. Loads carry no
    topics; read the table with ``keep_topics`` to keep those loaded before.
    """
    return start_loads(articles, index_path, checkpoint)


def start_loads(rows: DataFrame, index_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """With ``once`` a micro-batch is written before it is loaded: a load reads its rows several times, and a stream with
    state would go through its state again each time."""
    writer = f"stream-{hashlib.md5(checkpoint.rstrip('/').encode()).hexdigest()}"

    def load(batch: DataFrame, number: int) -> None:
        with staging(batch.sparkSession):
            load_index(stage(batch, "micro-batch") if once else batch, index_path, writer, number)

    return (
        rows.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(load)
        .start()
    )
