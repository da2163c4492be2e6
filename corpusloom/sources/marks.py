"""High-water marks: what a consumer has processed, committed after success."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schema import MARK


def marks(log: DataFrame) -> DataFrame:
    """The current mark of every consumer: the last one committed."""
    return log.groupBy("name").agg(F.max_by("ts", F.struct("committed_at", "ts")).alias("ts"))


def get_mark(spark: SparkSession, path: str, name: str, default: int = 0) -> int:
    """Epoch seconds of the consumer's mark, ``default`` before its first run."""
    try:
        log = spark.read.schema(MARK).parquet(path)
        row = marks(log.where(F.col("name") == name)).first()
    except Exception as error:  # no log yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        row = None
    return row["ts"] if row else default


def set_mark(spark: SparkSession, path: str, name: str, ts: int) -> None:
    """Commit a mark. Marks are appended, so a failed write never loses the former one."""
    row = [(name, int(ts), time.time_ns())]
    spark.createDataFrame(row, MARK).coalesce(1).write.mode("append").parquet(path)


def run_stamp() -> int:
    """Epoch seconds of the start of a run; take it once and pass it on."""
    return int(time.time())
