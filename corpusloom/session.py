"""Session settings and staged intermediate tables."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` adds or overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a row of a Python batch can be a whole page of a megabyte
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        # rows in memory are larger than their compressed files, by which Spark chooses broadcasts
        "spark.sql.sources.fileCompressionFactor": "4.0",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a master of one process (``local``, ``local[n]``) may go without the setting; it then
    gets its own folder, kept in the session so that later calls find the same one. Masters
    of several machines may not name a ``file:`` folder, which each of them would have for itself.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    check_shared(spark.sparkContext.master, folder)
    if folder:
        return folder
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def check_shared(master: str, folder: str | None) -> None:
    """Refuses a staging folder that the machines of ``master`` don't share."""
    if not folder and not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if folder and folder.startswith("file:") and not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir is a local folder: {folder}")


class _OpenBlocks(threading.local):
    """The open blocks of a thread: a stream loads in one of its own."""

    def __init__(self) -> None:
        self.paths: list[list[str]] = []


_open_blocks = _OpenBlocks()


def staged_path(spark: SparkSession, name: str) -> str:
    path = f"{staging_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open_blocks.paths:
        _open_blocks.paths[-1].append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Removes what is staged within the block at its end. Results must be written by then."""
    _open_blocks.paths.append([])
    try:
        yield
    finally:
        for path in _open_blocks.paths.pop():
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within the block keep their state in RocksDB, which holds more keys than fit in memory, unless the session names another store.

    A stream takes over the setting when it starts; the session's own stays as it was.
    """
    former = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STATE_STORE, former) if former else spark.conf.unset(_STATE_STORE)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def used_once(spark: SparkSession) -> Iterator[None]:
    """What is written within the block has its shuffle files removed as soon as it is written.

    Spark else keeps them until the driver collects its garbage, which with a large heap may be after the whole job. A write
    has a plan of its own that never runs again, so nothing needs them.
    """
    former = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, former) if former else spark.conf.unset(_CLEANUP)


def write_once(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet and keep nothing that it was shuffled by."""
    with used_once(df.sparkSession):
        df.write.parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage is cut in storage that outlives any executor, work used twice is done
    once, and the optimiser sees the true file size: a join against a staged table
    is broadcast only when that size is under ``autoBroadcastJoinThreshold`` and is
    a shuffle join (skew-split by adaptive execution) otherwise.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    write_once(df, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, splits: int) -> DataFrame:
    """A table dealt out evenly over ``splits`` tasks, for work that is heavy per row on few large files.

    The number is the caller's; nothing here looks at the machine. A table of many files
    needs none of it.
    """
    return table.repartition(splits)
