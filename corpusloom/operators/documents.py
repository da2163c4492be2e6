"""Index documents: shape, enrich with topics, flatten, number in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.schema import INDEX_FIELDS

# Fixed value: documents per upload file.
BATCH_SIZE = 4001

BUCKET_DIGITS = 4


def index_documents(articles: DataFrame, with_topics: bool = False) -> DataFrame:
    """``{id, type: add, fields: {...}}``; absent optionals are NULL fields."""
    names = INDEX_FIELDS + (("topics",) if with_topics else ())
    return articles.select("id", F.lit("add").alias("type"), F.struct(*names).alias("fields"))


def enrich(articles: DataFrame, bags: DataFrame, how: str = "inner") -> DataFrame:
    """Articles with the topics of their bag. With ``inner`` an article without a strong
    topic is left out, with ``left`` it keeps NULL topics."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    return articles.join(bags.select("id", "topics"), "id", how)


def topic_bag_documents(bags: DataFrame) -> DataFrame:
    """Bags in their nested JSON shape."""
    return bags.select("id", F.struct("topics").alias("fields"))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested columns as flat ones named by their path."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    return df.select(*[
        F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, ())
    ])


def unflatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Columns named by a path as nested structs again."""

    def build(tree: dict) -> list[Column]:
        return [
            F.struct(*build(node)).alias(name) if isinstance(node, dict) else F.col(f"`{node}`").alias(name)
            for name, node in tree.items()
        ]

    tree: dict = {}
    for column in df.columns:
        *parents, leaf = column.split(sep)
        node = tree
        for parent in parents:
            node = node.setdefault(parent, {})
        node[leaf] = column
    return df.select(*build(tree))


def document_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; NULL fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def positions(docs: DataFrame, key: str, name: str) -> DataFrame:
    """``docs`` with a gapless number from 0 in column ``name``.

    ``key`` must be unique. Rows are numbered in the order of (hash of key, key). The
    leading hash digits cut that order into a fixed number of even buckets, so numbering
    within a bucket is a bounded window, and the rows before a bucket come from one count
    per bucket.
    """
    digest = F.md5(F.col(key).cast("string"))
    placed = docs.withColumn("_digest", digest).withColumn("_bucket", F.left("_digest", F.lit(BUCKET_DIGITS)))
    counts = docs.select(F.left(digest, F.lit(BUCKET_DIGITS)).alias("_bucket")).groupBy("_bucket").count()
    # 16 ** BUCKET_DIGITS rows at most, whatever the table holds
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_bucket").orderBy("_digest", key)
    position = F.col("_start") + F.row_number().over(within) - 1
    return placed.join(F.broadcast(starts), "_bucket").select(*docs.columns, position.cast("bigint").alias(name))


def batch_numbers(docs: DataFrame, key: str = "id", size: int = BATCH_SIZE) -> DataFrame:
    """``docs`` with a batch number; every batch but the last has exactly ``size`` rows (see ``positions``)."""
    placed = positions(docs, key, "batch")
    return placed.withColumn("batch", F.floor(F.col("batch") / size).cast("bigint"))


def batch_counts(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("batch").agg(F.count("*").alias("n_documents"))
