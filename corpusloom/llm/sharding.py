"""Sharding by sampled splitters: shards of near equal bytes over ranges of a text key.

1. A narrow table (id, size, key, row number) is written once; the key is a hash of the text,
   so equal texts are neighbours.
2. Keys are sampled with a chance in proportion to their bytes and their weighted quantiles
   are the splitters of many more ranges than shards. The sample is bounded by a parameter
   and aggregated by key, so a text with millions of copies is one row of it.
3. A key that fills ranges by itself gets a run of ranges, dealt by row number; ranges that turn out
   overfull are subdivided into equal parts of their key interval.
4. The exact bytes before each range and a running sum within it place every row on the byte
   line, which is cut into equal shards. A group of equal texts lies where it begins, so it
   stays in one shard, unless it is so large that it has ranges of its own: then it is cut.
5. Slots count the rows of a shard without gaps.

Windows run within ranges, never over a shard or a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stage

SHARDS = 24
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 16
SEED = 23


def _splitters(rows: DataFrame, n_ranges: int, samples: int, total: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys at which ranges start, and into how many each is dealt (1 unless one key fills it).

    About ``samples`` keys come to the driver, whatever the number of rows.
    """
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(samples / total))
    drawn = (F.pmod(F.xxhash64("row", "key", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)) < chance
    sample = rows.where(drawn).groupBy("key").agg(F.sum(F.col("size") / chance).alias("weight")).toPandas().sort_values("key")
    keys, upto = sample["key"].to_numpy(), np.cumsum(sample["weight"].to_numpy())
    if not len(keys):
        return np.zeros(0, np.int64), np.ones(1, np.int64)
    wanted = upto[-1] * np.arange(1, n_ranges) / n_ranges
    at, times = np.unique(keys[np.searchsorted(upto, wanted, side="left").clip(0, len(keys) - 1)], return_counts=True)
    heavy = at[times >= 2]
    last = heavy[heavy < np.iinfo(np.int64).max] + 1  # a heavy key is a range of its own
    starts = np.unique(np.concatenate([at, last]))
    deals = np.ones(len(starts) + 1, np.int64)
    deals[np.searchsorted(starts, heavy) + 1] = times[times >= 2] + 1
    return starts, deals


def _ranged(rows: DataFrame, starts: np.ndarray, deals: np.ndarray, parts: np.ndarray) -> DataFrame:
    """Adds ``range`` and ``heavy`` to the rows: the range by key, its deal by row number, or its part by key."""
    pieces = deals * parts
    first = np.cumsum(pieces) - pieces
    low = np.concatenate([[np.iinfo(np.int64).min], starts]).astype(np.float64)
    high = np.concatenate([starts, [np.iinfo(np.int64).max]]).astype(np.float64)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            key, deal = frame["key"].to_numpy(), frame["deal"].to_numpy()
            i = np.searchsorted(starts, key, side="right")
            share = (key.astype(np.float64) - low[i]) / np.maximum(high[i] - low[i], 1)
            within = np.where(deals[i] > 1, deal % pieces[i], np.minimum((share * parts[i]).astype(np.int64), parts[i] - 1))
            yield frame.drop(columns="deal").assign(range=first[i] + within, base=i, heavy=deals[i] > 1)

    dealt = rows.select("*", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 30)).alias("deal"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", range long, base long, heavy boolean"
    return dealt.mapInPandas(place, schema)


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, samples_per_range: int = SAMPLES_PER_RANGE, seed: int = SEED,
) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard and slot of every row of docs (doc_id, text).

    Null and empty texts have size 8 and are equal texts. Repeated rows get slots of their own.
    No rows give no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart, staged so that it holds
    ), "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 1
    n_ranges = shards * ranges_per_shard
    starts, deals = _splitters(rows, n_ranges, n_ranges * samples_per_range, total, seed)
    ranged = _ranged(rows, starts, deals, np.ones(len(deals), np.int64))
    bytes_of = ranged.groupBy("base").agg(F.sum("size").alias("size")).toPandas()  # a row per range
    filled = np.zeros(len(deals), np.int64)
    filled[bytes_of["base"].to_numpy(np.int64)] = bytes_of["size"].to_numpy(np.int64)
    parts = np.maximum(1, np.ceil(filled * n_ranges / total / 2 / deals)).astype(np.int64)  # over twice the mean: subdivided

    ranged = stage(_ranged(rows, starts, deals, parts).drop("base"), "shard-ranges")
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("range_size"), F.count(F.lit(1)).alias("range_rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("rows_before"))
    order = Window.partitionBy("range").orderBy("key", "doc_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select(
        "*", F.row_number().over(order).alias("n"), (F.sum("size").over(upto) - F.col("size")).alias("bytes_in"), F.lag("key").over(order).alias("last_key"),
    ).join(offsets, "range")
    own = F.col("bytes_before") + F.col("bytes_in")
    begins = F.when(F.col("heavy") | F.col("last_key").isNull() | (F.col("last_key") != F.col("key")), own)
    so_far = Window.partitionBy("range").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # n has no ties
    shard = F.least(F.floor(F.max(begins).over(so_far) * shards / F.lit(total)), F.lit(shards - 1)).cast("int")
    cut = stage(placed.select(
        "doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("n") - 1).alias("at"),
    ), "shards")
    firsts = cut.groupBy("shard").agg(F.min("at").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select(  # a row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Writes docs as folders ``shard=...`` of Parquet files, in the order of the slots; ``doc_id`` must be unique."""
    placed = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
