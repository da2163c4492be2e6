"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

1. Every document is sized in words and dealt to a shard by a seeded hash. The number of
   shards follows the number of documents, so a (source, shard) cell stays small however
   large its source is. Rows of equal id, size and source are numbered, and the copies go to one shard
   after the other, so rows repeated without end fill no shard either.
2. Target weights share a budget of words among the sources by water filling.
3. In every shard the budget is cut into equal-token blocks, and these seats go to the
   shard's sources by the highest quotients ``votes / (2 * seats + 1)``: an integer quota
   per source and shard. Most seats follow from a safe divisor in closed form, only the last
   few are ranked, so the work does not grow with the number of blocks.
4. The documents of a cell, in seeded order, are one stream of blocks. The quota takes whole
   passes over the stream, then its first blocks. A document is therefore taken whole, but
   for the one at the end of a quota, and reruns agree.

Only the source totals meet in one task: one row per source, by which targets are defined, so this
is for as many sources as have names, not for a source per document.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import count_words, stage

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 16
SHARD_DOCS = 2048
SEED = 17


def _seeded(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``copy`` to rows (row, key, of_source, ...) of a staged table: the number, from 0, of a row among those of its key and source.

    Only rows of repeated keys are moved, and these are counted per split of the table first, so
    a third of all rows under one key is numbered split by split in as many tasks. Which copy gets which number
    depends on the splits; the numbers given out do not.
    """
    group, one_split = ["key", "of_source"], ["key", "of_source", "split"]
    repeated = stage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*group), "repeated-rows")
    single = rows.join(repeated, group, "left_anti").select("*", F.lit(0).cast("long").alias("copy"))
    if repeated.isEmpty():
        return single
    split = rows.select("*", F.shiftright("row", 33).alias("split"))  # the high bits of a row number name its split
    before = Window.partitionBy(*group).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = split.select(*one_split).join(repeated, group, "left_semi").groupBy(*one_split).agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.select(*one_split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "copies-before")
    place = F.row_number().over(Window.partitionBy(*one_split).orderBy("row")) - 1
    copies = split.join(counts, one_split).select(*rows.columns, (F.col("before") + place).cast("long").alias("copy"))
    return single.unionByName(copies)


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` words per source from (source, source_size).

    Sources in code point order, null last, take the weights in turn. The budget is ``share``
    times all words; a source stops at ``most`` times its size and the excess is shared again
    by weight. With the sources ordered by cap per weight, the level at which the budget is
    used up is the largest of the levels that treat a prefix of them as stopped.
    """
    every, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.select(
        "*", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    stopped, spent = F.coalesce(F.sum("weight").over(before), F.lit(0)), F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) * F.lit(share) - spent) / (F.sum("weight").over(every) - stopped)
    levelled = weighed.select("*", level.alias("level")).select("*", F.max("level").over(every).alias("full"))
    target = F.least(F.col("cap").cast("double"), F.col("full") * F.col("weight"))
    return levelled.select(*totals.columns, target.alias("target"))


def shard_quotas(cells: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds ``quota`` (blocks) to cells (shard, of_source, votes): Sainte-Laguë within each shard.

    The seats of a shard are its votes over the block size, rounded. With S cells and M seats
    the divisor ``votes / (M - S)`` never gives more than M seats, and what a cell may still
    win is at most 1.5 * S * (its share) + 1 seats; just these are ranked. Ties go to the
    first source in code point order.
    """
    shard = Window.partitionBy("shard")
    with_seats = cells.select(
        "*", F.sum("votes").over(shard).alias("all_votes"), F.count(F.lit(1)).over(shard).alias("n_cells"),
    ).select("*", F.round(F.col("all_votes") / block_words).cast("long").alias("seats"))
    safe = F.when(F.col("seats") > F.col("n_cells"), F.floor(F.col("votes") * (F.col("seats") - F.col("n_cells")) / F.col("all_votes") + 0.5)).otherwise(F.lit(0))
    safe = with_seats.select("*", safe.cast("long").alias("sure"))
    left = safe.select("*", (F.col("seats") - F.sum("sure").over(shard)).alias("left"))
    may_win = F.when(F.col("all_votes") > 0, F.ceil(1.5 * F.col("n_cells") * F.col("votes") / F.col("all_votes")) + 2).otherwise(F.lit(1))
    seat = left.select("shard", "of_source", "votes", "left", "sure", F.explode(F.sequence(F.lit(0), may_win.cast("int") - 1)).alias("i"))
    best = Window.partitionBy("shard").orderBy((F.col("votes") / (2 * (F.col("sure") + F.col("i")) + 1)).desc(), F.col("of_source"), "i")
    ranked = seat.select("*", F.row_number().over(best).alias("place"))
    return ranked.groupBy("shard", "of_source").agg((F.max("sure") + F.count(F.when(F.col("place") <= F.col("left"), 1))).alias("quota"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS, seed: int = SEED, carry: Sequence[str] = (),
) -> DataFrame:
    """What the mix takes of each document (doc_id, source, text).

    Returns doc_id, size, source_size, target, taken, shard, passes (whole copies taken) and
    part (words taken from the start besides). ``taken`` is
    ``passes * size + part`` and at most ``most`` times the size; ``carry`` names columns that
    come along in a struct ``carried``. Null and blank texts have
    size 0 and are never taken; a null source is a source of its own; a source without words
    has target 0. Repeated rows count as documents each; which of the rows of one id, size and source takes
    which of their places is not said. No documents give no rows. Other columns are ignored.
    """
    sized = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), *(F.struct(*carry).alias("carried") for _ in carry[:1]))
    sized = stage(sized.select(F.monotonically_increasing_id().alias("row"), "*"), "sizes")
    n_shards = max(1, math.ceil(sized.count() / shard_docs))
    in_shard = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") + F.col("copy")) % n_shards
    # a source that is never null (null sorts last), so that windows and joins are dealt by the same plain keys
    of_source = F.when(F.col("source").isNull(), F.lit(">")).otherwise(F.concat(F.lit("="), F.col("source")))

    dealt = _numbered(sized.select("*", _seeded(seed).alias("key"), of_source.alias("of_source"))).select("*", in_shard.alias("shard"))
    cells = dealt.groupBy("shard", "of_source").agg(F.first("source").alias("source"), F.sum("size").alias("cell_size"))
    cells = stage(cells, "cells")
    targets = source_targets(cells.groupBy("of_source").agg(F.first("source").alias("source"), F.sum("cell_size").alias("source_size")), weights, share, most)
    voting = cells.join(targets.drop("source"), "of_source").select(
        "shard", "of_source", "source", "cell_size", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") * F.col("cell_size") / F.col("source_size")).otherwise(F.lit(0.0)).alias("votes"),
    )
    quotas = shard_quotas(voting.select("shard", "of_source", "votes"), block_words)
    n_blocks = F.ceil(F.col("cell_size") / block_words)
    full = voting.join(quotas, ["shard", "of_source"]).select(
        "shard", "of_source", "source_size", "target", n_blocks.alias("n_blocks"), F.least("quota", n_blocks * most).alias("quota"),
    )
    plan = full.select(
        "shard", "of_source", "source_size", "target",
        F.when(F.col("n_blocks") > 0, F.floor(F.col("quota") / F.col("n_blocks"))).otherwise(F.lit(0)).alias("passes"),
        F.when(F.col("n_blocks") > 0, F.col("quota") % F.col("n_blocks") * block_words).otherwise(F.lit(0)).alias("edge"),
    )
    stream = Window.partitionBy("shard", "of_source").orderBy("key", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.select("*", F.sum("size").over(stream).alias("end"))
    part = F.least("end", "edge") - F.least(F.col("end") - F.col("size"), F.col("edge"))
    taken = placed.join(plan, ["shard", "of_source"]).select("*", part.alias("part"))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), "shard", "passes", "part",
        *("carried" for _ in carry[:1]),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each whole pass is a row with the whole text, a part a row with its first words.

    All columns of ``docs`` are kept. White space is kept as well; a part ends with its last word.
    """
    text, size, part = F.col("carried.text"), F.col("size"), F.col("part").cast("int")
    words = F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")  # each with the white space before it
    head = F.when(part == size, text).otherwise(F.array_join(F.slice(words, F.lit(1), part), ""))
    none = F.array().cast("array<string>")
    copies = F.concat(F.array_repeat(text, F.col("passes").cast("int")), F.when(part > 0, F.array(head)).otherwise(none))
    out = mix_sources(docs, carry=docs.columns, **options).where("size > 0").select("carried", F.explode(copies).alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*(changed.get(c, F.col(f"carried.{c}")).alias(c) for c in docs.columns))
