"""Article store: validation, typed rows, keep-first insert, add-or-replace."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.schema import ARTICLE
from corpusloom.session import stage

KEY = ("id", "title")


def typed_items(items: DataFrame) -> DataFrame:
    """Columns of the article schema; missing optionals become NULL, NULL stays NULL."""
    have = set(items.columns)
    return items.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in ARTICLE.fields
    ])


def _missing() -> Column:
    return F.when(F.col("id").isNull() & F.col("title").isNull(), "id and title missing").when(
        F.col("id").isNull(), "id missing"
    ).when(F.col("title").isNull(), "title missing")


def valid_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("id").isNotNull() & F.col("title").isNotNull())


def rejected_items(items: DataFrame) -> DataFrame:
    """The rows ``valid_items`` drops, with the reason."""
    return items.withColumn("reason", _missing()).where(F.col("reason").isNotNull())


def _others(df: DataFrame, *named: str) -> list[str]:
    return [c for c in df.columns if c not in named]


def _on(rows: DataFrame, other: DataFrame, key: Sequence[str]) -> Column:
    """Equality of the key columns, null with null."""
    parts = [rows[c].eqNullSafe(other[f"_{c}"]) for c in key]
    return reduce(lambda a, b: a & b, parts)


def _one_per_key(items: DataFrame, key: Sequence[str], order_by: str, newest: bool, staged: bool) -> DataFrame:
    """The winning row of every key, by ``order_by`` and then by content.

    Keys are counted first, on the key and the stamp alone (numbers and hash aggregation).
    Most keys have one row: these rows pass as they are, filtered by the contested keys.
    Of a contested key only the rows at the winning stamp are compared by content. With ``staged`` the contested keys
    are written first: the wide rows then move only where those are too many to broadcast.
    """
    pick = F.max if newest else F.min
    # a missing stamp comes before all others
    stamp = pick(order_by) if newest else F.when(F.count("*") == F.count(order_by), F.min(order_by))
    contested = items.groupBy(*key).agg(F.count("*").alias("_n"), stamp.alias("_stamp")).where("_n > 1")
    contested = contested.select(*[F.col(c).alias(f"_{c}") for c in key], "_stamp")
    if staged:
        contested = stage(contested, "contested-keys")
    single = items.join(contested, _on(items, contested, key), "left_anti")
    at_stamp = items.join(contested, _on(items, contested, key) & items[order_by].eqNullSafe(contested["_stamp"]), "left_semi")
    best = at_stamp.groupBy(*key).agg(pick(F.struct(order_by, *_others(items, *key, order_by))).alias("best"))
    return single.unionByName(best.select(*[F.col(c) if c in key else F.col(f"best.{c}") for c in items.columns]))


def keep_first(items: DataFrame, key: Sequence[str] = KEY, order_by: str = "last_update", staged: bool = False) -> DataFrame:
    """The first row of every key by ``order_by``; equal stamps are settled by the row's content.

    Grouped and not a window: each input split already reduces a key to one row, so a key
    that owns a third of the table sends one row per split, not a third of the table, to
    one task.
    """
    return _one_per_key(items, key, order_by, newest=False, staged=staged)


def latest(items: DataFrame, key: str = "id", order_by: str = "last_update", staged: bool = False) -> DataFrame:
    """The newest row of every key (see ``keep_first``)."""
    return _one_per_key(items, [key], order_by, newest=True, staged=staged)


def insert_if_absent(new: DataFrame, existing: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of ``new`` to append: first of each key, and only keys the table does not hold.

    Only the key columns of the table are read, and rows it holds already are left out
    before the first of each key is looked for.
    """
    return keep_first(new.join(existing.select(*key), list(key), "left_anti"), key)


def replace(existing: DataFrame, fresh: DataFrame, key: str = "id", keep_columns: Sequence[str] = ()) -> DataFrame:
    """``existing`` with the rows of ``fresh`` (one per key) added or put in place of theirs.

    ``keep_columns`` lists columns a fresh row without them takes over from the stored row.
    The table itself is only filtered: its wide rows move in a shuffle only when the fresh
    keys are too many to broadcast.
    """
    added = fresh
    if keep_columns:
        stored = existing.select(key, *[F.col(c).alias(f"stored_{c}") for c in keep_columns])
        added = fresh.join(stored, key, "left").select(*[
            F.coalesce(c, f"stored_{c}").alias(c) if c in keep_columns else F.col(c) for c in fresh.columns
        ])
    return existing.join(fresh.select(key), key, "left_anti").unionByName(added)


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    key: str = "id",
    order_by: str = "last_update",
    keep_columns: Sequence[str] = (),
) -> DataFrame:
    """Add or replace by key; the newest incoming version wins over the stored row.

    The fresh rows are staged, since they filter the table and are added to it.
    """
    return replace(existing, stage(latest(incoming, key, order_by), "fresh"), key, keep_columns)
