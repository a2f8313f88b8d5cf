"""Applying a feed of inserts, updates and deletes to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__lv_rank"


def _free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key by the columns of order (greatest first, null oldest).

    Rows with a null in any key column are left out. Rows equal in key and order are deliveries of one change:
    one of them stays, the one with the greatest tie columns where those are given. The ranking keeps a
    row_number of 1, which Spark also evaluates before the shuffle (WindowGroupLimit): every task sends at most
    one row of a key, so that a hot key costs no more than any other.
    """
    rank = _free(df, _RANK)
    keyed = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in [*order, *tie]))
    return keyed.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def apply_changes(
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    deleted: Column,
    base: DataFrame | None = None,
    tie: Sequence[str] = (),
    keep_deletes: bool = False,
) -> DataFrame:
    """The present state of a table after a change feed, whatever the order and number of deliveries.

    changes: rows with the key columns, the order columns (log position) and any payload.
    deleted: a Boolean over the columns of changes that marks a delete; null counts as false.
    base: the state before, with the columns of changes; the newer of a base row and a change wins, and at equal
    log positions they are one change. It must be a result with keep_deletes: a key's last delete is a row of it, by the same
    mark, or else an older change that comes later would bring the key back.
    Result: the columns of changes, one row per key with a value at the end; with keep_deletes also the delete of every
    key that ends with one, so that the result can be a base. Null keys have no state. An empty
    feed gives the base without its older versions. Columns of any name may be present.
    """
    rows = changes if base is None else changes.unionByName(base.select(*changes.columns))
    last = newest(rows, keys, order, tie)
    return last if keep_deletes else last.filter(~F.coalesce(deleted, F.lit(False)))


def change_counts(changes: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: Column) -> DataFrame:
    """What a feed holds: rows, rows without a key, changes, repeated deliveries, deletes, keys.

    One row. Deliveries of one change are equal in key and order columns. The distinct changes are counted in a
    hash aggregate over (key, order), which is partially done before the shuffle.
    """
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    per = changes.groupBy(has_key.alias("k"), *(F.col(c) for c in [*keys, *order])).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce(deleted, F.lit(False)).cast("int")).alias("d")
    )
    per_key = per.groupBy("k", *keys).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.sum("d").cast("long").alias("d")
    )
    zero = F.lit(0).cast("long")
    return per_key.agg(
        F.coalesce(F.sum("n"), zero).alias("n_rows"),
        F.coalesce(F.sum(F.when(~F.col("k"), F.col("n"))), zero).alias("n_without_key"),
        F.coalesce(F.sum(F.when(F.col("k"), F.col("c"))), zero).alias("n_changes"),
        F.coalesce(F.sum(F.when(F.col("k"), F.col("n") - F.col("c"))), zero).alias("n_repeated"),
        F.coalesce(F.sum(F.when(F.col("k"), F.col("d"))), zero).alias("n_deletes"),
        F.count(F.when(F.col("k"), F.lit(1))).alias("n_keys"),
    )
