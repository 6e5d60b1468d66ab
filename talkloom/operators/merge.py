"""Snapshots and changes: merges, deletes, inserts of what is absent, differences, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.session import cut


def latest_wins(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order`` (nulls first). Combined before the shuffle; ties fall to the other columns."""
    rest = [c for c in changes.columns if c not in keys]
    rank = F.struct(*(F.col(c) for c in order), F.xxhash64(*rest) if rest else F.lit(0))
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*").select(*changes.columns)


def upsert(snapshot: DataFrame, batch: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), fill: Sequence[str] = ()) -> DataFrame:
    """``snapshot`` with the rows of ``batch`` (unique keys) in place of those with the same key.

    Columns in ``keep`` stay as they were where the key was known; columns in ``fill`` change only where the
    batch has a value. Adds nothing else to the columns.
    """
    columns = [c for c in snapshot.columns if c not in keys]
    old = snapshot.select(*keys, *(F.col(c).alias(f"o_{c}") for c in columns), F.lit(True).alias("__o"))
    new = batch.select(*keys, *(F.col(c).alias(f"n_{c}") for c in columns), F.lit(True).alias("__n"))
    joined = old.join(new, list(keys), "full")

    def value(c: str) -> Column:
        was, now = F.col(f"o_{c}"), F.col(f"n_{c}")
        if c in keep:
            return F.when(F.col("__o"), was).otherwise(now)
        if c in fill:
            return F.coalesce(now, was)
        return F.when(F.col("__n"), now).otherwise(was)

    return joined.select(*keys, *(value(c).alias(c) for c in columns)).select(*snapshot.columns)


def upsert_counts(snapshot: DataFrame, batch: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """One row (inserted, updated, unchanged): what ``upsert`` does to each row of the batch."""
    old = snapshot.select(*keys, F.struct(*content).alias("was"), F.lit(True).alias("known"))
    new = batch.select(*keys, F.struct(*content).alias("now"))
    known = F.coalesce("known", F.lit(False))
    same = F.col("was").eqNullSafe(F.col("now"))
    return new.join(old, list(keys), "left").agg(
        F.count_if(~known).alias("inserted"), F.count_if(known & ~same).alias("updated"), F.count_if(known & same).alias("unchanged")
    )


def partial_update(snapshot: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null values of ``updates`` (unique keys) in place of the snapshot's; unknown keys do nothing."""
    columns = [c for c in updates.columns if c not in keys]
    new = updates.withColumnsRenamed({c: f"n_{c}" for c in columns})
    out = snapshot.join(new, list(keys), "left")
    return out.select(*(F.coalesce(f"n_{c}", c).alias(c) if c in columns else F.col(c) for c in snapshot.columns))


def delete_refs(snapshot: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``snapshot`` without the keys of ``refs``; repeated and unknown refs do no harm."""
    return snapshot.join(refs.select(*keys), list(keys), "left_anti")


def insert_if_absent(snapshot: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``snapshot`` and one row per new key of ``batch``; of repeated ones the least in the order of all columns."""
    first = latest_absent(batch, keys).join(snapshot.select(*keys), list(keys), "left_anti")
    return snapshot.unionByName(first.select(*snapshot.columns))


def latest_absent(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else batch.distinct()


def ranked(rows: DataFrame, position: str, order: Sequence[str], parts: int = 200) -> DataFrame:
    """``rows`` with their 0-based position in ``order``, which should be total, without one task seeing all rows.

    Rows are ranged by ``order``; each range numbers its own rows, starting behind the counts of the ranges before.
    """
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    # As many rows as ranges.
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_k", own).join(offsets, "_p").withColumn(position, F.col("_o") + F.col("_k") - 1).drop("_p", "_k", "_o")


def next_ids(batch: DataFrame, id_column: str, highest: int, order: Sequence[str], parts: int = 200) -> DataFrame:
    """Ids from ``highest`` + 1 on in ``order``, without gaps."""
    return ranked(batch, id_column, order, parts).withColumn(id_column, F.col(id_column) + highest + 1)


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int = 200, new_order: Sequence[str] | None = None) -> DataFrame:
    """(keys, op, old_index, new_index): D removed, I inserted, U changed, M moved; unchanged rows are left out.

    Indexes are 0-based positions in ``order`` (of ``new``: in ``new_order``, if given), which should be total. Content
    is compared by hash of the other columns. Moved are rows of the same content whose place among the rows that both
    lists have is another; with one order for both lists and no change of content nothing moves, so these places are
    made only where orders differ.
    """
    content = [c for c in old.columns if c not in keys]

    def indexed(df: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
        return ranked(df, f"{name}_index", by, parts).select(*keys, f"{name}_index", F.xxhash64(*content).alias(f"{name}_hash"))

    joined = indexed(old, "old", order).join(indexed(new, "new", new_order or order), list(keys), "full")
    moved = F.lit(False)
    if new_order and list(new_order) != list(order):
        joined = cut(joined, "joined")
        both = joined.where("old_index is not null and new_index is not null").select(*keys, "old_index", "new_index")
        places = ranked(ranked(both, "_was", ["old_index"], parts), "_now", ["new_index"], parts).where("_was <> _now").select(*keys, F.lit(True).alias("_moved"))
        joined = joined.join(places, list(keys), "left")
        moved = F.coalesce("_moved", F.lit(False))
    op = F.when(F.col("new_index").isNull(), "D").when(F.col("old_index").isNull(), "I").when(F.col("old_hash") != F.col("new_hash"), "U").when(moved, "M")
    return joined.withColumn("op", op).where("op is not null").select(*keys, "op", "old_index", "new_index")


def snapshot_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, op) by key and content alone: the difference that any size of table can take."""
    content = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.xxhash64(*content).alias("a"))
    b = new.select(*keys, F.xxhash64(*content).alias("b"))
    op = F.when(F.col("b").isNull(), "D").when(F.col("a").isNull(), "I").when(F.col("a") != F.col("b"), "U")
    return a.join(b, list(keys), "full").withColumn("op", op).where("op is not null").select(*keys, "op")


def symmetric_difference(upstream: DataFrame, mirror: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, action): index what only upstream has, remove what only the mirror has."""
    a = upstream.select(*keys).distinct().withColumn("up", F.lit(True))
    b = mirror.select(*keys).distinct().withColumn("here", F.lit(True))
    action = F.when(F.col("here").isNull(), "index").when(F.col("up").isNull(), "remove")
    return a.join(b, list(keys), "full").select(*keys, action.alias("action")).where("action is not null")
