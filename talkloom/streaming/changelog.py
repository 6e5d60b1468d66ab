"""Change logs: replay in order, latest versions, gaps, purge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.operators.merge import latest_wins
from talkloom.sources.store import VersionedTable


def gaps(rows: DataFrame, groups: Sequence[str], number: str, block: int = 65536) -> DataFrame:
    """(groups, first_missing, last_missing) of the numbers that are missing between those there.

    Numbers are looked at in blocks, then the ends of the blocks, so a large group is many windows.
    Null numbers are ignored, repeated ones count once.
    """
    within = Window.partitionBy(*groups, "_b").orderBy("a")
    numbers = rows.where(F.col(number).isNotNull()).select(*groups, F.col(number).alias("a"), F.floor(F.col(number) / block).alias("_b"))
    inside = numbers.withColumn("b", F.lead("a").over(within)).select(*groups, "a", "b")
    ends = numbers.groupBy(*groups, "_b").agg(F.min("a").alias("low"), F.max("a").alias("a"))
    between = ends.withColumn("b", F.lead("low").over(Window.partitionBy(*groups).orderBy("_b"))).select(*groups, "a", "b")
    return inside.unionByName(between).where("b > a + 1").select(*groups, (F.col("a") + 1).alias("first_missing"), (F.col("b") - 1).alias("last_missing"))


def needs_snapshot(last_seq: int, oldest_seq: int) -> bool:
    """Whether the log no longer reaches back to what was applied last."""
    return last_seq + 1 < oldest_seq


def replay(state: DataFrame, changes: DataFrame, keys: Sequence[str], version: str = "version", op: str = "op") -> DataFrame:
    """``state`` (keys, version, ...) after ``changes`` (op U or D, the same columns): of each key the greatest
    version counts, stale changes do nothing, deleted rows go. Repeating a change changes nothing."""
    all_rows = state.withColumn(op, F.lit("U")).unionByName(changes.select(*state.columns, op))
    return latest_wins(all_rows, keys, [version, op]).where(F.col(op) != "D").drop(op)


def purge(tables: dict[str, DataFrame], chats: DataFrame) -> dict[str, DataFrame]:
    """Every table with a chat_id without the rows of ``chats``."""
    return {n: t.join(chats.select("chat_id"), "chat_id", "left_anti") if "chat_id" in t.columns else t for n, t in tables.items()}


def apply_stream(spark: SparkSession, changes: DataFrame, target: VersionedTable, keys: Sequence[str], checkpoint: str, version: str = "version"):
    """A streaming query that keeps ``target`` at the latest versions. Batches are committed once, whatever is repeated.

    Only the parts of ``target`` (buckets of ``keys``) in which a batch has keys are read and written again.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        changes = latest_wins(df, keys, [version, "op"])
        df.persist()
        try:
            target.merge(changes, lambda old, new: replay(old, new, keys, version), batch_id)
        finally:
            df.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
