"""Streaming rollups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators.rolling import State, daily_amounts
from talkloom.sources.store import VersionedTable


def daily_counts(events: DataFrame, entity: str, seconds: str) -> DataFrame:
    """Counts per entity and UTC day by event time. Without watermark, as late rows count in their own day whenever they come."""
    at = F.timestamp_seconds(seconds)
    return events.withColumn("_t", at).groupBy(F.window("_t", "1 day").alias("w"), entity).agg(F.count("*").alias("n")).select(entity, F.to_date("w.start").alias("day"), "n")


def hourly_counts(events: DataFrame, time: str, entity: str, late: str = "2 days") -> DataFrame:
    """Counts per hour with state bounded by a watermark; later rows are left to the daily corrections."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), entity).agg(F.count("*").alias("n")).select(entity, F.col("w.start").alias("hour"), "n")


def keep_latest(counts: DataFrame, target: VersionedTable, checkpoint: str):
    """Writes updated counts over those of the same entity and day; parts of ``target`` without an update keep their files."""

    def batch(df: DataFrame, batch_id: int) -> None:
        keys = [c for c in df.columns if c != "n"]
        df.persist()
        try:
            target.merge(df, lambda old, new: old.join(new.select(*keys), keys, "left_anti").unionByName(new), batch_id)
        finally:
            df.unpersist()

    return counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def advance_daily(state: State, events: DataFrame, entity: str, day: dt.date) -> int:
    """Takes a rolling state on to ``day`` by the events of that day (entity, day); returns the version committed."""
    return state.advance(daily_amounts(events.where(F.col("day") == F.lit(day).cast("date")), entity, "day", F.count("*")), day)
