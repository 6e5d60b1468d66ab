"""Mirrored state: soft deletes, typed events, evidence selection, caches that only newer results replace."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(rows: DataFrame) -> DataFrame:
    """The base view of a table with soft deletes (deleted_at): every read goes through it."""
    return rows.where("deleted_at is null").drop("deleted_at")


def compactable(rows: DataFrame, as_of: Column, version: str, acked: Column, days: int = 30) -> DataFrame:
    """Tombstones that may go: deleted ``days`` days ago or longer, and their version acknowledged. Live rows never."""
    return rows.where((F.col("deleted_at") <= as_of - F.make_dt_interval(F.lit(days))) & (acked >= F.col(version)))


def apply_events(events: DataFrame, key: str, seq: str, kind: str, fields: Mapping[str, tuple[Sequence[str], Column]], deletes: Sequence[str]) -> DataFrame:
    """(key, fields, seq): state after typed events, whatever their order and repeats.

    ``fields`` gives of each column the event types that set it and the value they carry; the last by ``seq`` counts,
    unless an event of ``deletes`` came after it, which clears all. Keys whose last event is a delete have no row;
    null keys and sequences are left out. One aggregation, combined before the shuffle.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    last = lambda kinds, value: F.max(F.when(F.col(kind).isin(list(kinds)), F.struct(F.col(seq).alias("s"), value.alias("v"))))
    out = rows.groupBy(key).agg(
        F.max(F.when(F.col(kind).isin(list(deletes)), F.col(seq))).alias("_gone"), F.max(seq).alias("_last"), *(last(k, v).alias(c) for c, (k, v) in fields.items())
    )
    gone = F.coalesce("_gone", F.lit(-1))
    kept = [F.when(F.col(f"{c}.s") > gone, F.col(f"{c}.v")).alias(c) for c in fields]
    return out.where(F.col("_last") > gone).select(key, *kept, F.col("_last").alias(seq))


def rewrite_evidence(evidence: DataFrame, group: str, mark: str, since: Column, best: Sequence[Column], k: int) -> DataFrame:
    """``evidence`` with part: 'delta', all that came after ``since``, and 'rest', the first ``k`` by ``best`` of each
    group among the others. The two exclude each other by their condition, so no anti-join is needed."""
    delta = evidence.where(F.col(mark) > since).withColumn("part", F.lit("delta"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*best))
    rest = evidence.where(F.col(mark) <= since).withColumn("_k", place).where(F.col("_k") <= k).drop("_k").withColumn("part", F.lit("rest"))
    return delta.unionByName(rest)


def sweep(evidence: DataFrame, applied: DataFrame, group: str, mark: str) -> DataFrame:
    """What is left after results were applied: of each group only what came after the snapshot (group, bound) that
    they saw. Groups without a bound keep all."""
    return evidence.join(applied, group, "left").where(F.col("bound").isNull() | (F.col(mark) > F.col("bound"))).drop("bound")


def replace_if_newer(cache: DataFrame, incoming: DataFrame, window: str, mark: str) -> DataFrame:
    """``cache`` with the windows of ``incoming`` whose mark is greater than the cached one in place of it, whole; stale
    ones are refused. A window has one mark."""
    marks = lambda df, name: df.groupBy(window).agg(F.max(mark).alias(name))
    newer = marks(incoming, "_new").join(marks(cache, "_old"), window, "left").where("_old is null or _new > _old").select(window)
    return cache.join(newer, window, "left_anti").unionByName(incoming.join(newer, window, "left_semi").select(*cache.columns))


def purge_cascade(messages: DataFrame, links: DataFrame, topics: DataFrame, chats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, links and topics without those of ``chats``; topics that lose all their links go too, topics that had
    none stay."""
    gone = chats.select("chat_id").distinct()
    kept = links.join(gone, "chat_id", "left_anti")
    had = links.select("topic_id").distinct()
    emptied = had.join(kept.select("topic_id"), "topic_id", "left_anti")
    return messages.join(gone, "chat_id", "left_anti"), kept, topics.join(emptied, "topic_id", "left_anti")


def freeze_citations(evidence: DataFrame, group: str, text: str, order: Sequence[str], keep: Sequence[str], version: int) -> DataFrame:
    """(group, keep, version): of each group the first message of every different text; texts are told apart by hash, so
    that they are not shuffled. Null texts are one text."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    first = evidence.groupBy(group, digest.alias("_h")).agg(F.min(F.struct(*order, *keep)).alias("f"))
    return first.select(group, *(F.col(f"f.{c}").alias(c) for c in keep), F.lit(version).alias("version"))
