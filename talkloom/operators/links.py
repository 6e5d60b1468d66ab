"""Topic links with their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.sources.tables import table

LINK = ["topic_id", "chat_id", "message_id"]


def dated_links(spark: SparkSession, folder: str, links: DataFrame, arrival: bool = False) -> DataFrame:
    """``links`` whose message exists, with its earliest timestamp (and first arrival).

    Messages are reduced to one row per key before the join, so repeated deliveries never multiply links. Links without a full
    key are dropped; columns named timestamp or arrived are replaced. Messages without time give null.
    """
    what = [F.min("timestamp").alias("timestamp"), *([F.min("received_at").alias("arrived")] if arrival else [])]
    dates = table(spark, folder, "messages").where("chat_id is not null and message_id is not null").groupBy("chat_id", "message_id").agg(*what)
    return links.drop("timestamp", "arrived").join(dates, ["chat_id", "message_id"])


def distinct_links(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (topic_id, chat_id, message_id) with its greatest relevance; keys with a null are dropped."""
    rows = table(spark, folder, "topic_messages").where(" and ".join(f"{c} is not null" for c in LINK))
    return rows.groupBy(*LINK).agg(F.max("relevance").alias("relevance"))
