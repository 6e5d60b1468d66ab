"""Explicit schemas of the known tables and a loader that never infers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "messages": "message_id long, chat_id long, timestamp long, text_plain string, text_stripped string, link string, "
    "sender_id long, batch_id long, received_at timestamp_ntz",
    "chats": "chat_id long, title string, chat_type string, username string, access_hash long, is_excluded boolean",
    "wiki_categories": "category_id long, name string, name_ko string, sort_order long",
    "wiki_topics": "topic_id long, title string, title_ko string, category_id long, updated_at string",
    "topic_messages": "topic_id long, chat_id long, message_id long, relevance double, assigned_category string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, chat_id long, published_at timestamp_ntz",
    "eval_items": "item_id long, suite string, text string",
    "mix_targets": "source string, target_share double, max_repeats int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder`` with its declared schema (``<folder>/<name>.parquet``, file or directory)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def current_chats(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chat_id. Re-sent chats carry an older title and no time, so the greatest
    (title, chat_type, username) in code point order is kept: arbitrary, but the same everywhere."""
    rows = table(spark, folder, "chats")
    order = F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "chat_type", "username")))
    one = rows.groupBy("chat_id").agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return one.select("r.*")


def current_topics(spark: SparkSession, folder: str) -> DataFrame:
    """One row per topic_id, the latest updated_at."""
    rows = table(spark, folder, "wiki_topics")
    return rows.groupBy("topic_id").agg(F.max_by(F.struct(*rows.columns), "updated_at").alias("r")).select("r.*")


def distinct_messages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per message with its earliest timestamp and, where asked, text_plain (on which copies agree)."""
    rows = table(spark, folder, "messages")
    extra = [F.max(c).alias(c) for c in columns]
    return rows.groupBy("chat_id", "message_id").agg(F.min("timestamp").alias("timestamp"), *extra)
