"""Store queries: scans, lookups, merges, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import text as tx
from talkloom.operators import merge
from talkloom.operators.links import distinct_links
from talkloom.operators.lists import first_occurrence
from talkloom.plans.registry import Registry
from talkloom.plans.search_queries import CHATS, TOPICS
from talkloom.sources.store import point_lookup, setting
from talkloom.sources.tables import current_chats, current_topics, distinct_messages, table

query = Registry()
KEY = ["chat_id", "message_id"]
#: The batch that comes in: everything delivered in the last batches, against what came before.
SPLIT = "(SELECT max(batch_id) - 20 FROM messages)"
OLD = f"(SELECT chat_id, message_id, min(timestamp) AS timestamp, max(text_plain) AS text FROM messages WHERE batch_id < {SPLIT} GROUP BY 1, 2)"
NEW = f"(SELECT chat_id, message_id, max(timestamp) AS timestamp, max(text_plain) AS text FROM messages WHERE batch_id >= {SPLIT} GROUP BY 1, 2)"


def _old_new(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "messages")
    split = rows.agg(F.max("batch_id") - 20).first()[0] or 0
    side = lambda which, stamp: rows.where(which).groupBy(*KEY).agg(stamp("timestamp").alias("timestamp"), F.max("text_plain").alias("text"))
    return side(F.col("batch_id") < split, F.min), side(F.col("batch_id") >= split, F.max)


@query(f"SELECT chat_id, title, chat_type FROM {CHATS} WHERE NOT is_excluded")
def chat_active_list(spark: SparkSession, folder: str) -> DataFrame:
    return current_chats(spark, folder).where("not is_excluded").select("chat_id", "title", "chat_type").orderBy("title")


@query(f"SELECT chat_id, title FROM {CHATS} WHERE trim(title) <> ''")
def chat_nonblank_titles(spark: SparkSession, folder: str) -> DataFrame:
    return current_chats(spark, folder).where("trim(title) <> ''").select("chat_id", "title").orderBy("title")


@query("SELECT count(DISTINCT chat_id) AS chats FROM chats")
def chat_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chats").agg(F.countDistinct("chat_id").alias("chats"))


@query("SELECT category_id, name, name_ko, sort_order FROM wiki_categories WHERE category_id = 7")
def category_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return point_lookup(table(spark, folder, "wiki_categories"), category_id=7)


@query(f"SELECT topic_id, title, updated_at FROM {TOPICS} WHERE topic_id = 42")
def topic_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return point_lookup(current_topics(spark, folder), topic_id=42).select("topic_id", "title", "updated_at")


@query("SELECT category_id, coalesce(TRY_CAST(name AS BIGINT), 5) AS value FROM wiki_categories")
def typed_setting(spark: SparkSession, folder: str) -> DataFrame:
    """Settings that don't parse take their default."""
    return table(spark, folder, "wiki_categories").select("category_id", setting(F.col("name"), 5).alias("value"))


@query(f"SELECT coalesce(n.chat_id, o.chat_id) AS chat_id, coalesce(n.message_id, o.message_id) AS message_id, coalesce(n.timestamp, o.timestamp) AS timestamp FROM {OLD} o FULL JOIN {NEW} n ON o.chat_id = n.chat_id AND o.message_id = n.message_id")
def upsert_latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _old_new(spark, folder)
    return merge.upsert(old, new, KEY).select(*KEY, "timestamp")


@query(
    f"""SELECT count(*) FILTER (o.chat_id IS NULL) AS inserted,
        count(*) FILTER (o.chat_id IS NOT NULL AND (n.text IS DISTINCT FROM o.text OR n.timestamp <> o.timestamp)) AS updated,
        count(*) FILTER (o.chat_id IS NOT NULL AND NOT (n.text IS DISTINCT FROM o.text OR n.timestamp <> o.timestamp)) AS unchanged
    FROM {NEW} n LEFT JOIN {OLD} o ON o.chat_id = n.chat_id AND o.message_id = n.message_id"""
)
def upsert_counts(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _old_new(spark, folder)
    return merge.upsert_counts(old, new, KEY, ["timestamp", "text"])


@query(f"SELECT chat_id, message_id, timestamp FROM {OLD} o WHERE NOT EXISTS (SELECT 1 FROM {NEW} n WHERE n.chat_id = o.chat_id AND n.message_id = o.message_id)")
def delete_refs(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _old_new(spark, folder)
    return merge.delete_refs(old, new, KEY).select(*KEY, "timestamp")


@query(f"SELECT chat_id, message_id, timestamp FROM {OLD} UNION ALL SELECT chat_id, message_id, timestamp FROM {NEW} n WHERE NOT EXISTS (SELECT 1 FROM {OLD} o WHERE n.chat_id = o.chat_id AND n.message_id = o.message_id)")
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _old_new(spark, folder)
    return merge.insert_if_absent(old.drop("text"), new.drop("text"), KEY)


@query("SELECT DISTINCT m.chat_id, m.message_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM topic_messages t WHERE t.chat_id = m.chat_id AND t.message_id = m.message_id)")
def enqueue_unlinked(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that no topic has yet, as an insert from a selection."""
    links = table(spark, folder, "topic_messages").select(*KEY)
    return table(spark, folder, "messages").select(*KEY).join(links, KEY, "left_anti").distinct()


@query(
    f"""SELECT c.chat_id, coalesce(n.title, c.title) AS title, c.is_excluded FROM {CHATS} c
    LEFT JOIN (SELECT chat_id, 'chat ' || CAST(count(*) AS VARCHAR) AS title FROM messages GROUP BY 1) n USING (chat_id)
    UNION ALL SELECT chat_id, 'chat ' || CAST(count(*) AS VARCHAR), false FROM messages WHERE chat_id NOT IN (SELECT chat_id FROM chats) GROUP BY 1"""
)
def chat_upsert_keep_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Titles are replaced, the excluded flag of known chats stays."""
    counts = table(spark, folder, "messages").groupBy("chat_id").agg(F.count("*").alias("n"))
    batch = counts.select("chat_id", F.concat(F.lit("chat "), F.col("n").cast("string")).alias("title"), F.lit(False).alias("is_excluded"))
    return merge.upsert(current_chats(spark, folder).select("chat_id", "title", "is_excluded"), batch, ["chat_id"], keep=["is_excluded"])


@query(
    f"""SELECT c.chat_id, title, coalesce(last_message_id, access_hash) AS access_hash FROM {CHATS} c
    LEFT JOIN (SELECT chat_id, max(message_id) AS last_message_id FROM messages GROUP BY 1) m USING (chat_id)"""
)
def sync_state_update(spark: SparkSession, folder: str) -> DataFrame:
    """A column of known keys is updated where there is a value."""
    last = table(spark, folder, "messages").groupBy("chat_id").agg(F.max("message_id").alias("access_hash"))
    return merge.partial_update(current_chats(spark, folder).select("chat_id", "title", "access_hash"), last, ["chat_id"])


@query(
    f"""SELECT coalesce(n.chat_id, o.chat_id) AS chat_id, coalesce(n.message_id, o.message_id) AS message_id,
        CASE WHEN n.chat_id IS NULL THEN 'D' WHEN o.chat_id IS NULL THEN 'I' ELSE 'U' END AS op
    FROM {OLD} o FULL JOIN {NEW} n ON o.chat_id = n.chat_id AND o.message_id = n.message_id
    WHERE n.chat_id IS NULL OR o.chat_id IS NULL OR n.text IS DISTINCT FROM o.text OR n.timestamp <> o.timestamp"""
)
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _old_new(spark, folder)
    return merge.snapshot_changes(old, new, KEY)


_FIRST = "(SELECT topic_id, arg_min(title_ko, updated_at) AS title_ko, row_number() OVER (ORDER BY topic_id) - 1 AS i FROM wiki_topics WHERE topic_id % 3 > 0 GROUP BY 1)"
_SECOND = "(SELECT topic_id, arg_max(title_ko, updated_at) AS title_ko, row_number() OVER (ORDER BY topic_id) - 1 AS i FROM wiki_topics WHERE topic_id % 3 < 2 GROUP BY 1)"


@query(
    f"""WITH o AS {_FIRST.replace("topic_id % 3 > 0", "category_id IS NOT NULL")}, n AS {_SECOND.replace("topic_id % 3 < 2", "title_ko IS NOT NULL")}
    SELECT coalesce(n.topic_id, o.topic_id) AS topic_id, CASE WHEN n.i IS NULL THEN 'D' WHEN o.i IS NULL THEN 'I' ELSE 'U' END AS op,
        CAST(o.i AS INTEGER) AS old_index, CAST(n.i AS INTEGER) AS new_index
    FROM o FULL JOIN n ON o.topic_id = n.topic_id WHERE n.i IS NULL OR o.i IS NULL OR o.title_ko IS DISTINCT FROM n.title_ko"""
)
def keyed_list_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Two ordered lists of topics: what was removed, inserted and updated, with places in both."""
    rows = table(spark, folder, "wiki_topics")
    old = rows.where("category_id is not null").groupBy("topic_id").agg(F.min_by("title_ko", "updated_at").alias("title_ko"))
    new = rows.where("title_ko is not null").groupBy("topic_id").agg(F.max_by("title_ko", "updated_at").alias("title_ko"))
    return merge.diff(old, new, ["topic_id"], ["topic_id"], 8)


@query(
    """WITH m AS (SELECT DISTINCT chat_id, message_id FROM messages), l AS (SELECT DISTINCT chat_id, message_id FROM topic_messages)
    SELECT coalesce(m.chat_id, l.chat_id) AS chat_id, coalesce(m.message_id, l.message_id) AS message_id, CASE WHEN l.chat_id IS NULL THEN 'index' ELSE 'remove' END AS action
    FROM m FULL JOIN l ON m.chat_id = l.chat_id AND m.message_id = l.message_id WHERE m.chat_id IS NULL OR l.chat_id IS NULL"""
)
def symmetric_difference(spark: SparkSession, folder: str) -> DataFrame:
    return merge.symmetric_difference(table(spark, folder, "messages"), table(spark, folder, "topic_messages"), KEY)


@query(f"SELECT 1000000 + row_number() OVER (ORDER BY title) AS new_id, title FROM (SELECT DISTINCT title FROM {TOPICS} WHERE title IS NOT NULL)")
def assign_ids(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "wiki_topics").where("title is not null").select("title").distinct()
    return merge.next_ids(titles, "new_id", 1_000_000, ["title"], 8).select("new_id", "title")


@query(
    f"""SELECT m.chat_id, message_id, CASE WHEN username IS NOT NULL AND username <> '' THEN 'https://example.org/' || username || '/' || CAST(message_id AS VARCHAR)
        ELSE 'app://post?channel=' || CAST(-m.chat_id - 1000000000000 AS VARCHAR) || '&post=' || CAST(message_id AS VARCHAR) END AS link
    FROM (SELECT DISTINCT chat_id, message_id FROM messages) m LEFT JOIN {CHATS} c ON m.chat_id = c.chat_id"""
)
def message_links(spark: SparkSession, folder: str) -> DataFrame:
    chats = current_chats(spark, folder).select("chat_id", "username")
    rows = table(spark, folder, "messages").select(*KEY).distinct().join(chats, "chat_id", "left")
    link = tx.message_link(F.col("username"), F.col("chat_id"), F.col("message_id"), "https://example.org/{chat}/{message}", "app://post?channel={chat}&post={message}")
    return rows.select(*KEY, link.alias("link"))


@query(
    f"""SELECT chat_id, title FROM (SELECT chat_id, title, 0 AS p FROM {CHATS} UNION ALL SELECT DISTINCT chat_id, 'unknown', 1 FROM messages)
    QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY p) = 1"""
)
def unique_peers(spark: SparkSession, folder: str) -> DataFrame:
    """Known chats and those that only messages name, each once, known ones first."""
    known = current_chats(spark, folder).select("chat_id", "title").withColumn("p", F.lit(0))
    named = table(spark, folder, "messages").select("chat_id").distinct().select("chat_id", F.lit("unknown").alias("title"), F.lit(1).alias("p"))
    return first_occurrence(known.unionByName(named), ["chat_id"], ["p"]).drop("p")


@query("SELECT DISTINCT chat_id, message_id, CASE WHEN coalesce(text_plain, '') = '' THEN 'D' ELSE 'U' END AS op FROM messages")
def push_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What a push of messages does: texts are upserts, empty ones deletes, in chats of every kind."""
    op = F.when(F.coalesce("text_plain", F.lit("")) == "", "D").otherwise("U")
    return table(spark, folder, "messages").select(*KEY, op.alias("op")).distinct()


@query(f"SELECT t.chat_id, count(*) AS links FROM (SELECT DISTINCT topic_id, chat_id, message_id FROM topic_messages) t WHERE t.chat_id NOT IN (SELECT chat_id FROM {CHATS} WHERE is_excluded) GROUP BY 1")
def links_without_opted_out(spark: SparkSession, folder: str) -> DataFrame:
    """Chats named in a list are left out everywhere."""
    out = current_chats(spark, folder).where("is_excluded").select("chat_id")
    return distinct_links(spark, folder).join(out, "chat_id", "left_anti").groupBy("chat_id").agg(F.count("*").alias("links"))


@query(f"SELECT chat_id, message_id, timestamp FROM {OLD} WHERE timestamp < 1746057600")
def tombstone_retention(spark: SparkSession, folder: str) -> DataFrame:
    """Rows old enough to be compacted away."""
    return _old_new(spark, folder)[0].where("timestamp < 1746057600").select(*KEY, "timestamp")


@query("SELECT chat_id, max(message_id) AS last_message_id, min(message_id) AS oldest_message_id, count(DISTINCT message_id) AS n FROM messages GROUP BY 1")
def sync_state(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages").groupBy("chat_id").agg(
        F.max("message_id").alias("last_message_id"), F.min("message_id").alias("oldest_message_id"), F.countDistinct("message_id").alias("n")
    )


@query("SELECT chat_id, a + 1 AS first_missing, b - 1 AS last_missing FROM (SELECT chat_id, message_id AS a, lead(message_id) OVER (PARTITION BY chat_id ORDER BY message_id) AS b FROM (SELECT DISTINCT chat_id, message_id FROM messages)) WHERE b > a + 1")
def sequence_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps in the numbers of each chat."""
    from talkloom.streaming.changelog import gaps

    return gaps(distinct_messages(spark, folder), ["chat_id"], "message_id")


QUERIES, SQL = query.queries, query.sql
