"""Topic analytics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions import text as tx
from talkloom.operators import topics as tp
from talkloom.operators.lists import in_order, share_of_total
from talkloom.operators.links import dated_links, distinct_links
from talkloom.plans.registry import Registry
from talkloom.plans.search_queries import CHATS, TOPICS, WS
from talkloom.sources.tables import current_chats, current_topics, distinct_messages, table

query = Registry()

#: 2025-06-30 12:00 UTC, the time as of which windows end.
AS_OF = 1751284800
LINKS = "(SELECT topic_id, chat_id, message_id, max(relevance) AS relevance FROM topic_messages GROUP BY 1, 2, 3)"
DATES = "(SELECT chat_id, message_id, min(timestamp) AS timestamp, max(text_plain) AS text FROM messages GROUP BY 1, 2)"
DATED = f"(SELECT topic_id, chat_id, message_id, relevance, timestamp FROM {LINKS} JOIN {DATES} USING (chat_id, message_id))"
DAY = "CAST(to_timestamp(timestamp) AT TIME ZONE 'UTC' AS DATE)"
DAILY = f"(SELECT topic_id, {DAY} AS date, count(*) AS msg_count FROM {DATED} GROUP BY 1, 2)"
MEMBERS = f"(SELECT DISTINCT topic_id, {DAY} AS date, chat_id FROM {DATED})"
SINCE = lambda n: f"date >= DATE '2025-06-30' - INTERVAL {n} DAY"
COUNTERS = f"""(SELECT l.topic_id, count(*) AS message_count, count(DISTINCT l.chat_id) AS channel_count, min(timestamp) AS first_seen_at, max(timestamp) AS last_seen_at
    FROM {LINKS} l LEFT JOIN {DATES} d ON l.chat_id = d.chat_id AND l.message_id = d.message_id GROUP BY 1)"""
BUSIEST = f"(SELECT topic_id FROM {LINKS} GROUP BY 1 ORDER BY count(*) DESC, topic_id LIMIT 1)"


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    return dated_links(spark, folder, distinct_links(spark, folder))


def _counters(spark: SparkSession, folder: str) -> DataFrame:
    return tp.topic_counters(distinct_links(spark, folder), _dated(spark, folder))


def _with_text(spark: SparkSession, folder: str, links: DataFrame) -> DataFrame:
    """Texts are joined only to the links that are left."""
    return links.join(distinct_messages(spark, folder, "text_plain").drop("timestamp"), ["chat_id", "message_id"])


def _busiest(spark: SparkSession, folder: str) -> DataFrame:
    links = distinct_links(spark, folder)
    top = links.groupBy("topic_id").count().orderBy(F.desc("count"), "topic_id").first()
    return links.where(F.col("topic_id") == (top.topic_id if top else -1))


@query(
    f"""SELECT d.topic_id, d.chat_id, d.message_id, d.relevance, d.timestamp, c.title AS chat_title
    FROM {DATED} d JOIN {CHATS} c ON d.chat_id = c.chat_id WHERE d.topic_id = {BUSIEST} ORDER BY relevance DESC NULLS LAST, timestamp DESC, chat_id, message_id LIMIT 50"""
)
def topic_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The first 50 sources of the busiest topic in known chats."""
    rows = dated_links(spark, folder, _busiest(spark, folder)).join(current_chats(spark, folder).select("chat_id", F.col("title").alias("chat_title")), "chat_id")
    columns = ["topic_id", "chat_id", "message_id", "relevance", "timestamp", "chat_title"]
    return rows.select(*columns).orderBy(F.desc_nulls_last("relevance"), F.desc("timestamp"), "chat_id", "message_id").limit(50)


@query(f"SELECT d.topic_id, d.chat_id, d.message_id, d.timestamp, coalesce(c.title, '') AS chat_title FROM {DATED} d LEFT JOIN {CHATS} c ON d.chat_id = c.chat_id")
def topic_messages_left(spark: SparkSession, folder: str) -> DataFrame:
    """All links with the title of their chat, '' where it is unknown."""
    chats = current_chats(spark, folder).select("chat_id", F.col("title").alias("chat_title"))
    return _dated(spark, folder).join(chats, "chat_id", "left").select("topic_id", "chat_id", "message_id", "timestamp", F.coalesce("chat_title", F.lit("")).alias("chat_title"))


@query(f"SELECT d.chat_id, d.message_id, d.timestamp, t.text AS text_plain FROM {DATED} d JOIN {DATES} t USING (chat_id, message_id) WHERE topic_id = {BUSIEST} ORDER BY d.timestamp DESC, d.chat_id, d.message_id LIMIT 20")
def topic_latest_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The newest messages of the busiest topic; texts are fetched for the page only."""
    newest = dated_links(spark, folder, _busiest(spark, folder)).orderBy(F.desc("timestamp"), "chat_id", "message_id").limit(20)
    return _with_text(spark, folder, newest).select("chat_id", "message_id", "timestamp", "text_plain")


@query(f"SELECT t.topic_id, t.title, coalesce(c.name, 'Uncategorized') AS category, c.name_ko AS category_ko FROM {TOPICS} t LEFT JOIN wiki_categories c USING (category_id)")
def topic_with_category(spark: SparkSession, folder: str) -> DataFrame:
    categories = table(spark, folder, "wiki_categories").select("category_id", "name", F.col("name_ko").alias("category_ko"))
    rows = current_topics(spark, folder).join(categories, "category_id", "left")
    return rows.select("topic_id", "title", F.coalesce("name", F.lit("Uncategorized")).alias("category"), "category_ko")


@query(
    f"""SELECT c.category_id, c.name, CAST(coalesce(sum(n.message_count), 0) AS BIGINT) AS messages, count(t.topic_id) AS topics,
        row_number() OVER (ORDER BY coalesce(sum(n.message_count), 0) DESC, c.name, c.category_id) AS position
    FROM wiki_categories c LEFT JOIN {TOPICS} t ON c.category_id = t.category_id LEFT JOIN {COUNTERS} n ON t.topic_id = n.topic_id GROUP BY 1, 2"""
)
def category_usage_order(spark: SparkSession, folder: str) -> DataFrame:
    """Categories by use, unused ones too."""
    topics = current_topics(spark, folder).select("topic_id", "category_id").join(_counters(spark, folder).select("topic_id", "message_count"), "topic_id", "left")
    used = topics.groupBy("category_id").agg(F.sum("message_count").alias("m"), F.count("topic_id").alias("t"))
    rows = table(spark, folder, "wiki_categories").join(used, "category_id", "left")
    zero = F.lit(0).cast("long")
    rows = rows.select("category_id", "name", F.coalesce("m", zero).alias("messages"), F.coalesce("t", zero).alias("topics"))
    return in_order(rows, F.desc("messages"), "name", "category_id")


@query(f"SELECT category_id, name, (SELECT count(*) FROM {TOPICS} t WHERE t.category_id = c.category_id) AS topics FROM wiki_categories c")
def category_topic_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = current_topics(spark, folder).groupBy("category_id").agg(F.count("*").alias("topics"))
    rows = table(spark, folder, "wiki_categories").join(n, "category_id", "left")
    return rows.select("category_id", "name", F.coalesce("topics", F.lit(0).cast("long")).alias("topics"))


@query(f"SELECT count(DISTINCT topic_id) AS topics, count(*) AS messages FROM {DATED} WHERE timestamp >= {AS_OF - 30 * 86400}")
def counts_since(spark: SparkSession, folder: str) -> DataFrame:
    return tp.counts_since(_dated(spark, folder), AS_OF - 30 * 86400)


@query(f"SELECT topic_id, message_count, channel_count, first_seen_at, last_seen_at FROM {COUNTERS}")
def topic_counters(spark: SparkSession, folder: str) -> DataFrame:
    return _counters(spark, folder)


@query(f"SELECT topic_id, date, msg_count FROM {DAILY}")
def daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return tp.daily_rollup(_dated(spark, folder))


@query(f"SELECT topic_id, date, chat_id FROM {MEMBERS}")
def daily_membership(spark: SparkSession, folder: str) -> DataFrame:
    return tp.daily_membership(_dated(spark, folder))


@query(f"SELECT topic_id, CAST(sum(msg_count) AS BIGINT) AS msgs_7d FROM {DAILY} WHERE {SINCE(7)} GROUP BY 1")
def window_msgs_7d(spark: SparkSession, folder: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(AS_OF))
    return tp.daily_rollup(_dated(spark, folder)).where(tp.since_days(F.col("date"), now, 7)).groupBy("topic_id").agg(F.sum("msg_count").alias("msgs_7d"))


@query(f"SELECT topic_id, count(DISTINCT chat_id) AS channels_7d FROM {MEMBERS} WHERE {SINCE(7)} GROUP BY 1")
def window_channels_7d(spark: SparkSession, folder: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(AS_OF))
    return tp.daily_membership(_dated(spark, folder)).where(tp.since_days(F.col("date"), now, 7)).groupBy("topic_id").agg(F.countDistinct("chat_id").alias("channels_7d"))


@query(f"SELECT DISTINCT topic_id FROM {DAILY} WHERE {SINCE(30)}")
def active_topics(spark: SparkSession, folder: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(AS_OF))
    return tp.daily_rollup(_dated(spark, folder)).where(tp.since_days(F.col("date"), now, 30)).select("topic_id").distinct()


@query(f"SELECT count(DISTINCT chat_id) AS channels FROM {MEMBERS}")
def active_channels(spark: SparkSession, folder: str) -> DataFrame:
    return tp.daily_membership(_dated(spark, folder)).agg(F.countDistinct("chat_id").alias("channels"))


_LAST = "(SELECT topic_id, chat_id, message_id, max(assigned_category) AS assigned_category FROM topic_messages GROUP BY 1, 2, 3)"


@query(
    f"""WITH v AS (SELECT topic_id, assigned_category, count(*) AS votes FROM {_LAST} GROUP BY 1, 2),
    n AS (SELECT topic_id, CAST(sum(votes) AS BIGINT) AS message_count FROM v GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY votes DESC, assigned_category) AS k FROM v WHERE assigned_category IS NOT NULL)
    SELECT topic_id, assigned_category AS category, votes, message_count FROM r JOIN n USING (topic_id) WHERE k = 1 AND message_count > 10 AND votes / message_count > 0.6"""
)
def majority_category(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "topic_messages").where("topic_id is not null and chat_id is not null and message_id is not null")
    return tp.majority_category(rows.groupBy("topic_id", "chat_id", "message_id").agg(F.max("assigned_category").alias("assigned_category")))


_SCORED = f"""(WITH s AS (SELECT topic_id, sum(msg_count) FILTER ({SINCE(1)}) AS d, sum(msg_count) AS w FROM {DAILY} WHERE {SINCE(7)} GROUP BY 1),
    c AS (SELECT topic_id, count(DISTINCT chat_id) AS ch FROM {MEMBERS} WHERE {SINCE(7)} GROUP BY 1), a AS (SELECT count(DISTINCT chat_id) AS total FROM {MEMBERS})
    SELECT t.topic_id, message_count, round(coalesce(d, 0) / greatest(coalesce(w, 0) / 7, 1.0) * exp(-0.1 * ({AS_OF} - coalesce(last_seen_at, 0)) / 3600)
        * log2(message_count + 1.0) * (coalesce(ch, 0) / greatest(total, 1.0)), 9) AS score
    FROM {COUNTERS} t LEFT JOIN s USING (topic_id) LEFT JOIN c USING (topic_id), a)"""


def _trending(spark: SparkSession, folder: str) -> DataFrame:
    dated = _dated(spark, folder)
    scored = tp.trending(_counters(spark, folder), tp.daily_rollup(dated), tp.daily_membership(dated), AS_OF)
    return scored.withColumn("score", F.round("score", 9))


@query(f"SELECT topic_id, message_count, score FROM {_SCORED}")
def trending_v1(spark: SparkSession, folder: str) -> DataFrame:
    return _trending(spark, folder)


@query(f"SELECT topic_id, score FROM {_SCORED} ORDER BY score DESC, topic_id LIMIT 40 OFFSET 40")
def trending_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of 40."""
    return _trending(spark, folder).select("topic_id", "score").orderBy(F.desc("score"), "topic_id").offset(40).limit(40)


@query(f"SELECT t.topic_id, score FROM {_SCORED} s JOIN {TOPICS} t USING (topic_id) WHERE category_id = (SELECT min(category_id) FROM wiki_categories WHERE lower(name) = 'shipping') ORDER BY score DESC, t.topic_id LIMIT 10")
def trending_in_category(spark: SparkSession, folder: str) -> DataFrame:
    """A category is named whatever its case; an unknown name gives no topics."""
    category = table(spark, folder, "wiki_categories").where(F.lower("name") == "shipping").groupBy().agg(F.min("category_id").alias("category_id"))
    topics = current_topics(spark, folder).select("topic_id", "category_id").join(F.broadcast(category), "category_id", "left_semi")
    return _trending(spark, folder).join(topics, "topic_id").select("topic_id", "score").orderBy(F.desc("score"), "topic_id").limit(10)


@query(f"SELECT topic_id FROM {COUNTERS} JOIN {TOPICS} t USING (topic_id) WHERE updated_at IS NULL OR last_seen_at > epoch(CAST(updated_at AS TIMESTAMP))")
def needs_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Topics that had a message since they were last written."""
    written = F.unix_timestamp(F.to_timestamp("updated_at", "yyyy-MM-dd HH:mm:ss"))
    rows = _counters(spark, folder).join(current_topics(spark, folder).select("topic_id", "updated_at"), "topic_id")
    return rows.where(F.col("updated_at").isNull() | (F.col("last_seen_at") > written)).select("topic_id")


@query(
    f"""WITH n AS (SELECT topic_id, (timestamp - {AS_OF - 86400 * 24}) // 86400 AS bucket, count(*) AS n FROM {DATED}
        WHERE timestamp >= {AS_OF - 86400 * 24} AND timestamp < {AS_OF} GROUP BY 1, 2)
    SELECT t.topic_id, CAST(b AS INTEGER) AS bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT topic_id FROM n) t CROSS JOIN range(24) g(b) LEFT JOIN n ON n.topic_id = t.topic_id AND n.bucket = b"""
)
def sparkline(spark: SparkSession, folder: str) -> DataFrame:
    """24 buckets of a day."""
    return tp.sparkline(_dated(spark, folder), AS_OF, 24, 86400)


@query(
    f"""SELECT chat_id, count(*) AS n, count(DISTINCT topic_id) AS topics FROM {DATED} WHERE timestamp >= {AS_OF - 7 * 86400} GROUP BY 1 HAVING count(*) >= 3"""
)
def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Chats with three links or more since they were last opened."""
    rows = _dated(spark, folder).where(F.col("timestamp") >= AS_OF - 7 * 86400).groupBy("chat_id")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("topic_id").alias("topics")).where("n >= 3")


@query(
    f"""WITH d AS (SELECT * FROM {DATED} WHERE timestamp >= {AS_OF - 86400 * 2} AND timestamp < {AS_OF}),
    g AS (SELECT topic_id, count(*) AS n FROM d GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, topic_id) AS k FROM g)
    SELECT topic_id, n, CAST(k AS INTEGER) AS position, (SELECT count(*) FROM g) AS topics, (SELECT count(*) FROM d) AS messages FROM r WHERE k <= 3"""
)
def today_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Topics and messages of the last days, and the three busiest topics."""
    n = _dated(spark, folder).where((F.col("timestamp") >= AS_OF - 86400 * 2) & (F.col("timestamp") < AS_OF)).groupBy("topic_id").agg(F.count("*").alias("n"))
    total = n.agg(F.count("*").alias("topics"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages")).first()
    top = n.orderBy(F.desc("n"), "topic_id").limit(3)
    top = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "topic_id")))
    return top.withColumn("topics", F.lit(total.topics).cast("long")).withColumn("messages", F.lit(total.messages).cast("long"))


@query(f"SELECT topic_id, title, lower(regexp_replace(title, '{WS}', '', 'g')) AS squeezed FROM {TOPICS} WHERE title IS NOT NULL")
def squeezed_titles(spark: SparkSession, folder: str) -> DataFrame:
    return current_topics(spark, folder).where("title is not null").select("topic_id", "title", F.lower(tx.strip_whitespace(F.col("title"))).alias("squeezed"))


def _ending(s: str, e: str) -> str:
    return f"CASE WHEN ends_with({s}, '{e}') AND octet_length(encode({s})) > {len(e) + 3} THEN left({s}, length({s}) - {len(e)}) ELSE {s} END"


_NORM = f"""(WITH s0 AS (SELECT topic_id, title, regexp_replace(lower(title), '{WS}', '', 'g') AS s FROM {TOPICS} WHERE title IS NOT NULL),
    s1 AS (SELECT topic_id, title, {_ending("s", "update")} AS s FROM s0), s2 AS (SELECT topic_id, title, {_ending("s", "news")} AS s FROM s1),
    s3 AS (SELECT topic_id, title, {_ending("s", "alert")} AS s FROM s2) SELECT topic_id, title, {_ending("s", "analysis")} AS alias FROM s3)"""


@query(f"SELECT alias, min(topic_id) AS topic_id FROM {_NORM} GROUP BY 1")
def alias_table(spark: SparkSession, folder: str) -> DataFrame:
    return tp.aliases(current_topics(spark, folder))


@query(f"SELECT t.topic_id AS raw_id, t.alias, a.topic_id FROM {_NORM} t JOIN (SELECT alias, min(topic_id) AS topic_id FROM {_NORM} GROUP BY 1) a USING (alias)")
def alias_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Each title by its alias."""
    topics = current_topics(spark, folder)
    raw = topics.where("title is not null").select(F.col("topic_id").alias("raw_id"), "title")
    return tp.resolve_alias(raw, "title", tp.aliases(topics)).select("raw_id", "alias", "topic_id")


@query(f"SELECT alias, min(topic_id) AS topic_id FROM {_NORM} WHERE starts_with(alias, 'mas') GROUP BY 1 ORDER BY 1, 2 LIMIT 20")
def similar_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return tp.similar_aliases(tp.aliases(current_topics(spark, folder)), "Mas ira News", 20)


_WORDS = "list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}'']'), lambda w: octet_length(encode(w)) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "], w)))"


@query(
    f"""WITH c AS (SELECT t.topic_id, {_WORDS} AS theirs FROM {TOPICS} t JOIN {COUNTERS} n USING (topic_id) WHERE message_count >= 2 AND title IS NOT NULL ORDER BY last_seen_at DESC NULLS LAST, t.topic_id LIMIT 500),
    m AS (SELECT topic_id AS raw_id, {_WORDS} AS mine FROM {TOPICS} t WHERE title IS NOT NULL),
    s AS (SELECT raw_id, topic_id, len(list_intersect(mine, theirs)) / least(len(mine), len(theirs)) AS score FROM m, c WHERE len(mine) >= 2 AND len(theirs) > 0 AND list_has_any(mine, theirs)),
    r AS (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY score DESC, topic_id) AS k FROM s WHERE score >= 0.6)
    SELECT raw_id, topic_id, round(score, 6) AS score FROM r WHERE k = 1"""
)
def fuzzy_best(spark: SparkSession, folder: str) -> DataFrame:
    """The topic among the 500 most recent that shares most words with each title."""
    topics = current_topics(spark, folder).where("title is not null")
    raw = topics.select(F.col("topic_id").alias("raw_id"), "title")
    return tp.fuzzy_topic(raw, "raw_id", "title", topics, _counters(spark, folder))


_RAW = "(SELECT DISTINCT assigned_category FROM topic_messages)"
_OWN = "CASE WHEN trim(coalesce(assigned_category, '')) = '' THEN 'other' ELSE lower(trim(assigned_category)) END"


@query(
    f"""WITH r AS (SELECT assigned_category, {_OWN} AS own FROM {_RAW}),
    e AS (SELECT assigned_category, own, (SELECT min(category_id) FROM wiki_categories WHERE lower(name) = own) AS x,
        (SELECT min(category_id) FROM wiki_categories WHERE contains(lower(name), own) OR contains(own, lower(name))) AS p FROM r)
    SELECT assigned_category, coalesce(x, p) AS category_id FROM e"""
)
def category_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Unevenly spelled category names, by name or by part."""
    raw = table(spark, folder, "topic_messages").select("assigned_category").distinct()
    return tp.resolve_category(raw, "assigned_category", table(spark, folder, "wiki_categories"))


def _title_sql(s: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split_regex({s}, '\\s+'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"


@query(
    f"""WITH r AS (SELECT DISTINCT trim(title) AS raw FROM {CHATS} WHERE trim(title) <> ''),
    n AS (SELECT DISTINCT {_title_sql("raw")} AS name FROM r WHERE NOT EXISTS (
        SELECT 1 FROM wiki_categories WHERE contains(lower(name), lower(raw)) OR contains(lower(raw), lower(name))))
    SELECT (SELECT max(category_id) FROM wiki_categories) + row_number() OVER (ORDER BY name) AS category_id, name FROM n"""
)
def category_create(spark: SparkSession, folder: str) -> DataFrame:
    """New categories for words that no category fits."""
    raw = current_chats(spark, folder).select(F.trim("title").alias("raw")).where("raw <> ''").distinct()
    categories = table(spark, folder, "wiki_categories")
    return tp.new_categories(tp.resolve_category(raw, "raw", categories), "raw", categories)


@query("SELECT topic_id, arg_min(title_ko, updated_at) FILTER (title_ko IS NOT NULL) AS title_ko FROM wiki_topics GROUP BY 1")
def first_nonnull(spark: SparkSession, folder: str) -> DataFrame:
    """The first title that was ever set."""
    rows = table(spark, folder, "wiki_topics")
    return rows.groupBy("topic_id").agg(F.min_by("title_ko", F.when(F.col("title_ko").isNotNull(), F.col("updated_at"))).alias("title_ko"))


@query(f"SELECT topic_id, len({_WORDS}) AS n_words FROM {TOPICS} WHERE title IS NOT NULL")
def significant_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_topics(spark, folder).where("title is not null")
    return rows.select("topic_id", F.size(F.array_distinct(tx.significant_words(F.col("title")))).cast("long").alias("n_words"))


@query(
    f"""WITH g AS (SELECT coalesce(c.name, 'Uncategorized') AS category, CAST(sum(message_count) AS BIGINT) AS n FROM {COUNTERS} JOIN {TOPICS} t USING (topic_id) LEFT JOIN wiki_categories c USING (category_id) GROUP BY 1)
    SELECT category, n, round(n / sum(n) OVER (), 6) AS share FROM g"""
)
def pct_of_total(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each category in all links."""
    n = _counters(spark, folder).join(topic_with_category(spark, folder), "topic_id").groupBy("category").agg(F.sum("message_count").alias("n"))
    return share_of_total(n, "n")


QUERIES, SQL = query.queries, query.sql
