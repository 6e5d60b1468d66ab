"""Ordered-list, date and formatting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions import dates as dt
from talkloom.functions import text as tx
from talkloom.operators import lists as ls
from talkloom.operators.links import dated_links, distinct_links
from talkloom.plans.registry import Registry
from talkloom.plans.search_queries import CHATS, TOPICS
from talkloom.plans.topic_queries import AS_OF, DATED, LINKS
from talkloom.sources.tables import current_chats, current_topics, distinct_messages, table

query = Registry()
MESSAGES = "(SELECT chat_id, message_id, min(timestamp) AS timestamp, max(text_plain) AS text FROM messages GROUP BY 1, 2)"
UTC = "to_timestamp({}) AT TIME ZONE 'UTC'"


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_messages(spark, folder, "text_plain").withColumnRenamed("text_plain", "text")


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    return dated_links(spark, folder, distinct_links(spark, folder))


@query(
    f"""SELECT chat_id, message_id FROM (SELECT chat_id, message_id, sum(length(coalesce(text, ''))) OVER w AS s, row_number() OVER w AS k FROM {MESSAGES}
    WINDOW w AS (PARTITION BY chat_id ORDER BY timestamp, message_id ROWS UNBOUNDED PRECEDING)) WHERE s < 2500 AND k < 21"""
)
def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Of each chat the first messages within a budget of characters."""
    size = F.char_length(F.coalesce("text", F.lit("")))
    return ls.take_budget(_messages(spark, folder), ["chat_id"], [F.col("timestamp"), F.col("message_id")], size, 2500, 21).select("chat_id", "message_id")


@query(
    f"""WITH m AS (SELECT topic_id, chat_id, message_id, timestamp, last_day(CAST({UTC.format('timestamp')} AS DATE)) AS month FROM {DATED})
    SELECT topic_id, chat_id, message_id, month, coalesce(lead(month) OVER w <> month, true) AS header FROM m WINDOW w AS (PARTITION BY topic_id ORDER BY timestamp DESC, chat_id, message_id)"""
)
def month_headers(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.desc("timestamp"), F.col("chat_id"), F.col("message_id")]
    return ls.month_headers(_dated(spark, folder), ["topic_id"], order, dt.month_key(F.col("timestamp"))).select("topic_id", "chat_id", "message_id", "month", "header")


@query(f"SELECT chat_id, last_day(CAST({UTC.format('timestamp')} AS DATE)) AS month, count(*) AS n, max(timestamp) AS newest FROM {MESSAGES} GROUP BY 1, 2")
def month_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = distinct_messages(spark, folder)
    return rows.groupBy("chat_id", dt.month_key(F.col("timestamp")).alias("month")).agg(F.count("*").alias("n"), F.max("timestamp").alias("newest"))


@query("SELECT sender_id, arg_min(chat_id, (timestamp, chat_id, message_id)) AS chat_id FROM messages WHERE sender_id IS NOT NULL GROUP BY 1")
def ordered_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Each sender where it was seen first."""
    rows = table(spark, folder, "messages").where("sender_id is not null").select("sender_id", "chat_id", "timestamp", "message_id")
    return ls.first_occurrence(rows, ["sender_id"], ["timestamp", "chat_id", "message_id"]).select("sender_id", "chat_id")


@query(
    f"""WITH g AS (SELECT chat_id, count(*) AS n FROM {MESSAGES} GROUP BY 1)
    SELECT chat_id, n, greatest(0, (SELECT count(*) FROM g) - 10) AS more FROM g ORDER BY n DESC, chat_id LIMIT 10"""
)
def top10_more(spark: SparkSession, folder: str) -> DataFrame:
    n = distinct_messages(spark, folder).groupBy("chat_id").agg(F.count("*").alias("n"))
    return ls.top_and_more(n, [F.desc("n"), F.col("chat_id")])


@query(
    f"""SELECT chat_id, message_id, count(*) OVER (PARTITION BY chat_id ORDER BY timestamp RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM {MESSAGES}"""
)
def sliding_hour_count(spark: SparkSession, folder: str) -> DataFrame:
    return ls.sliding_count(distinct_messages(spark, folder), ["chat_id"], "timestamp", 3600).select("chat_id", "message_id", "recent")


_PIE = "(SELECT coalesce(chat_type, '') AS kind, count(*) AS n FROM (SELECT DISTINCT chat_id, message_id FROM messages) m LEFT JOIN " + CHATS + " c USING (chat_id) GROUP BY 1)"


@query(
    f"""WITH p AS (SELECT kind, n, CASE WHEN n < floor(sum(n) OVER () * 0.05) THEN CAST(floor(sum(n) OVER () * 0.05) AS BIGINT) ELSE n END AS r FROM {_PIE})
    SELECT kind, n, CAST(r - floor(sum(r - n) OVER () / count(*) OVER ()) AS BIGINT) AS drawn FROM p"""
)
def pie_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Messages by kind of chat, small slices raised to 5 %."""
    chats = current_chats(spark, folder).select("chat_id", "chat_type")
    rows = table(spark, folder, "messages").select("chat_id", "message_id").distinct().join(chats, "chat_id", "left")
    return ls.raise_small(rows.groupBy(F.coalesce("chat_type", F.lit("")).alias("kind")).agg(F.count("*").alias("n")), "n", 0.05)


@query(
    """SELECT media, CAST(sum(n) AS BIGINT) AS total FROM (SELECT unnest(['text', 'links', 'empty']) AS media,
        unnest([count(*) FILTER (coalesce(text_plain, '') <> '' AND link IS NULL), count(*) FILTER (link IS NOT NULL), count(*) FILTER (coalesce(text_plain, '') = '')]) AS n FROM messages) GROUP BY 1"""
)
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of totals turned into rows."""
    has = F.coalesce("text_plain", F.lit("")) != ""
    wide = table(spark, folder, "messages").agg(F.count_if(has & F.col("link").isNull()).alias("text"), F.count_if(F.col("link").isNotNull()).alias("links"), F.count_if(~has).alias("empty"))
    return wide.unpivot([], ["text", "links", "empty"], "media", "total")


@query(f"SELECT c.chat_id, row_number() OVER (ORDER BY last DESC NULLS LAST, c.chat_id) AS position FROM {CHATS} c LEFT JOIN (SELECT chat_id, max(timestamp) AS last FROM messages GROUP BY 1) m USING (chat_id)")
def presence_order(spark: SparkSession, folder: str) -> DataFrame:
    """Chats by their last message, silent ones last."""
    last = table(spark, folder, "messages").groupBy("chat_id").agg(F.max("timestamp").alias("last"))
    rows = current_chats(spark, folder).select("chat_id").join(last, "chat_id", "left")
    return ls.in_order(rows, F.desc_nulls_last("last"), "chat_id").select("chat_id", "position")


@query(
    f"""SELECT chat_id, title, row_number() OVER (ORDER BY NOT regexp_matches(coalesce(title, ''), '\\p{{L}}'), lower(coalesce(title, '')), chat_id) AS position FROM {CHATS}"""
)
def name_order(spark: SparkSession, folder: str) -> DataFrame:
    """Titles with letters first; numbers inside them by value."""
    title = F.coalesce("title", F.lit(""))
    return ls.in_order(current_chats(spark, folder).select("chat_id", "title"), ~title.rlike(r"\p{L}"), ls.natural_key(title), "chat_id")


@query("SELECT position, v.category_id, name FROM (SELECT unnest([9, 3, 99, 1]) AS category_id, unnest([0, 1, 2, 3]) AS position) v LEFT JOIN wiki_categories c USING (category_id)")
def enrich_in_list_order(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by a list of ids, in its order, unknown ones kept."""
    return ls.by_list(table(spark, folder, "wiki_categories").select("category_id", "name"), "category_id", [9, 3, 99, 1]).select("position", "category_id", "name")


@query("SELECT category_id, name, row_number() OVER (ORDER BY list_position([7, 2, 11], category_id) NULLS LAST, sort_order, category_id) AS position FROM wiki_categories")
def recents_first(spark: SparkSession, folder: str) -> DataFrame:
    at = F.nullif(F.array_position(F.array(*map(F.lit, (7, 2, 11))), F.col("category_id").cast("int")), F.lit(0))
    rows = table(spark, folder, "wiki_categories").select("category_id", "name", "sort_order")
    return ls.in_order(rows, at.asc_nulls_last(), F.col("sort_order").asc_nulls_last(), "category_id").drop("sort_order")


_ANCHOR = "(SELECT chat_id FROM messages GROUP BY 1 ORDER BY count(*) DESC, chat_id LIMIT 1)"


@query(
    f"""WITH m AS (SELECT message_id, timestamp FROM {MESSAGES} WHERE chat_id = {_ANCHOR}),
    a AS (SELECT * FROM m WHERE timestamp < 1746057600 ORDER BY timestamp DESC, message_id DESC LIMIT 20), b AS (SELECT * FROM m WHERE timestamp >= 1746057600 ORDER BY timestamp, message_id LIMIT 30)
    SELECT * FROM a UNION ALL SELECT * FROM b"""
)
def history_around(spark: SparkSession, folder: str) -> DataFrame:
    """The history of the busiest chat around a time."""
    rows = table(spark, folder, "messages")
    chat = rows.groupBy("chat_id").count().orderBy(F.desc("count"), "chat_id").first()
    own = distinct_messages(spark, folder).where(F.col("chat_id") == (chat.chat_id if chat else -1)).select("message_id", "timestamp")
    return ls.around(own, "timestamp", "message_id", (1746057600, -1), 20, 30)


@query(
    f"""WITH s AS (SELECT topic_id, category_id FROM {TOPICS} WHERE topic_id % 50 = 0), g AS (SELECT DISTINCT category_id FROM s WHERE category_id IS NOT NULL)
    SELECT topic_id, category_id FROM {TOPICS} WHERE topic_id % 50 = 0 OR category_id IN (SELECT category_id FROM g)"""
)
def expand_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Selected topics and all of their categories, each once."""
    rows = current_topics(spark, folder).select("topic_id", "category_id")
    return ls.expand_groups(rows, rows.where("topic_id % 50 = 0"), "topic_id", "category_id")


@query(
    f"""SELECT chat_id, message_id, sender_id FROM (SELECT chat_id, message_id, sender_id, lag(sender_id) OVER w AS before, row_number() OVER w AS k
        FROM (SELECT chat_id, message_id, max(sender_id) AS sender_id, min(timestamp) AS t FROM messages GROUP BY 1, 2) WINDOW w AS (PARTITION BY chat_id ORDER BY t, message_id))
    WHERE k = 1 OR sender_id IS DISTINCT FROM before"""
)
def distinct_until_changed(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with which another sender takes over."""
    rows = table(spark, folder, "messages").groupBy("chat_id", "message_id").agg(F.max("sender_id").alias("sender_id"), F.min("timestamp").alias("t"))
    return ls.changes_only(rows, ["chat_id"], ["t", "message_id"], "sender_id", F.floor(F.col("t") / 86400)).select("chat_id", "message_id", "sender_id")


@query(
    f"""SELECT chat_id, message_id, CASE WHEN d = 0 THEN strftime(t, '%H:%M') WHEN d BETWEEN 1 AND 6 THEN strftime(t, '%a') ELSE strftime(t, '%Y-%m-%d') END AS shown
    FROM (SELECT chat_id, message_id, {UTC.format('timestamp')} AS t, datediff('day', CAST({UTC.format('timestamp')} AS DATE), DATE '2025-06-30') AS d FROM {MESSAGES})"""
)
def relative_dates(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_messages(spark, folder).select("chat_id", "message_id", dt.relative_text(F.col("timestamp"), F.lit(AS_OF)).alias("shown"))


@query(
    f"""SELECT chat_id, CASE WHEN s // 3600 > 0 THEN CAST(s // 3600 AS VARCHAR) || ':' || printf('%02d:%02d', s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60 % 60, s % 60) END AS span
    FROM (SELECT chat_id, max(timestamp) - min(timestamp) AS s FROM messages GROUP BY 1)"""
)
def duration_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "messages").groupBy("chat_id").agg((F.max("timestamp") - F.min("timestamp")).alias("s"))
    return rows.select("chat_id", dt.duration_text(F.col("s")).alias("span"))


@query(
    f"""SELECT DISTINCT day, last_day(day) AS last, CAST(date_trunc('month', day + INTERVAL 1 MONTH) AS DATE) AS next_month, CAST((dayofweek(day) + 6) % 7 AS INTEGER) AS column_of
    FROM (SELECT CAST({UTC.format('timestamp')} AS DATE) AS day FROM messages)"""
)
def calendar_days(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "messages").select(dt.utc_day(F.col("timestamp")).alias("day")).distinct()
    return days.select("day", F.last_day("day").alias("last"), dt.month_step(F.col("day"), 1).alias("next_month"), dt.weekday_column(F.col("day")).alias("column_of"))


@query(
    f"""SELECT topic_id, CASE WHEN length(title) > 12 THEN left(title, 9) || '...' ELSE title END AS tail, CASE WHEN length(title) > 12 THEN '...' || right(title, 9) ELSE title END AS head,
        CASE WHEN length(title) > 12 THEN left(title, 4) || '...' || right(title, 5) ELSE title END AS middle FROM {TOPICS}"""
)
def shortened_titles(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("title")
    return current_topics(spark, folder).select("topic_id", *(tx.shorten(t, 12, m).alias(m) for m in ("tail", "head", "middle")))


@query(
    f"""SELECT chat_id, array_to_string(list_transform(list_filter(string_split_regex(title, '\\s+'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title FROM {CHATS} WHERE title IS NOT NULL"""
)
def title_case(spark: SparkSession, folder: str) -> DataFrame:
    return current_chats(spark, folder).where("title is not null").select("chat_id", tx.titlecase(F.col("title")).alias("title"))


@query()
def nfkc_title_norm(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by their normalised title: the latest of each."""
    rows = table(spark, folder, "wiki_topics").where("title_ko is not null").withColumn("norm", tx.title_norm(F.col("title_ko")))
    return rows.groupBy("norm").agg(F.max_by("topic_id", F.struct("updated_at", "topic_id")).alias("topic_id"), F.count("*").alias("n"))


def _field_sql(c: str) -> str:
    return f"printf('%08X', octet_length(encode(coalesce(CAST({c} AS VARCHAR), '')))) || hex(encode(coalesce(CAST({c} AS VARCHAR), '')))"


@query(f"SELECT topic_id, chat_id, message_id, upper(left(sha256(unhex({' || '.join(map(_field_sql, ('topic_id', 'message_id', 'chat_id', 'text')))})), 32)) AS hash FROM {DATED} d JOIN (SELECT chat_id, message_id, text FROM {MESSAGES}) m USING (chat_id, message_id)")
def evidence_hash(spark: SparkSession, folder: str) -> DataFrame:
    rows = _dated(spark, folder).join(_messages(spark, folder).drop("timestamp"), ["chat_id", "message_id"])
    return rows.select("topic_id", "chat_id", "message_id", F.hex(tx.evidence_hash(F.col("topic_id"), F.col("message_id"), F.col("chat_id"), F.col("text"))).alias("hash"))


@query(f"SELECT chat_id, message_id, regexp_replace(regexp_replace(text, '[🏻-🏿]', '', 'g'), '️', '', 'g') AS text FROM {MESSAGES} WHERE regexp_matches(text, '^\\s*(?:{tx._EMOJI_UNIT}\\s*)+$')")
def picture_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of nothing but pictures, without skin tones and variation marks."""
    rows = _messages(spark, folder).where(tx.only_emoji(F.col("text")))
    return rows.select("chat_id", "message_id", tx.strip_variation(tx.strip_skin_tone(F.col("text"))).alias("text"))


@query(f"SELECT topic_id, chat_id, message_id, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY timestamp DESC, chat_id, message_id) AS k FROM {DATED}) WHERE k <= 10")
def rewrite_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The newest ten pieces of evidence of each topic. Reduced where the rows are before the groups are formed."""
    # Ranked by an order that a window limit pushes down, so a large topic sends few rows.
    w = Window.partitionBy("topic_id").orderBy(F.desc("timestamp"), "chat_id", "message_id")
    return _dated(spark, folder).withColumn("k", F.row_number().over(w)).where("k <= 10").select("topic_id", "chat_id", "message_id", "k")


@query(f"SELECT t.topic_id, count(*) AS links, count(relevance) AS rated FROM {LINKS} l JOIN {TOPICS} t USING (topic_id) GROUP BY 1 HAVING count(relevance) > 0 AND any_value(t.title) IS NOT NULL")
def rated_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topics that are known, named and have a rated link."""
    known = current_topics(spark, folder).where("title is not null").select("topic_id")
    n = distinct_links(spark, folder).groupBy("topic_id").agg(F.count("*").alias("links"), F.count("relevance").alias("rated"))
    return n.where("rated > 0").join(known, "topic_id", "left_semi")


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """A field of a JSON payload."""
    rows = table(spark, folder, "events").select("event_type", F.from_json("props", "k string").alias("p"))
    return rows.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


QUERIES, SQL = query.queries, query.sql
