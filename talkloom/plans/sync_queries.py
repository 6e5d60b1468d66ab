"""Queries of mirrored state, evidence, caches and the remaining orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators import lists as ls
from talkloom.operators import merge, search, sync
from talkloom.operators import topics as tp
from talkloom.operators.links import dated_links, distinct_links
from talkloom.plans.registry import Registry
from talkloom.plans.search_queries import CHATS, TOPICS, _any, _bm25_sql
from talkloom.plans.store_queries import SPLIT
from talkloom.plans.topic_queries import _SCORED, AS_OF, COUNTERS, DATED, LINKS, _counters, _trending
from talkloom.sources.tables import current_chats, current_topics, distinct_messages, table

query = Registry()
KEY = ["chat_id", "message_id"]
#: Evidence up to two weeks before the end was seen by the last rewrite.
SEEN = AS_OF - 14 * 86400
GONE = "(SELECT chat_id, message_id, min(timestamp) AS timestamp, max(batch_id) AS version, CASE WHEN coalesce(max(text_plain), '') = '' THEN max(received_at) END AS deleted_at FROM messages GROUP BY 1, 2)"


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    return dated_links(spark, folder, distinct_links(spark, folder))


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with soft deletes: an empty text deletes at its last arrival."""
    rows = table(spark, folder, "messages").groupBy(*KEY)
    gone = F.when(F.coalesce(F.max("text_plain"), F.lit("")) == "", F.max("received_at"))
    return rows.agg(F.min("timestamp").alias("timestamp"), F.max("batch_id").alias("version"), gone.alias("deleted_at"))


def _split(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "messages").agg(F.max("batch_id") - 20).first()[0] or 0


@query(f"SELECT chat_id, message_id, timestamp, version FROM {GONE} WHERE deleted_at IS NULL")
def live_messages(spark: SparkSession, folder: str) -> DataFrame:
    return sync.live(_versions(spark, folder))


@query(f"SELECT chat_id, message_id, version FROM {GONE} WHERE deleted_at <= TIMESTAMP '2025-06-30 12:00:00' - INTERVAL 30 DAY AND version <= {SPLIT}")
def tombstones_to_compact(spark: SparkSession, folder: str) -> DataFrame:
    """Deletes older than 30 days that everybody has seen."""
    as_of = F.lit("2025-06-30 12:00:00").cast("timestamp_ntz")
    return sync.compactable(_versions(spark, folder), as_of, "version", F.lit(_split(spark, folder))).select(*KEY, "version")


_PAGES = "(SELECT 0 AS chat_id, doc_id AS message_id, 0 AS timestamp, text AS text_plain FROM documents WHERE source = 'wiki_page')"
_PAGE_PLAN = search.plan_query("exchange")
_PAGE_HITS = _bm25_sql(_PAGE_PLAN.phrases, " OR ".join("(" + " AND ".join(_any(t) for t in v) + ")" for v in _PAGE_PLAN.variants)).replace("FROM messages", f"FROM {_PAGES}")


@query(f"SELECT t.topic_id, t.title, h.rank FROM (SELECT * FROM ({_PAGE_HITS}) ORDER BY rank, tf_total DESC, message_id LIMIT 20) h JOIN {TOPICS} t ON t.topic_id = h.message_id")
def page_search_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best pages of a query, each with the topic it belongs to; pages without a topic drop out."""
    pages = table(spark, folder, "documents").where("source = 'wiki_page'").select(F.lit(0).cast("long").alias("chat_id"), F.col("doc_id").alias("message_id"), F.lit(0).cast("long").alias("timestamp"), "text")
    hits = search.bm25(pages, "exchange").orderBy("rank", F.desc("tf_total"), "message_id").limit(20)
    topics = current_topics(spark, folder).select("topic_id", "title")
    return hits.join(topics, hits.message_id == topics.topic_id).select("topic_id", "title", "rank")


@query(
    f"""SELECT t.topic_id, t.title, coalesce(s.score, 0) AS score FROM {TOPICS} t LEFT JOIN {_SCORED} s USING (topic_id)
    WHERE contains(lower(t.title), 'exchange') OR contains(lower(t.title_ko), 'exchange') ORDER BY score DESC, t.topic_id LIMIT 20"""
)
def topic_search_trending(spark: SparkSession, folder: str) -> DataFrame:
    """Topics by a part of their titles, the most trending first."""
    hit = lambda c: F.lower(c).contains("exchange")
    found = current_topics(spark, folder).where(hit("title") | hit("title_ko")).select("topic_id", "title")
    scored = found.join(_trending(spark, folder).select("topic_id", "score"), "topic_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.orderBy(F.desc("score"), "topic_id").limit(20)


@query(
    """SELECT m.chat_id, m.message_id, m.timestamp FROM (SELECT chat_id, message_id, min(timestamp) AS timestamp FROM messages GROUP BY 1, 2) m
    WHERE NOT EXISTS (SELECT 1 FROM topic_messages t WHERE t.chat_id = m.chat_id AND t.message_id = m.message_id) ORDER BY timestamp, chat_id, message_id LIMIT 100"""
)
def oldest_unlinked(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred messages that wait longest for a topic."""
    links = table(spark, folder, "topic_messages").select(*KEY)
    return distinct_messages(spark, folder).join(links, KEY, "left_anti").select(*KEY, "timestamp").orderBy("timestamp", *KEY).limit(100)


@query(
    """WITH m AS (SELECT chat_id, message_id, max(coalesce(text_plain, '')) AS t, max(link) AS link FROM messages GROUP BY 1, 2), l AS (SELECT DISTINCT chat_id, message_id, true AS has FROM topic_messages)
    SELECT count(*) FILTER (has) AS linked, count(*) FILTER (has IS NULL AND t <> '') AS waiting, count(*) FILTER (has IS NULL AND t = '') AS empty, count(*) FILTER (link IS NOT NULL) AS with_link, count(*) AS total
    FROM m LEFT JOIN l USING (chat_id, message_id)"""
)
def state_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Messages by state, all in one row; zeros for an empty table."""
    messages = table(spark, folder, "messages").groupBy(*KEY).agg(F.max(F.coalesce("text_plain", F.lit(""))).alias("t"), F.max("link").alias("link"))
    rows = messages.join(table(spark, folder, "topic_messages").select(*KEY).distinct().withColumn("has", F.lit(True)), KEY, "left")
    no = F.col("has").isNull()
    return rows.agg(
        F.count_if(F.col("has")).alias("linked"), F.count_if(no & (F.col("t") != "")).alias("waiting"), F.count_if(no & (F.col("t") == "")).alias("empty"), F.count_if(F.col("link").isNotNull()).alias("with_link"), F.count("*").alias("total")
    )


@query(
    """WITH g AS (SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'error'), -1) AS gone, max(event_id) AS last FROM events GROUP BY 1),
    e AS (SELECT events.*, gone FROM events JOIN g USING (user_id) WHERE event_id > gone)
    SELECT g.user_id, s.seen, p.spent, g.last AS event_id FROM g
    LEFT JOIN (SELECT user_id, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) AS seen FROM e WHERE event_type IN ('view', 'click') GROUP BY 1) s USING (user_id)
    LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS spent FROM e WHERE event_type = 'purchase' GROUP BY 1) p USING (user_id) WHERE g.last > g.gone"""
)
def apply_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's state after all events: what was seen last, what was spent last; an error clears it."""
    k = F.from_json("props", "k long")["k"]
    fields = {"seen": (("view", "click"), k), "spent": (("purchase",), F.col("value"))}
    return sync.apply_events(table(spark, folder, "events"), "user_id", "event_id", "event_type", fields, ("error",))


@query(
    f"""SELECT topic_id, chat_id, message_id, 'delta' AS part FROM {DATED} WHERE timestamp > {SEEN} UNION ALL
    SELECT topic_id, chat_id, message_id, 'rest' FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY relevance DESC NULLS LAST, timestamp DESC, chat_id, message_id) AS k FROM {DATED} WHERE timestamp <= {SEEN}) WHERE k <= 10"""
)
def evidence_delta(spark: SparkSession, folder: str) -> DataFrame:
    """What is new since the last rewrite, and the ten best of what is not."""
    best = [F.desc_nulls_last("relevance"), F.desc("timestamp"), F.col("chat_id"), F.col("message_id")]
    return sync.rewrite_evidence(_dated(spark, folder), "topic_id", "timestamp", F.lit(SEEN), best, 10).select("topic_id", *KEY, "part")


@query(f"SELECT d.topic_id, chat_id, message_id FROM {DATED} d LEFT JOIN (SELECT topic_id, max(timestamp) AS bound FROM {DATED} WHERE timestamp <= {SEEN} GROUP BY 1) b USING (topic_id) WHERE bound IS NULL OR timestamp > bound")
def evidence_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence that came after the snapshot of the rewrite of its topic."""
    rows = _dated(spark, folder)
    bounds = rows.where(F.col("timestamp") <= SEEN).groupBy("topic_id").agg(F.max("timestamp").alias("bound"))
    return sync.sweep(rows, bounds, "topic_id", "timestamp").select("topic_id", *KEY)


def _cache_sql(condition: str, less: int) -> str:
    return f"(SELECT chat_id, batch_id, count(*) AS n, max(max(batch_id)) OVER (PARTITION BY chat_id) - {less} AS mark FROM messages WHERE batch_id {condition} {SPLIT} GROUP BY 1, 2)"


@query(
    f"""WITH c AS {_cache_sql("<", 0)}, i AS {_cache_sql(">=", 10)},
    w AS (SELECT chat_id FROM (SELECT chat_id, max(mark) AS n FROM i GROUP BY 1) LEFT JOIN (SELECT chat_id, max(mark) AS o FROM c GROUP BY 1) USING (chat_id) WHERE o IS NULL OR n > o)
    SELECT * FROM c WHERE chat_id NOT IN (SELECT chat_id FROM w) UNION ALL SELECT * FROM i WHERE chat_id IN (SELECT chat_id FROM w)"""
)
def cache_replaced_if_newer(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per chat and batch; a chat's cached ones go only for newer ones."""
    split, rows = _split(spark, folder), table(spark, folder, "messages")

    def counts(which, less: int) -> DataFrame:
        n = rows.where(which).groupBy("chat_id", "batch_id").agg(F.count("*").alias("n"))
        marks = rows.where(which).groupBy("chat_id").agg((F.max("batch_id") - less).alias("mark"))
        return n.join(marks, "chat_id").select("chat_id", "batch_id", "n", "mark")

    return sync.replace_if_newer(counts(F.col("batch_id") < split, 0), counts(F.col("batch_id") >= split, 10), "chat_id", "mark")


@query(
    f"""WITH t AS (SELECT topic_id, title, title_ko FROM {TOPICS} WHERE title IS NOT NULL AND title_ko IS NOT NULL),
    r AS (SELECT topic_id, row_number() OVER (ORDER BY title, topic_id) - 1 AS o, row_number() OVER (ORDER BY title_ko, topic_id) - 1 AS n FROM t)
    SELECT topic_id, 'M' AS op, CAST(o AS INTEGER) AS old_index, CAST(n AS INTEGER) AS new_index FROM r WHERE o <> n"""
)
def keyed_list_moves(spark: SparkSession, folder: str) -> DataFrame:
    """The same topics in the order of either title: what moved."""
    rows = current_topics(spark, folder).where("title is not null and title_ko is not null").select("topic_id", "title", "title_ko")
    return merge.diff(rows, rows, ["topic_id"], ["title", "topic_id"], 8, ["title_ko", "topic_id"])


@query(
    f"""WITH v AS (SELECT topic_id, assigned_category, count(*) AS votes FROM (SELECT topic_id, chat_id, message_id, max(assigned_category) AS assigned_category FROM topic_messages GROUP BY 1, 2, 3) GROUP BY 1, 2),
    n AS (SELECT topic_id, sum(votes) AS total FROM v GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY votes DESC, assigned_category) AS k FROM v WHERE assigned_category IS NOT NULL),
    m AS (SELECT topic_id, lower(trim(assigned_category)) AS c FROM r JOIN n USING (topic_id) WHERE k = 1 AND total > 10 AND votes / total > 0.6)
    SELECT t.topic_id, coalesce((SELECT min(category_id) FROM wiki_categories WHERE lower(name) = c), t.category_id) AS category_id FROM {TOPICS} t LEFT JOIN m USING (topic_id)"""
)
def category_set_by_majority(spark: SparkSession, folder: str) -> DataFrame:
    """Topics with the category that most of their links name, where one is named so; others keep theirs."""
    rows = table(spark, folder, "topic_messages").where("topic_id is not null and chat_id is not null and message_id is not null")
    votes = tp.majority_category(rows.groupBy("topic_id", *KEY).agg(F.max("assigned_category").alias("assigned_category")))
    named = table(spark, folder, "wiki_categories").groupBy(F.lower("name").alias("c")).agg(F.min("category_id").alias("category_id"))
    new = votes.select("topic_id", F.lower(F.trim("category")).alias("c")).join(named, "c").select("topic_id", "category_id")
    return merge.partial_update(current_topics(spark, folder).select("topic_id", "category_id"), new, ["topic_id"])


@query(f"SELECT topic_id, arg_min(chat_id, (timestamp, chat_id, message_id)) AS chat_id, arg_min(message_id, (timestamp, chat_id, message_id)) AS message_id, 1 AS version FROM {DATED} d JOIN (SELECT chat_id, message_id, max(text_plain) AS text FROM messages GROUP BY 1, 2) t USING (chat_id, message_id) GROUP BY topic_id, coalesce(text, '')")
def citations_frozen(spark: SparkSession, folder: str) -> DataFrame:
    """The messages that a page cites: of equal texts the first."""
    rows = _dated(spark, folder).join(distinct_messages(spark, folder, "text_plain").drop("timestamp"), KEY)
    return sync.freeze_citations(rows, "topic_id", "text_plain", ["timestamp"], KEY, 1)


@query(
    f"""WITH u AS (SELECT chat_id, count(*) FILTER (batch_id >= {SPLIT}) - count(*) FILTER (batch_id < {SPLIT} AND timestamp >= {SEEN}) AS unread FROM messages GROUP BY 1)
    SELECT coalesce(chat_type, '') AS kind, CAST(sum(greatest(unread, 0)) AS BIGINT) AS unread FROM u LEFT JOIN {CHATS} c USING (chat_id) GROUP BY 1"""
)
def unread_clipped(spark: SparkSession, folder: str) -> DataFrame:
    """Unread messages by kind of chat; a chat that was read ahead counts as none."""
    split = _split(spark, folder)
    new, old = F.count_if(F.col("batch_id") >= split), F.count_if((F.col("batch_id") < split) & (F.col("timestamp") >= SEEN))
    n = table(spark, folder, "messages").groupBy("chat_id").agg((new - old).alias("unread"))
    kinds = current_chats(spark, folder).select("chat_id", "chat_type")
    return n.join(kinds, "chat_id", "left").groupBy(F.coalesce("chat_type", F.lit("")).alias("kind")).agg(F.sum(F.greatest("unread", F.lit(0))).alias("unread"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id DESC LIMIT 50")
def largest_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), F.desc("doc_id")).limit(50)


_LAST = "(SELECT chat_id, CAST(sum(length(coalesce(text_plain, ''))) AS BIGINT) AS total, max(timestamp) AS last FROM messages GROUP BY 1)"


def _use(spark: SparkSession, folder: str) -> DataFrame:
    use = table(spark, folder, "messages").groupBy("chat_id").agg(F.sum(F.char_length(F.coalesce("text_plain", F.lit("")))).alias("total"), F.max("timestamp").alias("last"))
    return current_chats(spark, folder).join(use, "chat_id", "left")


@query(f"SELECT c.chat_id, total, row_number() OVER (ORDER BY total DESC NULLS LAST, title DESC NULLS LAST, c.chat_id DESC) AS position FROM {CHATS} c LEFT JOIN {_LAST} u USING (chat_id)")
def chat_storage_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = _use(spark, folder).select("chat_id", "title", "total")
    return ls.in_order(rows, F.desc_nulls_last("total"), F.desc_nulls_last("title"), F.desc("chat_id")).drop("title")


@query(f"SELECT c.chat_id, row_number() OVER (ORDER BY coalesce(last >= {AS_OF - 86400}, false) DESC, last DESC NULLS LAST, c.chat_id) AS position FROM {CHATS} c LEFT JOIN {_LAST} u USING (chat_id)")
def active_first(spark: SparkSession, folder: str) -> DataFrame:
    """Chats that are being written in, then by presence."""
    active = F.coalesce(F.col("last") >= AS_OF - 86400, F.lit(False))
    return ls.in_order(_use(spark, folder).select("chat_id", "last"), active.desc(), F.desc_nulls_last("last"), "chat_id").drop("last")


@query(f"SELECT chat_id, row_number() OVER (ORDER BY is_excluded NULLS LAST, username IS NULL, access_hash DESC NULLS LAST, chat_id) AS position FROM {CHATS}")
def fetch_order(spark: SparkSession, folder: str) -> DataFrame:
    """A sort by several keys of which some may be null."""
    rows = current_chats(spark, folder).select("chat_id", "is_excluded", "username", "access_hash")
    return ls.in_order(rows, F.asc_nulls_last("is_excluded"), F.col("username").isNull().asc(), F.desc_nulls_last("access_hash"), "chat_id").select("chat_id", "position")


@query(f"SELECT topic_id, row_number() OVER (ORDER BY sort_order NULLS LAST, updated_at DESC NULLS LAST, topic_id) AS position FROM {TOPICS} LEFT JOIN wiki_categories c USING (category_id)")
def pinned_first(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of placed categories in their order, then the newest."""
    pins = table(spark, folder, "wiki_categories").select("category_id", "sort_order")
    rows = current_topics(spark, folder).join(pins, "category_id", "left").select("topic_id", "sort_order", "updated_at")
    return ls.in_order(rows, F.asc_nulls_last("sort_order"), F.desc_nulls_last("updated_at"), "topic_id").select("topic_id", "position")


@query(
    f"""WITH w AS (SELECT topic_id, title, list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM {TOPICS} WHERE title IS NOT NULL)
    SELECT topic_id, title FROM w WHERE len(list_filter(words, lambda x: starts_with(x, 'ma'))) > 0 AND len(list_filter(words, lambda x: starts_with(x, 'ex'))) > 0
    ORDER BY NOT (list_contains(words, 'ma') AND list_contains(words, 'ex')), len(words) >= 3, NOT starts_with(words[1], 'm'), title, topic_id LIMIT 20"""
)
def shortcode_completion(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of which every typed beginning starts a word: whole words first, then short entries, then those that begin alike."""
    typed = ["ma", "ex"]
    rows = current_topics(spark, folder).where("title is not null").select("topic_id", "title")
    words = F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = rows.withColumn("w", words)
    begins = lambda t: F.exists("w", lambda w: w.startswith(t))
    rows = rows.where(begins(typed[0]) & begins(typed[1]))
    whole = F.forall(F.array(*map(F.lit, typed)), lambda t: F.array_contains(F.col("w"), t))
    return rows.orderBy((~whole).asc(), (F.size("w") >= 3).asc(), (~F.get("w", F.lit(0)).startswith(typed[0][0])).asc(), "title", "topic_id").limit(20).drop("w")


@query(
    """WITH a AS (SELECT lower(name_ko) AS alias, min(lower(name)) AS name FROM wiki_categories WHERE name_ko IS NOT NULL GROUP BY 1), r AS (SELECT name_ko AS raw FROM wiki_categories UNION SELECT name FROM wiki_categories),
    o AS (SELECT raw, CASE WHEN trim(coalesce(raw, '')) = '' THEN 'other' ELSE lower(trim(raw)) END AS own FROM r), e AS (SELECT raw, own, coalesce(a.name, own) AS name FROM o LEFT JOIN a ON a.alias = own)
    SELECT raw, coalesce((SELECT min(category_id) FROM wiki_categories c WHERE lower(c.name) = e.name), (SELECT min(category_id) FROM wiki_categories c WHERE contains(lower(c.name), own) OR contains(own, lower(c.name)))) AS category_id FROM e"""
)
def category_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Names in either language, by a table of aliases."""
    known = table(spark, folder, "wiki_categories")
    raw = known.select(F.col("name_ko").alias("raw")).unionByName(known.select(F.col("name").alias("raw"))).distinct()
    aliases = known.where("name_ko is not null").select(F.col("name_ko").alias("alias"), "name")
    return tp.resolve_category(raw, "raw", known, aliases)


@query(
    f"""WITH o AS (SELECT chat_id, max(timestamp) AS opened FROM messages WHERE batch_id < {SPLIT} GROUP BY 1)
    SELECT d.chat_id, count(*) AS n, count(DISTINCT topic_id) AS topics FROM {DATED} d JOIN o USING (chat_id) JOIN {CHATS} c USING (chat_id)
    WHERE d.timestamp > opened - {7 * 86400} AND NOT is_excluded GROUP BY 1 HAVING count(*) >= 3"""
)
def digest_since_opened(spark: SparkSession, folder: str) -> DataFrame:
    """Of chats that aren't excluded, the links of the week before each was last open and after it, three or more."""
    rows, split = table(spark, folder, "messages"), _split(spark, folder)
    opened = rows.where(F.col("batch_id") < split).groupBy("chat_id").agg(F.max("timestamp").alias("opened"))
    shown = current_chats(spark, folder).where("not is_excluded").select("chat_id").join(opened, "chat_id")
    new = _dated(spark, folder).join(shown, "chat_id").where(F.col("timestamp") > F.col("opened") - 7 * 86400)
    return new.groupBy("chat_id").agg(F.count("*").alias("n"), F.countDistinct("topic_id").alias("topics")).where("n >= 3")


@query(
    f"""WITH d AS (SELECT topic_id, count(*) AS n FROM {DATED} WHERE timestamp >= 1751155200 AND timestamp < 1751241600 GROUP BY 1)
    SELECT d.topic_id, n, score FROM d JOIN {_SCORED} s USING (topic_id) ORDER BY score DESC, d.topic_id LIMIT 3"""
)
def today_by_trending(spark: SparkSession, folder: str) -> DataFrame:
    """The three most trending of the topics touched between two midnights."""
    n = _dated(spark, folder).where("timestamp >= 1751155200 and timestamp < 1751241600").groupBy("topic_id").agg(F.count("*").alias("n"))
    return n.join(_trending(spark, folder).select("topic_id", "score"), "topic_id").orderBy(F.desc("score"), "topic_id").limit(3)


@query(f"SELECT chat_id, title FROM {CHATS} WHERE NOT is_excluded AND (len(list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda w: starts_with(w, 'tu'))) > 0 OR starts_with(lower(username), 'tu'))")
def member_token_search(spark: SparkSession, folder: str) -> DataFrame:
    """By the beginning of a word of the name or of the handle."""
    words = F.split(F.lower("title"), r"[^\p{L}\p{N}]+")
    hit = F.coalesce(F.exists(words, lambda w: w.startswith("tu")), F.lit(False)) | F.coalesce(F.lower("username").startswith("tu"), F.lit(False))
    return current_chats(spark, folder).where("not is_excluded").where(hit).select("chat_id", "title")


@query(
    f"""WITH k AS (SELECT * FROM {LINKS} WHERE chat_id NOT IN (SELECT chat_id FROM {CHATS} WHERE is_excluded))
    SELECT topic_id, title FROM {TOPICS} t WHERE topic_id IN (SELECT topic_id FROM k) OR topic_id NOT IN (SELECT topic_id FROM {LINKS})"""
)
def topics_after_purge(spark: SparkSession, folder: str) -> DataFrame:
    """Topics that are left once excluded chats are purged with all that came from them."""
    out = current_chats(spark, folder).where("is_excluded")
    topics = current_topics(spark, folder).select("topic_id", "title")
    return sync.purge_cascade(table(spark, folder, "messages"), distinct_links(spark, folder), topics, out)[2]


@query(f"SELECT t.topic_id, t.title, coalesce(n.message_count, 0) AS messages FROM {TOPICS} t LEFT JOIN {COUNTERS} n USING (topic_id) WHERE coalesce(n.message_count, 0) = 0 OR n.last_seen_at IS NULL")
def topics_without_messages(spark: SparkSession, folder: str) -> DataFrame:
    counters = _counters(spark, folder).select("topic_id", "message_count", "last_seen_at")
    rows = current_topics(spark, folder).join(counters, "topic_id", "left")
    return rows.where("message_count is null or last_seen_at is null").select("topic_id", "title", F.coalesce("message_count", F.lit(0).cast("long")).alias("messages"))


QUERIES, SQL = query.queries, query.sql
