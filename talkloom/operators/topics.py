"""Topic analytics: counters, daily rollups, windows, scores, categories, entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.dates import utc_day
from talkloom.functions.text import normalize_topic_title, overlap, significant_words, titlecase
from talkloom.operators.merge import next_ids


def topic_counters(links: DataFrame, dated: DataFrame) -> DataFrame:
    """Per topic message_count and channel_count from all links, first/last_seen_at from links whose message is known."""
    dates = dated.select("topic_id", "chat_id", "message_id", "timestamp")
    return links.join(dates, ["topic_id", "chat_id", "message_id"], "left").groupBy("topic_id").agg(
        F.count("*").alias("message_count"),
        F.countDistinct("chat_id").alias("channel_count"),
        F.min("timestamp").alias("first_seen_at"),
        F.max("timestamp").alias("last_seen_at"),
    )


def daily_rollup(dated: DataFrame) -> DataFrame:
    """(topic_id, date, msg_count) rebuilt from distinct links, so a replay changes nothing."""
    return dated.groupBy("topic_id", utc_day(F.col("timestamp")).alias("date")).agg(F.count("*").alias("msg_count"))


def daily_membership(dated: DataFrame) -> DataFrame:
    return dated.select("topic_id", utc_day(F.col("timestamp")).alias("date"), "chat_id").distinct()


def since_days(date: Column, as_of: Column, days: int) -> Column:
    """The last ``days`` calendar days and today."""
    return date >= F.date_sub(F.to_date(as_of), days)


def counts_since(dated: DataFrame, seconds: int) -> DataFrame:
    """One row: distinct topics and links since a time; zeros if there are none."""
    return dated.where(F.col("timestamp") >= seconds).agg(F.countDistinct("topic_id").alias("topics"), F.count("*").alias("messages"))


def trending_score(count: Column, last_seen: Column, day: Column, week: Column, channels: Column, all_channels: Column, now: Column) -> Column:
    """Velocity, recency, size and spread multiplied; 0 without messages."""
    recency = F.exp(F.lit(-0.1) * (now - F.coalesce(last_seen, F.lit(0))) / 3600)
    velocity = day / F.greatest(week / 7, F.lit(1.0))
    spread = channels / F.greatest(all_channels.cast("double"), F.lit(1.0))
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(0.0)).otherwise(velocity * recency * F.log2(count + 1.0) * spread)


def trending(counters: DataFrame, rollup: DataFrame, members: DataFrame, as_of: int) -> DataFrame:
    """(topic_id, message_count, score) of every topic with links. All sums come from the daily tables."""
    now = F.timestamp_seconds(F.lit(as_of))
    sums = rollup.where(since_days(F.col("date"), now, 7)).groupBy("topic_id").agg(
        F.sum(F.when(since_days(F.col("date"), now, 1), F.col("msg_count"))).alias("day"), F.sum("msg_count").alias("week")
    )
    spread = members.where(since_days(F.col("date"), now, 7)).groupBy("topic_id").agg(F.countDistinct("chat_id").alias("channels"))
    channels = members.agg(F.countDistinct("chat_id")).first()[0]
    zero = F.lit(0)
    joined = counters.join(sums, "topic_id", "left").join(spread, "topic_id", "left")
    score = trending_score(
        F.col("message_count"), F.col("last_seen_at"), F.coalesce("day", zero), F.coalesce("week", zero), F.coalesce("channels", zero), F.lit(channels), F.lit(as_of)
    )
    return joined.select("topic_id", "message_count", score.alias("score"))


def majority_category(links: DataFrame, least_count: int = 10, least_share: float = 0.6) -> DataFrame:
    """(topic_id, category, votes, message_count): the category of more than ``least_share`` of the links of topics with
    more than ``least_count``. Ties go to the first name. Null is no vote but counts in the share."""
    votes = links.groupBy("topic_id", "assigned_category").agg(F.count("*").alias("votes"))
    best = votes.groupBy("topic_id").agg(
        F.sum("votes").alias("message_count"),
        F.max(F.when(F.col("assigned_category").isNotNull(), F.col("votes"))).alias("votes"),
    )
    named = best.join(votes.where("assigned_category is not null").withColumnRenamed("votes", "v"), "topic_id").where("v = votes")
    first = named.groupBy("topic_id", "message_count", "votes").agg(F.min("assigned_category").alias("category"))
    return first.where((F.col("message_count") > least_count) & (F.col("votes") / F.col("message_count") > least_share)).select("topic_id", "category", "votes", "message_count")


def sparkline(dated: DataFrame, as_of: int, buckets: int = 24, width: int = 3600) -> DataFrame:
    """(topic_id, bucket, n) for each of the last ``buckets`` spans of ``width`` seconds, empty ones with 0; 0 is the oldest."""
    start = as_of - buckets * width
    seen = dated.where((F.col("timestamp") >= start) & (F.col("timestamp") < as_of))
    n = seen.groupBy("topic_id", F.floor((F.col("timestamp") - start) / width).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    grid = n.select("topic_id").distinct().select("topic_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return grid.join(n, ["topic_id", "bucket"], "left").select("topic_id", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def aliases(topics: DataFrame) -> DataFrame:
    """(alias, topic_id): each normalised title, held by the first topic that had it."""
    return topics.where("title is not null").groupBy(normalize_topic_title(F.col("title")).alias("alias")).agg(F.min("topic_id").alias("topic_id"))


def resolve_alias(raw: DataFrame, title: str, known: DataFrame) -> DataFrame:
    """``raw`` with the topic_id of its normalised title, null if unknown."""
    return raw.withColumn("alias", normalize_topic_title(F.col(title))).join(known, "alias", "left")


def similar_aliases(known: DataFrame, raw_title: str, limit: int) -> DataFrame:
    """Aliases that begin with the first syllable (or three Latin letters) of a title's normalised form."""
    import re

    s = re.sub(r"\s+", "", raw_title.lower())
    head = s.encode()[:3].decode("utf-8", "ignore")
    return known.where(F.col("alias").startswith(head)).orderBy("alias", "topic_id").limit(limit)


def fuzzy_topic(raw: DataFrame, key: str, title: str, topics: DataFrame, counters: DataFrame, candidates: int = 500, least: float = 0.6) -> DataFrame:
    """(key, topic_id, score): the best topic by word overlap for titles with two significant words or more.

    Only the ``candidates`` most recently seen topics with two messages or more are compared, as a
    feature; they are joined by their words, so no title meets a topic with which it shares none.
    """
    recent = topics.join(counters.where("message_count >= 2"), "topic_id").orderBy(F.col("last_seen_at").desc_nulls_last(), "topic_id").limit(candidates)
    recent = recent.select("topic_id", F.array_distinct(significant_words(F.col("title"))).alias("theirs"))
    mine = raw.select(key, F.array_distinct(significant_words(F.col(title))).alias("mine")).where("size(mine) >= 2")
    words = mine.select(key, "mine", F.explode("mine").alias("w")).join(F.broadcast(recent.select("topic_id", "theirs", F.explode("theirs").alias("w"))), "w")
    scored = words.select(key, "topic_id", overlap(F.col("mine"), F.col("theirs")).alias("score")).where(F.col("score") >= least)
    return scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "topic_id")).alias("b")).select(key, "b.topic_id", F.round(-F.col("b.s"), 6).alias("score"))


def _grams(text: Column) -> Column:
    """All substrings of one to three characters, and the empty one."""
    sized = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(F.concat(F.array(F.lit("")), sized(1), sized(2), sized(3)))


def _containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The columns of ``inner`` (i, ...) and ``outer`` (o, ...) for all pairs in which ``o`` contains ``i``. They meet by
    the first three characters of ``i`` (all, if fewer), so a string meets none with which it shares nothing."""
    a = inner.withColumn("_g", F.left("i", F.lit(3)))
    b = outer.withColumn("_g", F.explode(_grams(F.col("o"))))
    return a.join(b, "_g").where(F.col("o").contains(F.col("i"))).drop("_g")


def resolve_category(raw: DataFrame, column: str, categories: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """``raw`` with category_id: by synonym (alias, name), by name, or by the first category that contains the
    name or is contained in it; null if none fits. Empty and null names count as "Other".

    Names are compared once each, whatever the number of rows or categories: equal ones by a join, parts by a join on
    short substrings. Nothing is collected.
    """
    own = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    rows = raw.drop("category_id").withColumn("_own", F.when(own == "", "other").otherwise(own))
    names = rows.select("_own").distinct()
    if synonyms is not None:
        alias = synonyms.groupBy(F.lower("alias").alias("_own")).agg(F.min(F.lower("name")).alias("_name"))
        names = names.join(alias, "_own", "left").withColumn("_name", F.coalesce("_name", "_own"))
    else:
        names = names.withColumn("_name", F.col("_own"))
    known = categories.where("name is not null and category_id is not null").groupBy(F.lower("name").alias("_n")).agg(F.min("category_id").alias("k"))
    exact = names.join(known.withColumnsRenamed({"_n": "_name", "k": "_exact"}), "_name", "left")
    rest = exact.where("_exact is null").select("_own")
    inside = _containing(rest.select(F.col("_own").alias("i")), known.select(F.col("_n").alias("o"), "k")).select(F.col("i").alias("_own"), "k")
    around = _containing(known.select(F.col("_n").alias("i"), "k"), rest.select(F.col("_own").alias("o"))).select(F.col("o").alias("_own"), "k")
    part = inside.unionByName(around).groupBy("_own").agg(F.min("k").alias("_part"))
    found = exact.join(part, "_own", "left").select("_own", F.coalesce("_exact", "_part").alias("category_id"))
    return rows.join(found, "_own").drop("_own")


def new_categories(resolved: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """(category_id, name): ids for names that nothing fits, in the order of the names; folded on distinct names only."""
    highest = categories.agg(F.max("category_id")).first()[0] or 0
    names = resolved.where("category_id is null").select(titlecase(F.trim(F.col(column))).alias("name")).distinct()
    return next_ids(names, "category_id", highest, ["name"], 8).select("category_id", "name")
