"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import text as tx
from talkloom.functions.hangul import FINALS, INITIALS, VOWELS, decompose_jamo, has_bare_jamo
from talkloom.operators import search
from talkloom.operators.lists import first_occurrence
from talkloom.operators.search_index import SearchIndex, index_of
from talkloom.plans.registry import Registry
from talkloom.sources.tables import current_chats, current_topics, table

query = Registry()

_list = lambda letters: "[" + ", ".join(f"'{x}'" for x in letters) + "]"
JAMO_SQL = (
    "array_to_string(list_transform(string_split(lower({t}), ''), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN "
    f"{_list(INITIALS)}[(unicode(c) - 44032) // 588 + 1] || {_list(VOWELS)}[(unicode(c) - 44032) % 588 // 28 + 1] || {_list(FINALS)}[(unicode(c) - 44032) % 28 + 1] ELSE c END), '')"
)
#: Unicode white space as DuckDB writes it.
WS = r"[\s\x0b\x{85}\p{Z}]"
CHATS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY coalesce(title, '') DESC, coalesce(chat_type, '') DESC, coalesce(username, '') DESC) AS k FROM chats) WHERE k = 1)"""
TOPICS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC) AS k FROM wiki_topics) WHERE k = 1)"""


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages").select("chat_id", "message_id", "timestamp", F.col("text_plain").alias("text"))


def _index(spark: SparkSession, folder: str) -> SearchIndex:
    return index_of(spark, _messages(spark, folder), f"{folder}/messages.parquet")


def _hits_sql(condition: str, scope: str = "") -> str:
    return f"SELECT chat_id, message_id, min(timestamp) AS timestamp, any_value(text_plain) AS text FROM messages WHERE ({condition}) {scope} GROUP BY 1, 2"


@query(_hits_sql(f"lower(text_plain) LIKE '%tariff%' AND lower(text_plain) LIKE '%on%' OR regexp_replace(lower(text_plain), '{WS}', '', 'g') LIKE '%tariffon%'"))
def search_variant_match(spark: SparkSession, folder: str) -> DataFrame:
    """All messages that match a query of two words, the second too short to be ranked by, or the words run together."""
    rows = _messages(spark, folder)
    forms = search.search_columns(F.col("text"))
    hit = search._contains([forms["content"]], "tariff") & search._contains([forms["content"]], "on") | search._contains([forms["nospace"]], "tariffon")
    return rows.where(hit).groupBy("chat_id", "message_id").agg(F.min("timestamp").alias("timestamp"), F.first("text").alias("text"))


def _bm25_sql(phrases: list[str], matched: str) -> str:
    occ = lambda c, p: f"((length({c}) - length(replace({c}, '{p}', ''))) / {len(p)})"
    tf = [f"({' + '.join(occ(c, p) for c in ('a', 'b', 'c'))})" for p in phrases]
    has = [f"({' OR '.join(f'contains({c}, $${p}$$)' for c in ('a', 'b', 'c'))})" for p in phrases]
    df = ", ".join(f"count(*) FILTER ({h}) AS n{k}" for k, h in enumerate(has))
    score = " + ".join(f"greatest(ln((n - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * len / d))" for k in range(len(phrases)))
    return f"""
    WITH r AS (SELECT chat_id, message_id, timestamp, text_plain AS text, lower(coalesce(text_plain, '')) AS a,
        {JAMO_SQL.format(t="coalesce(text_plain, '')")} AS b, regexp_replace(lower(coalesce(text_plain, '')), '{WS}', '', 'g') AS c FROM messages),
    m AS (SELECT *, greatest(length(a) - 2, 0) + greatest(length(b) - 2, 0) + greatest(length(c) - 2, 0) AS len,
        {", ".join(f"{t} AS t{k}" for k, t in enumerate(tf))}, {matched} AS hit FROM r),
    s AS (SELECT count(*) AS n, avg(len) AS d, {df} FROM m)
    SELECT chat_id, message_id, min(timestamp) AS timestamp, any_value(text) AS text, any_value(round(-({score}), 6)) AS rank,
        any_value(CAST({" + ".join(f"t{k}" for k in range(len(phrases)))} AS INTEGER)) AS tf_total FROM m, s WHERE hit GROUP BY 1, 2"""


_QUERY = "Turbine Exchange"
_PLAN = search.plan_query(_QUERY)
_any = lambda p: "(" + " OR ".join(f"contains({c}, $${p}$$)" for c in ("a", "b", "c")) + ")"
_MATCHED = " OR ".join("(" + " AND ".join(_any(t) for t in v) + ")" for v in _PLAN.variants)
_BM25 = _bm25_sql(_PLAN.phrases, _MATCHED)
_ORDERED = "ORDER BY rank, tf_total DESC, timestamp DESC, chat_id, message_id"


@query(
    f"""WITH m AS (SELECT greatest(length(a) - 2, 0) + greatest(length(b) - 2, 0) + greatest(length(c) - 2, 0) AS len FROM (SELECT lower(coalesce(text_plain, '')) AS a,
        {JAMO_SQL.format(t="coalesce(text_plain, '')")} AS b, regexp_replace(lower(coalesce(text_plain, '')), '{WS}', '', 'g') AS c FROM messages))
    SELECT count(*) AS n, round(avg(len), 6) AS mean_length FROM m"""
)
def search_index(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of the stored index, which is made if it is not there."""
    figures = _index(spark, folder).figures
    return spark.createDataFrame([(figures.n, figures.mean)], "n long, mean double").select("n", F.round("mean", 6).alias("mean_length"))


@query(_BM25)
def search_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """All ranked matches of a query."""
    return _index(spark, folder).bm25(_QUERY)


_KO = search.plan_query("반도체 수율")


@query(_bm25_sql(_KO.phrases, " OR ".join("(" + " AND ".join(_any(t) for t in v) + ")" for v in _KO.variants)))
def search_bm25_korean(spark: SparkSession, folder: str) -> DataFrame:
    """Korean terms, matched by their letters too."""
    return _index(spark, folder).bm25("반도체 수율")


_SCOPED = f"""WITH hits AS ({_BM25}), e AS (SELECT chat_id FROM {CHATS} WHERE is_excluded),
    kept AS (SELECT * FROM hits WHERE chat_id NOT IN (SELECT chat_id FROM e)), p AS (SELECT *, row_number() OVER ({_ORDERED}) AS position, count(*) OVER () AS total FROM kept)
    SELECT chat_id, message_id, timestamp, rank, tf_total"""


def _scoped(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus figures are those of all messages; the scope narrows what comes out."""
    return search.in_scope(_index(spark, folder).bm25(_QUERY), current_chats(spark, folder)).drop("text")


@query(f"{_SCOPED}, CAST(position AS INTEGER) AS position, total > 30 AS has_more FROM p WHERE position <= 30")
def search_page(spark: SparkSession, folder: str) -> DataFrame:
    """The first page outside excluded chats."""
    return search.page(_scoped(spark, folder))


@query(f"{_SCOPED}, CAST(position - 30 AS INTEGER) AS position, total > 60 AS has_more FROM p WHERE position > 30 AND position <= 60")
def search_keyset_page2(spark: SparkSession, folder: str) -> DataFrame:
    """The page behind the last row of the first one, found by its sort key."""
    hits = _scoped(spark, folder)
    last = search.page(hits).where("position = 30").first()
    if last is None:
        return search.page(hits).limit(0)
    return search.page(hits, cursor=[last[c] for c, _ in search.ORDER])


@query(_hits_sql(f"contains(lower(text_plain), 'ok') OR contains(regexp_replace(lower(text_plain), '{WS}', '', 'g'), 'ok')"))
def search_like(spark: SparkSession, folder: str) -> DataFrame:
    """A query too short for ranking: every term somewhere."""
    return _index(spark, folder).contains_all("ok")


@query(_hits_sql(f"contains(lower(text_plain), 'ㅅㅜㅇ') OR contains(regexp_replace(lower(text_plain), '{WS}', '', 'g'), 'ㅅㅜㅇ') OR contains({JAMO_SQL.format(t='text_plain')}, 'ㅅㅜㅇ')"))
def search_jamo(spark: SparkSession, folder: str) -> DataFrame:
    """Bare letters are found inside syllables."""
    return _index(spark, folder).contains_all("ㅅㅜㅇ")


_ONE = "(SELECT chat_id FROM messages GROUP BY 1 ORDER BY count(*) DESC, chat_id LIMIT 1)"


@query(_hits_sql("contains(lower(text_plain), 'tariff')", f"AND chat_id = {_ONE}"))
def search_in_chat(spark: SparkSession, folder: str) -> DataFrame:
    """The busiest chat only; without index, as the filter reaches the scan."""
    rows = _messages(spark, folder)
    chat = rows.groupBy("chat_id").count().orderBy(F.desc("count"), "chat_id").first()
    return search.contains_all(search.in_scope(rows, rows, chat.chat_id if chat else -1), "tariff")


@query()
def search_shaped(spark: SparkSession, folder: str) -> DataFrame:
    """A page with chat titles, links and highlights."""
    links = table(spark, folder, "messages").where("link is not null").groupBy("chat_id", "message_id").agg(F.max("link").alias("link"))
    hits = search.page(_index(spark, folder).bm25(_QUERY))
    return search.shaped(hits, current_chats(spark, folder), links, _QUERY)


@query(f"SELECT topic_id, title, title_ko FROM {TOPICS} WHERE contains(lower(title), 'exchange') OR contains(lower(title_ko), 'exchange')")
def topic_search(spark: SparkSession, folder: str) -> DataFrame:
    hit = lambda c: F.lower(c).contains("exchange")
    return current_topics(spark, folder).where(hit("title") | hit("title_ko")).select("topic_id", "title", "title_ko")


@query("SELECT doc_id, instr(lower(text), 'forecast') AS first_at FROM documents WHERE instr(lower(text), 'forecast') > 0")
def substring_range(spark: SparkSession, folder: str) -> DataFrame:
    at = tx.first_range(F.col("text"), "Forecast")
    return table(spark, folder, "documents").select("doc_id", at.cast("long").alias("first_at")).where("first_at is not null")


def _rating_sql(q: str) -> str:
    same = f"len(list_filter(range(1, {len(q) + 1}), lambda k: left(w, k) = left('{q}', k)))"
    longest = f"greatest(length(w), {len(q)})"
    return f"(CASE WHEN {same} > 0 THEN ({longest} - {same}) / {longest} ELSE 1.0 END)"


@query(
    f"""WITH w AS (SELECT topic_id, unnest(list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM {TOPICS} WHERE title IS NOT NULL)
    SELECT DISTINCT topic_id, w AS word FROM w WHERE {_rating_sql("logistic")} < 0.37 OR {_rating_sql("found")} < 0.37"""
)
def fuzzy_prefix_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_topics(spark, folder).select("topic_id", F.explode(tx.fuzzy_prefix_hits(F.col("title"), "logistic found")).alias("word"))
    return rows.distinct()


@query(
    f"""WITH q AS (SELECT unnest(['ьщещкы', translate('ьщещкы', '{tx.RUSSIAN_KEYS}', '{tx.ENGLISH_KEYS}')]) AS q)
    SELECT DISTINCT topic_id, title FROM {TOPICS} t, q WHERE contains(lower(title), q)"""
)
def keyboard_layout_search(spark: SparkSession, folder: str) -> DataFrame:
    """A query typed with the wrong layout is looked up both ways and the results are united without repeats."""
    typed = "ьщещкы"
    meant = typed.translate(str.maketrans(tx.RUSSIAN_KEYS, tx.ENGLISH_KEYS))
    topics = current_topics(spark, folder).select("topic_id", "title")
    parts = [topics.where(F.lower("title").contains(q)).withColumn("position", F.lit(k)) for k, q in enumerate((typed, meant))]
    return first_occurrence(parts[0].unionByName(parts[1]), ["topic_id"], ["position"]).drop("position")


@query(f"SELECT chat_id, title, username FROM {CHATS} WHERE chat_type <> 'private' AND (contains(lower(title), 'news') OR starts_with(lower(username), 'tu'))")
def member_search(spark: SparkSession, folder: str) -> DataFrame:
    """By a word of the title or the beginning of the handle."""
    hit = F.lower("title").contains("news") | F.lower("username").startswith("tu")
    return current_chats(spark, folder).where((F.col("chat_type") != "private") & hit).select("chat_id", "title", "username")


@query(
    f"""WITH e AS (SELECT chat_id, message_id, regexp_extract_all(text_plain, '{tx._EMOJI_UNIT}') AS all_ FROM messages),
    x AS (SELECT chat_id, message_id, unnest(all_) AS emoji, unnest(range(len(all_))) AS place FROM e)
    SELECT emoji, count(DISTINCT (chat_id, message_id)) AS n_messages, CAST(min(place) AS INTEGER) AS first_at FROM x GROUP BY 1"""
)
def emoji_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of the messages, each once, ordered by their first place, with how many messages hold them."""
    rows = table(spark, folder, "messages").select("chat_id", "message_id", F.posexplode(tx.extract_emoji(F.col("text_plain"))).alias("at", "emoji"))
    return rows.groupBy("emoji").agg(F.countDistinct("chat_id", "message_id").alias("n_messages"), F.min("at").alias("first_at"))


@query(f"SELECT DISTINCT chat_id, message_id, {JAMO_SQL.format(t='text_plain')} AS jamo FROM messages WHERE text_plain IS NOT NULL")
def jamo_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "messages").where("text_plain is not null")
    return rows.select("chat_id", "message_id", decompose_jamo(F.lower("text_plain")).alias("jamo")).distinct()


@query("SELECT DISTINCT chat_id, message_id FROM messages WHERE regexp_matches(text_plain, '[ㄱ-ㅎㅏ-ㅣ]')")
def bare_jamo_messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages").where(has_bare_jamo(F.col("text_plain"))).select("chat_id", "message_id").distinct()


QUERIES, SQL = query.queries, query.sql
