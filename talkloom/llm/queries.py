"""The queries of this subpackage with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm.canonical import canonicalise, standins
from talkloom.llm.contamination import contaminated
from talkloom.llm.mixture import Mixture
from talkloom.llm.names import entities, entity_pairs
from talkloom.llm.neardup import NearCopies
from talkloom.llm.pii import find_personal, redact_column
from talkloom.llm.spans import shared_pairs, shared_share, windows_of
from talkloom.llm.topn import top_n
from talkloom.operators.links import dated_links, distinct_links
from talkloom.sources.tables import table

#: Domains of the sources of these tables.
DOMAINS = {"channel_post": "feed", "group_thread": "feed", "news_digest": "reference", "wiki_page": "reference", "help_answer": "reference", "voice_transcript": "speech", "bot_log": "machine"}
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
    WITH dates AS (SELECT chat_id, message_id, min(timestamp) AS ts FROM messages GROUP BY 1, 2),
    links AS (SELECT topic_id, chat_id, message_id, max(relevance) AS relevance FROM topic_messages WHERE relevance IS NOT NULL GROUP BY 1, 2, 3)
    SELECT topic_id, chat_id, message_id FROM (
      SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY relevance DESC, ts DESC, chat_id, message_id) AS k
      FROM links JOIN dates USING (chat_id, message_id)) WHERE k <= 5""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    links = dated_links(spark, folder, distinct_links(spark, folder).where("relevance is not null"))
    order = [F.col("relevance").desc(), F.col("timestamp").desc(), F.col("chat_id").asc(), F.col("message_id").asc()]
    return top_n(links, ["topic_id"], order, 5).select("topic_id", "chat_id", "message_id")


@query()
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of a message agree in their text, so found rows are reduced to keys only after the scan."""
    messages = table(spark, folder, "messages").where("text_plain is not null").select("chat_id", F.col("message_id").alias("record_id"), F.col("text_plain").alias("t"))
    topics = table(spark, folder, "wiki_topics").where("title_ko is not null").select(F.lit(0).cast("long").alias("chat_id"), F.col("topic_id").alias("record_id"), F.col("title_ko").alias("t"))
    found = [standins(rows, "t").select(F.lit(kind).alias("record_kind"), "*") for kind, rows in (("message", messages), ("topic", topics))]
    return found[0].unionByName(found[1]).distinct()


@query()
def p6_canonical_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Every topic row with the consistent form of its Korean title."""
    return canonicalise(table(spark, folder, "wiki_topics").select("topic_id", "updated_at", "title_ko"), "title_ko", "title_form")


@query()
def p6_canonical_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every message row with the consistent form of its text."""
    return canonicalise(table(spark, folder, "messages").select("chat_id", "message_id", "batch_id", "text_plain"), "text_plain", "text_form").drop("text_plain")


def _shared(spark: SparkSession, folder: str) -> DataFrame:
    return windows_of(table(spark, folder, "documents"), "doc_id", "text", 200)


_SHARED = """WITH w AS (SELECT doc_id, k, substr(text, k, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS k FROM documents WHERE length(text) >= 200)),
    g AS (SELECT s FROM w GROUP BY 1 HAVING min(doc_id) <> max(doc_id)), m AS (SELECT w.* FROM w JOIN g USING (s))"""


@query(f"{_SHARED} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b USING (s) WHERE a.doc_id < b.doc_id")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_pairs(_shared(spark, folder)).select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


@query(
    f"""{_SHARED}, c AS (SELECT doc_id, least(200, coalesce(k - lag(k) OVER (PARTITION BY doc_id ORDER BY k), 200)) AS new FROM m),
    t AS (SELECT doc_id, CAST(sum(new) AS BIGINT) AS shared_chars FROM c GROUP BY 1)
    SELECT doc_id, length(coalesce(text, '')) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, round(coalesce(shared_chars, 0) / greatest(length(coalesce(text, '')), 1), 6) AS shared_share
    FROM documents LEFT JOIN t USING (doc_id)"""
)
def p10_shared_share(spark: SparkSession, folder: str) -> DataFrame:
    share = shared_share(_shared(spark, folder), table(spark, folder, "documents"), "doc_id", "text", 200)
    return share.withColumnRenamed("key", "doc_id")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "eval_items"), 50)


_REDUCED = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')"


@query(
    f"""WITH i AS (SELECT item_id, {_REDUCED} AS t FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {_REDUCED} AS t FROM documents WHERE text IS NOT NULL),
    iw AS (SELECT DISTINCT item_id, substr(t, k, 50) AS s FROM (SELECT item_id, t, unnest(range(1, length(t) - 48)) AS k FROM i WHERE length(t) >= 50)),
    dw AS (SELECT doc_id, substr(t, k, 50) AS s FROM (SELECT doc_id, t, unnest(range(1, length(t) - 48)) AS k FROM d WHERE length(t) >= 50))
    SELECT DISTINCT item_id, doc_id FROM iw JOIN dw USING (s)"""
)
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("item_id", "doc_id").distinct()


@query(
    f"""WITH i AS (SELECT item_id, {_REDUCED} AS t FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {_REDUCED} AS t FROM documents WHERE text IS NOT NULL),
    iw AS (SELECT item_id, k AS ik, substr(t, k, 50) AS s FROM (SELECT item_id, t, unnest(range(1, length(t) - 48)) AS k FROM i WHERE length(t) >= 50)),
    dw AS (SELECT doc_id, k AS dk, substr(t, k, 50) AS s FROM (SELECT doc_id, t, unnest(range(1, length(t) - 48)) AS k FROM d WHERE length(t) >= 50)),
    m AS (SELECT item_id, doc_id, ik, dk - ik AS diagonal FROM iw JOIN dw USING (s)),
    r AS (SELECT item_id, doc_id, count(*) + 49 AS run FROM (SELECT *, ik - row_number() OVER (PARTITION BY item_id, doc_id, diagonal ORDER BY ik) AS island FROM m) GROUP BY item_id, doc_id, diagonal, island),
    b AS (SELECT item_id, count(DISTINCT doc_id) AS n_docs, CAST(max(run) AS INTEGER) AS longest_run FROM r GROUP BY 1)
    SELECT item_id, n_docs, longest_run, CAST(length(t) AS INTEGER) AS item_chars, round(longest_run / length(t), 6) AS longest_share FROM b JOIN i USING (item_id)"""
)
def p8_leak_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per test item: in how many documents it leaked and the longest part found."""
    best = _leaks(spark, folder).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.max("run_chars").alias("longest_run"), F.max("item_chars").alias("item_chars")
    )
    return best.withColumn("longest_share", F.round(F.col("longest_run") / F.col("item_chars"), 6))


def _near_copies(spark: SparkSession, folder: str) -> NearCopies:
    return NearCopies(table(spark, folder, "messages"), ["chat_id", "message_id"], "text_plain", 5, 0.6, 130)


@query()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near_copies(spark, folder).pairs().select("chat_id_a", "message_id_a", "chat_id_b", "message_id_b")


@query()
def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _near_copies(spark, folder).classes()


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "messages").where("text_plain is not null").select("chat_id", "message_id", "text_plain")
    return find_personal(rows, "text_plain").distinct()


@query()
def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact_column(table(spark, folder, "messages").select("chat_id", "message_id", "text_plain"), "text_plain").drop("text_plain")


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    return Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), DOMAINS)


@query()
def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).drawn()


@query()
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).shares()


@query()
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return entity_pairs(entities(table(spark, folder, "wiki_topics")), "topic_id")


@query()
def p5_entities(spark: SparkSession, folder: str) -> DataFrame:
    return entities(table(spark, folder, "wiki_topics"))
