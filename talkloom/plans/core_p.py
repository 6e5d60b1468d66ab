"""The general problems (1 and 7) as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators import deliveries, rolling
from talkloom.operators.links import dated_links, distinct_links
from talkloom.session import cut, scratch_dir
from talkloom.sources.tables import SCHEMAS

KEY, ORDER = ("chat_id", "message_id"), ("timestamp", "received_at", "batch_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return deliveries.redelivered(spark, f"{folder}/messages.parquet", SCHEMAS["messages"], KEY, ORDER)


def p1_dedup(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["chat_id", "message_id", "timestamp", "received_at", "text_plain"]
    return deliveries.deduplicate(spark, f"{folder}/messages.parquet", SCHEMAS["messages"], KEY, ORDER, columns)


def p7_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """A day is closed when it ends: messages that first arrived on a later UTC day than their own are corrections."""
    links = dated_links(spark, folder, distinct_links(spark, folder), arrival=True)
    day = F.to_date(F.timestamp_seconds("timestamp"))
    late = F.to_date("arrived") > day
    daily = (
        links.where("timestamp is not null")
        .groupBy(F.col("topic_id").alias("entity"), day.alias("day"))
        .agg(F.count_if(~F.coalesce(late, F.lit(False))).alias("on_time"), F.count_if(late).alias("late"))
    )
    state = rolling.rolling_state(spark, cut(daily, "p7-daily"), scratch_dir(spark, "p7-state"))
    return state.select(
        F.col("entity").alias("topic_id"),
        "day",
        F.col("amount").alias("n_links"),
        "total_7",
        "total_30",
        F.round(F.col("total_7") / 7, 6).alias("avg_7"),
        F.round(F.col("total_30") / 30, 6).alias("avg_30"),
    )


QUERIES = {"p1_found": p1_found, "p1_dedup": p1_dedup, "p7_rolling": p7_rolling}

SQL = {
    "p1_found": "SELECT chat_id, message_id FROM messages GROUP BY 1, 2 HAVING count(*) > 1",
    "p1_dedup": """
        SELECT chat_id, message_id, timestamp, received_at, text_plain FROM (
          SELECT *, row_number() OVER (PARTITION BY chat_id, message_id ORDER BY timestamp, received_at, batch_id) AS k FROM messages)
        WHERE k = 1""",
    "p7_rolling": """
        WITH dates AS (SELECT chat_id, message_id, min(timestamp) AS ts FROM messages GROUP BY 1, 2),
        links AS (SELECT DISTINCT topic_id, chat_id, message_id FROM topic_messages),
        daily AS (SELECT topic_id, CAST(to_timestamp(ts) AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n
                  FROM links JOIN dates USING (chat_id, message_id) GROUP BY 1, 2),
        span AS (SELECT topic_id, min(day) AS a, max(day) AS b FROM daily GROUP BY 1),
        days AS (SELECT topic_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
        full_days AS (SELECT d.topic_id, d.day, coalesce(n, 0) AS n FROM days d LEFT JOIN daily x ON d.topic_id = x.topic_id AND d.day = x.day),
        sums AS (SELECT topic_id, day, n,
            sum(n) OVER (PARTITION BY topic_id ORDER BY day ROWS 6 PRECEDING) AS t7,
            sum(n) OVER (PARTITION BY topic_id ORDER BY day ROWS 29 PRECEDING) AS t30 FROM full_days)
        SELECT topic_id, day, CAST(n AS BIGINT) AS n_links, CAST(t7 AS BIGINT) AS total_7, CAST(t30 AS BIGINT) AS total_30,
            round(t7 / 7, 6) AS avg_7, round(t30 / 30, 6) AS avg_30 FROM sums""",
}
