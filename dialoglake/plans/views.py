"""Views of the given tables in the shape the operators take, in Spark and as the matching SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglake.operators.dialogue import assign_turns

# Latin lexicons that hit in the given tables.
RISK = {"R2": ["der", "ción"], "R1": ["que"]}
EMOTION = {"calm": ["thatthe", "ruhe"], "sad": ["ouan", "enst"], "glad": ["anth", "erer"]}
DOMAIN = ["the", "and"]
TOPICS = {"en": ["the"], "de": ["und"], "fr": ["les"], "es": ["los"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of user and assistant as stored messages of 20 users."""
    t = assign_turns(turns(spark, sf).where("role <> 'system'"))
    mid = lambda c: F.col("conv_id") * 100 + F.col(c)
    return t.select(
        mid("turn").alias("message_id"), (F.col("conv_id") % 20).alias("user_id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), "position",
        (F.lit(1_700_000_000).cast("long") + F.col("conv_id") * 3600 + F.col("turn")).alias("created_at"), mid("turn_id").alias("turn_id"), mid("reply_to").alias("reply_to_message_id"),
        F.lit(True).alias("retrievable"), F.lit(True).alias("visible_to_user"), (mid("turn") % 37 != 0).alias("is_final"), (mid("turn") % 41 == 0).alias("is_deleted"),
    )


MESSAGES_SQL = """
msgs AS (
    SELECT conv_id * 100 + turn AS message_id, conv_id % 20 AS user_id, conv_id AS conversation_id, role, text AS content,
        row_number() OVER w AS position, 1700000000 + conv_id * 3600 + turn AS created_at,
        conv_id * 100 + coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w, turn) AS turn_id,
        CASE WHEN role = 'assistant' THEN conv_id * 100 + last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w END AS reply_to_message_id,
        (conv_id * 100 + turn) % 37 <> 0 AS is_final, (conv_id * 100 + turn) % 41 = 0 AS is_deleted
    FROM conversations WHERE role <> 'system'
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

_CJK_SQL = "len(regexp_extract_all({0}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'))"
TOKENS_SQL = f"CASE WHEN length({{0}}) = 0 THEN 0 ELSE greatest(1, {_CJK_SQL} + CAST(ceil((length({{0}}) - {_CJK_SQL}) / 3.0) AS BIGINT)) END"


def units(spark: SparkSession, sf: str) -> DataFrame:
    from dialoglake.operators.memory import index_units

    return index_units(messages(spark, sf).where("not is_deleted"))


def turn_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    consult = F.col("event_type").isin("error", "purchase")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") * 7 + F.col("event_id") % 7).alias("conversation_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"),
        consult.cast("int").alias("is_consult"), F.when(consult, "consult").otherwise("chat").alias("route"),
    )


METRICS_SQL = """
turn_metrics AS (
    SELECT event_id AS id, user_id * 7 + event_id % 7 AS conversation_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at,
        CAST(event_type IN ('error', 'purchase') AS INTEGER) AS is_consult, CASE WHEN event_type IN ('error', 'purchase') THEN 'consult' ELSE 'chat' END AS route
    FROM events
)"""
