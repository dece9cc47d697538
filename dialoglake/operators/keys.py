"""Keys, exclusion, deduplication and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.functions import text as T


def conversation_signature(turns: DataFrame, max_msgs: int = 6) -> DataFrame:
    """conv_id, signature: sha1 of role:key of the first max_msgs messages, blank ones skipped after that cut; human
    and gpt count as user and assistant."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    role = F.when(F.col("role").isin("human", "user"), "user").when(F.col("role").isin("gpt", "assistant"), "assistant").otherwise(F.col("role"))
    first = turns.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_msgs).select("conv_id", "turn", F.concat(role, F.lit(":"), T.norm_key(F.col("text"))).alias("line"), T.norm_key(F.col("text")).alias("key"))
    g = first.where("key <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("x"))
    return g.select("conv_id", F.sha1(F.array_join("x.line", "|").cast("binary")).alias("signature"))


def seen_unseen(corpus: DataFrame, sft: DataFrame, dpo: DataFrame) -> DataFrame:
    """corpus (.., signature) with exposure: seen if in sft, unseen if in neither; in dpo alone it is dropped."""
    a = sft.select("signature", F.lit(1).alias("in_sft")).distinct()
    b = dpo.select("signature", F.lit(1).alias("in_dpo")).distinct()
    j = corpus.join(a, "signature", "left").join(b, "signature", "left")
    return j.withColumn("exposure", F.when(F.col("in_sft") == 1, "seen").when(F.col("in_dpo").isNull(), "unseen")).where("exposure is not null").drop("in_sft", "in_dpo")


def exclude_used(df: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(used.select(*keys).distinct(), keys, "left_anti")


def first_per_key(df: DataFrame, key: Column, order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def row_hash(*columns: Column) -> Column:
    """sha1 of the columns' JSON (keys in the columns' order)."""
    return F.sha1(F.to_json(F.struct(*columns)).cast("binary"))


def compact_latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each key, with first_seq, the place of its first; null keys are dropped."""
    rest = [c for c in df.columns if c != key]
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("last"), F.min(seq).alias("first_seq"))
    return g.select(key, *(F.col(f"last.{c}").alias(c) for c in rest), "first_seq")


def hash_bucket(seed: str, key: Column, modulus: int) -> Column:
    """md5(seed::key), first 8 hex digits, modulo."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}::"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % modulus).cast("long")


def hash_split(seed: str, key: Column, test: int = 500, valid: int = 1000, modulus: int = 10_000) -> Column:
    """test below `test`, valid below `valid`, else train."""
    b = hash_bucket(seed, key, modulus)
    return F.when(b < test, "test").when(b < valid, "valid").otherwise("train")


def append_new_until(existing: DataFrame, candidates: DataFrame, key: str, order: list[Column], target: int) -> DataFrame:
    """existing and the first candidates of new keys, up to `target` rows in all."""
    have = existing.count()
    new = first_per_key(candidates.join(existing.select(key).distinct(), key, "left_anti"), F.col(key), order)
    return existing.unionByName(new.orderBy(*order).limit(max(0, target - have)))


def duplicate_sessions(sessions: DataFrame) -> DataFrame:
    """(text) -> one row: how many sessions repeat another's whole text."""
    return sessions.groupBy(F.md5("text")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def session_of_message(message_id: Column) -> Column:
    """`case-s3-u2` -> `case-s3`; null for other ids."""
    return F.nullif(F.regexp_extract(message_id, r"^(.*-s\d+)-[ua]\d+$", 1), F.lit(""))


def id_map(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored ids and the source ids they came from, with the source's session: message_id, source_id, session_id."""
    return stored.join(sources, "source_id").select("message_id", "source_id", session_of_message(F.col("source_id")).alias("session_id"))


def owned_sources(ops: DataFrame, messages: DataFrame) -> DataFrame:
    """Operations whose source message is a live user message of the same user."""
    live = messages.where("role = 'user' and not is_deleted").select("user_id", F.col("message_id").alias("source_message_id"))
    return ops.join(live, ["user_id", "source_message_id"], "left_semi")


def neighbour_range(anchors: DataFrame, messages: DataFrame, before: int, after: int) -> DataFrame:
    """Messages of an anchor's conversation at most so far before and after its position: anchor_id, message_id, distance."""
    # The wanted positions are listed, so that a long conversation costs each anchor no more than a short one.
    a = anchors.select(F.col("message_id").alias("anchor_id"), "conversation_id", F.col("position").alias("at"), F.explode(F.sequence(F.col("position") - before, F.col("position") + after)).alias("position"))
    j = a.join(messages.select("conversation_id", "message_id", "position"), ["conversation_id", "position"])
    return j.select("anchor_id", "message_id", (F.col("position") - F.col("at")).alias("distance"))
