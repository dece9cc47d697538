"""Message memory: index units, upserts, deletes, health of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.functions import text as T

_PARAGRAPH, _SENTENCE, _SEMICOLON, _COMMA = r"\n\s*\n", r"(?<=[。！？!?\.])", r"(?<=[；;])", r"(?<=[，,、])"


def _merge(pieces: Column, fits: callable, join: str = "", small: callable = lambda t: F.lit(False)) -> Column:
    """Neighbouring pieces joined while they fit together (a condition on the joined text), or the text so far is still
    small."""

    def step(acc: Column, p: Column) -> Column:
        longer = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit(join), p))
        over = (acc["cur"] != "") & ~fits(longer) & ~small(acc["cur"])
        return F.struct(F.when(over, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"), F.when(over, p).otherwise(longer).alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    return F.aggregate(pieces, start, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))


def _hard(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def _nonblank(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: T.strip(p) != "")


def chunk_clauses(text: Column, whole: int = 500, most: int = 350, least: int = 150) -> Column:
    """One chunk up to `whole` characters; else clauses joined up to `most`; a short chunk joins the one before; hard cuts
    where a clause alone is too long."""
    clauses = _nonblank(F.split(text, r"(?<=[。！？!?；;，,\n])"))
    cut = F.flatten(F.transform(clauses, lambda c: F.when(F.length(c) > most, _hard(c, most)).otherwise(F.array(c))))
    merged = _merge(cut, lambda t: F.length(t) <= most)

    def back(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        join = (n > 0) & (F.length(p) < least)
        return F.when(join, F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, F.greatest(n, F.lit(1))), p)))).otherwise(F.concat(acc, F.array(p)))

    parts = F.aggregate(F.slice(merged, F.lit(2), F.greatest(F.size(merged) - 1, F.lit(0))), F.slice(merged, 1, 1), back)
    t = T.text_of(text)
    return F.when(T.strip(t) == "", F.array().cast("array<string>")).when(F.length(t) <= whole, F.array(t)).otherwise(parts)


def split_segments(text: Column, target: int = 120, most: int = 200) -> Column:
    """Segments of at most about `most` tokens: paragraphs; one that is too long is split at the first level (sentence,
    semicolon, comma) that splits it and joined again up to `most`, or beyond while a segment has less than half of
    `target`; what is still too long is cut hard."""

    def level(p: Column, pattern: str) -> Column:
        return _nonblank(F.split(p, pattern))

    def divide(p: Column) -> Column:
        s, m, c = level(p, _SENTENCE), level(p, _SEMICOLON), level(p, _COMMA)
        parts = F.when(F.size(s) > 1, s).when(F.size(m) > 1, m).when(F.size(c) > 1, c).otherwise(F.array(p))
        fit = _merge(parts, lambda t: T.count_tokens(t) <= most, small=lambda t: T.count_tokens(t) < max(1, target // 2))
        return F.flatten(F.transform(fit, lambda x: F.when(T.count_tokens(x) > most, _hard(x, 2 * most)).otherwise(F.array(x))))

    paragraphs = _nonblank(F.split(T.text_of(text), _PARAGRAPH))
    return F.transform(F.flatten(F.transform(paragraphs, lambda p: F.when(T.count_tokens(p) <= most, F.array(p)).otherwise(divide(p)))), lambda x: T.strip(x))


def segments_with_offsets(df: DataFrame, segments: str, text: str) -> DataFrame:
    """Adds offsets: where each segment starts and ends in the text (from 0), each sought from the end of the one before."""

    def step(acc: Column, s: Column) -> Column:
        at = F.greatest(F.expr("0") + F.position(s, F.col(text), acc["cursor"]) - 1, F.lit(0))
        return F.struct(F.concat(acc["out"], F.array(F.struct(at.cast("int").alias("start"), (at + F.length(s)).cast("int").alias("end")))).alias("out"), (at + F.length(s) + 1).cast("int").alias("cursor"))

    start = F.struct(F.array().cast("array<struct<start: int, end: int>>").alias("out"), F.lit(1).alias("cursor"))
    return df.withColumn("offsets", F.aggregate(F.col(segments), start, step, lambda a: a["out"]))


def index_units(messages: DataFrame, whole_tokens: int = 320, segments: Column | None = None) -> DataFrame:
    """One message unit for a message of at most whole_tokens, else a unit per segment, never both: unit_id, message_id,
    user_id, role, unit_type, segment_index, content, token_count, and the message's flags and time."""
    parts = segments if segments is not None else split_segments(F.col("content"))
    small = T.count_tokens(F.col("content")) <= whole_tokens
    m = messages.where(T.strip(T.text_of(F.col("content"))) != "").withColumn("__small", small)
    units = F.when(F.col("__small"), F.array(F.struct(F.lit(-1).alias("i"), F.col("content").alias("c")))).otherwise(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("c"))))
    rows = m.withColumn("u", F.explode(units))
    return rows.select(
        (F.col("message_id") * 1000 + F.when(F.col("__small"), 0).otherwise(F.col("u.i") + 1)).alias("unit_id"), "message_id", "user_id", "conversation_id", "role", F.when(F.col("__small"), "message").otherwise("segment").alias("unit_type"),
        F.when(~F.col("__small"), F.col("u.i").cast("long")).alias("segment_index"), F.col("u.c").alias("content"), T.count_tokens(F.col("u.c")).alias("token_count"), "created_at", "retrievable", "visible_to_user", "is_final", "is_deleted",
    )


def upsert_index(old: DataFrame, new_messages: DataFrame, seq: str) -> DataFrame:
    """old units without those of re-indexed messages, and the units of each message's last version, alive again."""
    rest = [c for c in new_messages.columns if c != "message_id"]
    last = new_messages.groupBy("message_id").agg(F.max_by(F.struct(*rest), seq).alias("x")).select("message_id", "x.*").withColumn("is_deleted", F.lit(False))
    kept = old.join(last.select("message_id"), "message_id", "left_anti").select(*old.columns)
    return kept.unionByName(index_units(last).select(*old.columns))


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks (message_id, chunk_index, content): new ones replace old ones of the same place; places beyond a message's new
    last chunk go."""
    top = new.groupBy("message_id").agg(F.max("chunk_index").alias("top"))
    kept = old.join(new.select("message_id", "chunk_index"), ["message_id", "chunk_index"], "left_anti").join(top, "message_id", "left").where("top is null or chunk_index <= top").select(*old.columns)
    return kept.unionByName(new.select(*old.columns))


def active_units(units: DataFrame, role_scope: str = "both", cap: int = 5000) -> DataFrame:
    """Units that may be found, the newest `cap` of each user."""
    live = units.where("not is_deleted and retrievable and visible_to_user and is_final")
    if role_scope != "both":
        live = live.where(F.col("role") == role_scope)
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("unit_id"))
    return live.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def forget(units: DataFrame, messages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (user_id, message_id, keyword, everything): marks messages and all their units as deleted. A keyword
    forgets every message of the user that contains it, so a unit can't come back through its message."""
    r = requests.select(F.col("user_id").alias("__u"), F.col("message_id").alias("__m"), "keyword", "everything")
    hit = messages.join(r, (F.col("user_id") == F.col("__u")) & (F.col("everything") | (F.col("message_id") == F.col("__m")) | F.col("content").contains(F.col("keyword"))), "left_semi").select(F.col("message_id"), F.lit(True).alias("__gone"))
    gone = lambda df: df.join(hit, "message_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("__gone", F.lit(False))).select(*df.columns)
    return gone(units), gone(messages)


def verify_index(units: DataFrame, embeddings: DataFrame, retries: DataFrame) -> DataFrame:
    """Per user: units that may be found, those with an embedding, those waiting for one, missing, ok."""
    live = units.where("not is_deleted and retrievable and visible_to_user and is_final").select("user_id", "unit_id")
    j = live.join(embeddings.select("unit_id", F.lit(1).alias("e")).distinct(), "unit_id", "left").join(retries.select("unit_id", F.lit(1).alias("r")).distinct(), "unit_id", "left")
    g = j.groupBy("user_id").agg(F.count(F.lit(1)).alias("units"), F.count("e").alias("embedded"), F.count("r").alias("retrying"))
    missing = F.greatest(F.lit(0), F.col("units") - F.col("embedded") - F.col("retrying"))
    return g.withColumn("missing", missing).withColumn("ok", F.col("missing") == 0)


def index_fingerprint(units: DataFrame) -> DataFrame:
    """Per user: count, largest id and newest time of live units; it changes whenever the index does."""
    return units.where("not is_deleted").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("unit_id").alias("max_id"), F.max("created_at").alias("newest"))


def embed_retry_batch(queue: DataFrame, most_attempts: int = 5, n: int = 50) -> DataFrame:
    """The oldest entries (unit_id, attempts, queued_at) that may be tried again."""
    return queue.where(F.col("attempts") < most_attempts).orderBy("queued_at", "unit_id").limit(n)


def settle_retries(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after a batch (unit_id, ok): successes leave it, failures count an attempt."""
    j = queue.join(results, "unit_id", "left")
    return j.where(F.col("ok").isNull() | ~F.col("ok")).withColumn("attempts", F.col("attempts") + F.when(F.col("ok").isNotNull(), 1).otherwise(0)).drop("ok")


def reassemble_messages(chunks: DataFrame) -> DataFrame:
    """(message_id, chunk_index, content) -> message_id, content."""
    g = chunks.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("x"))
    return g.select("message_id", F.array_join("x.content", "").alias("content"))


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The newest n live messages of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    return messages.where("not is_deleted").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
