"""Reading and writing of corpora: JSON arrays, JSON lines, dialogue folders, chat and preference formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dialoglake.sources.json_array import read_json_array


def compact_to_parquet(spark: SparkSession, path: str, schema: str | T.StructType, to: str, partitions: int = 200) -> DataFrame:
    read_json_array(spark, path, schema).repartition(partitions).write.parquet(to)
    return spark.read.parquet(to)


def read_jsonl(spark: SparkSession, path: str, schema: str, on_bad: str = "skip", limit: int | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped. on_bad: skip, fail, or keep (the line stands in _corrupt_record)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    mode = {"mode": "FAILFAST" if on_bad == "fail" else "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    # Parsed as a column: the JSON reader refuses queries, such as counts, that need its corrupt records alone.
    rows = lines.select(F.from_json("value", schema + ("" if on_bad == "fail" else ", _corrupt_record string"), mode).alias("x")).select("x.*")
    if on_bad == "skip":
        rows = rows.where("_corrupt_record is null").drop("_corrupt_record")
    return rows.limit(limit) if limit is not None else rows


def convert_to_messages(df: DataFrame, cap: int | None = None, order: str | None = None) -> DataFrame:
    """prompt/completion, question/answers or ShareGPT rows, told apart by their columns -> (messages). A question's
    description follows it on a line of its own if it says something else; the first answer counts; rows with an empty
    side are dropped. cap: at most so many rows, in the order of a column."""
    cols = set(df.columns)
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))

    def two(a: Column, b: Column) -> DataFrame:
        rows = df.withColumns({"__a": text(a), "__b": text(b)}).where("__a <> '' and __b <> ''")
        say = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(c).alias("content"))
        return rows.withColumn("messages", F.array(say("user", "__a"), say("assistant", "__b")))

    if {"prompt", "completion"} <= cols:
        out = two(F.col("prompt"), F.col("completion"))
    elif {"question", "answers"} <= cols:
        d = text(F.col("description")) if "description" in cols else F.lit("")
        q = text(F.col("question"))
        out = two(F.when((d != "") & (d != q), F.concat(q, F.lit("\n"), d)).otherwise(q), F.get("answers", F.lit(0))["answer_text"])
    elif "conversations" in cols:
        role = lambda r: F.when(r.isin("human", "user"), "user").when(r.isin("gpt", "assistant"), "assistant")
        kept = F.filter(F.transform("conversations", lambda m: F.struct(role(m["from"]).alias("role"), m["value"].alias("content"))), lambda m: m["role"].isNotNull() & (text(m["content"]) != ""))
        out = df.withColumn("messages", kept).where(F.size("messages") > 0)
    else:
        raise ValueError(f"no known format in columns {df.columns}")
    if cap is not None:
        out = out.orderBy(order).limit(cap) if order else out.limit(cap)
    return out.select("messages")


def read_dialogue_dir(spark: SparkSession, pattern: str, message_schema: str = "array<struct<role: string, content: string>>") -> DataFrame:
    """One dialogue per JSON file: source (its path), messages; null messages for files that can't be read as a list."""
    files = spark.read.option("wholetext", True).text(pattern).select(F.col("_metadata.file_path").alias("source"), "value")
    return files.select("source", F.from_json("value", message_schema).alias("messages"))


def skipped_files(dialogues: DataFrame) -> DataFrame:
    return dialogues.agg(F.count_if(F.col("messages").isNull()).alias("skipped"), F.count_if(F.col("messages").isNotNull()).alias("read"))


def union_with_provenance(inputs: dict[str, DataFrame], order: str) -> DataFrame:
    """Rows of several inputs with _src_file (the input's name) and _src_idx (place in the input by a key, from 0)."""
    out = None
    for name, df in inputs.items():
        part = df.withColumn("_src_file", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("_src_idx", F.row_number().over(Window.partitionBy("_src_file").orderBy(order)) - 1)


def write_samples(df: DataFrame, path: str, label_columns: list[str], split: str = "split") -> None:
    """Instruction rows: instruction, input, output (labels as a JSON string), one folder per split."""
    df.select("instruction", "input", F.to_json(F.struct(*label_columns)).alias("output"), split).write.partitionBy(split).json(path)


def write_pairs(df: DataFrame, path: str) -> None:
    """Preference rows: id, conversations, chosen and rejected as {from, value}."""
    say = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    df.select("id", F.array(say("human", "prompt")).alias("conversations"), say("gpt", "chosen").alias("chosen"), say("gpt", "rejected").alias("rejected")).write.json(path)


def resume_filter(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the output yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def backfill_messages(messages: DataFrame, conversations: DataFrame, after_id: int) -> DataFrame:
    """Messages of users and assistants beyond the checkpoint, with their user and their position among all messages
    of the conversation (1-based, whatever the role); rows without a user are left out."""
    w = Window.partitionBy("conversation_id").orderBy("id")
    placed = messages.withColumn("position", F.row_number().over(w))
    j = placed.join(conversations.select(F.col("id").alias("conversation_id"), "user_id"), "conversation_id")
    return j.where((F.col("id") > after_id) & F.col("role").isin("user", "assistant") & F.col("user_id").isNotNull())


def import_profiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile lines (user_id, content, origin) -> the good ones as add operations, and one row of ok and failed counts."""
    ok = F.coalesce(F.col("origin").isin("explicit", "confirmed") & (F.trim("content") != "") & F.col("user_id").isNotNull(), F.lit(False))
    ops = rows.where(ok).select("user_id", F.lit("add").alias("op"), "content", "origin")
    return ops, rows.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
