"""Counts and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.functions import text as T
from dialoglake.operators.sampling import seeded


def label_distribution(df: DataFrame, labels: list[str], top: int = 12) -> DataFrame:
    """Counts of each label's values, and of the `top` most frequent combinations: label, value, n."""
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in labels))).alias("x")).groupBy("x.label", "x.value").agg(F.count(F.lit(1)).alias("n"))
    joint = df.groupBy(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in labels)).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
    return each.unionByName(joint.select(F.lit("joint").alias("label"), "value", "n"))


def dataset_stats(df: DataFrame, facets: list[str], flag: Column, flag_on: Column) -> DataFrame:
    """Rows, and the share with the flag among those it applies to, of every value of each facet: facet, value, n, flag_ratio."""
    x = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets)))
    rows = df.select(x.alias("x"), F.when(flag_on, flag.cast("double")).alias("f"))
    return rows.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("flag_ratio"))


def length_summary(df: DataFrame, group: list[str], chars: str) -> DataFrame:
    """Count, mean and order statistics at places n // 4, n // 2 and 3n // 4 (from 0, not interpolated).

    Order statistics come from the counts of each length, whose number is bounded by the longest text, not by rows."""
    counts = df.groupBy(*group, chars).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*group).orderBy(chars)
    cum = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(F.col("n") * k / 4), F.col(chars)))
    return cum.groupBy(*group).agg(F.max("n").alias("n"), (F.sum(F.col(chars) * F.col("c")) / F.max("n")).alias("mean"), *(at(k).alias(f"q{k}") for k in (1, 2, 3)))


def flag_report(df: DataFrame, flags: str, key: str, max_examples: int = 3) -> DataFrame:
    """Each flag's count and the keys of its first examples: flag, n, examples."""
    rows = df.select(key, F.explode(flags).alias("flag"))
    n = rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("flag").orderBy(key)
    some = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_examples).groupBy("flag").agg(F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("examples"))
    return n.join(some, "flag")


def sft_quality_report(turns: DataFrame, role_leak: str = r"\[(USER|ASSISTANT)\]", user_like: str = r"^(我|I )", prefix: int = 12, top: int = 10) -> DataFrame:
    """metric, value, n: empty messages, role labels inside texts, assistant texts that read like a user's, messages
    per role, and the most frequent starts of assistant texts."""
    t = T.strip(T.text_of(F.col("text")))
    flat = F.array_compact(F.array(F.when(t == "", F.struct(F.lit("empty").alias("metric"), F.col("role").alias("value"))), F.when(t.rlike(role_leak), F.struct(F.lit("role_leak").alias("metric"), F.col("role").alias("value"))), F.when((F.col("role") == "assistant") & t.rlike(user_like), F.struct(F.lit("user_like").alias("metric"), F.col("role").alias("value"))), F.struct(F.lit("messages").alias("metric"), F.col("role").alias("value"))))
    counts = turns.select(F.explode(flat).alias("x")).groupBy("x.metric", "x.value").agg(F.count(F.lit(1)).alias("n"))
    starts = turns.where((F.col("role") == "assistant") & (t != "")).groupBy(F.substring(t, 1, prefix).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
    return counts.unionByName(starts.select(F.lit("prefix").alias("metric"), "value", "n"))


def match_report(pairs: DataFrame, pos: DataFrame, quotas: dict[int, int], key: str) -> DataFrame:
    """Of match_length's pairs: n_turns, quota, got, bins, mean_chars of the positives."""
    chars = pos.select(F.col(key).alias("pos_key"), "chars")
    q = pairs.sparkSession.createDataFrame(list(quotas.items()), "n_turns long, quota long")
    got = pairs.join(chars, "pos_key").groupBy("n_turns").agg(F.count(F.lit(1)).alias("got"), F.countDistinct("bin").alias("bins"), F.avg("chars").alias("mean_chars"))
    return q.join(got, "n_turns", "left").fillna(0, ["got", "bins"])


def build_manifest(metrics: dict[str, DataFrame], config: dict[str, str]) -> DataFrame:
    """One table of metric, key, value: row counts of the given tables and the configuration."""
    spark = next(iter(metrics.values())).sparkSession
    rows = [df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("rows").alias("metric"), F.lit(name).alias("key"), "value") for name, df in metrics.items()]
    out = spark.createDataFrame([("config", k, str(v)) for k, v in sorted(config.items())], "metric string, key string, value string")
    for r in rows:
        out = out.unionByName(r)
    return out
