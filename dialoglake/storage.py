"""Stored intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder of our own if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-dialoglake-"))
    return _own[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and returns it read back; lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/dialoglake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based place of each row in a total order, without a single-task window: rows are dealt by range,
    sorted and numbered in their partition, and each partition's start is the count of rows before it (one number
    per partition reaches the driver)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    start, starts = 0, []
    for r in sorted(dealt.groupBy("__part").count().collect(), key=lambda r: r["__part"]):
        starts.append((r["__part"], start))
        start += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")
