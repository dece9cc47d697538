"""Structured Streaming jobs over new turns and turn metrics. Each gives what its batch operator gives on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dialoglake.functions import text as T
from dialoglake.operators.memory import index_units


def _forget_after(state: GroupState, rows: pd.DataFrame, idle: str) -> None:
    """The state times out when the watermark is `idle` past the last row (at)."""
    last = max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
    state.setTimeoutTimestamp(last + int(pd.Timedelta(idle).total_seconds() * 1000))


def stream_index_units(messages: DataFrame, path: str, checkpoint: str, whole_tokens: int = 320):
    """New messages -> index units under path. A batch replaces its own folder, so a batch that is tried again leaves one copy;
    current_units reads the latest version of each message."""

    def write(batch: DataFrame, batch_id: int) -> None:
        units = index_units(batch, whole_tokens)
        units.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id:09d}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_units(spark, path: str) -> DataFrame:
    """The units of each message's last batch."""
    units = spark.read.parquet(path)
    last = units.groupBy("message_id").agg(F.max("batch_id").alias("batch_id"))
    return units.join(last, ["message_id", "batch_id"]).drop("batch_id")


def stream_classifier_window(turns: DataFrame, n: int = 3, prefix: str = "[USER] ", idle: str = "1 hour") -> DataFrame:
    """At each user turn (conv_id, turn, role, text, at: time), its and the n - 1 user texts before it. State: the last n - 1
    texts of a conversation, forgotten when it has been idle past the watermark."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, text in zip(rows["turn"], rows["text"]):
            line = prefix + text.strip()
            out.append((key[0], turn, "\n".join([*ring, line])))
            ring = [*ring, line][-(n - 1) :] if n > 1 else []
        state.update((ring,))
        _forget_after(state, rows, idle)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "window"])

    users = turns.where((F.col("role") == "user") & (T.strip(T.text_of(F.col("text"))) != "")).withWatermark("at", idle)
    return users.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, window string", "ring array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_summary_due(messages: DataFrame, least: int = 3000, idle: str = "30 days") -> DataFrame:
    """(conversation_id, message_id, tokens, at: time): emits a conversation with its last message when the tokens since the last
    summary reach `least`, then counts anew. The count of a conversation that has been idle past the watermark is forgotten."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total = state.get[0] if state.exists else 0
        out = []
        rows = pd.concat(list(frames)).sort_values("message_id")
        for mid, tokens in zip(rows["message_id"], rows["tokens"]):
            total += int(tokens)
            if total >= least:
                out.append((key[0], int(mid), total))
                total = 0
        state.update((total,))
        _forget_after(state, rows, idle)
        yield pd.DataFrame(out, columns=["conversation_id", "last_id", "tokens"])

    return messages.withWatermark("at", idle).groupBy("conversation_id").applyInPandasWithState(step, "conversation_id long, last_id long, tokens long", "total long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_embed_retry(results: DataFrame, most: int = 5, idle: str = "7 days") -> DataFrame:
    """Outcomes of embedding attempts (unit_id, ok, at: time) -> unit_id, outcome (done or gave_up), attempts; the count is
    state, forgotten when a unit has been idle past the watermark."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        attempts = state.get[0] if state.exists else 0
        out = []
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for ok in rows["ok"]:
            if attempts < 0:
                break
            attempts += 1
            if ok or attempts >= most:
                out.append((key[0], "done" if ok else "gave_up", attempts))
                attempts = -1
        state.update((attempts,))
        _forget_after(state, rows, idle)
        yield pd.DataFrame(out, columns=["unit_id", "outcome", "attempts"])

    return results.withWatermark("at", idle).groupBy("unit_id").applyInPandasWithState(step, "unit_id long, outcome string, attempts int", "attempts int", "append", GroupStateTimeout.EventTimeTimeout)


def stream_daily_stats(metrics: DataFrame, late: str = "2 hours", window: str = "1 day") -> DataFrame:
    """Turn metrics (at: time) -> counts per window, final when the watermark passes its end; distinct conversations are
    approximate in the stream (the batch operator counts them exactly)."""
    w = metrics.withWatermark("at", late).groupBy(F.window("at", window))
    g = w.agg(F.count(F.lit(1)).alias("n_turns"), F.sum((F.col("is_consult") == 1).cast("long")).alias("n_consult"), F.approx_count_distinct("conversation_id").alias("n_conversations"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n_turns", "n_consult", "n_conversations")


def stream_latest_route(metrics: DataFrame, late: str = "2 hours", window: str = "1 day") -> DataFrame:
    """Per window of time (at) and conversation the metric with the largest id, updated as metrics come (update mode). A
    window's state goes when the watermark passes its end; a conversation's route is that of its last window."""
    g = metrics.withWatermark("at", late).groupBy(F.window("at", window), "conversation_id").agg(F.max_by(F.struct("id", "is_consult", "route"), "id").alias("m"))
    return g.select("conversation_id", F.col("window.start").alias("start"), F.col("m.id").alias("metric_id"), "m.is_consult", "m.route")


def stream_current_route(metrics: DataFrame, idle: str = "7 days") -> DataFrame:
    """Per conversation the metric with the largest id of all so far, however long ago: emitted when a batch brings a larger id.
    State: that id, forgotten when the conversation has been idle past the watermark. Metrics without an id count for nothing."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        last = rows.loc[rows["id"].idxmax()]
        before = state.get[0] if state.exists else None
        larger = before is None or int(last["id"]) > before
        state.update((int(last["id"]) if larger else before,))
        _forget_after(state, rows, idle)
        if larger:
            yield pd.DataFrame([(key[0], int(last["id"]), last["is_consult"], last["route"])], columns=["conversation_id", "metric_id", "is_consult", "route"])

    known = metrics.where("id is not null and conversation_id is not null").withWatermark("at", idle)
    return known.groupBy("conversation_id").applyInPandasWithState(step, "conversation_id long, metric_id long, is_consult int, route string", "id long", "update", GroupStateTimeout.EventTimeTimeout)


def stream_dedup_turns(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Messages (at: time) that were sent again within the watermark are handled once."""
    return messages.withWatermark("at", late).dropDuplicatesWithinWatermark(["message_id"])


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None):
    """Runs a stream over what is there now into an in-memory table (for tests and small results)."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
