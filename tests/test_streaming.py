"""Every streaming job over several small files, one a batch, against what the same rows give at once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dialoglake.operators.memory import index_units
from dialoglake.streaming import jobs

START = dt.datetime(2024, 3, 5, 8)


@pytest.fixture
def source(spark, tmp_path):
    """rows (lists of rows, one list a batch), schema -> the stream and the same rows as a table."""

    def make(batches, schema):
        folder = tmp_path / "in"
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        table = spark.read.parquet(str(folder))
        return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(folder)), table

    return make


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_index_units(spark, source, tmp_path):
    text = "第一句话说了很多。" * 60
    stream, table = source([[(1, 7, 1, "short"), (2, 7, 1, text)], [(3, 8, 2, "other")], [(1, 7, 1, "changed")]], "message_id long, conversation_id long, user_id long, content string")
    extra = lambda d: d.withColumns({"role": F.lit("user"), "position": F.col("message_id"), "created_at": F.lit(1), "is_deleted": F.lit(False), "retrievable": F.lit(True), "visible_to_user": F.lit(True), "is_final": F.lit(True)})
    out, checkpoint = str(tmp_path / "units"), str(tmp_path / "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        jobs.stream_index_units(extra(stream), out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = jobs.current_units(spark, out)
    latest = extra(table).where("not (message_id = 1 and content = 'short')")
    want = index_units(latest)
    key = lambda d: sorted((r.message_id, -1 if r.segment_index is None else r.segment_index, r.content) for r in d.collect())
    assert key(got) == key(want) and len(key(got)) > 3


def test_classifier_window(spark, source):
    at = lambda k: START + dt.timedelta(minutes=k)
    turns = [[(1, 0, "user", "a", at(0)), (1, 1, "assistant", "x", at(1)), (2, 0, "user", " b ", at(1))], [(1, 2, "user", "c", at(2)), (1, 3, "user", "  ", at(3))], [(1, 4, "user", "d", at(4)), (1, 5, "user", "e", at(5)), (2, 1, "user", None, at(5))]]
    stream, _ = source(turns, "conv_id long, turn long, role string, text string, at timestamp")
    got = rows_of(jobs.run_available(jobs.stream_classifier_window(stream, n=3), "windows"))
    u = "[USER] "
    assert got == [(1, 0, u + "a"), (1, 2, f"{u}a\n{u}c"), (1, 4, f"{u}a\n{u}c\n{u}d"), (1, 5, f"{u}c\n{u}d\n{u}e"), (2, 0, u + "b")]


def test_summary_due(spark, source):
    stream, _ = source([[(1, 1, 40, START), (1, 2, 50, START), (2, 3, 99, START)], [(1, 4, 10, START), (2, 5, 0, START)], [(1, 6, 100, START), (2, 7, 1, START)]], "conversation_id long, message_id long, tokens long, at timestamp")
    assert rows_of(jobs.run_available(jobs.stream_summary_due(stream, least=100), "due")) == [(1, 4, 100), (1, 6, 100), (2, 7, 100)]


def test_embed_retry(spark, source):
    at = lambda k: START + dt.timedelta(minutes=k)
    stream, _ = source([[(1, False, at(0)), (2, True, at(0)), (3, False, at(0))], [(1, False, at(1)), (3, True, at(1)), (2, True, at(1))], [(1, False, at(2)), (4, False, at(2))]], "unit_id long, ok boolean, at timestamp")
    assert rows_of(jobs.run_available(jobs.stream_embed_retry(stream, most=3), "attempts")) == [(1, "gave_up", 3), (2, "done", 1), (3, "done", 2)]


METRICS = "id long, conversation_id long, is_consult int, route string, at timestamp"


def metrics():
    at = lambda h: START + dt.timedelta(hours=h)
    return [[(1, 7, 0, "chat", at(0)), (2, 8, 1, "consult", at(1))], [(3, 7, 1, "consult", at(2)), (4, 9, 0, "chat", at(30))], [(6, 9, 1, "consult", at(31)), (5, 9, 0, "chat", at(32)), (7, 9, 0, "chat", at(90))]]


def test_daily_stats(spark, source):
    stream, table = source(metrics(), METRICS)
    got = rows_of(jobs.run_available(jobs.stream_daily_stats(stream), "daily"))
    day = table.groupBy(F.date_format(F.date_trunc("day", "at"), "yyyy-MM-dd HH:mm").alias("start"))
    want = rows_of(day.agg(F.count(F.lit(1)), F.sum("is_consult"), F.count_distinct("conversation_id")))
    assert got == want[:-1] and len(want) == 3  # the last day is still open


def test_latest_route(spark, source):
    stream, _ = source(metrics(), METRICS)
    updates = jobs.run_available(jobs.stream_latest_route(stream), "routes", mode="update")
    last = updates.groupBy("conversation_id").agg(F.max_by(F.struct("metric_id", "route"), "metric_id").alias("m")).select("conversation_id", "m.metric_id", "m.route")
    assert rows_of(last) == [(7, 3, "consult"), (8, 2, "consult"), (9, 7, "chat")]
    assert updates.where("conversation_id = 9 and metric_id = 5").count() == 0


def test_current_route(spark, source):
    """A conversation's route is kept across days; a late metric with a smaller id changes nothing."""
    stream, _ = source(metrics(), METRICS)
    updates = jobs.run_available(jobs.stream_current_route(stream), "current", mode="update")
    assert rows_of(updates) == [(7, 1, 0, "chat"), (7, 3, 1, "consult"), (8, 2, 1, "consult"), (9, 4, 0, "chat"), (9, 7, 0, "chat")]


def test_current_route_forgets_idle_conversations(spark, source):
    at = lambda d: START + dt.timedelta(days=d)
    stream, _ = source([[(5, 7, 1, "consult", at(0))], [(9, 8, 0, "chat", at(20))], [(10, 8, 0, "chat", at(40))], [(4, 7, 0, "chat", at(41))]], METRICS)
    got = rows_of(jobs.run_available(jobs.stream_current_route(stream, idle="2 days"), "forgotten", mode="update"))
    assert (7, 5, 1, "consult") in got and (7, 4, 0, "chat") in got


def test_dedup_turns(spark, source):
    at = lambda k: START + dt.timedelta(minutes=k)
    stream, _ = source([[(1, at(0)), (2, at(1))], [(1, at(5)), (3, at(6))], [(2, at(7)), (4, at(8)), (4, at(8))]], "message_id long, at timestamp")
    got = jobs.run_available(jobs.stream_dedup_turns(stream), "turns")
    assert sorted(r.message_id for r in got.collect()) == [1, 2, 3, 4]
