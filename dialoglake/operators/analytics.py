"""Operational statistics over conversations, turn metrics and triage records.

"Latest" is always max_by on an id, one combined aggregate, never a correlated lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def list_conversations(conversations: DataFrame, messages: DataFrame, limit: int) -> DataFrame:
    """Conversations with messages: time of the first and count, newest first."""
    m = messages.groupBy("conversation_id").agg(F.min("created_at").alias("first_at"), F.count(F.lit(1)).alias("n_messages"))
    return conversations.join(m, conversations["id"] == m["conversation_id"]).drop("conversation_id").orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def latest_metric(metrics: DataFrame) -> DataFrame:
    """conversation_id, metric_id, created_at, is_consult, route of the metric with the largest id."""
    g = metrics.groupBy("conversation_id").agg(F.max_by(F.struct("id", "created_at", "is_consult", "route"), "id").alias("m"))
    return g.select("conversation_id", F.col("m.id").alias("metric_id"), "m.created_at", "m.is_consult", "m.route")


def conversations_with_latest_metric(metrics: DataFrame, start: int, end: int, offset: int, limit: int) -> DataFrame:
    """Latest metrics of a time range, newest first, one page."""
    return latest_metric(metrics).where(F.col("created_at").between(start, end)).orderBy(F.desc("created_at"), F.desc("conversation_id")).offset(offset).limit(limit)


def users_with_stats(conversations: DataFrame, metrics: DataFrame, units: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per user: conversations, last active, live units and active profiles, most recent route; users never active last."""
    c = conversations.where("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_conversations"), F.max("updated_at").alias("last_active"))
    u = units.where("not is_deleted").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_units"))
    p = profiles.where("status = 'active'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_profiles"))
    r = metrics.join(conversations.select(F.col("id").alias("conversation_id"), "user_id"), "conversation_id").groupBy("user_id").agg(F.max_by("route", F.struct("created_at", "id")).alias("route"))
    out = c.join(u, "user_id", "left").join(p, "user_id", "left").join(r, "user_id", "left").fillna(0, ["n_units", "n_profiles"])
    return out.select("user_id", "n_conversations", "last_active", (F.col("n_units") + F.col("n_profiles")).alias("n_memory"), "route").orderBy(F.desc_nulls_last("last_active"), "user_id")


def user_activity(conversations: DataFrame, metrics: DataFrame, n: int = 8) -> DataFrame:
    """Per user: conversations, turns, last seen and the ids of the last n metrics, newest first."""
    j = metrics.join(conversations.select(F.col("id").alias("conversation_id"), "user_id"), "conversation_id").where("user_id is not null")
    w = Window.partitionBy("user_id").orderBy(F.desc("id"))
    last = j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("id"), asc=False), ",").alias("last_metrics"))
    g = j.groupBy("user_id").agg(F.countDistinct("conversation_id").alias("n_conversations"), F.count(F.lit(1)).alias("n_turns"), F.max("created_at").alias("last_seen"))
    return g.join(last, "user_id")


# Order of the states of a triage record.
STATES = ["pending", "tracking", "resolved"]


def state_order(status: Column) -> Column:
    out = F.lit(len(STATES))
    for i, s in enumerate(STATES):
        out = F.when(status == s, i).otherwise(out)
    return out


def triage_queue(metrics: DataFrame, triage: DataFrame) -> DataFrame:
    """Conversations whose latest metric is a consultation, with their triage state (pending if none)."""
    m = latest_metric(metrics).where("is_consult = 1")
    j = m.join(triage.select("conversation_id", "status", "assignee", F.col("updated_at").alias("triaged_at")), "conversation_id", "left")
    j = j.withColumn("status", F.coalesce("status", F.lit("pending")))
    return j.select("conversation_id", "status", "assignee", F.coalesce("triaged_at", "created_at").alias("at")).orderBy(state_order(F.col("status")), F.desc("at"), "conversation_id")


def triage_upsert(old: DataFrame, updates: DataFrame, statuses: tuple[str, ...] = ("pending", "tracking", "resolved", "ignored")) -> DataFrame:
    """Records after updates (conversation_id, status, assignee, note, updated_at): the last allowed one wins; long assignees
    and notes are cut; the time of creation stays."""
    good = updates.where(F.col("status").isin(*statuses)).select("conversation_id", "status", F.substring("assignee", 1, 80).alias("assignee"), F.substring("note", 1, 4000).alias("note"), F.col("updated_at").alias("created_at"), "updated_at")
    g = old.select(*good.columns).unionByName(good).groupBy("conversation_id").agg(F.max_by(F.struct("status", "assignee", "note", "updated_at"), "updated_at").alias("x"), F.min("created_at").alias("created_at"))
    return g.select("conversation_id", "x.status", "x.assignee", "x.note", "created_at", "x.updated_at")


def daily_stats(metrics: DataFrame, conversations: DataFrame, triage: DataFrame) -> DataFrame:
    """Per day (UTC): conversations, turns, users, consultations, and triage records updated that were left to do or done."""
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd").alias("day")
    m = metrics.join(conversations.select(F.col("id").alias("conversation_id"), "user_id"), "conversation_id", "left")
    a = m.groupBy(day("created_at")).agg(F.countDistinct("conversation_id").alias("n_conversations"), F.count(F.lit(1)).alias("n_turns"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("is_consult") == 1).alias("n_consult"), F.count_if(F.col("route") == "chat").alias("n_chat"))
    t = triage.groupBy(day("updated_at")).agg(F.count_if(F.col("status").isin("pending", "tracking")).alias("n_pending"), F.count_if(F.col("status").isin("resolved", "ignored")).alias("n_processed"))
    return a.join(t, "day", "full").fillna(0)


def activity_maps(metrics: DataFrame, conversations: DataFrame) -> DataFrame:
    """Mergeable daily counts: day, kind (conversations, users or turns), part, route, bits, n, n_consult. Distinct
    conversations and users are bitmaps of 32,768 ids a part; turns are counted by route. A range of days is
    the union of its days' bitmaps, so its distinct counts are exact without going back to the metrics; a new day is one
    more set of rows."""
    day = F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd").alias("day")
    m = metrics.join(conversations.select(F.col("id").alias("conversation_id"), "user_id"), "conversation_id", "left").withColumn("day", day)
    each = F.explode(F.array(F.struct(F.lit("conversations").alias("kind"), F.col("conversation_id").cast("long").alias("id")), F.struct(F.lit("users").alias("kind"), F.col("user_id").cast("long").alias("id"))))
    ids = m.select("day", each.alias("x")).where("x.id is not null").select("day", "x.kind", F.bitmap_bucket_number("x.id").alias("part"), F.bitmap_bit_position("x.id").alias("at"))
    maps = ids.groupBy("day", "kind", "part").agg(F.bitmap_construct_agg("at").alias("bits")).select("day", "kind", "part", F.lit(None).cast("string").alias("route"), "bits", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("n_consult"))
    turns = m.groupBy("day", "route").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_consult") == 1).alias("n_consult"))
    return maps.unionByName(turns.select("day", F.lit("turns").alias("kind"), F.lit(None).cast("long").alias("part"), "route", F.lit(None).cast("binary").alias("bits"), "n", "n_consult"))


def range_stats(maps: DataFrame, ranges: DataFrame) -> DataFrame:
    """activity_maps and ranges (range_id, day_from, day_to: yyyy-MM-dd, both included) -> range_id, n_conversations, n_users,
    n_turns, n_consult, routes (map of route to turns; a null route is ''). Ranges may overlap; a report asks for few."""
    r = F.broadcast(ranges.select("range_id", "day_from", "day_to"))
    j = maps.join(r, F.col("day").between(F.col("day_from"), F.col("day_to")))
    bits = j.where("kind <> 'turns'").groupBy("range_id", "kind", "part").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    found = bits.groupBy("range_id").agg(F.sum(F.when(F.col("kind") == "conversations", F.col("n"))).alias("n_conversations"), F.sum(F.when(F.col("kind") == "users", F.col("n"))).alias("n_users"))
    by_route = j.where("kind = 'turns'").groupBy("range_id", F.coalesce("route", F.lit("")).alias("route")).agg(F.sum("n").alias("n"), F.sum("n_consult").alias("n_consult"))
    turns = by_route.groupBy("range_id").agg(F.sum("n").alias("n_turns"), F.sum("n_consult").alias("n_consult"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "n")))).alias("routes"))
    out = ranges.select("range_id").join(found, "range_id", "left").join(turns, "range_id", "left")
    return out.fillna(0, ["n_conversations", "n_users", "n_turns", "n_consult"]).withColumn("routes", F.coalesce("routes", F.create_map().cast("map<string, bigint>")))


def conversation_workspace(messages: DataFrame, metrics: DataFrame, triage: DataFrame) -> DataFrame:
    """Per conversation: its messages in order, its number of metrics and its triage state."""
    m = messages.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "role", "content"))), lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("thread"))
    n = metrics.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_metrics"))
    out = m.join(n, "conversation_id", "left").join(triage.select("conversation_id", "status"), "conversation_id", "left")
    return out.select("conversation_id", "thread", F.coalesce("n_metrics", F.lit(0)).alias("n_metrics"), F.coalesce("status", F.lit("pending")).alias("status"))


def empty_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    return conversations.join(messages.select(F.col("conversation_id").alias("id")).distinct(), "id", "left_anti")


def summary_due(messages: DataFrame, marks: DataFrame, tokens: Column, least: int = 3000) -> DataFrame:
    """Conversations whose messages after the last summarised one (conversation_id, last_id) have so many tokens."""
    j = messages.join(marks, "conversation_id", "left").where("last_id is null or message_id > last_id")
    return j.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens")).where(F.col("tokens") >= least)


def generation_log_stats(log: DataFrame) -> DataFrame:
    """Per route of the log (route, output): calls, mean and largest output."""
    n = F.length(F.coalesce("output", F.lit("")))
    return log.groupBy("route").agg(F.count(F.lit(1)).alias("calls"), F.avg(n).alias("mean_chars"), F.max(n).alias("max_chars"))
