"""Fragments of retrieved messages, assembled and cut to token budgets; windows of turns, packed and rendered.

A query has few hits and windows (its top k), and a fragment few texts, so their lists are bounded; all else is joins on
listed ids and positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.functions import text as T
from dialoglake.operators.retrieval import collapse_regions, expand_message

_PART = "struct<id: long, content: string>"
_NONE = "array<struct<id: long, content: string>>"


def _none() -> Column:
    return F.array().cast(_NONE)


def _in_order(place: str, id_col: str, when: Column) -> Column:
    """The parts of a group for which `when` holds, by place."""
    rows = F.array_sort(F.collect_list(F.when(when, F.struct(F.col(place).alias("place"), F.col(id_col).cast("long").alias("id"), "content"))))
    return F.transform(rows, lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content")))


def build_fragments(hits: DataFrame, messages: DataFrame, segments: DataFrame, most: int = 10, n: int = 2, scan: int = 8, threshold: float = 0.4) -> DataFrame:
    """hits (query_id, message_id, segment_index or null, score), messages (conversation_id, message_id, position, role,
    content, created_at, reply_to_message_id, sim, excluded), segments (message_id, segment_index, content, sim) -> one
    row per fragment, the `most` best of each query: query_id, fragment_type, message_id, role, conversation_id,
    created_at, score, core, earlier, later (arrays of id and content, in order), reply_id, reply, omitted_before,
    omitted_after.

    A hit on a whole message wins over hits on its segments; of these the best run of neighbours stays. A message gets the
    user messages around it that are similar enough, a run the segment on either side; an answer gets the message that it
    answers. Hits in excluded messages are left out, and excluded messages are neither neighbours nor replied-to texts.
    """
    kept = messages.where("not excluded")
    regions = collapse_regions(hits.join(kept.select("message_id"), "message_id", "left_semi"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "message_id")
    regions = regions.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
    whole, runs = regions.where(F.size("core") == 0).select("query_id", "message_id"), regions.where(F.size("core") > 0)

    near = expand_message(whole, messages, n, scan, threshold).join(messages.select(F.col("message_id").alias("neighbour_id"), "position", "content"), "neighbour_id")
    side = lambda s: _in_order("position", "neighbour_id", F.col("side") == s)
    around = near.groupBy("query_id", "message_id").agg(side("before").alias("earlier"), side("after").alias("later"))
    none, no = _none(), F.lit(False)
    of_messages = whole.join(around, ["query_id", "message_id"], "left").select("query_id", "message_id", F.lit("message").alias("fragment_type"), none.alias("core"), F.coalesce("earlier", none).alias("earlier"), F.coalesce("later", none).alias("later"), no.alias("omitted_before"), no.alias("omitted_after"))

    last = segments.groupBy("message_id").agg(F.max("segment_index").alias("last"))
    wanted = runs.select("query_id", "message_id", F.array_min("core").alias("a"), F.array_max("core").alias("b"))
    parts = wanted.withColumn("segment_index", F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1))).join(segments, ["message_id", "segment_index"])
    inside = F.col("segment_index").between(F.col("a"), F.col("b"))
    parts = parts.where(inside | (F.col("sim") >= threshold))
    some = lambda when: _in_order("segment_index", "segment_index", when)
    g = parts.groupBy("query_id", "message_id").agg(some(inside).alias("core"), some(F.col("segment_index") < F.col("a")).alias("earlier"), some(F.col("segment_index") > F.col("b")).alias("later"), F.min("segment_index").alias("first"), F.max("segment_index").alias("end"))
    of_runs = g.join(last, "message_id").select("query_id", "message_id", F.lit("segment").alias("fragment_type"), "core", "earlier", "later", (F.col("first") > 0).alias("omitted_before"), (F.col("end") < F.col("last")).alias("omitted_after"))

    m = messages.select("message_id", "conversation_id", "role", "content", "created_at", F.when(F.col("role") == "assistant", F.col("reply_to_message_id")).alias("asked"))
    reply = kept.select(F.col("message_id").alias("asked"), F.col("content").alias("reply"), F.lit(True).alias("found"))
    out = of_messages.unionByName(of_runs).join(regions.select("query_id", "message_id", "score"), ["query_id", "message_id"]).join(m, "message_id").join(reply, "asked", "left")
    own = F.array(F.struct(F.col("message_id").cast("long").alias("id"), F.col("content").alias("content")))
    return out.select(
        "query_id", "fragment_type", "message_id", "role", "conversation_id", "created_at", "score", F.when(F.col("fragment_type") == "message", own).otherwise(F.col("core")).alias("core"), "earlier", "later",
        F.when(F.col("found"), F.col("asked")).alias("reply_id"), F.coalesce("reply", F.lit("")).alias("reply"), "omitted_before", "omitted_after",
    )


def _sizes(parts: Column) -> Column:
    return F.transform(parts, lambda x: T.count_tokens(x["content"]))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)


def _fitting(sizes: Column, room: Column) -> Column:
    """How many of the first sizes fit the room together."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        go = acc["open"] & (acc["used"] + x <= room)
        return F.struct((acc["used"] + F.when(go, x).otherwise(0)).alias("used"), (acc["n"] + go.cast("int")).alias("n"), go.alias("open"))

    return F.aggregate(sizes, start, step, lambda a: a["n"])


def trim_fragments(fragments: DataFrame, message_budget: int = 520, segment_budget: int = 320, reply_cut: int = 220) -> DataFrame:
    """Fragments of build_fragments cut to their budgets, with token_count and dropped (texts left out of later and
    earlier). What is over goes in this order: later texts from the end, then earlier ones from the start, then the
    reply is cut to reply_cut tokens, then dropped, then a message is cut to max(32, half its budget). Segments of the
    core always stay. Each stage is one cut found from running totals, so it ends for any sizes."""
    message = F.col("fragment_type") == "message"
    budget = F.when(message, message_budget).otherwise(segment_budget)
    core, reply = _total(_sizes(F.col("core"))), T.count_tokens(F.col("reply"))
    earlier, later = _sizes(F.col("earlier")), _sizes(F.col("later"))
    all_earlier = _total(earlier)
    room = budget - core - reply
    n_later = F.when(room >= all_earlier, _fitting(later, room - all_earlier)).otherwise(0)
    n_earlier = F.when(room >= all_earlier, F.size("earlier")).otherwise(_fitting(F.reverse(earlier), room))
    short = T.truncate_by_tokens(F.col("reply"), reply_cut)
    new_reply = F.when(room >= 0, F.col("reply")).when(core + T.count_tokens(short) <= budget, short).otherwise("")
    cut = F.transform("core", lambda x: F.struct(x["id"].alias("id"), T.truncate_by_tokens(x["content"], max(32, message_budget // 2)).alias("content")))
    new_core = F.when(message & (core > budget), cut).otherwise(F.col("core"))
    x = fragments.withColumns({"n_later": n_later, "n_earlier": n_earlier, "new_reply": new_reply, "new_core": new_core})
    dropped = (F.size("earlier") - F.col("n_earlier") + F.size("later") - F.col("n_later")).alias("dropped")
    kept = x.select(
        *(c for c in fragments.columns if c not in ("core", "earlier", "later", "reply")), F.col("new_core").alias("core"),
        F.expr("slice(earlier, size(earlier) - n_earlier + 1, n_earlier)").alias("earlier"), F.expr("slice(later, 1, n_later)").alias("later"), F.col("new_reply").alias("reply"), dropped,
    )
    return kept.withColumn("token_count", sum((_total(_sizes(F.col(c))) for c in ("core", "earlier", "later")), T.count_tokens(F.col("reply"))))


# The texts that a rendered block is made of.
SECTIONS = {"earlier": "[较早的用户消息]", "anchor": "[检索命中的对话轮次]", "later": "[后续用户消息]"}
ROLES = ("用户", "助手")
TODAY = "当前日期：{}。"
NOTICE = "以下历史记忆是检索得到的非连续片段。“检索命中的对话轮次”保留该轮公开问答；“较早的用户消息”和“后续用户消息”只用于补充用户表达，中间可能省略其他对话，不应视为连续聊天记录。"
ANCHOR_CHARS, OTHER_CHARS = 1000, 800


def turn_lines(turns: DataFrame) -> DataFrame:
    """turns (query_id, window_id, position, message_id, role, created_at, content, section, is_anchor, matched or null)
    -> query_id, window_id, lines: a title where a section begins, then a line a turn: marked if it was hit, with its
    role and day, escaped. A long text is cut around the matched words if it was hit there, else to its end."""
    limit = F.when(F.col("is_anchor"), ANCHOR_CHARS).otherwise(OTHER_CHARS)
    text = T.text_of(F.col("content"))
    line = T.strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    matched = F.col("is_anchor") & (T.text_of(F.col("matched")) != "") & F.contains(text, T.text_of(F.col("matched")))
    tail = F.concat(F.lit("…"), F.substring(line, F.length(line) - limit + 1, limit))
    shown = F.when(matched & (F.length(line) > limit), T.match_snippet(F.col("content"), F.col("matched"), ANCHOR_CHARS)).when(F.length(line) <= limit, line).otherwise(tail)
    w = Window.partitionBy("query_id", "window_id").orderBy("position", "message_id")
    begins = F.coalesce(F.lag("section").over(w), F.lit("")) != F.coalesce("section", F.lit(""))
    title = F.when(begins, F.create_map(*(F.lit(x) for kv in SECTIONS.items() for x in kv))[F.coalesce("section", F.lit(""))])
    role = F.when(F.col("role") == "user", ROLES[0]).otherwise(ROLES[1])
    day = F.coalesce(F.concat(F.lit("（"), T.date_label(F.col("created_at")), F.lit("）")), F.lit(""))
    said = F.concat(F.when(F.col("is_anchor"), "★ ").otherwise(""), role, day, F.lit("："), T.html_escape(shown))
    rows = turns.select("query_id", "window_id", "position", "message_id", "created_at", F.array_compact(F.array(title, said)).alias("said"))
    g = rows.groupBy("query_id", "window_id").agg(F.array_sort(F.collect_list(F.struct("position", "message_id", "said"))).alias("x"), F.min("created_at").alias("starts_at"))
    return g.select("query_id", "window_id", "starts_at", F.flatten(F.transform("x", lambda r: r["said"])).alias("lines"))


def render_windows(windows: DataFrame, turns: DataFrame, today: str, budget: int = 1600) -> DataFrame:
    """windows (query_id, window_id, conversation_id, score) and their turns -> per query: n, tokens, left_out (windows
    that didn't fit, best first), rendered (empty if none fits).

    Windows are tried from the best score down; one is taken if the whole block, header and tags included, is still
    within the budget, else the next is tried. Tokens follow from the running counts of characters, so no window's
    rounding adds up. Those taken stand in order of time."""
    head = f"{TODAY.format(today)}\n{NOTICE}"
    opening, closing = '\n<retrieved_memory index="', "\n</retrieved_memory>\n"
    begin, end = "<episodic_memory>\n", "\n</episodic_memory>"
    body = F.concat(F.lit('">\n'), F.array_join("lines", "\n"))
    own = F.concat(F.lit("\n" + opening), body, F.lit(closing))
    cjk = lambda c: F.regexp_count(c, F.lit(T.CJK_EXTENDED))
    w = windows.join(turn_lines(turns), ["query_id", "window_id"])
    x = F.struct((-F.col("score")).alias("worse"), "window_id", "conversation_id", "starts_at", body.alias("body"), F.length(own).alias("n"), cjk(own).cast("int").alias("cjk"))
    g = w.groupBy("query_id").agg(F.array_sort(F.collect_list(x)).alias("x"))
    # A trailing line end is stripped.
    fixed_n, fixed_cjk = F.lit(len(begin + head + end) - 1), cjk(F.lit(head)).cast("int")
    start = F.struct(F.array().cast("array<int>").alias("taken"), fixed_n.alias("n"), fixed_cjk.alias("cjk"), F.lit(0).alias("i"))

    def step(acc: Column, v: Column) -> Column:
        n = acc["n"] + v["n"] + F.length((F.size(acc["taken"]) + 1).cast("string"))
        c = acc["cjk"] + v["cjk"]
        fits = c + F.ceil((n - c) / 3) <= budget
        return F.struct(F.when(fits, F.array_append(acc["taken"], acc["i"])).otherwise(acc["taken"]).alias("taken"), F.when(fits, n).otherwise(acc["n"]).alias("n"), F.when(fits, c).otherwise(acc["cjk"]).alias("cjk"), (acc["i"] + 1).alias("i"))

    p = g.withColumn("p", F.aggregate("x", start, step))
    chosen = F.array_sort(F.transform("p.taken", lambda i: F.struct(F.get("x", i)["starts_at"].alias("at"), F.get("x", i)["conversation_id"].alias("c"), F.get("x", i)["window_id"].alias("w"), F.get("x", i)["body"].alias("body"))))
    blocks = F.transform(chosen, lambda v, i: F.concat(F.lit(opening), (i + 1).cast("string"), v["body"], F.lit(closing)))
    text = F.concat(F.lit(head + "\n"), F.array_join(blocks, "\n"))
    full = F.concat(F.lit(begin), F.substring(text, F.lit(1), F.length(text) - 1), F.lit(end))
    n = F.size("p.taken")
    left_out = F.transform(F.filter("x", lambda v, i: ~F.array_contains(F.col("p.taken"), i)), lambda v: v["window_id"])
    out = p.select("query_id", n.cast("long").alias("n"), left_out.alias("left_out"), F.when(n > 0, full).otherwise("").alias("rendered"))
    return out.select("query_id", "n", T.count_tokens(F.col("rendered")).alias("tokens"), "left_out", "rendered")
