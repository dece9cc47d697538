"""Fragments and spans of retrieved messages: assembly under token budgets, rendering, stitching, merging, linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.functions import text as T


def _prefix_that_fits(items: Column, room: Column) -> Column:
    """The longest prefix of texts whose tokens fit the room."""

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + T.count_tokens(x)
        go = ~acc["full"] & (used <= room)
        return F.struct(F.when(go, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"), F.when(go, used).otherwise(acc["used"]).alias("used"), (acc["full"] | ~go).alias("full"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"))
    return F.aggregate(items, start, step, lambda a: a["out"])


def render_fragments(fragments: DataFrame) -> DataFrame:
    """Per query: fragments (of fragments.trim_fragments) in order of time, numbered, escaped, without ids and scores; … where a
    segment's message goes on before or after it: query_id, n, rendered."""
    texts = lambda c: F.transform(c, lambda x: x["content"])
    some = lambda when, text: F.when(when, F.array(text)).otherwise(F.array().cast("array<string>"))
    dots = F.lit("…")
    parts = F.concat(some(F.col("reply") != "", F.col("reply")), some(F.col("omitted_before"), dots), texts("earlier"), texts("core"), texts("later"), some(F.col("omitted_after"), dots))
    g = fragments.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "message_id", T.html_escape(F.array_join(parts, "\n")).alias("body"), T.date_label(F.col("created_at")).alias("day")))).alias("x"))
    lines = F.transform("x", lambda f, i: F.concat(F.lit('<memory index="'), (i + 1).cast("string"), F.lit('" date="'), f["day"], F.lit('">\n'), f["body"], F.lit("\n</memory>")))
    return g.select("query_id", F.size("x").cast("long").alias("n"), F.array_join(lines, "\n").alias("rendered"))


def memory_block(profile: DataFrame, episodes: DataFrame, profile_most: int = 640, budget: int = 1600, most: int = 2400) -> DataFrame:
    """(query_id, profile text) and (query_id, episode lines) -> the block: the profile (an error if it is too long) and, in
    <episodic_memory>, the first lines that fit what the profile leaves of the budget, at most `most` tokens."""
    p = profile.withColumn("pt", T.count_tokens(F.col("profile")))
    p = p.withColumn("profile", F.when(F.col("pt") > profile_most, F.raise_error(F.concat(F.lit("profile too long: "), F.col("pt").cast("string")))).otherwise(F.col("profile")))
    room = F.least(F.greatest(F.lit(0), F.lit(budget) - F.coalesce("pt", F.lit(0))), F.lit(most))
    j = episodes.join(p, "query_id", "full")
    body = T.strip(F.array_join(_prefix_that_fits(F.coalesce("lines", F.array().cast("array<string>")), room), "\n"))
    tagged = F.when(body != "", F.concat(F.lit("<episodic_memory>\n"), body, F.lit("\n</episodic_memory>")))
    return j.select("query_id", F.concat_ws("\n\n", F.nullif(T.text_of(F.col("profile")), F.lit("")), tagged).alias("block"))


def stitch_spans(anchors: DataFrame, messages: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Anchors (query_id, message_id, score) -> span rows: the whole turn of the anchor and the user messages of the `before` and
    `after` turns around it; a neighbour belongs to its best anchor only: query_id, anchor_id, message_id, kind."""
    turns = messages.select("conversation_id", "turn_id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn_id")))
    m = messages.join(turns, ["conversation_id", "turn_id"]).select("conversation_id", "message_id", "role", "rank")
    a = anchors.join(m, "message_id").select("query_id", F.col("message_id").alias("anchor_id"), "score", "conversation_id", F.col("rank").alias("at"))
    j = a.join(m, "conversation_id").where(F.col("rank").between(F.col("at") - before, F.col("at") + after))
    own = j.where("rank = at").select("query_id", "anchor_id", "score", "message_id", F.when(F.col("message_id") == F.col("anchor_id"), "anchor").otherwise("turn").alias("kind"))
    near = j.where("rank <> at and role = 'user'").select("query_id", "anchor_id", "score", "message_id", F.lit("neighbour").alias("kind"))
    w = Window.partitionBy("query_id", "message_id").orderBy(F.expr("kind = 'neighbour'"), F.desc("score"), "anchor_id")
    return own.unionByName(near).withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", "anchor_id", "message_id", "kind")


def span_components(spans: DataFrame) -> DataFrame:
    """Spans (query_id, conversation_id, span_id, position) that share a position of a conversation, also by way of
    others, are one component: query_id, conversation_id, span_id, component (its smallest span id).

    One shuffle and one fold for each query and conversation, whose spans are few (those retrieved for the query): each
    span joins all components so far that it shares a position with, so chains of any length need no further round."""
    each = spans.groupBy("query_id", "conversation_id", "span_id").agg(F.collect_set("position").alias("positions"))
    g = each.groupBy("query_id", "conversation_id").agg(F.array_sort(F.collect_list(F.struct("span_id", "positions"))).alias("x"))
    kind = {f: each.schema[f].dataType.simpleString() for f in ("span_id", "positions")}
    none = F.array().cast(f"array<struct<positions: {kind['positions']}, spans: array<{kind['span_id']}>>>")

    def step(acc: Column, v: Column) -> Column:
        met = F.filter(acc, lambda c: F.arrays_overlap(c["positions"], v["positions"]))
        one = F.struct(
            F.array_distinct(F.concat(F.flatten(F.transform(met, lambda c: c["positions"])), v["positions"])).alias("positions"), F.concat(F.flatten(F.transform(met, lambda c: c["spans"])), F.array(v["span_id"])).alias("spans")
        )
        return F.array_append(F.filter(acc, lambda c: ~F.arrays_overlap(c["positions"], v["positions"])), one)

    found = g.select("query_id", "conversation_id", F.explode(F.aggregate("x", none, step)).alias("c"))
    return found.select("query_id", "conversation_id", F.explode("c.spans").alias("span_id"), F.array_min("c.spans").alias("component"))


def merge_spans(spans: DataFrame, turns: DataFrame, most: int = 8) -> DataFrame:
    """spans (query_id, span_id, conversation_id, fused, rerank, queries: array) and turns (query_id, span_id, position,
    message_id, is_anchor, matched) -> one row per component: query_id, conversation_id, bundle_id, anchor_ids, messages
    (position, message_id, is_anchor, matched; in order), fused, rerank, queries.

    Scores are the highest of the component, queries those of its spans without repeats, best span first. A message is
    an anchor if it is one in any span; its matched text is that of its best span as an anchor, else of its best span with
    one. Anchors always stay; of the others the nearest to the anchors' mean position fill up to `most` messages (ties:
    the earlier position). Without an anchor that is the middle message's position and no ids are given."""
    rows = turns.join(spans, ["query_id", "span_id"])
    comp = span_components(rows).drop("conversation_id")
    rows = rows.join(comp, ["query_id", "span_id"])
    key = ["query_id", "conversation_id", "component"]
    rank = F.struct(-F.coalesce("rerank", F.lit(0.0)), -F.coalesce("fused", F.lit(0.0)), F.col("span_id"))
    text = F.nullif(F.coalesce("matched", F.lit("")), F.lit(""))
    one = rows.groupBy(*key, "message_id").agg(
        F.min("position").alias("position"), F.bool_or("is_anchor").alias("is_anchor"), F.min_by(text, F.when(text.isNotNull() & F.col("is_anchor"), rank)).alias("own"), F.min_by(text, F.when(text.isNotNull(), rank)).alias("other")
    )
    m = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", "message_id", "is_anchor", F.coalesce("own", "other").alias("matched")))).alias("m"))
    heads = spans.join(comp, ["query_id", "span_id"]).groupBy(*key).agg(F.max(F.coalesce("fused", F.lit(0.0))).alias("fused"), F.max(F.coalesce("rerank", F.lit(0.0))).alias("rerank"), F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.coalesce("queries", F.array().cast("array<string>")).alias("q")))).alias("q"))
    j = m.join(heads, key).withColumn("anchors", F.filter("m", lambda x: x["is_anchor"])).withColumn("rest", F.filter("m", lambda x: ~x["is_anchor"]))
    mean = F.aggregate("anchors", F.lit(0.0), lambda s, x: s + x["position"]) / F.size("anchors")
    centre = F.when(F.size("anchors") > 0, mean).otherwise(F.get("m", F.floor(F.size("m") / 2).cast("int"))["position"].cast("double"))
    j = j.withColumn("centre", centre).withColumn("room", F.greatest(F.lit(0), most - F.size("anchors")))
    nearest = F.array_sort(F.transform("rest", lambda x: F.struct(F.abs(x["position"] - F.col("centre")).alias("far"), x.alias("x"))))
    kept = F.when(F.size("m") <= most, F.col("m")).otherwise(F.array_sort(F.concat("anchors", F.transform(F.slice(nearest, F.lit(1), F.col("room")), lambda x: x["x"]))))
    ids = F.array_sort(F.transform("anchors", lambda x: x["message_id"]))
    bundle = F.concat(F.lit("c"), F.col("conversation_id").cast("string"), F.lit("-"), F.array_join(F.slice(ids, 1, 4), "-"))
    return j.select("query_id", "conversation_id", bundle.alias("bundle_id"), ids.alias("anchor_ids"), kept.alias("messages"), "fused", "rerank", F.array_distinct(F.flatten(F.transform("q", lambda x: x["q"]))).alias("queries"))


def link_strength(windows: DataFrame) -> DataFrame:
    """Ordered pairs of a query's windows (window_id, conversation_id, starts_at, ends_at, entities, terms, query_terms, vector)
    -> a, b, strength of b as the continuation of a: 0.30 shared entities, 0.30 cosine, 0.20 nearness in time, 0.15 share
    of the query's terms that b adds, 0.10 same session. Nearness falls from 0.35 to 0.05 with the days from a's end to b's
    start; where b starts before that, it is 0.15 within three days, else 0. A query has at most 10 windows."""
    cols = ("window_id", "conversation_id", "starts_at", "ends_at", "entities", "terms", "vector")
    side = lambda s: windows.select("query_id", *(F.col(c).alias(f"{s}_{c}") for c in cols), F.col("query_terms").alias(f"{s}_query_terms"))
    j = side("a").join(side("b"), "query_id").where("a_window_id <> b_window_id")
    gap = (F.col("b_starts_at") - F.col("a_ends_at")).cast("double")
    near = F.when(gap >= 0, F.greatest(F.lit(0.05), 0.35 * F.exp(-gap / 86400 / 90))).when(gap > -3 * 86400, 0.15).otherwise(0.0)
    asked = F.array_distinct("b_query_terms")
    gain = F.size(F.array_intersect(F.array_except("b_terms", "a_terms"), asked)) / F.greatest(F.lit(1), F.size(asked))
    same = F.when(F.col("a_conversation_id") == F.col("b_conversation_id"), 0.1).otherwise(0.0)
    strength = 0.3 * T.jaccard(F.col("a_entities"), F.col("b_entities")) + 0.3 * T.cosine(F.col("a_vector"), F.col("b_vector")) + 0.2 * near + 0.15 * gain + same
    return j.select("query_id", F.col("a_window_id").alias("a"), F.col("b_window_id").alias("b"), strength.alias("strength"))


def link_chains(windows: DataFrame, links: DataFrame, threshold: float = 0.22) -> DataFrame:
    """Chains of a query's windows (window_id, score), greedily: the best free window starts one, and the free window most
    strongly linked to its end joins while that is at least the threshold: query_id, chain, place, window_id. Groups hold
    at most 10 windows."""
    import pandas as pd

    g = windows.groupBy("query_id").agg(F.collect_list(F.struct("window_id", "score")).alias("w"))
    e = links.groupBy("query_id").agg(F.collect_list(F.struct("a", "b", "strength")).alias("e"))
    rows = g.join(e, "query_id", "left")

    def grow(frames):
        for df in frames:
            out = []
            for q, w, edges in zip(df["query_id"], df["w"], df["e"]):
                strength = {}
                for x in edges if edges is not None else []:
                    strength[x["a"], x["b"]] = x["strength"]
                free = [x["window_id"] for x in sorted(w, key=lambda x: (-x["score"], x["window_id"]))]
                chain = 0
                while free:
                    end, place = free.pop(0), 0
                    out.append((q, chain, place, end))
                    while free:
                        best = max(free, key=lambda x: (strength.get((end, x), 0.0), -x))
                        if strength.get((end, best), 0.0) < threshold:
                            break
                        free.remove(best)
                        end, place = best, place + 1
                        out.append((q, chain, place, end))
                    chain += 1
            yield pd.DataFrame(out, columns=["query_id", "chain", "place", "window_id"])

    return rows.mapInPandas(grow, "query_id long, chain int, place int, window_id long")


def query_snippet(df: DataFrame, limit: int) -> Column:
    """(content, sims: similarity of each sentence): the content if short; else the best sentence and, unless it is far off and
    much weaker, the second, each with its neighbours; the end of the text without similarities."""
    s = T.sentences(F.col("content"))
    order = F.transform(F.sort_array(F.transform("sims", lambda x, i: F.struct(x.alias("s"), (-i).alias("i"))), asc=False), lambda x: F.struct(x["s"].alias("s"), (-x["i"]).alias("i")))
    one, two = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    use_two = two.isNotNull() & ~((F.abs(one["i"] - two["i"]) > 2) & (two["s"] < 0.55 * one["s"]))
    near = lambda i, at: F.abs(i - at) <= 1
    picked = F.filter(F.transform(s, lambda x, i: F.when(near(i, one["i"]) | F.coalesce(use_two & near(i, two["i"]), F.lit(False)), T.strip(x)).otherwise("")), lambda x: x != "")
    body = F.array_join(picked, "")
    cut = F.when(F.length(body) > limit, F.concat(F.substring(body, F.lit(1), F.lit(limit)), F.lit("…"))).otherwise(body)
    tail = F.concat(F.lit("…"), F.substring(F.col("content"), F.length("content") - limit + 1, F.lit(limit)))
    return F.when(F.length("content") <= limit, F.col("content")).when(F.coalesce(F.size("sims"), F.lit(0)) < 1, tail).otherwise(cut)
