"""Fragments, spans, windows, replayed profiles, blocked top-k and LCS on fixtures worked out by hand or by plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoglake.operators import evaluate, fragments, profiles, retrieval, spans

PART = "array<struct<id: long, content: string>>"


def fragment(spark, kind, core, earlier=(), later=(), reply="", omitted=False):
    part = lambda xs: [(i, x) for i, x in enumerate(xs)]
    row = (1, kind, 7, "user", 3, 1_700_000_000, 0.9, part(core), part(earlier), part(later), None, reply, omitted, False)
    return spark.createDataFrame([row], f"query_id long, fragment_type string, message_id long, role string, conversation_id long, created_at long, score double, core {PART}, earlier {PART}, later {PART}, reply_id long, reply string, omitted_before boolean, omitted_after boolean")


def texts(parts):
    return [p.content for p in parts]


def test_budgets_drop_later_then_earlier_then_the_reply(spark):
    t = lambda n: "x" * (3 * n)  # noqa: E731  n tokens
    trim = lambda *a, **k: fragments.trim_fragments(fragment(spark, *a, **k)).first()
    r = trim("message", [t(300)], [t(50), t(60)], [t(70), t(80)], t(50))
    # 300 + 50 + 110 leave 60: neither of the later ones fits, and the first that doesn't fit ends it.
    assert texts(r.earlier) == [t(50), t(60)] and r.later == [] and r.dropped == 2 and r.token_count == 460
    r = trim("message", [t(400)], [t(50), t(60)], [t(5)], t(50))
    # Earlier ones go from the start, and only once no later one is left.
    assert texts(r.earlier) == [t(60)] and r.later == [] and r.token_count == 510
    r = trim("message", [t(310)], [t(1)], [], t(400))
    assert r.earlier == [] and len(r.reply) == 221 and r.token_count == 310 + 74
    # The pair that never ends if a cut that changes nothing is tried again: 310 and 220 tokens of CJK characters.
    r = trim("message", ["核" * 310], [], [], "答" * 220)
    assert r.reply == "" and texts(r.core) == ["核" * 310] and r.token_count == 310
    r = trim("message", ["核" * 600], [], [], "答" * 300)
    assert r.reply == "" and r.token_count <= 260 and len(r.core[0].content) > 200


def test_segments_of_the_core_survive_any_budget(spark):
    r = fragments.trim_fragments(fragment(spark, "segment", ["核心内容必须保留"], ["扩展一" * 50], ["扩展二" * 50, "尾" * 9])).first()
    assert texts(r.core) == ["核心内容必须保留"] and texts(r.earlier) == ["扩展一" * 50] and texts(r.later) == ["扩展二" * 50, "尾" * 9][:2] and r.token_count == 317
    r = fragments.trim_fragments(fragment(spark, "segment", ["核" * 500, "心" * 9], ["前"], ["后"], "答" * 300)).first()
    assert texts(r.core) == ["核" * 500, "心" * 9] and not r.earlier and not r.later and r.reply == "" and r.token_count == 509
    r = fragments.trim_fragments(fragment(spark, "segment", ["核" * 100], ["前" * 100, "近" * 90], ["后" * 50], "")).first()
    assert texts(r.earlier) == ["前" * 100, "近" * 90] and r.later == [] and r.dropped == 1
    r = fragments.trim_fragments(fragment(spark, "segment", [""], [], [], "")).first()
    assert r.token_count == 0


def test_rendered_fragments_are_escaped_and_mark_what_is_left_out(spark):
    f = fragments.trim_fragments(fragment(spark, "segment", ["a <b>"], ["e & f"], [], "asked", True))
    assert spans.render_fragments(f).first().rendered == '<memory index="1" date="2023-11-14">\nasked\n…\ne &amp; f\na &lt;b&gt;\n</memory>'


TURN = "query_id long, span_id long, position long, message_id long, is_anchor boolean, matched string"


def merged(spark, windows, most=8, scores=None):
    """windows: span id -> [(position, is_anchor)]; a message's id is its position."""
    rows = [(1, s, p, p, a, f"m{s}" if a else None) for s, ps in windows.items() for p, a in ps]
    heads = [(1, s, 5, *(scores or {}).get(s, (1.0 / s, 2.0 / s)), [f"q{s}", "all"]) for s in windows]
    df = spark.createDataFrame(heads, "query_id long, span_id long, conversation_id long, fused double, rerank double, queries array<string>")
    return spans.merge_spans(df, spark.createDataFrame(rows, TURN), most).collect()


def test_sparse_spans_are_merged_by_shared_positions(spark):
    got = merged(spark, {1: [(1, True), (5, False)], 2: [(5, False), (9, True)], 3: [(9, False), (12, True)], 4: [(20, True)], 5: [(3, True)]})
    by = {r.bundle_id: r for r in got}
    assert sorted(by) == ["c5-1-9-12", "c5-20", "c5-3"]
    one = by["c5-1-9-12"]
    assert [m.position for m in one.messages] == [1, 5, 9, 12] and (one.fused, one.rerank) == (1.0, 2.0)
    assert one.queries == ["q1", "all", "q2", "q3"] and [m.matched for m in one.messages] == ["m1", None, "m2", "m3"]


def test_anchors_survive_the_cap_and_neighbours_near_them_stay(spark):
    anchors = [(i, True) for i in range(1, 10)]
    got = merged(spark, {1: anchors[:5] + [(20, False)], 2: anchors[4:] + [(21, False)]})
    assert len(got) == 1 and [m.position for m in got[0].messages] == list(range(1, 10)) and got[0].bundle_id == "c5-1-2-3-4"
    got = merged(spark, {1: [(p, p in (6, 10)) for p in (1, 5, 6, 7, 10, 11, 30)]}, most=5)
    assert [m.position for m in got[0].messages] == [5, 6, 7, 10, 11]
    got = merged(spark, {1: [(p, False) for p in (1, 2, 3, 4)]}, most=2)
    assert [m.position for m in got[0].messages] == [2, 3] and got[0].anchor_ids == []


def test_a_long_chain_is_one_component(spark):
    n = 400
    rows = [(1, 1, s, p) for s in range(n) for p in (s, s + 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, (1, 1, 9_000, 9_000), (1, 2, 9_001, 5), (2, 1, 9_002, 5)], "query_id long, conversation_id long, span_id long, position long")
    got = {(r.query_id, r.conversation_id, r.span_id): r.component for r in spans.span_components(df).collect()}
    assert all(got[1, 1, s] == 0 for s in range(n)) and got[1, 1, 9_000] == 9_000 and got[1, 2, 9_001] == 9_001 and got[2, 1, 9_002] == 9_002


def windows(spark, bodies, scores, matched=None):
    turns = [(1, k, p, k * 10 + p, "user" if p == 0 else "assistant", 1_700_000_000 + k * 86400, body, "anchor" if p == 0 else "later", p == 0, matched if p == 0 else None) for k, body in enumerate(bodies) for p in (0, 1)]
    w = spark.createDataFrame([(1, k, 100 + k, s) for k, s in enumerate(scores)], "query_id long, window_id long, conversation_id long, score double")
    return w, spark.createDataFrame(turns, "query_id long, window_id long, position long, message_id long, role string, created_at long, content string, section string, is_anchor boolean, matched string")


def test_a_window_that_is_too_large_is_skipped_and_the_next_tried(spark):
    w, t = windows(spark, ["<b>一</b>", "二" * 700, "三&四"], [0.9, 0.8, 0.7])
    r = fragments.render_windows(w, t, "2026-01-01", 400).first()
    assert (r.n, r.left_out) == (2, [1]) and r.tokens <= 400
    blocks = [x.split("</retrieved_memory>")[0] for x in r.rendered.split('<retrieved_memory index="')[1:]]
    assert blocks[0] == '1">\n[检索命中的对话轮次]\n★ 用户（2023-11-14）：&lt;b&gt;一&lt;/b&gt;\n[后续用户消息]\n助手（2023-11-14）：&lt;b&gt;一&lt;/b&gt;\n'
    assert blocks[1].startswith('2">') and "三&amp;四" in blocks[1]
    assert r.rendered.startswith("<episodic_memory>\n当前日期：2026-01-01。\n以下") and r.rendered.endswith("\n</retrieved_memory>\n</episodic_memory>")
    assert fragments.render_windows(w, t, "2026-01-01", 100).first().rendered == ""
    # Exactly its own tokens fit, one less doesn't; time decides the order, not the score.
    w, t = windows(spark, ["a", "b"], [0.1, 0.9])
    full = fragments.render_windows(w, t, "2026-01-01").first()
    assert fragments.render_windows(w, t, "2026-01-01", full.tokens).first() == full
    assert fragments.render_windows(w, t, "2026-01-01", full.tokens - 1).first().left_out == [0]


@pytest.mark.parametrize("n", range(1, 7))
def test_a_block_of_just_the_budget_is_taken(spark, n):
    # Six lengths in a row, so that every remainder of three characters a token is met.
    w, t = windows(spark, ["a" * n], [1.0])
    full = fragments.render_windows(w, t, "2026-01-01").first()
    assert full.n == 1 and fragments.render_windows(w, t, "2026-01-01", full.tokens).first() == full
    assert fragments.render_windows(w, t, "2026-01-01", full.tokens - 1).first().left_out == [0]


def test_long_turns_are_cut_to_the_match_or_the_end(spark):
    body = "x" * 3000 + "needle" + "y" * 3000
    w, t = windows(spark, [body], [1.0], "needle")
    r = fragments.render_windows(w, t, "2026-01-01", 5000).first().rendered
    assert r.count("needle") == 1 and "…" + "y" * 800 in r


OPS = "user_id long, message_id long, op_no int, op string, target_id long, content string"
FACTS = "id long, user_id long, content string, status string, created_at long"
MESSAGES = "message_id long, user_id long, role string, is_deleted boolean, created_at long, content string"


def test_replay_in_order(spark):
    have = spark.createDataFrame([(1, 9, "likes tea.", "active", 5), (2, 9, "has a dog.", "active", 6), (3, 9, "old.", "deleted", 1), (4, 8, "other.", "active", 5)], FACTS)
    m = spark.createDataFrame([(k, 9, "user", False, 100 + k, "t") for k in (10, 11, 12, 13)] + [(14, 9, "assistant", False, 1, "t"), (15, 9, "user", True, 1, "t"), (16, 8, "user", False, 116, "t")], MESSAGES)
    rows = [
        (9, 10, 0, "delete", 1, ""),
        (9, 11, 0, "update", 1, "likes coffee"), (9, 11, 1, "add", None, "likes tea"),  # 1 is gone, so its content is free again
        (9, 12, 0, "update", 2, "has a cat"), (9, 12, 1, "add", None, "has a dog."), (9, 12, 2, "add", None, "a "), (9, 12, 3, "add", None, "fourth"),  # has a dog is active before the message; the fourth isn't looked at
        (9, 13, 0, "add", 2, "x"), (9, 13, 1, "update", 2, "has a cat"), (9, 13, 2, "add", None, "y" * 65), (9, 14, 0, "delete", 2, ""), (9, 15, 0, "delete", 2, ""), (8, 16, 0, "delete", 2, ""), (8, 16, 1, "delete", 4, "x"), (8, 99, 0, "delete", 4, ""),
    ]
    ops = spark.createDataFrame(rows, OPS)
    got = {r.id: (r.content, r.status, r.created_at, r.why) for r in profiles.apply_ops(have, ops, m).collect()}
    assert got == {
        1: ("likes tea.", "deleted", 5, "deleted"), 2: ("has a cat。", "active", 6, None), 3: ("old.", "deleted", 1, None), 4: ("other.", "active", 5, None), 111: ("likes tea。", "active", 111, None), 122: ("a。", "active", 112, None),
    }


def test_replay_twice_changes_nothing_and_limits_hold_for_skipped_messages(spark):
    have = spark.createDataFrame([(i, 9, f"fact {i}.", "active", i) for i in range(5)], FACTS)
    m = spark.createDataFrame([(10, 9, "user", False, 110, "t"), (11, 9, "user", False, 111, "t")], MESSAGES)
    ops = spark.createDataFrame([(9, 10, 0, "add", None, "new"), (9, 11, 0, "delete", 4, "")], OPS)
    none = spark.createDataFrame([], "user_id long, message_id long, content_hash string")
    once = profiles.apply_ops(have, ops, m, none, most_items=4)
    rows = lambda df: sorted((r.id, r.content, r.status) for r in df.collect())
    assert rows(once) == [(0, "fact 0.", "deleted"), (1, "fact 1.", "deleted"), (2, "fact 2.", "active"), (3, "fact 3.", "active"), (4, "fact 4.", "deleted"), (100, "new。", "active")]
    ledger = profiles.new_ledger_rows(m, none)
    assert ledger.count() == 2
    assert rows(profiles.apply_ops(once.drop("why"), ops, m, ledger, most_items=4)) == rows(once)
    assert profiles.new_ledger_rows(m, ledger).count() == 0
    # Skipped, yet the lower limit is enforced.
    less = profiles.apply_ops(once.drop("why"), ops, m, ledger, most_items=1)
    assert [r.id for r in less.where("status = 'active'").collect()] == [100]
    changed = m.withColumn("content", F.lit("edited"))
    assert profiles.new_ledger_rows(changed, ledger).count() == 2
    short = profiles.apply_ops(have, ops, m, none, most_tokens=6)
    assert sorted(r.id for r in short.where("status = 'active'").collect()) == [100]  # 4 was left with it, and goes


def test_top_k_in_blocks_is_the_top_k_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    units = [(i, i % 3 if i % 5 else 0, rng.integers(-2, 3, 4 if i % 7 else 3).astype(float).tolist()) for i in range(400)] + [(900, 0, None), (901, 0, [None, 1.0, 1.0, 1.0]), (902, 0, [])]
    asked = [(1000 + i, i % 4, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(20)] + [(2000, 0, [0.0] * 4)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, user_id long, vector array<double>")
    want = set()
    for q, user, v in asked:
        near = []
        for u, owner, x in units:
            if owner == user and x and len(x) == len(v) and None not in x and any(x) and any(v):
                c = float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v))
                if c > 1e-12:
                    near.append((-round(c, 9), u))
        want |= {(q, u, k + 1) for k, (_, u) in enumerate(sorted(near)[:6])}
    for size in (7, 100_000):
        got = retrieval.dense_topk(frame(asked, "query_id"), frame(units, "unit_id"), 6, unit_block=size, query_block=3)
        assert {(r.query_id, r.unit_id, r.semantic_rank) for r in got.collect()} == want


def test_lcs_against_the_table():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 90)) for _ in "ab")
        assert evaluate.lcs(a, b) == table(a, b)
    long = rng.choices("abcdefgh", k=5_000)
    assert evaluate.lcs(long, long[::-1]) == evaluate.lcs(long[::-1], long) > 1_000 and evaluate.lcs(long, long) == 5_000


def test_lcs_length_of_columns(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), (None, ["b"]), ([], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(evaluate.lcs_length(F.col("a"), F.col("b"))).collect()] == [1, 0, 0]


@pytest.mark.parametrize("most, want", [(10, 3), (1, 1)])
def test_build_fragments(spark, most, want):
    msg = [(5, k, k, r, f"text {k}", 100 + k, rep, s, x) for k, r, rep, s, x in [(1, "user", None, 0.9, False), (2, "assistant", 1, 0.9, False), (3, "user", None, 0.9, False), (4, "assistant", 3, 0.1, False), (5, "user", None, 0.2, False), (6, "user", None, 0.9, False), (7, "user", None, 0.9, True)]]
    m = spark.createDataFrame(msg, "conversation_id long, message_id long, position long, role string, content string, created_at long, reply_to_message_id long, sim double, excluded boolean")
    seg = spark.createDataFrame([(2, i, f"part {i}", s) for i, s in enumerate([0.9, 0.1, 0.1, 0.1, 0.9])], "message_id long, segment_index int, content string, sim double")
    hits = spark.createDataFrame([(1, 3, None, 0.5), (1, 3, 0, 0.99), (1, 2, 1, 0.7), (1, 2, 2, 0.6), (1, 2, 4, 0.65), (1, 7, None, 1.0), (1, 4, None, 0.4)], "query_id long, message_id long, segment_index int, score double")
    got = {r.message_id: r for r in fragments.build_fragments(hits, m, seg, most).collect()}
    assert len(got) == want and 7 not in got
    r = got[2]
    assert (r.fragment_type, texts(r.core), texts(r.earlier), texts(r.later)) == ("segment", ["part 1", "part 2"], ["part 0"], [])
    assert (r.omitted_before, r.omitted_after, r.reply_id, r.reply, r.score) == (False, True, 1, "text 1", 0.7)
    if most > 1:
        # Message 5 is too far off, so what is behind it isn't reached.
        assert (texts(got[3].core), texts(got[3].earlier), texts(got[3].later), got[3].reply) == (["text 3"], ["text 1"], [], "")
        assert (got[4].reply, texts(got[4].earlier)) == ("text 3", ["text 1", "text 3"])


def test_users_of_any_size_are_scored_and_paired_in_blocks(spark):
    """Small blocks and slices give what large ones give, and no shuffle of pairs is planned for a fallback."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    units = spark.createDataFrame([(i, i % 2, i, rng.choice(["user", "assistant"]), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(60)], "unit_id long, user_id long, message_id long, role string, content string")
    queries = spark.createDataFrame([(i, i % 3, " ".join(rng.choices(words, k=3)), ["user", "assistant", "both"][i % 4 % 3]) for i in range(20)], "query_id long, user_id long, text string, role_scope string")
    key = lambda df: sorted(map(tuple, df.select("query_id", "unit_id", F.round("bm25", 9), "lexical_rank").collect()))
    whole = key(retrieval.bm25_topk(queries, units, 4))
    assert whole and key(retrieval.bm25_topk(queries, units, 4, unit_block=7, query_block=3)) == whole
    out = queries.select("query_id", "user_id").join(units.where("message_id % 3 = 0").select("user_id", "message_id"), "user_id")
    pairs = lambda n: sorted(map(tuple, retrieval.scoped(queries, units, out, n).collect()))
    assert pairs(50) == pairs(10**9) and pairs(50)
    for least in (1, 14, 99):
        scopes = queries.select("query_id", "user_id", F.explode(F.array_distinct(F.array(F.lit("both"), "role_scope"))).alias("role_scope"))
        hits = scopes.join(units, "user_id").where("role_scope = 'both' or role_scope = role").select("query_id", "role_scope", "unit_id")
        want = sorted(map(tuple, retrieval.scope_fallback(hits, queries, least).select("query_id", "role_scope", "unit_id").collect()))
        assert sorted(map(tuple, retrieval.scoped_fallback(queries, units, least).collect())) == want


def test_overlap_shuffles_nothing(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "b"], ["a", "b", "a"]), (2, [], ["a"]), (3, None, ["a"])], "id long, p array<string>, r array<string>")
    got = evaluate.sentence_metrics(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, round(r.rouge_1, 6), round(r.rouge_2, 6)) for r in got.orderBy("id").collect()] == [(1, round(6 / 7, 6), 0.8), (2, 0.0, 0.0), (3, 0.0, 0.0)]
