"""Text rules and operators on small fixtures whose expected values are worked out by hand."""

import json
from math import exp

import pytest
from pyspark.sql import functions as F

from dialoglake.functions import text as T
from dialoglake.operators import memory, pairs, profiles, spans
from dialoglake.operators.keys import append_new_until, neighbour_range
from dialoglake.sources.json_array import elements, read_json_array


def values(spark, rule, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", rule(F.col("t")).alias("v")).orderBy("i").collect()]


def test_repetition_score(spark):
    abab = "ab " * 20
    got = values(spark, T.repetition_score, [None, "  ", "short?", abab, "？" * 3, "abcdefghijkl"])
    # 59 characters after strip; 40 without blanks, 38 runs of three, two of them distinct.
    assert got[:2] == [-1e9, -1e9]
    assert got[2:] == pytest.approx([6 / 400 - 0.06, 59 / 400 - 1.2 * 0.4, 3 / 400 - 0.18, 12 / 400])
    # 13 runs in 15 characters, 12 distinct.
    assert values(spark, T.repetition_score, ["abc defghijkl abc"]) == pytest.approx([17 / 400 - 1.2 / 13])


def test_snippet_and_truncate(spark):
    assert values(spark, lambda c: T.snippet(c, 5), [" ab\ncd ", "abcdef", "abcde", None, "你好世界朋友"]) == ["ab cd", "abcd…", "abcde", "", "你好世界…"]
    assert values(spark, lambda c: T.truncate_chars(c, 3), ["abcd", "abc", None]) == ["ab…", "abc", ""]


def test_count_tokens(spark):
    assert values(spark, T.count_tokens, [None, "", "a", "abcd", "你好", "㐀㐁㐂㐃㐄㐅", "你好abcd"]) == [0, 0, 1, 2, 2, 6, 4]


def test_first_sentence(spark):
    long = "这是很长的一句话" * 20 + "。"
    rule = lambda c: T.first_sentence(c, 30, 120)
    texts = ["短句。", "短句。" + long + "后面。", "一" * 30 + "。第二句。", None, "没有标点" * 50, " \n "]
    assert values(spark, rule, texts) == ["短句。", "短句。" + long, "一" * 30 + "。", "", "没有标点" * 50, ""]


def test_redact_pii(spark):
    texts = ["写信到 a.b+c@mail.example.cn 吧", "电话13812345678。", "call +86 010-12345678 now", "身份证11010519491231002X号", "12345", None]
    assert values(spark, T.redact_pii, texts) == ["写信到 [REDACTED_EMAIL] 吧", "电话[REDACTED_PHONE]。", "call [REDACTED_PHONE] now", "身份证[REDACTED_ID]号", "12345", ""]


def test_small_text_rules(spark):
    assert values(spark, T.norm_text, [" a b​c ", None]) == ["abc", ""]
    assert values(spark, T.char_bigrams, ["你好你好", "x", None]) == [["你好", "好你"], [], []]
    assert values(spark, T.strip_think, ["<think>a\nb</think> c", "d<THINK>e", None]) == ["c", "d", ""]
    assert values(spark, T.strip_quotes, ['"a"', "“好”", "'x", None]) == ["a", "好", "'x", ""]
    assert values(spark, T.extract_json_text, ['so: {"a": {"b": 1}} end', "none", None]) == ['{"a": {"b": 1}}', None, None]
    assert values(spark, T.html_escape, ["<a&b>"]) == ["&lt;a&amp;b&gt;"]
    assert values(spark, lambda c: T.match_snippet(c, F.lit("needle"), 64), ["x" * 100 + "needle" + "y" * 100])[0].count("needle") == 1
    assert [str(v) for v in values(spark, T.parse_session_date, ["2024/03/05 (Tue) 08:30", "no date"])][0] == "2024-03-05 08:30:00"
    with pytest.raises(Exception, match="not a label"):
        values(spark, T.safe_int_label, ["maybe"])
    assert values(spark, T.safe_int_label, ["1", " true ", "0.0"]) == [1, 1, 0]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("x"), F.col("y"))).collect()] == [pytest.approx(1 / 3), 0.0]


def test_read_json_array_keeps_what_is_complete(spark, tmp_path):
    whole = [{"a": 1, "t": "x]y"}, {"a": 2, "t": "中文"}, {"a": 3, "t": None}]
    (tmp_path / "whole.json").write_text(json.dumps(whole))
    (tmp_path / "cut.json").write_text("﻿ [\n" + ",\n".join(json.dumps(x, ensure_ascii=False) for x in whole) + ',\n{"a": 4, "t": "tru')
    (tmp_path / "empty.json").write_text("[]")
    read = lambda name: sorted((r.a, r.t) for r in read_json_array(spark, str(tmp_path / name), "a int, t string").collect())
    assert [x[0] for x in read("cut.json")] == [1, 2, 3] and read("cut.json")[1][1] == "中文"
    assert [x[0] for x in read("whole.json")] == [1, 2, 3] and read("empty.json") == []
    (tmp_path / "none.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="no JSON array"):
        read("none.json")


def test_memory_block_leaves_the_profile_its_tokens(spark):
    lines = ["x" * 300] * 20  # 100 tokens each
    episodes = spark.createDataFrame([(1, lines), (2, lines), (3, None)], "query_id int, lines array<string>")
    profile = spark.createDataFrame([(1, "p" * 900), (3, "only profile"), (4, "p" * 1500)], "query_id int, profile string")
    got = {r.query_id: r.block for r in spans.memory_block(profile, episodes).collect()}
    assert got[1] == "p" * 900 + "\n\n<episodic_memory>\n" + "\n".join(lines[:13]) + "\n</episodic_memory>"
    assert got[2] == "<episodic_memory>\n" + "\n".join(lines[:16]) + "\n</episodic_memory>"
    assert got[3] == "only profile" and got[4] == "p" * 1500
    assert spans.memory_block(profile, episodes, budget=5000).where("query_id = 2").first().block.count("x" * 300) == 20
    with pytest.raises(Exception, match="profile too long"):
        spans.memory_block(spark.createDataFrame([(1, "p" * 3000)], "query_id int, profile string"), episodes).collect()


def test_link_strength_and_chains(spark):
    day = 86400
    rows = [(1, 10, 7, 0, day, ["a", "b"], ["k"], ["k", "m"], [1.0, 0.0]), (1, 11, 8, 91 * day, 92 * day, ["b"], ["m"], ["k", "m"], [1.0, 0.0]), (1, 12, 7, day // 2, day, [], ["k"], ["k", "m"], [0.0, 1.0])]
    w = spark.createDataFrame(rows, "query_id int, window_id long, conversation_id long, starts_at long, ends_at long, entities array<string>, terms array<string>, query_terms array<string>, vector array<double>")
    got = {(r.a, r.b): r.strength for r in spans.link_strength(w).collect()}
    assert len(got) == 6
    assert got[10, 11] == pytest.approx(0.3 * 0.5 + 0.3 + 0.2 * 0.35 * exp(-1) + 0.15 * 0.5)
    assert got[11, 10] == pytest.approx(0.3 * 0.5 + 0.3 + 0.15 * 0.5)
    assert got[10, 12] == pytest.approx(0.2 * 0.15 + 0.1)
    scored = spark.createDataFrame([(1, 10, 3.0), (1, 11, 1.0), (1, 12, 2.0)], "query_id int, window_id long, score double")
    chains = sorted((r.chain, r.place, r.window_id) for r in spans.link_chains(scored, spans.link_strength(w)).collect())
    assert chains == [(0, 0, 10), (0, 1, 11), (1, 0, 12)]


def test_filter_ops_one_after_another(spark):
    have = spark.createDataFrame([(1, 9, "likes tea.", "active"), (2, 9, "has a dog.", "active"), (3, 9, "old", "deleted")], "id long, user_id long, content string, status string")
    rows = [
        (1, 9, 0, "update", 1, "has a dog."), (1, 9, 1, "delete", 1, ""), (1, 9, 2, "add", None, "new fact."),  # the update repeats a fact: its target stays free
        (2, 9, 0, "add", None, "one."), (2, 9, 1, "update", 1, "one."), (2, 9, 2, "delete", 1, ""),
        (3, 9, 0, "delete", 2, ""), (3, 9, 1, "update", 2, "else."), (3, 9, 2, "add", None, "a."), (3, 9, 3, "add", None, "b."),
    ]
    ops = spark.createDataFrame(rows, "message_id long, user_id long, op_no int, op string, target_id long, content string")
    got = sorted((r.message_id, r.op_no) for r in profiles.filter_ops(ops, have).collect())
    assert got == [(1, 1), (1, 2), (2, 0), (2, 2), (3, 0), (3, 2)]


def test_split_segments_joins_small_pieces(spark):
    a, b, c = "一" * 29 + "。", "二" * 189 + "。", "三" * 99 + "。"
    rule = lambda x: memory.split_segments(x, target=120, most=200)
    # 30 + 190 tokens are over 200, but 30 are less than half of 120: joined all the same, and cut only beyond 400 characters.
    assert values(spark, rule, [a + b + c, c + b, "短。\n\n段落", None, "  "]) == [[a + b, c], [c, b], ["短。", "段落"], [], []]


def test_rejected_quality_flags(spark):
    texts = [None, " ", "只有中文的正常回复，用户可以看看。", "Let's count the words: we need to say more.", "<reply>好的好的好的好的</reply>", '他说"yes indeed ok"没问题的吧', "短", "我需要分析一下这个问题再说"]
    got = values(spark, pairs.rejected_quality_flags, texts)
    assert got == [["missing_rejected"], ["empty_rejected"], [], ["no_cjk", "englishy", "meta_trace"], ["xml_tags"], ["quote_meta"], ["too_short"], ["meta_trace"]]


def test_neighbours_and_appending(spark):
    m = spark.createDataFrame([(c * 100 + p, c, p) for c in (1, 2) for p in range(6)], "message_id long, conversation_id long, position long")
    got = sorted((r.anchor_id, r.message_id, r.distance) for r in neighbour_range(m.where("message_id in (100, 205)"), m, 2, 1).collect())
    assert got == [(100, 100, 0), (100, 101, 1), (205, 203, -2), (205, 204, -1), (205, 205, 0)]
    have = spark.createDataFrame([(1, "a")], "n int, k string")
    new = spark.createDataFrame([(9, "b"), (5, "a"), (7, "c"), (8, "c")], "n int, k string")
    rows = lambda target: sorted(r.n for r in append_new_until(have, new, "k", [F.col("n")], target).collect())
    assert rows(2) == [1, 7] and rows(9) == [1, 7, 9] and rows(0) == [1]


def test_terms_in_any_case_need_no_pattern(spark):
    terms = ["the user|fine\\.|a(b|c)|[|]x", "你好"]
    assert T._alternatives(terms[0]) == ["the user", "fine\\.", "a(b|c)", "[|]x"]
    texts = ["THE USER", "the ſser", "the uſer", "FİNE.", "fıne.", "fine!", "AC", "|X", "x", "说你好", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = df.select(F.col("t").rlike("(?iu)" + "|".join(f"(?:{p})" for p in terms))).collect()
    assert df.select(T.matches_any(F.col("t"), T.folded(F.col("t")), terms)).collect() == want
    plan = df.select(T.matches_any(F.col("t"), T.folded(F.col("t")), terms))._jdf.queryExecution().optimizedPlan().toString()
    assert "the user|" not in plan
