"""More rules on fixtures whose values are worked out by hand: arrays cut at any byte, text rules, plans, evaluation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dialoglake.functions import text as T
from dialoglake.operators import analytics, curation, dialogue, evaluate, keys, labels, pairs, profiles, retrieval, spans
from dialoglake.sources import corpora
from dialoglake.sources.json_array import elements


def values(spark, rule, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", rule(F.col("t")).alias("v")).orderBy("i").collect()]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- arrays


def odd(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind == 0:
        return "".join(rng.choices('ab,]}[{"\\ \n中é', k=rng.randint(0, 12)))
    if kind < 5:
        return [None, True, rng.randint(-5, 5), 1.5][kind - 1]
    if kind == 5:
        return [odd(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}": odd(rng, depth + 1) for i in range(rng.randint(0, 3))}


@pytest.mark.parametrize("size", [41, 150, 1 << 20])
def test_elements_for_cuts_at_any_byte(spark, tmp_path, size):
    rng = random.Random(size)
    whole = [{"n": i, "x": odd(rng)} for i in range(9)] + [[], {}, "}", [[1]], {"deep": [{"a": [{}]}]}]
    one = json.dumps(whole, ensure_ascii=bool(size % 2))
    (tmp_path / "line.json").write_text(one)
    (tmp_path / "lines.json").write_text("﻿ \n" + json.dumps(whole, indent=1) + "\n trailing }")
    (tmp_path / "cut.json").write_text(one[: one.rindex("}") - 1])
    (tmp_path / "brace.json").write_text('[{"a": 1}, {"b": {"c": 2}')
    (tmp_path / "done.json").write_text('[{"a": 1}, {"b": 2}')
    (tmp_path / "empty.json").write_text(" [ ] ")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = {}
        for r in elements(spark, str(tmp_path / "*.json")).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.element] = json.loads(r.text)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [v for _, v in sorted(got["line.json"].items())] == [v for _, v in sorted(got["lines.json"].items())] == whole
    assert sorted(got["line.json"]) == list(range(len(whole)))
    assert [v for _, v in sorted(got["cut.json"].items())] == whole[:-1]
    assert got["brace.json"] == {0: {"a": 1}} and got["done.json"] == {0: {"a": 1}, 1: {"b": 2}} and "empty.json" not in got


# --- text


def test_candidate_clean_up(spark):
    texts = ['比如：\n"真正的回复"', "例如\n第一行\n最后一行", "分析：他很累。\n回复：休息一下吧", "建议： 早点睡", "- 列表里的话", "“带引号”", '示例 "', None, "平常的话"]
    assert values(spark, T.postprocess_candidate, texts) == ["真正的回复", "最后一行", "休息一下吧", "早点睡", "列表里的话", "带引号", '"', "", "平常的话"]


def test_entities_and_titles(spark):
    assert values(spark, T.entity_set, ["我今天39.5度 OpenMind-2 x 9月9月", None]) == [["我今天", "39.5度", "OpenMind-2", "9月"], []]
    assert values(spark, T.auto_title, [" a\nb ", "一" * 20, "一" * 21, None]) == ["a b", "一" * 20, "一" * 20 + "…", ""]


def test_utterances(spark):
    good = lambda c: T.is_meaningful_utterance(c, ["广告"])
    assert values(spark, good, ["今天下班以后想去公园走走", "太短", "今天下班广告以后想去公园走走", "哈" * 40, "abcdefghijklm好", None]) == [True, False, False, False, False, False]
    ok = lambda c: T.is_ok_user_utterance(c, ["广告"])
    assert values(spark, ok, ["我好累呀", "好累", "看广告吧", "啊" * 60, "hello there", None]) == [True, False, False, False, False, False]
    pick = values(spark, lambda c: T.stable_pick(c, ["a", "b", "c"]), ["x", "x", "y", "z", "w"])
    assert pick[0] == pick[1] and set(pick) <= {"a", "b", "c"} and len(set(pick)) > 1


def test_truncate_by_tokens(spark):
    rule = lambda c: T.truncate_by_tokens(c, 40)
    cjk = "".join(chr(0x4E00 + i) for i in range(100))
    got = values(spark, rule, ["short", "x" * 200, cjk, None])
    # 40 characters of CJK and … are 41 tokens; 8 fewer fit: 19 from the start, 13 from the end.
    assert got == ["short", "x" * 24 + "…" + "x" * 16, cjk[:19] + "…" + cjk[-13:], ""]
    assert [len(x) for x in got] == [5, 41, 33, 0]


def test_clean_reply(spark):
    assert values(spark, lambda c: T.clean_reply(c, ["好的"]), ["好的，我在 \t 听\U0001f600。\n\n\n\n说吧", None]) == ["我在 听。\n\n说吧", ""]


# --- dialogue, keys, labels


def test_io_context(spark):
    df = spark.createDataFrame([(1, [("你 好", "在"), ("", "嗯"), ("再见", "好")])], "id int, conversation array<struct<input: string, output: string>>")
    got = {r.turn: (r.context, r.user_focus) for r in dialogue.io_context(df).collect()}
    assert got[0] == ("[USER] 你好", "你好") and 1 not in got
    assert got[2] == ("[USER] 你好\n[ASSISTANT] 在\n[USER] \n[ASSISTANT] 嗯\n[USER] 再见", "你好\n再见")


def test_dialogue_text(spark):
    texts = ["上文：我累\n用户：怎么办", "问题\n补充：细节", "只有一句", "", "上文：\n用户：后半"]
    f = "\n[ASSISTANT] 我在，慢慢说。\n[USER] "
    assert values(spark, dialogue.to_dialogue_text, texts) == ["[USER] 我累" + f + "怎么办", "[USER] 问题" + f + "细节", "[USER] 只有一句", "", "[USER] 后半"]


def test_ids_of_sources(spark):
    assert values(spark, keys.session_of_message, ["case-s3-u2", "case-s3-x2", "s1-a1", None]) == ["case-s3", None, None, None]
    stored = spark.createDataFrame([(5, "a-s1-u1"), (6, "a-s2-a2"), (7, "gone")], "message_id int, source_id string")
    sources = spark.createDataFrame([("a-s1-u1",), ("a-s2-a2",)], "source_id string")
    assert rows(keys.id_map(stored, sources)) == [(5, "a-s1-u1", "a-s1"), (6, "a-s2-a2", "a-s2")]
    h = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "x string, y int").select(keys.row_hash(F.col("x"), F.col("y")).alias("h")).collect()
    assert h[0] == h[1] != h[2] and h[0].h == __import__("hashlib").sha1(b'{"x":"a","y":1}').hexdigest()


def test_route(spark):
    assert values(spark, lambda c: labels.route(c.cast("int")), ["1", "0", None]) == ["consult", "chat", "chat"]


def test_rewriting(spark):
    rule = lambda c: curation.rewrite(c, [("a+", "b")], ["嗯嗯"], {"原句": "新句"})
    assert values(spark, rule, ["caat  嗯嗯！！", " 原句 ", None]) == ["cbt ！", "新句", ""]
    table = [(["累", "困"], "休息"), (["饿"], "吃饭")]
    assert values(spark, lambda c: curation.canned_reply(c, table, F.lit("嗯")), ["又饿又困", "饿了", "好"]) == ["休息", "吃饭", "嗯"]


def test_extract_reply(spark):
    texts = ["<think>不算</think><reply>“真的回复”</reply>", "plain words here\n今天先休息一下吧\n短", "<think>想</think>only english", None]
    assert values(spark, pairs.extract_reply, texts) == ["真的回复", "今天先休息一下吧", "", ""]


# --- retrieval


def test_plans_of_subqueries(spark):
    plan = lambda *subs: json.dumps({"mode": "split", "subqueries": [{"query": q, "role_scope": s} for q, s in subs]})
    df = spark.createDataFrame([(1, "whole", plan(("a", "user"), ("A", "user"), ("b", "all"), ("", "user"), ("c", "both"), ("d", "both"))), (2, "alone", plan(("x", "user"))), (3, "broken", "{")], "query_id int, text string, plan string")
    got = rows(retrieval.parse_plan(df))
    assert got == [(1, 0, "whole", "both"), (1, 1, "a", "user"), (1, 2, "b", "both"), (1, 3, "c", "both"), (2, 0, "alone", "both"), (3, 0, "broken", "both")]
    asked = spark.createDataFrame([(1, 0, "Whole"), (1, 1, "whole"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (1, 5, "e")], "query_id int, sub_no int, query string")
    assert rows(retrieval.ce_queries(asked)) == [(1, 0, "Whole"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")]
    assert values(spark, lambda c: retrieval.guess_scope(c, "我说", "你说"), ["我说过", "你说过", "谁说"]) == ["user", "assistant", "both"]


def test_merged_subqueries(spark):
    hits = spark.createDataFrame([(1, 1, 10, 1), (1, 2, 10, 3), (1, 1, 11, 2), (1, 1, 11, 9), (1, 2, 12, 1)], "query_id int, sub_no int, unit_id int, place int")
    got = [(r.unit_id, r.sub_nos, round(r.fused, 12), r.fused_rank) for r in retrieval.split_merge(hits).orderBy("fused_rank").collect()]
    assert got == [(10, [1, 2], round(1 / 61 + 1 / 63, 12), 1), (12, [2], round(1 / 61, 12), 2), (11, [1], round(1 / 62, 12), 3)]


def test_hits_and_segments(spark):
    hits = spark.createDataFrame([(1, 5, 50, 0.5, 0.1), (1, 5, 51, None, 0.9), (1, 5, 52, 0.5, 0.2), (1, 5, 49, 0.5, 0.2), (1, 6, 60, None, 0.3)], "query_id int, message_id int, unit_id int, rerank double, fused double")
    assert rows(retrieval.collapse_chunks(hits).select("message_id", "unit_id")) == [(5, 49), (6, 60)]
    a = spark.createDataFrame([(1, 5, 1), (1, 5, 3)], "query_id int, message_id int, segment_index int")
    s = spark.createDataFrame([(5, i, x, 10 + i) for i, x in enumerate([0.9, 0.1, 0.3, 0.2])], "message_id int, segment_index int, sim double, token_count int")
    got = {r.segment_index: (r["first"], r["last"], r.tokens, r.omitted_before, r.omitted_after) for r in retrieval.expand_segment(a, s).collect()}
    assert got == {1: (0, 1, 21, False, True), 3: (3, 3, 13, True, False)}
    lines = spark.createDataFrame([(["x" * 15, "y" * 15, "z"],), (["x" * 90],), ([],)], "lines array<string>")
    assert [r[0] for r in lines.select(retrieval.trim_lines(lines, "lines", 20)).collect()] == [["x" * 15, "y" * 15], ["x" * 90], []]
    w = spark.createDataFrame([(1, 3, 9, 50), (1, 1, 8, 50), (1, 2, 7, 10)], "query_id int, window_id int, conversation_id int, starts_at int")
    assert [r.window_id for r in retrieval.sort_by_time(w).orderBy("place").collect()] == [2, 1, 3]


def test_stitched_spans(spark):
    m = spark.createDataFrame([(1, t, t * 10 + k, r) for t in range(1, 7) for k, r in ((1, "user"), (2, "assistant"))], "conversation_id int, turn_id int, message_id int, role string")
    a = spark.createDataFrame([(1, 32, 0.9), (1, 51, 0.5)], "query_id int, message_id int, score double")
    got = rows(spans.stitch_spans(a, m))
    assert (1, 32, 31, "turn") in got and (1, 32, 32, "anchor") in got and (1, 51, 51, "anchor") in got and (1, 51, 52, "turn") in got
    assert [(x[1], x[2]) for x in got if x[3] == "neighbour"] == [(32, 11), (32, 21), (32, 41), (51, 61)]


# --- evaluation


def test_answers(spark):
    row = lambda **k: (k["qid"], k["type"], k.get("answer"), k.get("gold"), k.get("aliases"), k.get("judge"), k.get("expected"), k.get("got"))
    cases = [
        row(qid=1, type="text", answer="在 北京。", gold="北京"), row(qid=2, type="text", answer="上海", gold="北京", aliases=["沪", "上海"]), row(qid=3, type="text", answer="错", gold="对", judge=True), row(qid=4, type="text", answer="错", gold="对"),
        row(qid=5, type="choice", answer="选 b", gold="B"), row(qid=6, type="choice", answer="A", gold="B"), row(qid=7, type="abstention", answer="我不知道呢", gold="x"), row(qid=8, type="abstention", answer="是红色", gold="x"),
        row(qid=9, type="structured", expected={"城": "北京", "年": "2020"}, got={"城": "北京。", "年": "2020", "多": "x"}), row(qid=10, type="structured", expected={"城": "北京"}, got={}, judge=True), row(qid=11, type="structured", expected={}, got={}),
    ]
    df = spark.createDataFrame(cases, "qid int, type string, answer string, gold string, aliases array<string>, judge boolean, expected map<string, string>, got map<string, string>")
    got = {r.qid: (r.correct, r.scored_by) for r in evaluate.score_qa(df, ["不知道"]).collect()}
    assert got == {
        1: (True, "match"), 2: (True, "match"), 3: (True, "judge"), 4: (False, "judge"), 5: (True, "match"), 6: (False, "judge"), 7: (True, "match"), 8: (False, "judge"), 9: (True, "match"), 10: (False, "match"), 11: (False, "match"),
    }
    assert rows(evaluate.structured_fields(df.where("qid in (9, 10)"))) == [(10, 1, 0, False, 0.0), (9, 2, 2, True, 1.0)]


def test_recall_of_messages_sessions_and_turns(spark):
    schema = "qid int, answerable boolean, evidence array<string>, anchors array<string>, included array<string>, superseded array<string>, answer_sessions array<string>, sessions array<string>"
    df = spark.createDataFrame([
        (1, True, ["s1-t1-u", "s1-t2-u"], ["s1-t1-u"], ["s1-t1-u", "s1-t2-a"], ["s0-t1-u"], ["s1", "s2"], ["s1", "s9"]),
        (2, True, ["s1-t1-u"], [], ["s0-t1-u"], ["s0-t1-u"], [], []), (3, False, ["a-b"], ["a-b"], ["a-b"], [], ["a"], ["a"]), (4, True, [], [], ["x"], [], None, None), (5, True, ["e-1"], ["e-1"], ["e-1"], ["e-1"], ["e"], ["e"]),
    ], schema)
    got = {r.qid: tuple(r)[1:] for r in evaluate.retrieval_recall(df).collect()}
    assert got[1] == (0.5, 0.5, 0.5, 1.0, False, False, True, False)
    assert got[2] == (0.0, 0.0, None, 0.0, False, False, False, True)
    assert got[3] == (None,) * 8 and got[4] == (None, None, None, None, False, False, False, False) and got[5] == (1.0, 1.0, 1.0, 1.0, True, True, True, False)


def test_cases_and_profiles(spark):
    df = spark.createDataFrame([(1, "overgeneral", True, False), (1, "overgeneral", False, False), (1, "stale", True, True), (2, "plain", True, False)], "case_id int, probe string, correct boolean, stale boolean")
    assert rows(evaluate.score_case(df)) == [(1, 3, 2 / 3, 0.5, 1.0), (2, 1, 1.0, None, None)]
    f1 = spark.createDataFrame([(2, 1, 1), (0, 0, 0), (0, 1, 0), (0, 0, 1)], "tp int, missed int, false int").select(evaluate.content_f1(F.col("tp"), F.col("missed"), F.col("false")).alias("f"))
    assert [r.f for r in f1.collect()] == [pytest.approx(4 / 6), 1.0, 0.0, 0.0]
    cases = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.0, 0.0)], "case_id int, accuracy double, f1 double")
    assert rows(evaluate.summarize_cases(cases, df)) == [(2, 0.75, 0.5, 0.25, 0.75)]
    m = spark.createDataFrame([(True, True, "fact"), (True, False, "fact"), (False, True, "stale"), (False, True, "transient")], "in_gold boolean, in_profile boolean, kind string")
    assert rows(evaluate.profile_eval(m)) == [(1 / 3, 0.5, 0.4, 1 / 3, 0.0, 1 / 3)]


MESSAGE = "struct<message_id: string, role: string, content: string, has_answer: boolean>"
INSTANCE = f"question_id string, category string, capability string, question string, answer string, question_date string, answerable boolean, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<{MESSAGE}>>, answer_session_ids array<string>, evidence_message_ids array<string>, superseded_message_ids array<string>"


def instance(qid="q1", **changes):
    say = lambda s, k, has=False: (f"{s}-t{k}", "user" if k % 2 else "assistant", f"{s} text {k}", has)
    base = {
        "question_id": qid, "category": "c", "capability": "p", "question": "where?", "answer": "Rome", "question_date": "2024/03/09 (Sat) 08:00", "answerable": True,
        "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["2024/03/05 (Tue) 08:30", "2024/03/06 (Wed) 08:30"], "haystack_sessions": [[say("s1", 1), say("s1", 2)], [say("s2", 1, True), say("s2", 2)]],
        "answer_session_ids": ["s2"], "evidence_message_ids": ["s2-t1"], "superseded_message_ids": ["s1-t1"],
    }
    return tuple((base | changes).values())


def test_benchmarks(spark):
    frame = lambda *xs: spark.createDataFrame(list(xs), INSTANCE)
    found = lambda **k: {r.check for r in evaluate.validate_benchmark(frame(instance(**k))).collect()}
    assert found() == set()
    assert found(haystack_dates=["2024/03/06 (Wed) 08:30", "2024/03/05 (Tue) 08:30"]) == {"unsorted_dates"}
    assert found(question_date="2024/03/06 (Wed) 08:00") == {"question_before_history"}
    assert found(superseded_message_ids=["s2-t2"]) == {"superseded_not_before"}
    assert found(answer_session_ids=["s3"]) == {"answer_session_unknown"} and found(question="where is Rome?") == {"answer_in_question"}
    assert found(evidence_message_ids=["s9-t1"]) == {"evidence_not_marked", "evidence_unknown", "superseded_not_before"}
    assert found(answerable=False) == {"evidence_unanswerable"} and found(haystack_session_ids=["s2", "s2"]) == {"repeated_session"}
    swapped = [[("s1-t1", "assistant", "x", False)], [("s2-t1", "user", "y", True)]]
    assert found(haystack_sessions=swapped) == {"roles_not_alternating"}
    many = frame(*(instance(f"q{i}") for i in range(12)))
    assert rows(evaluate.validate_benchmark(many)) == [("session_too_often", "q0")] * 2
    assert rows(evaluate.validate_benchmark(frame(instance(), instance()))) == [("repeated_id", "q1")]
    stats = {r.measure: (r.mean, r.least, r.most) for r in evaluate.benchmark_stats(frame(instance(), instance("q2", evidence_message_ids=[]))).collect()}
    assert stats["sessions"] == (2.0, 2, 2) and stats["messages"] == (4.0, 4, 4) and stats["evidence"] == (0.5, 0, 1) and stats["tokens"] == (12.0, 12, 12)
    m = evaluate.explode_benchmark(frame(instance())).orderBy("source_id").collect()
    assert [(r.source_id, r.position) for r in m] == [("s1-a-2", 2), ("s1-u-1", 1), ("s2-a-2", 2), ("s2-u-1", 1)] and m[3].created_at == 1709713800
    with pytest.raises(Exception, match="unequal haystack"):
        evaluate.explode_benchmark(frame(instance(haystack_session_ids=["s1"]))).collect()
    o = evaluate.oracle_subset(frame(instance())).first()
    assert o.haystack_session_ids == ["s2"] and len(o.haystack_sessions) == 1 and o.haystack_dates == ["2024/03/06 (Wed) 08:30"]
    assert [r.question_id for r in evaluate.filter_instances(many, ["c"], ["p"], 2).collect()] == ["q0", "q1"] and evaluate.filter_instances(many, ["d"]).count() == 0


def test_log_and_payload(spark):
    log = spark.createDataFrame([("chat", "abc"), ("chat", None), ("consult", "x")], "route string, output string")
    assert rows(analytics.generation_log_stats(log)) == [("chat", 2, 1.5, 3), ("consult", 1, 1.0, 1)]
    m = spark.createDataFrame([(k, 9, 1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(1, 12)], "message_id int, user_id int, conversation_id int, position int, role string, content string")
    p = spark.createDataFrame([(1, 9, "b", "active"), (2, 9, "x", "deleted")], "id int, user_id int, content string, status string")
    got = {r.message_id: json.loads(r.payload) for r in profiles.maintainer_payload(m, p).collect()}
    assert sorted(got) == [1, 3, 5, 7, 9, 11] and got[1]["earlier"] == "" and got[11]["earlier"].split("\n")[0] == "user: t3"
    assert got[3] == {"capacity": 19, "profiles": [{"id": 1, "content": "b"}], "earlier": "user: t1\nassistant: t2", "current": "t3"}
    raw = spark.createDataFrame([(1, 9, 'so {"operations": [{"op": "add", "content": "x"}, {"op": "boom"}, {"op": "delete", "target_id": 4}]}'), (2, 9, "no json")], "message_id int, user_id int, raw string")
    assert rows(profiles.parse_ops(raw)) == [(1, 9, 0, "add", None, "x"), (1, 9, 2, "delete", 4, None)]


# --- corpora


def test_lines_formats_and_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    path = str(tmp_path / "a.jsonl")
    assert rows(corpora.read_jsonl(spark, path, "a int")) == [(1,), (2,)] and corpora.read_jsonl(spark, path, "a int", limit=1).count() == 1
    kept = corpora.read_jsonl(spark, path, "a int", "keep").cache()
    assert [r._corrupt_record for r in kept.where("_corrupt_record is not null").collect()] == ["broken"]
    with pytest.raises(Exception):
        corpora.read_jsonl(spark, path, "a int", "fail").collect()
    said = lambda df: [[(m.role, m.content) for m in r.messages] for r in corpora.convert_to_messages(df).collect()]
    assert said(spark.createDataFrame([("q", "a"), (" ", "x")], "prompt string, completion string")) == [[("user", "q"), ("assistant", "a")]]
    qa = spark.createDataFrame([("q", "more", [("a1",), ("a2",)]), ("q", "q", [("b",)]), ("q", None, [])], "question string, description string, answers array<struct<answer_text: string>>")
    assert said(qa) == [[("user", "q\nmore"), ("assistant", "a1")], [("user", "q"), ("assistant", "b")]]
    gpt = spark.createDataFrame([([("human", "h"), ("gpt", " "), ("system", "s"), ("gpt", "g")],)], "conversations array<struct<from: string, value: string>>")
    assert said(gpt) == [[("user", "h"), ("assistant", "g")]]
    with pytest.raises(ValueError, match="no known format"):
        corpora.convert_to_messages(spark.createDataFrame([(1,)], "z int"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.json").write_text('[{"role": "user", "content": "x"}]')
    (tmp_path / "d" / "two.json").write_text("not json")
    files = corpora.read_dialogue_dir(spark, str(tmp_path / "d" / "*.json"))
    assert {r.source.rsplit("/", 1)[1]: r.messages and len(r.messages) for r in files.collect()} == {"one.json": 1, "two.json": None}
    assert rows(corpora.skipped_files(files)) == [(1, 1)]
    u = corpora.union_with_provenance({"x": spark.createDataFrame([(2,), (1,)], "a int"), "y": spark.createDataFrame([(5, "t")], "a int, b string")}, "a")
    assert rows(u.select("_src_file", "_src_idx", "a", "b")) == [("x", 0, 1, None), ("x", 1, 2, None), ("y", 0, 5, "t")]
    ops, counts = corpora.import_profiles(spark.createDataFrame([(1, "a", "explicit"), (1, "b", "guessed"), (None, "c", "confirmed"), (1, " ", "explicit"), (1, "d", None)], "user_id int, content string, origin string"))
    assert rows(ops) == [(1, "add", "a", "explicit")] and rows(counts) == [(1, 4)]
    corpora.write_samples(spark.createDataFrame([("i", "x", 1, "train")], "instruction string, input string, risk int, split string"), str(tmp_path / "s"), ["risk"])
    back = spark.read.json(str(tmp_path / "s"))
    assert rows(back.select("instruction", "input", "output", "split")) == [("i", "x", '{"risk":1}', "train")]
    corpora.write_pairs(spark.createDataFrame([("1", "p", "c", "r")], "id string, prompt string, chosen string, rejected string"), str(tmp_path / "p"))
    r = spark.read.json(str(tmp_path / "p")).first()
    assert (r.conversations[0]["from"], r.chosen.value, r.rejected["from"], r.rejected.value) == ("human", "c", "gpt", "r")
