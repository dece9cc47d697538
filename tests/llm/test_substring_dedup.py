import random

from dialoglake.llm import substring_dedup as S


def some_text(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzéñ", k=rng.randint(2, 9))) for _ in range(n))


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(1)
    text = some_text(rng, 400)
    for t in (text, "x", "日本語" * 900, "a" * 5000, "\n\n", "é " * 50):
        digests, place, words = S.chunks(t.encode())
        at = 0
        for p in place.tolist():
            assert p >> 32 == at
            at += p >> 1 & 0x7FFFFFFF
        assert at == len(t) and sum(words.tolist()) >= len(t.encode().split())
    same = {bytes(d) for d in S.chunks(text.encode())[0]}
    for prefix in ("inserted ", "more words put before, ", "é"):
        moved = {bytes(d) for d in S.chunks((prefix + text).encode())[0]}
        assert len(same - moved) <= 2


def brute(rows, min_words):
    """Chunk by chunk: a chunk goes if an equal one stands in a smaller id or earlier in this row; runs of them."""
    cut = {i: [(bytes(d), (int(p), int(w))) for d, p, w in zip(*S.chunks(t.encode()))] for i, t in rows if t}
    count, keeper = {}, {}
    for i, cs in cut.items():
        for d, _ in cs:
            count[d] = count.get(d, 0) + 1
            keeper[d] = min(keeper.get(d, i), i)
    out = set()
    for i, cs in cut.items():
        seen, run = set(), []
        for d, p in [*cs, (None, None)]:
            gone = d is not None and count[d] > 1 and (keeper[d] != i or d in seen)
            seen.add(d)
            if gone:
                run.append((p[0] >> 32, p[0] >> 1 & 0x7FFFFFFF, p[1], keeper[d]))
            else:
                if sum(r[2] for r in run) >= min_words:
                    out.add((i, run[0][0], run[-1][0] + run[-1][1] - run[0][0], sum(r[2] for r in run), min(r[3] for r in run)))
                run = []
    return out


def corpus(rng):
    passage = some_text(rng, 70)
    rows = [(i, some_text(rng, rng.randint(5, 200))) for i in range(30)]
    rows += [(100 + i, some_text(rng, 40) + " " + passage + " " + some_text(rng, 30)) for i in range(6)]
    rows += [(200, rows[3][1]), (201, ""), (202, None), (203, passage + "\n" + passage)]
    return rows, passage


def test_spans_against_brute_force(spark):
    rows, _ = corpus(random.Random(6))
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, row string")
    got = {(r.doc_id, r.start, r.length, r.n_words, r.first_doc_id) for r in S.repeated_spans(docs, min_words=20).collect()}
    assert got == brute(rows, 20)
    assert {101, 102, 103, 104, 105, 200, 203} <= {g[0] for g in got}
    assert not {g[0] for g in got} & set(range(30))


def test_removal_cuts_exactly_the_spans(spark):
    rows, passage = corpus(random.Random(7))
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, start string")
    want = dict(rows)
    for i, start, length, *_ in sorted(brute(rows, 20), reverse=True):
        want[i] = want[i][:start] + want[i][start + length :]
    got = S.remove_repeats(docs, min_words=20)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert sum(passage in (t or "") for t in want.values()) == 1


def test_repeated_rows_nulls_and_empty_tables(spark):
    rng = random.Random(8)
    t = some_text(rng, 60)
    docs = spark.createDataFrame([(1, t), (2, t), (2, t), (None, t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.start, r.length) for r in S.repeated_spans(docs).collect())
    assert got == [("2", 0, len(t)), ("None", 0, len(t))]
    left = [(r.doc_id, r.text) for r in S.remove_repeats(docs).collect()]
    assert sorted(left, key=str) == sorted([(1, t), (2, ""), (2, ""), (None, "")], key=str)
    assert S.repeated_spans(docs.limit(0)).collect() == [] and S.remove_repeats(docs.limit(0)).collect() == []


def test_text_without_blanks_resists_shifts(spark):
    rng = random.Random(9)
    codes = "".join(rng.choices("0123456789abcdef", k=60_000))
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(20_000))
    for text in (codes, chinese):
        before = [bytes(d) for d in S.chunks(text.encode())[0]]
        after = {bytes(d) for d in S.chunks((text[:50] + "x" + text[50:]).encode())[0]}
        assert sum(d in after for d in before) >= 0.95 * len(before) and len(before) > 1000
    passage = chinese[:300]
    rows = [(1, chinese[1000:1100] + passage), (2, chinese[2000:2150] + passage + chinese[3000:3050]), (3, chinese[4000:4400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.repeated_spans(docs).collect()
    assert [r.doc_id for r in got] == [2] and 250 <= got[0].length <= 300


def test_runs_of_any_byte_or_short_pattern_are_one_chunk(spark):
    for unit in [chr(c) for c in range(33, 127)] + ["ab", "=-", "0x00", "é", "日本", "<td></td>"]:
        assert len(S.cuts((unit * (6_000 // len(unit))).encode())) <= 6, unit
        assert len(S.cuts(f"intro text {unit * 2000} end of it".encode())) <= 12, unit
    rows = [(i, f"intro text {unit * 3000} end of it") for i, unit in enumerate("1~=C RX".replace(" ", ""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert S.repeated_spans(docs).collect() == []
    again = spark.createDataFrame([*rows, (99, rows[1][1])], "doc_id long, text string")
    assert [(r.doc_id, r.length) for r in S.repeated_spans(again).collect()] == [(99, len(rows[1][1]))]


def test_clashing_columns_are_carried(spark):
    passage = " ".join(f"shared{k}" for k in range(90))
    docs = spark.createDataFrame([(1, passage, 5, "a"), (2, passage + " own", 6, "b"), (2, passage + " own", 6, "b")], "doc_id long, text string, cut long, row string")
    got = S.remove_repeats(docs, drop_emptied=True)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.cut, r.row) for r in got.collect()) == [(1, 5, "a"), (2, 6, "b"), (2, 6, "b")]


def test_chunks_are_done_before_texts_are_dealt(spark):
    """The shuffles of the chunks are gone before that of the texts: what is left to run only joins the spans."""
    rows, _ = corpus(random.Random(10))
    plan = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan
