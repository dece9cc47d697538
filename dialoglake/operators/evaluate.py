"""Evaluation: overlap metrics, answer matching, recall of evidence, summaries. Judgements by models come in as columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglake.functions import text as T


def tokens_of(c: Column) -> Column:
    """The default tokens: CJK characters, Latin words and digits, in order. A column of other tokens may be given instead."""
    return F.regexp_extract_all(F.lower(T.text_of(c)), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"), F.lit(0))


def gram_overlap(p: Column, r: Column, most: int) -> Column:
    """For n = 1..most, how many n-grams two token arrays share, each as often as both have it; null has none. A row has all
    that it needs, so nothing is shuffled."""

    def hits(a: Sequence[str] | None, b: Sequence[str] | None) -> list[int]:
        a, b = (list(x) if x is not None else [] for x in (a, b))
        runs = lambda t, n: Counter(zip(*(t[i:] for i in range(n))))
        return [sum((runs(a, n) & runs(b, n)).values()) for n in range(1, most + 1)]

    @F.pandas_udf("array<int>")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([hits(a, b) for a, b in zip(x, y)], dtype=object)

    return of(p, r)


def sentence_metrics(rows: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """(id, p, r: token arrays) -> id, bleu_1..4, rouge_1, rouge_2, rouge_l, in 0..1.

    BLEU has uniform weights, a brevity penalty, and epsilon in place of a zero count; ROUGE is the F value."""
    out = rows.where("id is not null").select("id", "p", "r", F.size("p").alias("len_p"), F.size("r").alias("len_r"), gram_overlap(F.col("p"), F.col("r"), 4).alias("hits"))
    grams = lambda c, n: F.greatest(F.col(c) - (n - 1), F.lit(0))
    out = out.select("*", *(F.col("hits")[n - 1].alias(f"hit{n}") for n in range(1, 5)), *(grams(f"len_{c}", n).alias(f"n_{c}{n}") for c in "pr" for n in range(1, 5)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    precision = lambda n: F.when(zero(f"hit{n}") > 0, F.col(f"hit{n}")).otherwise(epsilon) / F.greatest(zero(f"n_p{n}"), F.lit(1))
    bp = F.when(F.col("len_p") >= F.col("len_r"), 1.0).otherwise(F.exp(1 - F.col("len_r") / F.col("len_p")))
    empty = (F.col("len_p") == 0) | (F.col("len_r") == 0) | (zero("hit1") == 0)
    bleu = lambda k: F.when(empty, 0.0).otherwise(bp * F.exp(sum((F.log(precision(n)) for n in range(1, k + 1)), F.lit(0.0)) / k))
    f = lambda hit, a, b: F.when(hit > 0, 2 * hit / (a + b)).otherwise(0.0)
    lcs = lcs_length(F.col("p"), F.col("r"))
    return out.select("id", *(bleu(k).alias(f"bleu_{k}") for k in range(1, 5)), *(f(zero(f"hit{n}"), zero(f"n_p{n}"), zero(f"n_r{n}")).alias(f"rouge_{n}") for n in (1, 2)), f(lcs, F.col("len_p"), F.col("len_r")).alias("rouge_l"))


def lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, all of a row at once: bit i of `row` is 0 where the row of the table rises
    at i, and a token of b turns the row into the next by one addition on whole numbers as long as a."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """lcs of two token arrays; 0 where one is null."""

    @F.pandas_udf("int")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs(p, q) if p is not None and q is not None else 0 for p, q in zip(x, y)], dtype="int32")

    return of(a, b)


def metrics_from_predictions(sentences: DataFrame, by: list[str]) -> DataFrame:
    """Means in percent per run (and split), with n."""
    names = [c for c in sentences.columns if c.startswith(("bleu_", "rouge_"))]
    return sentences.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c) * 100, 3).alias(c) for c in names))


def combine_runs(per_split: DataFrame, run: str = "run") -> DataFrame:
    """Means of splits weighted by their n, per run."""
    names = [c for c in per_split.columns if c.startswith(("bleu_", "rouge_"))]
    return per_split.groupBy(run).agg(F.sum("n").alias("n"), *(F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 3).alias(c) for c in names))


def deterministic_match(answer: Column, accepted: Column) -> Column:
    """Whether the normal form of the answer contains an accepted one's, or the other way round; empty forms don't count."""
    a = T.norm_answer(answer)
    return F.exists(accepted, lambda x: (T.norm_answer(x) != "") & (a != "") & (F.contains(a, T.norm_answer(x)) | F.contains(T.norm_answer(x), a)))


def abstention_match(answer: Column, markers: list[str], aliases: Column) -> Column:
    a = T.norm_answer(answer)
    return F.exists(F.concat(F.array(*(F.lit(m) for m in markers)), F.coalesce(aliases, F.array().cast("array<string>"))), lambda m: (T.norm_answer(m) != "") & F.contains(a, T.norm_answer(m)))


def score_qa(df: DataFrame, markers: list[str]) -> DataFrame:
    """(qid, type, answer, gold, aliases, judge, and for structured answers the maps expected and got) -> qid, correct,
    scored_by: abstentions, choices, structured and text answers by matching, what doesn't match by the judge's verdict
    (null counts as wrong). A structured answer is right if all its expected fields are; the judge isn't asked."""
    match = deterministic_match(F.col("answer"), F.concat(F.array("gold"), F.coalesce("aliases", F.array().cast("array<string>"))))
    abstain = abstention_match(F.col("answer"), markers, F.col("aliases"))
    choice = T.extract_choice(F.col("answer")) == F.upper("gold")
    structured = F.lit(False)
    if {"expected", "got"} <= set(df.columns):
        same = F.forall(F.map_keys("expected"), lambda k: F.coalesce(T.norm_answer(F.col("got")[k]) == T.norm_answer(F.col("expected")[k]), F.lit(False)))
        structured = F.coalesce((F.size("expected") > 0) & same, F.lit(False))
    kind = F.col("type")
    sure = F.when(kind == "abstention", abstain).when(kind == "choice", F.coalesce(choice, F.lit(False))).when(kind == "structured", structured).otherwise(F.coalesce(match, F.lit(False)))
    asked = ~sure & (F.coalesce(kind, F.lit("")) != "structured")
    return df.select("qid", (sure | (asked & F.coalesce("judge", F.lit(False)))).alias("correct"), F.when(asked, "judge").otherwise("match").alias("scored_by"))


def structured_fields(df: DataFrame) -> DataFrame:
    """(qid, expected and got: maps) -> qid, fields, correct, all_correct, accuracy."""
    x = df.select("qid", "got", F.explode("expected").alias("k", "v"))
    ok = F.coalesce(T.norm_answer(F.col("got")[F.col("k")]) == T.norm_answer(F.col("v")), F.lit(False))
    return x.groupBy("qid").agg(F.count(F.lit(1)).alias("fields"), F.count_if(ok).alias("correct"), F.bool_and(ok).alias("all_correct"), F.avg(ok.cast("double")).alias("accuracy"))


def turn_of(message_id: Column) -> Column:
    """`s3-t2-u` -> `s3-t2`: what is before the last hyphen; null for ids without one."""
    return F.nullif(F.regexp_extract(message_id.cast("string"), r"^(.*)-[^-]*$", 1), F.lit(""))


def retrieval_recall(df: DataFrame) -> DataFrame:
    """(qid, answerable, evidence, anchors, included, superseded: id arrays; if there, answer_sessions and sessions)
    -> recall by anchors and by all included ids, by session and by turn (turn_of the ids), all evidence among the anchors,
    all and any among the included, and stale_only: only superseded evidence found. Null where there is nothing to
    answer, a recall also where its gold is empty."""
    none = F.array().cast("array<string>")
    ids = lambda c: F.array_distinct(F.coalesce(F.col(c).cast("array<string>"), none)) if c in df.columns else none
    turns = lambda c: F.array_distinct(F.array_compact(F.transform(ids(c), turn_of)))
    on = F.coalesce("answerable", F.lit(True))
    share = lambda gold, got: F.when(on & (F.size(gold) > 0), F.size(F.array_intersect(gold, got)) / F.size(gold))
    gold, got = ids("evidence"), ids("included")
    any_, all_ = F.arrays_overlap(gold, got), lambda c: (F.size(gold) > 0) & (F.size(F.array_except(gold, ids(c))) == 0)
    told = {
        "anchor_recall": share(gold, ids("anchors")), "included_recall": share(gold, got), "session_recall": share(ids("answer_sessions"), ids("sessions")), "turn_recall": share(turns("evidence"), turns("included")),
        "all_anchors": F.when(on, all_("anchors")), "all_included": F.when(on, all_("included")), "any_included": F.when(on, any_), "stale_only": F.when(on, F.arrays_overlap(ids("superseded"), got) & ~any_),
    }
    return df.select("qid", *(v.alias(k) for k, v in told.items()))


def summarize_qa(df: DataFrame, facets: list[str], measures: list[str]) -> DataFrame:
    """n and means of the measures, nulls left out, overall and by each facet: facet, value, n, .."""
    x = F.explode(F.array(F.struct(F.lit("all").alias("facet"), F.lit("all").alias("value")), *(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets)))
    return df.withColumn("x", x).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col(m).cast("double")).alias(m) for m in measures))


def score_case(df: DataFrame) -> DataFrame:
    """(case_id, probe, correct, stale) -> case_id, n, accuracy, overgeneral_rate and stale_rate of their probes."""
    rate = lambda p, c: F.avg(F.when(F.col("probe") == p, F.col(c).cast("double")))
    return df.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), (1 - rate("overgeneral", "correct")).alias("overgeneral_rate"), rate("stale", "stale").alias("stale_rate"))


def content_f1(tp: Column, missed: Column, false: Column) -> Column:
    """F1 from counts; 1 if nothing was wanted and nothing given, 0 if only one of both is empty."""
    return F.when((tp + missed == 0) & (tp + false == 0), 1.0).when(tp == 0, 0.0).otherwise(2 * tp / (2 * tp + missed + false))


def summarize_cases(cases: DataFrame, probes: DataFrame) -> DataFrame:
    """One row: accuracy and F1 as means over cases, staleness over all probes."""
    a = cases.agg(F.count(F.lit(1)).alias("cases"), F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"))
    b = probes.agg(F.avg(F.col("stale").cast("double")).alias("stale_rate"), F.avg(F.col("correct").cast("double")).alias("micro_accuracy"))
    return a.crossJoin(b)  # one row each


def explode_benchmark(instances: DataFrame) -> DataFrame:
    """(question_id, haystack_session_ids, haystack_dates, haystack_sessions) -> messages with session, position and time; fails
    if the three arrays of an instance differ in length."""
    same = (F.size("haystack_session_ids") == F.size("haystack_dates")) & (F.size("haystack_dates") == F.size("haystack_sessions"))
    z = instances.select("question_id", F.when(same, F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("messages"))).otherwise(F.raise_error(F.concat(F.lit("unequal haystack of "), "question_id"))).alias("z"))
    s = z.select("question_id", F.posexplode("z").alias("session_no", "s"))
    m = s.select("question_id", "session_no", F.col("s.sid").alias("session_id"), T.parse_session_date(F.col("s.date")).alias("date"), F.posexplode("s.messages").alias("pos", "m"))
    return m.select("question_id", "session_id", F.concat_ws("-", "session_id", F.substring("m.role", 1, 1), (F.col("pos") + 1).cast("string")).alias("source_id"), "m.role", "m.content", (F.col("pos") + 1).cast("long").alias("position"), (F.unix_timestamp("date") + F.col("pos")).alias("created_at"))


def oracle_subset(instances: DataFrame) -> DataFrame:
    """Instances with only the sessions that hold the answer."""

    def cut(c: str) -> Column:
        both = F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col(c).alias("v"))
        return F.transform(F.filter(both, lambda z: F.array_contains("answer_session_ids", z["sid"])), lambda z: z["v"])

    return instances.withColumns({c: cut(c) for c in ("haystack_session_ids", "haystack_dates", "haystack_sessions")})


def validate_benchmark(instances: DataFrame, most_repeats: int = 10) -> DataFrame:
    """Violations, one row each: check, question_id (null for a check of the whole set)."""
    dates = F.transform("haystack_dates", T.parse_session_date)
    said = F.flatten(F.transform("haystack_sessions", lambda s: s))
    marked = F.transform(F.filter(said, lambda m: m["has_answer"]), lambda m: m["message_id"])
    all_ids = F.transform(said, lambda m: m["message_id"])
    gold = F.filter("evidence_message_ids", lambda x: ~F.array_contains("superseded_message_ids", x))
    place = lambda x: F.array_position(all_ids, x)
    current = F.array_min(F.transform(gold, place))
    out_of_turn = lambda m, i: m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")
    roles = F.exists("haystack_sessions", lambda s: F.size(F.filter(s, out_of_turn)) > 0)
    checks = {
        "unsorted_dates": F.array_sort(dates) != dates,
        "question_before_history": T.parse_session_date(F.col("question_date")) < F.array_max(dates),
        "unequal_haystack": (F.size("haystack_session_ids") != F.size("haystack_dates")) | (F.size("haystack_dates") != F.size("haystack_sessions")),
        "repeated_session": F.size(F.array_distinct("haystack_session_ids")) < F.size("haystack_session_ids"),
        "repeated_message": F.size(F.array_distinct(all_ids)) < F.size(all_ids),
        "evidence_not_marked": F.array_sort(marked) != F.array_sort("evidence_message_ids"),
        "evidence_unknown": F.size(F.array_except("evidence_message_ids", all_ids)) > 0,
        "no_evidence": F.col("answerable") & (F.size("evidence_message_ids") == 0),
        "evidence_unanswerable": ~F.col("answerable") & (F.size("evidence_message_ids") > 0),
        "superseded_not_before": F.exists("superseded_message_ids", lambda x: place(x) >= current),
        "answer_session_unknown": F.size(F.array_except("answer_session_ids", "haystack_session_ids")) > 0,
        "unknown_role": F.exists(said, lambda m: ~m["role"].isin("user", "assistant")),
        "roles_not_alternating": roles,
        "answer_in_question": F.contains(F.col("question"), F.col("answer")) & F.col("answerable"),
    }
    rows = instances.select("question_id", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in checks.items())))).alias("check"))
    twice = instances.groupBy("question_id").count().where("count > 1").select("question_id", F.lit("repeated_id").alias("check"))
    # The same session text in more questions than allowed.
    texts = instances.select("question_id", F.explode("haystack_sessions").alias("s")).select("question_id", F.sha2(F.to_json("s"), 256).alias("h"))
    often = texts.groupBy("h").agg(F.countDistinct("question_id").alias("n"), F.min("question_id").alias("question_id")).where(F.col("n") > most_repeats).select("question_id", F.lit("session_too_often").alias("check"))
    return rows.unionByName(twice).unionByName(often).select("check", "question_id")


def benchmark_stats(instances: DataFrame) -> DataFrame:
    """measure, mean, least, most over the questions: sessions, messages, evidence, tokens of the history, in one pass."""
    said = F.flatten("haystack_sessions")
    of = {"sessions": F.size("haystack_session_ids"), "messages": F.size(said), "evidence": F.size("evidence_message_ids"), "tokens": F.aggregate(said, F.lit(0).cast("long"), lambda s, m: s + T.count_tokens(m["content"]))}
    x = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("long").alias("v")) for k, v in of.items())))
    return instances.select(x.alias("x")).groupBy("x.measure").agg(F.avg("x.v").alias("mean"), F.min("x.v").alias("least"), F.max("x.v").alias("most"))


def filter_instances(instances: DataFrame, categories: list[str] | None = None, capabilities: list[str] | None = None, limit: int | None = None) -> DataFrame:
    out = instances
    if categories:
        out = out.where(F.col("category").isin(categories))
    if capabilities:
        out = out.where(F.col("capability").isin(capabilities))
    return out.orderBy("question_id").limit(limit) if limit else out


def classification_metrics(df: DataFrame) -> DataFrame:
    """(task, truth, predicted) -> task, n, accuracy, macro_f1 over the classes that occur."""
    cells = df.groupBy("task", "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    x = cells.select("task", "n", F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), (F.col("truth") == F.col("predicted")).alias("hit"))
    per = x.groupBy("task", "x.c").agg(F.sum(F.col("n") * F.col("x.t")).alias("t"), F.sum(F.col("n") * F.col("x.p")).alias("p"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.t")).otherwise(0)).alias("hit"))
    f = per.groupBy("task").agg(F.sum("t").alias("n"), (F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg(F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("t") + F.col("p"))).otherwise(0.0)).alias("macro_f1"))
    return f


def mrr_single_evidence(hits: DataFrame) -> DataFrame:
    """(query_id, place, is_evidence) -> one row: mean of 1 / place of the first evidence, 0 for queries without."""
    g = hits.groupBy("query_id").agg(F.min(F.when(F.col("is_evidence"), F.col("place"))).alias("first"))
    return g.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def profile_eval(matches: DataFrame) -> DataFrame:
    """(in_gold, in_profile, kind) -> one row: precision, recall, f1, and the share of the profile that is stale, of third
    parties or transient."""
    both = F.count_if(F.col("in_gold") & F.col("in_profile"))
    got, gold = F.count_if(F.col("in_profile")), F.count_if(F.col("in_gold"))
    rates = [(F.count_if(F.col("in_profile") & (F.col("kind") == k)) / F.greatest(got, F.lit(1))).alias(f"{k}_rate") for k in ("stale", "third_party", "transient")]
    return matches.agg((both / F.greatest(got, F.lit(1))).alias("precision"), (both / F.greatest(gold, F.lit(1))).alias("recall"), (2 * both / F.greatest(got + gold, F.lit(1))).alias("f1"), *rates)
