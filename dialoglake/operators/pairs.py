"""Preference pairs: chosen candidates, rejected answers, flags and judgements. Generated answers and judgements come in
as columns; the model call itself is a hook (dialoglake.hooks)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglake.functions import text as T
from dialoglake.operators.dialogue import in_order
from dialoglake.operators.sampling import round_robin, seeded
from dialoglake.storage import global_rank


def chosen_candidates(turns: DataFrame, least: int = 60, max_msgs: int = 8, openers: list[str] = ()) -> DataFrame:
    """Every adjacent pair whose cleaned answer has at least `least` key characters: conv_id, turn, prompt, chosen."""
    t = turns.where(F.col("role").isin("user", "assistant"))
    line = F.concat("role", F.lit(": "), T.strip(F.col("text")))
    p = t.select("conv_id", "turn", "role", F.collect_list(line).over(in_order().rowsBetween(-(max_msgs - 1), 0)).alias("lines"), F.lead("role").over(in_order()).alias("next_role"), T.clean_reply(F.lead("text").over(in_order()), openers).alias("chosen"))
    return p.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.length(T.norm_key(F.col("chosen"))) >= least)).select("conv_id", "turn", F.array_join("lines", "\n").alias("prompt"), "chosen")


def reject_mismatch(pairs: DataFrame, seed: str = "42") -> DataFrame:
    """Adds mismatch: the chosen text of another row, different in key. The distinct texts stand in a ring in seeded
    order and each row gets its text's successor; null if there is only one text."""
    texts = pairs.select(T.norm_key(F.col("chosen")).alias("__key"), F.col("chosen").alias("__text")).groupBy("__key").agg(F.min("__text").alias("__text"))
    ring = global_rank(texts, [seeded(seed, "__key"), F.col("__key")], "__place")
    n = ring.count()
    following = ring.select((F.col("__place") - 1).alias("__place"), F.col("__text").alias("mismatch")).withColumn("__place", F.when(F.col("__place") == 0, n).otherwise(F.col("__place")))
    table = ring.select("__key", "__place").join(following, "__place").select("__key", F.when(F.lit(n > 1), F.col("mismatch")).alias("mismatch"))
    return pairs.withColumn("__key", T.norm_key(F.col("chosen"))).join(table, "__key", "left").drop("__key")


def build_pairs(pairs: DataFrame, generic: list[str], p_mismatch: float = 0.7, seed: str = "42") -> DataFrame:
    """Pairs (conv_id, turn, prompt, chosen) with a rejected answer: by seeded hash another row's answer or a bare first
    sentence; the latter too if the former is missing, a generic answer if that equals the chosen one; pairs that stay
    equal are dropped. Adds rejected, mode and id."""
    m = reject_mismatch(pairs, seed)
    u = F.conv(F.substring(seeded(seed + "/mode", "conv_id", "turn"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    same = lambda a: T.norm_key(a) == T.norm_key(F.col("chosen"))
    cut = T.first_sentence(F.col("chosen"))
    pick = T.stable_pick(F.concat_ws("|", "conv_id", "turn"), generic)
    usable_cut = (cut != "") & ~same(cut)
    mode = F.when((u < p_mismatch) & F.col("mismatch").isNotNull(), "mismatch").when(usable_cut, "truncate").otherwise("generic")
    out = m.withColumn("mode", mode).withColumn("rejected", F.when(F.col("mode") == "mismatch", F.col("mismatch")).when(F.col("mode") == "truncate", cut).otherwise(pick))
    out = out.where(~same(F.col("rejected"))).drop("mismatch")
    return out.withColumn("id", F.sha1(F.to_json(F.struct("prompt", "chosen", "rejected")).cast("binary")))


def topic_balanced_pairs(candidates: DataFrame, used: DataFrame, topics: list[str], n: int, seed: str = "42") -> DataFrame:
    """n candidates (conv_id, turn, topic, ..), one topic after the other, none of a used conversation."""
    free = candidates.join(used.select("conv_id").distinct(), "conv_id", "left_anti").withColumn("__id", F.concat_ws(":", "conv_id", "turn"))
    return round_robin(free, "topic", topics, n, "__id", seed).drop("__id")


def extract_reply(raw: Column, least_cjk: int = 4) -> Column:
    """The reply in generated text: the body of a <reply> or <rejected> tag, else the line with the most CJK and least
    ASCII characters, if it has enough CJK; empty otherwise. Thinking blocks don't count."""
    t = T.strip_think(raw)
    tagged = F.regexp_extract(t, r"(?is)<(reply|rejected)>(.*?)</\1>", 2)
    scored = F.transform(F.filter(F.split(t, r"\n+"), lambda x: T.count_cjk(x) >= least_cjk), lambda x: F.struct((2 * T.count_cjk(x) - T.count_ascii_letters(x)).alias("s"), T.strip(x).alias("x")))
    return T.strip_quotes(F.when(T.strip(tagged) != "", tagged).otherwise(F.coalesce(F.array_max(scored)["x"], F.lit(""))))


def generation_flags(reply: Column, chosen: Column, user: Column, least: int = 10) -> Column:
    """What makes a generated answer unusable: empty, equals_chosen, echoes_user, too_short."""
    r, c, u = (T.norm_key(x) for x in (reply, chosen, user))
    return F.array_compact(F.array(F.when(r == "", "empty"), F.when((r != "") & (r == c), "equals_chosen"), F.when((r != "") & (u != "") & (u.contains(r) | r.contains(u)), "echoes_user"), F.when((r != "") & (F.length(r) < least), "too_short")))


# Traces of reasoning about the task in English and Chinese, any case.
META_TRACE = [
    r"the user|system prompt|assistant:|analysis|reasoning|thinking|thought process|you are a helpful assistant|we need to",
    r"now count|let's count|so total|characters?\s*[:=]|within\s+\d+|that's within|fine\.",
    r"根据要求|系统提示|输出格式|不要输出|只输出|(思考|分析|推理)(过程|如下|：|:)|我需要(思考|分析|推理)|让我(思考|分析|推理)|下面(是|进行).{0,10}(思考|分析|推理)",
]
# Tags that wrap thinking or replies, and any short tag.
TAGS = [r"</?(reply|rejected|think|thinking|reasoning|analysis|回复)[^>]*>", r"<[^>]{1,30}>"]


def rejected_quality_flags(text: Column, cjk_expected: bool = True, meta: list[str] = META_TRACE, tags: list[str] = TAGS, least: int = 8) -> Column:
    """What is wrong with a rejected answer: missing_rejected (null), empty_rejected, or any of no_cjk, englishy, meta_trace,
    xml_tags, quote_meta (double quotes among ASCII letters) and too_short."""
    # Whether a text has n of a kind of character is one search that ends at the n-th; a count would go on to its end.
    def flags(x: Column) -> Column:
        t, low = x["t"], x["low"]
        said, cjk, ascii_ = t != "", lambda n: t.rlike(T.at_least(T.CJK, n)), lambda n: t.rlike(T.at_least("[A-Za-z]", n))
        each = [
            F.when(text.isNull(), "missing_rejected"), F.when(text.isNotNull() & ~said, "empty_rejected"), F.when(F.lit(cjk_expected) & said & ~cjk(1), "no_cjk"),
            F.when(F.lit(cjk_expected) & ascii_(25) & ~cjk(10), "englishy"), F.when(T.matches_any(t, low, meta), "meta_trace"), F.when(T.matches_any(t, low, tags), "xml_tags"),
            F.when(t.contains('"') & ascii_(10), "quote_meta"), F.when(said & (F.length(t) < least), "too_short"),
        ]
        return F.array_compact(F.array(*each))

    # Stripped and folded once for all flags.
    return T.bound(T.strip(T.text_of(text)), lambda t: T.bound(F.struct(t.alias("t"), T.folded(t).alias("low")), flags))


def parse_winner(raw: Column) -> Column:
    """A or B from a judge's text: a bare letter, JSON with winner, choice or better, the last line, 选A/选B, the last letter
    that stands alone; null if none says."""
    t = F.upper(F.translate(T.strip(T.strip_think(raw)), "ＡＢａｂ", "ABAB"))
    last = F.element_at(F.filter(F.split(t, r"\n"), lambda x: T.strip(x) != ""), -1)
    alone = F.regexp_extract_all(t, F.lit(r"(?<![A-Z])([AB])(?![A-Z])"), F.lit(1))
    tries = [F.regexp_extract(t, r"^[\"'(\[]?([AB])[\"')\].。]?$", 1), F.regexp_extract(t, r"\"(?:WINNER|CHOICE|BETTER)\"\s*:\s*\"([AB])\"", 1), F.regexp_extract(F.coalesce(last, F.lit("")), r"^[^A-Z]*([AB])[^A-Z]*$", 1), F.regexp_extract(t, r"选\s*([AB])", 1)]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in tries), F.when(F.size(alone) > 0, F.element_at(alone, -1)))


def judge_pairs(df: DataFrame) -> DataFrame:
    """(id, a, b, verdict, retry) -> id, chosen, rejected, decided_by: the judge's verdict, else the strict retry, else the
    higher repetition score (A of equals)."""
    first, second = parse_winner(F.col("verdict")), parse_winner(F.col("retry"))
    score = F.when(T.repetition_score(F.col("a")) >= T.repetition_score(F.col("b")), "A").otherwise("B")
    w = df.select("id", "a", "b", F.coalesce(first, second, score).alias("w"), F.when(first.isNotNull(), "judge").when(second.isNotNull(), "retry").otherwise("score").alias("decided_by"))
    return w.select("id", F.when(F.col("w") == "A", F.col("a")).otherwise(F.col("b")).alias("chosen"), F.when(F.col("w") == "A", F.col("b")).otherwise(F.col("a")).alias("rejected"), "decided_by")
