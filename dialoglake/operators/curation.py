"""Dataset-level text jobs: profiles of a corpus, clean-up with counts, filtering with reasons, parsed model outputs with a
quarantine, and pairs of near texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglake.functions import lexicons as X
from dialoglake.functions import text as T
from dialoglake.operators import pairs as P


def profile_text(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Per group: rows, blank rows, characters, tokens, CJK characters, distinct keys."""
    c = F.col(text)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(T.norm_text(c) == "").alias("n_blank"), F.sum(F.length(T.text_of(c))).alias("chars"), F.sum(T.count_tokens(c)).alias("tokens"), F.sum(T.count_cjk(c)).cast("long").alias("cjk"), F.countDistinct(F.md5(T.norm_key(c).cast("binary"))).alias("distinct_keys"))


def rewrite(c: Column, rules: list[tuple[str, str]], drop: list[str] = (), override: dict[str, str] | None = None) -> Column:
    """An exact match in override wins; else the rules (pattern, replacement) in order, phrases dropped, blanks collapsed."""
    out = T.text_of(c)
    for pattern, new in rules:
        out = F.regexp_replace(out, pattern, new)
    for phrase in drop:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    out = T.strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"([，。！？,!?])\1+", "$1"))
    for old, new in (override or {}).items():
        out = F.when(T.strip(T.text_of(c)) == old, new).otherwise(out)
    return out


def canned_reply(c: Column, table: list[tuple[list[str], str]], otherwise: Column) -> Column:
    """The reply of the first entry with a keyword in the text."""
    out = otherwise
    for words, reply in reversed(table):
        out = F.when(T.contains_any(T.text_of(c), words), reply).otherwise(out)
    return out


def clean_corpus(df: DataFrame, rules: dict[str, callable], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rules (name -> function of the text column) in order -> the cleaned table, and how many rows each rule changed."""
    out, changed = df, {}
    for name, rule in rules.items():
        out = out.withColumn("__new", rule(F.col(text))).withColumn(f"__{name}", ~F.col("__new").eqNullSafe(F.col(text))).withColumn(text, F.col("__new")).drop("__new")
        changed[name] = F.count_if(F.col(f"__{name}")).alias(name)
    counts = out.agg(*changed.values()).select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("changed")) for n in rules))).alias("x")).select("x.*")
    return out.select(*df.columns), counts


def filter_utterances(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """checks: reason -> condition to keep. -> kept rows, and counts of the first reason against each dropped row."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in checks.items()))
    marked = df.withColumn("__reason", reason)
    return marked.where("__reason is null").drop("__reason"), marked.where("__reason is not null").groupBy(F.col("__reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def parse_model_outputs(df: DataFrame, kind: str, raw: str = "raw") -> tuple[DataFrame, DataFrame, DataFrame]:
    """kind: json (correct: boolean, rescued by pattern if the JSON is broken), choice, winner, reply or label. -> parsed rows
    (with value), quarantined rows (with reason), counts of reasons."""
    c = F.col(raw)
    j = F.from_json(T.extract_json_text(c), "struct<correct: boolean>")["correct"]
    value = {
        "json": F.coalesce(j, F.lower(F.nullif(F.regexp_extract(c, r'(?i)"correct"\s*:\s*(true|false)', 1), F.lit(""))).cast("boolean")).cast("string"),
        "choice": T.extract_choice(c), "winner": P.parse_winner(c), "reply": F.nullif(P.extract_reply(c), F.lit("")),
        "label": F.when(F.lower(T.strip(c)).rlike(r"^(-?\d+|true|false)$"), F.lower(T.strip(c))),
    }[kind]
    m = df.withColumn("value", value)
    bad = m.where("value is null").drop("value").withColumn("reason", F.when(T.strip(T.text_of(c)) == "", "empty").otherwise("unparsable"))
    return m.where("value is not null"), bad, bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def near_text_pairs(df: DataFrame, block: str, key: str, least: float, text: str = "text") -> DataFrame:
    """Pairs of rows with the same block whose word sets have a Jaccard similarity of at least `least`: block, a, b, jaccard.
    The pairs meet on the words of a prefix (rarest first within the block), so rows without a rare word in common never
    meet."""
    from pyspark.sql.window import Window

    s = df.select(F.col(block).alias("block"), F.col(key).alias("id"), T.words(F.col(text)).alias("w")).where(F.size("w") > 0)
    tok = s.select("block", "id", F.size("w").alias("n"), F.explode("w").alias("t"))
    often = tok.groupBy("block", "t").agg(F.count(F.lit(1)).alias("df"))
    placed = tok.join(often, ["block", "t"]).withColumn("p", F.row_number().over(Window.partitionBy("block", "id").orderBy("df", "t")))
    prefix = placed.where(F.col("p") <= F.col("n") - F.ceil(least * F.col("n")) + 1)
    a, b = (prefix.select("block", "t", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in ("a", "b"))
    met = a.join(b, ["block", "t"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("block", "a", "b").distinct()
    sets = s.select("block", F.col("id"), "w")
    j = met.join(sets.select("block", F.col("id").alias("a"), F.col("w").alias("wa")), ["block", "a"]).join(sets.select("block", F.col("id").alias("b"), F.col("w").alias("wb")), ["block", "b"])
    return j.select("block", "a", "b", T.jaccard(F.col("wa"), F.col("wb")).alias("jaccard")).where(F.col("jaccard") >= least)


def daily_chat(df: DataFrame, blocked: list[str] = X.COUNSELLING, **bounds) -> tuple[DataFrame, DataFrame]:
    """filter_utterances with the rules for daily chat, by reason."""
    t = T.norm_text(F.col("text"))
    n = F.length(t)
    return filter_utterances(df, {"length": n.between(bounds.get("least", 10), bounds.get("most", 160)), "script": t.rlike(bounds.get("needs", T.CJK)), "blocked": ~T.contains_any(t, blocked), "varied": T.distinct_share(t) >= bounds.get("least_distinct", 0.15)})
