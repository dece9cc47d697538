"""Rule labels over text, and plumbing of labels in samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglake.functions import lexicons as X
from dialoglake.functions import text as T


def risk_level(text: Column, lists: dict[str, list[str]] = X.RISK, otherwise: str = "R0") -> Column:
    return T.first_label(T.norm_text(text), lists, otherwise)


def emotion(text: Column, lists: dict[str, list[str]] = X.EMOTION, otherwise: str = X.NO_EMOTION) -> Column:
    return T.first_label(T.norm_text(text), lists, otherwise)


def domain_flag(text: Column, terms: list[str] = X.CAMPUS) -> Column:
    return T.contains_any(T.norm_text(text), terms)


def domain_score(text: Column, terms: list[str] = X.CAMPUS, weighted: list[str] = X.CAMPUS_WEIGHTED) -> Column:
    """Places where a term stands, and one more for each weighted term that occurs."""
    t = T.norm_text(text)
    return (F.regexp_count(t, F.lit(T.one_of(terms))) + sum((t.contains(w).cast("int") for w in weighted), F.lit(0))).cast("long")


def topic_bucket(text: Column, lists: dict[str, list[str]] = X.TOPICS, otherwise: str = "other") -> Column:
    return T.first_label(T.norm_key(text), lists, otherwise)


def strict_match(text: Column, pattern: str) -> Column:
    return T.text_of(text).rlike(pattern)


def get_label(df: DataFrame, key: str) -> Column:
    """The label under its own column, else `label`, else inside `output` (a JSON string)."""
    places = [F.col(c).cast("string") for c in (key, "label") if c in df.columns]
    if "output" in df.columns:
        places.append(F.get_json_object("output", f"$.{key}"))
    return F.coalesce(*places)


def derive_labels(samples: DataFrame) -> DataFrame:
    """Samples with a mother label (output: JSON with is_consult, risk, emotion) -> one row per task: intent for all, risk
    and emotion for consultations; each says what it was derived from."""
    j = lambda k: F.get_json_object("output", f"$.{k}")
    tasks = F.array(F.struct(F.lit("intent").alias("task"), j("is_consult").alias("label")), F.when(j("is_consult") == "1", F.struct(F.lit("risk").alias("task"), j("risk").alias("label"))), F.when(j("is_consult") == "1", F.struct(F.lit("emotion").alias("task"), j("emotion").alias("label"))))
    rows = samples.select("id", "input", F.explode(F.array_compact(tasks)).alias("t"))
    return rows.select("id", "input", "t.task", "t.label", F.lit("mother").alias("derived_from")).where("label is not null")


# Four risk levels become three.
MERGED_LEVELS = {"R0": "R0", "R1": "R0", "R2": "R1", "R3": "R2"}


def remap_labels(samples: DataFrame, mapping: dict[str, str] = MERGED_LEVELS, columns: tuple[str, ...] = ("risk",), texts: tuple[str, ...] = ()) -> DataFrame:
    """Levels mapped in the label columns, and where they stand as words in the texts; changed says whether any did."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    new = {c: F.coalesce(table[F.col(c)], F.col(c)) for c in columns}
    for c in texts:
        out = F.col(c)
        for k in mapping:
            out = F.regexp_replace(out, rf"\b{k}\b", f"\u0001{k}\u0002")
        for k, v in mapping.items():
            out = F.replace(out, F.lit(f"\u0001{k}\u0002"), F.lit(v))
        new[c] = out
    changed = F.lit(False)
    for c, v in new.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    return samples.select(*(new[c].alias(c) if c in new else F.col(c) for c in samples.columns), changed.alias("changed"))


def route(is_consult: Column) -> Column:
    return F.when(is_consult == 1, "consult").otherwise("chat")


def corpus_samples(pairs: DataFrame, seed: str, risk: dict[str, list[str]], emotions: dict[str, list[str]], domain: list[str]) -> DataFrame:
    """Labelled classifier samples from pairs with context: conv_id, pair_idx, split, input, n_tokens, risk, emotion, domain."""
    from dialoglake.operators.keys import hash_split

    focus = F.col("user_focus")
    return pairs.select(
        "conv_id", "pair_idx", hash_split(seed, F.col("conv_id")).alias("split"), F.col("context").alias("input"), T.count_tokens(F.col("context")).alias("n_tokens"),
        risk_level(focus, risk).alias("risk"), emotion(focus, emotions, "none").alias("emotion"), domain_flag(focus, domain).alias("domain"),
    )
