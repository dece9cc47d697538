"""Operator 4, quality rules with risk-controlled thresholds.

Each rule rejects a document when a measure of its text exceeds a cutoff. Cutoffs are chosen per stratum (language) from
a fixed grid, on documents with a quality label that pass the base rules, half of them for comparing cutoffs and half
held out for the guarantee. A cutoff is admissible if, on the holdout, an exact binomial test rejects "the rule loses
more than risk / #rules of the good documents" at level delta / #tests (Bonferroni over all strata, rules and cutoffs).
So with probability 1 - delta no stratum loses more than `risk` of its good documents. Among admissible cutoffs the one
that removes most bad documents is taken, good ones counting ten times; without one the rule stays silent.

Measures are computed once over all texts; the tests work on one row per stratum, rule and cutoff.

Defined results: null text has no words (and fails the base rules); a null stratum is the stratum "unknown"; several
labels of a document count as the lowest, null labels don't count; without labels only the base rules reject; repeated
rows and repeated or null ids are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import freeze

# Cutoffs that are tried for each measure (a document above the cutoff is rejected).
GRID = {
    "symbols_per_word": [0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0, 2.5],
    "dup_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeat_share": [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "upper_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "bangs_per_word": [0.05, 0.1, 0.2, 0.5, 0.8, 1.0, 1.5, 1.8],
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    size = len(ids)
    pair = a[:-2] * size + a[1:-1]
    if size > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, times = np.unique(pair * size + a[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    marked = np.zeros(n, dtype=bool)
    for k in range(3):
        marked[k : n - 2 + k] |= twice
    return int(marked.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of _COUNTS for one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    if not words:
        return (0, 0, sum(map(text.count, "#*$%&|<>")), 0, 0, 0, 0, 0)
    seen: set[str] = set()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    seen.update(lines)
    codes = np.frombuffer(raw, np.uint8)
    upper = int(np.count_nonzero((codes >= 65) & (codes <= 90)))
    return (
        len(words), len(text) - (len(raw) - sum(map(len, words))), sum(map(text.count, "#*$%&|<>")),
        len(lines) - len(seen), repeated_words(words), len(lines), upper, text.count("!"),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [text_counts(t) for t in b.column(2).to_pylist()]
            cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "stratum", *_COUNTS])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("unknown")).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _measures() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
        "bangs_per_word": F.col("n_bangs") / words,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding. Terms are added from the k-th down until they vanish,
    which takes about as many as the standard deviation, not k."""
    if k >= n:
        return 1.0
    term = first = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p)
    top, total, step = first, 1.0, log1p(-p) - log(p)
    for i in range(k, 0, -1):
        term += log(i) - log(n - i + 1) + step
        if term > top:
            total, top = total * exp(top - term), term
        total += exp(term - top)
        if term < top - 45 and i < p * n:
            break
    return min(1.0, exp(top + log(total)))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, grid: dict[str, list[float]] = GRID, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, one column per rule: the cutoff or null)."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.min(label_col) > 0).alias("good"))
    rows = measured.where(~base_failed()).join(known, "doc_id")
    fit = F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary")) % 2 == 0
    tries = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (m > c).alias("hit")) for r, m in _measures().items() for c in grid[r])))
    n = lambda *conditions: F.sum(sum((c.cast("int") for c in conditions[1:]), conditions[0].cast("int")).eqNullSafe(len(conditions)).cast("long"))
    good, hit = F.col("good"), F.col("hit")
    tests = freeze(
        rows.select("stratum", "good", fit.alias("fit"), tries.alias("x")).select("stratum", "good", "fit", "x.*").groupBy("stratum", "rule", "cutoff").agg(
            n(~F.col("fit"), good).alias("n_good"), n(~F.col("fit"), good, hit).alias("lost"),
            n(F.col("fit"), good).alias("fit_good"), n(F.col("fit"), good, hit).alias("fit_lost"),
            n(F.col("fit"), ~good).alias("fit_bad"), n(F.col("fit"), ~good, hit).alias("fit_removed"),
        ), "quality-tests",
    )
    level, each = delta / max(1, tests.count()), risk / len(grid)

    @F.pandas_udf("double")
    def p_value(lost: pd.Series, n_good: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(k), int(m), each) if m else 1.0 for k, m in zip(lost, n_good)])

    gain = F.col("fit_removed") / F.greatest("fit_bad", F.lit(1)) - 10 * F.col("fit_lost") / F.greatest("fit_good", F.lit(1))
    admitted = tests.withColumn("p", p_value("lost", "n_good")).where(F.col("p") <= level).withColumn("gain", gain).where("gain > 0")
    best = lambda r: F.max_by(F.when(F.col("rule") == r, F.col("cutoff")), F.when(F.col("rule") == r, F.struct("gain", "cutoff"))).alias(f"cut_{r}")
    return freeze(admitted.groupBy("stratum").agg(*(best(r) for r in grid)), "quality-cutoffs")


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, rejected_by (names of the rules that rejected)."""
    measured = freeze(measure(docs, id_col, text_col, stratum_col), "quality-measures")
    cutoffs = choose_cutoffs(measured, labels, risk, delta, id_col=id_col)
    joined = measured.join(cutoffs, "stratum", "left")
    rejected = F.array_compact(F.array(F.when(base_failed(), F.lit("base")), *(F.when(m > F.col(f"cut_{r}"), F.lit(r)) for r, m in _measures().items())))
    out = joined.select("doc_id", *_COUNTS[:5], base_failed().alias("base_failed"), rejected.alias("rejected_by"))
    return out.select("doc_id", *_COUNTS[:5], "base_failed", (F.size("rejected_by") == 0).alias("kept"), "rejected_by")
