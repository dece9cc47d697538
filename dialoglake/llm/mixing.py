"""Operator 7, mixing to target weights by soft membership, with built-in functions only.

A classifier learned from a table of labelled documents gives every document a posterior over domains: naive Bayes
over the presence of words, limited to the words whose counts differ most from what the domains' sizes predict. Its
log-odds are shrunken, since a language's words occur together and small differences of theirs would add up to
certainty; what is left is calibrated by logistic regression on labelled rows kept apart. Then rates r_i >= 0 are
fitted so that the expected tokens of each domain, sum_i r_i * tokens_i * P(domain | i), match the targets, by
projected gradient descent on the weighted least squares
    1/2 * sum_d (expected_d - target_d)^2 / mass_d,     mass_d = sum_i tokens_i * P(d | i),
in the metric in which a token counts alike in long and short documents. In that metric the Gram matrix scaled by
mass has row sums of 1, so a step of 1 can't diverge. A round is one pass over a narrow stored table that sums one
number per domain; the descent starts at rate 1 for every document and only as many numbers as there are domains
reach the driver.

The classifier is fitted on about `max_labelled` labelled rows at most, taken by a hash of the id, and has at most
`max_words` words in its table (documented bounds), so the table may be broadcast: words that `min_rows` labelled rows
or more have and whose chi-squared distance is over `min_apart`, which leaves out words that say nothing. Everything
else covers all rows. If the targets can't be met, `miss` says by how much.

Defined results: null and empty texts have no tokens, the prior as posterior and the rate their posterior implies;
several labels of a document count each; null domains don't count; without labels all posteriors are uniform; a domain
without expected tokens can't be matched and is left out of the fit; repeated rows and repeated or null ids are rows
of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import freeze, row_of


def _words(text: str) -> Column:
    """Words of a text at blanks, as they stand; empty strings may occur."""
    return F.split(F.coalesce(F.col(text), F.lit("")), r"\s+")


def _marks(words: Column, n: Column) -> Column:
    """Hashes of a text's distinct words, and of how varied they are (in tenths)."""
    distinct = F.array_distinct(words)
    varied = F.concat(F.lit("distinct-share:"), F.floor(10 * F.size(distinct) / F.greatest(n, F.lit(1))).cast("string"))
    return F.array_append(distinct, varied)


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _sample_marks(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int, id_col: str, text_col: str) -> DataFrame:
    """(fold, domain, marks) of about max_labelled labelled rows at most, as a stored table; fold is 0 to 3."""
    known = labelled.where(F.col("domain").isin(domains)).select(F.col(id_col).cast("long").alias("doc_id"), "domain")
    n_known = known.count()
    draw = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    known = known.where(draw < min(1.0, max_labelled / max(1, n_known)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(known, "doc_id")
    w = _words("text")
    marks = texts.select(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)).alias("fold"), "domain", _marks(w, F.size(w)).alias("marks"))
    return freeze(marks.withColumn("marks", F.transform("marks", lambda m: F.xxhash64(m))), "mixing-sample")


def _table_of(marks: DataFrame, domains: list[str], max_words: int, min_rows: int, min_apart: float, shrink: float, errors: float) -> tuple[DataFrame, list[float]]:
    size = {r["domain"]: r["count"] for r in marks.groupBy("domain").count().collect()}
    total = sum(size.values())
    if not total:
        return marks.sparkSession.createDataFrame([], "mark long, " + ", ".join(f"l{k} double" for k in range(len(domains)))), [0.0] * len(domains)
    of = [size.get(d, 0) for d in domains]
    prior = [log((n + 1) / (total + len(domains))) for n in of]
    seen = marks.select("domain", F.explode("marks").alias("mark")).groupBy("mark").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)), F.count(F.lit(1)).alias("n"))
    # Chi-squared distance of a word's counts from the domains' sizes.
    apart = _total(F.pow(F.col(f"n{k}") - F.col("n") * (n / total), 2) / (F.col("n") * (max(n, 1) / total)) for k, n in enumerate(of))
    best = seen.where(F.col("n") >= min_rows).withColumn("apart", apart).where(F.col("apart") > min_apart).orderBy(F.desc("apart"), "mark").limit(max_words)
    # Counts are smoothed towards the domains' sizes, so that a rare word says little.
    overall = (F.col("n") + 0.5) / (total + 0.5)

    def odds(k: int) -> Column:
        if not of[k]:
            return F.lit(0.0)
        rate = (F.col(f"n{k}") + 0.5 * of[k] / total) / (of[k] + 0.5)
        raw = F.log(rate + 1e-6) - F.log(overall + 1e-6)
        error = 1 / F.sqrt(F.greatest(F.col(f"n{k}"), F.col("n") * (of[k] / total)))
        return F.signum(raw) * F.greatest(F.lit(0.0), F.abs(raw) - shrink - errors * error)

    return freeze(best.select("mark", *(odds(k).alias(f"l{k}") for k in range(len(domains)))), "mixing-table"), prior


def learn_table(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = 20_000, max_words: int = 20_000, min_rows: int = 5, min_apart: float = 40.0, shrink: float = 0.0, errors: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[float]]:
    """Word table (mark, l0..: log-odds of each domain) and the domains' log priors. labelled: (id, domain).
    Log-odds are moved towards 0 by `shrink` and by `errors` of their standard errors."""
    return _table_of(_sample_marks(docs, labelled, domains, max_labelled, id_col, text_col), domains, max_words, min_rows, min_apart, shrink, errors)


def _summed(met: DataFrame, keys: list[str], k: range) -> DataFrame:
    return met.groupBy(*keys).agg(*(F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"s{i}") for i in k))


def _shares(logits: list[Column]) -> list[Column]:
    """Softmax."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    e = [F.exp(x - top) for x in logits]
    return [x / _total(e) for x in e]


def calibrate(scored: DataFrame, domains: list[str], prior: list[float], ridge: float = 0.1, rounds: int = 50) -> list[list[float]]:
    """One row per domain of the weights of asinh(s_0), asinh(s_1), .. and 1, so that the softmax over the domains is
    a probability: multinomial logistic regression by Newton's method with halved steps.

    scored: (domain, s0..) of labelled rows that the word table was not learned from. Rows are counted by domain and
    values to a tenth; only these counts, no more of them than labelled rows were sampled, reach the driver. A ridge
    draws the weights to those of plain naive Bayes, which is what no rows give.
    """
    n = len(domains)
    tenths = [F.round(F.asinh(f"s{i}"), 1).alias(f"g{i}") for i in range(n)]
    counts = scored.groupBy("domain", *tenths).count().collect()
    start = np.array([[float(i == j) for j in range(n)] + [prior[i]] for i in range(n)])
    x = np.array([[r[f"g{i}"] for i in range(n)] + [1.0] for r in counts]).reshape(-1, n + 1)
    y = np.array([[float(r["domain"] == d) for d in domains] for r in counts]).reshape(-1, n)
    weight = np.array([float(r["count"]) for r in counts])

    def logs(theta):
        z = x @ theta.T
        z = z - z.max(axis=1, keepdims=True) if len(z) else z
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def loss(theta):
        return -(weight[:, None] * y * logs(theta)).sum() + 0.5 * ridge * ((theta - start) ** 2).sum()

    theta = start
    for _ in range(rounds):
        p = np.exp(logs(theta))
        slope = ((p - y) * weight[:, None]).T @ x + ridge * (theta - start)
        curve = ridge * np.eye(n * (n + 1))
        for i in range(n):
            for j in range(n):
                block = (x * (weight * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x
                curve[i * (n + 1) : (i + 1) * (n + 1), j * (n + 1) : (j + 1) * (n + 1)] += block
        step = np.linalg.solve(curve, slope.ravel()).reshape(theta.shape)
        size, now = 1.0, loss(theta)
        while size > 1e-6 and loss(theta - size * step) > now:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return theta.tolist()


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = 20_000, max_words: int = 20_000, min_rows: int = 5, min_apart: float = 40.0, shrink: float = 1.0, errors: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[float], list[list[float]]]:
    """Word table and priors learned from three quarters of the labelled rows, calibration learned from the fourth."""
    marks = _sample_marks(docs, labelled, domains, max_labelled, id_col, text_col)
    table, prior = _table_of(marks.where("fold != 0"), domains, max_words, min_rows, min_apart, shrink, errors)
    # Rows are numbered in a select of their own: beside an explode every mark would get a number.
    apart = marks.where("fold = 0").select(F.monotonically_increasing_id().alias("row"), "domain", "marks").select("row", "domain", F.explode("marks").alias("mark"))
    scored = _summed(apart.join(F.broadcast(table), "mark", "left"), ["row", "domain"], range(len(domains)))
    return table, prior, calibrate(scored, domains, prior)


def posteriors(docs: DataFrame, table: DataFrame, prior: list[float], id_col: str = "doc_id", text_col: str = "text", calibration: list[list[float]] | None = None) -> DataFrame:
    """(row, doc_id, digest of the text, n_tokens, p0..) for every row of docs, as a stored table: naive Bayes, or
    calibrated naive Bayes if a calibration is given."""
    k = range(len(prior))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), F.filter(_words(text_col), lambda x: x != "").alias("words"))
    rows = rows.withColumn("n_tokens", F.size("words").cast("long"))
    marks = rows.select("row", "doc_id", "digest", "n_tokens", F.explode(_marks(F.col("words"), F.col("n_tokens"))).alias("word"))
    met = marks.select("row", "doc_id", "digest", "n_tokens", F.xxhash64("word").alias("mark")).join(F.broadcast(table), "mark", "left")
    summed = _summed(met, ["row", "doc_id", "digest", "n_tokens"], k)
    if calibration is None:
        logits = [F.col(f"s{i}") + F.lit(prior[i]) for i in k]
    else:
        logits = [_total([*(F.asinh(f"s{j}") * F.lit(calibration[i][j]) for j in k), F.lit(calibration[i][-1])]) for i in k]
    return freeze(summed.select("row", "doc_id", "digest", "n_tokens", *(p.alias(f"p{i}") for i, p in enumerate(_shares(logits)))), "mixing-posteriors")


def fit_rates(members: DataFrame, targets: list[float], rounds: int = 40, tolerance: float = 1e-4) -> tuple[DataFrame, float]:
    """members (n_tokens, p0..) with rates added, and the largest miss of a target as a share of all targets, at most
    the tolerance unless the rounds ended before. targets: expected tokens wanted of each domain."""
    k = range(len(targets))
    sums = lambda rate: [F.coalesce(F.sum(rate * F.col("n_tokens") * F.col(f"p{i}")), F.lit(0.0)) for i in k]
    mass = members.agg(*sums(F.lit(1.0))).first()
    rate, df = F.lit(1.0), members
    for r in range(rounds + 1):
        got = df.agg(*sums(rate)).first()
        miss = [(got[i] - targets[i]) if mass[i] > 0 else 0.0 for i in k]
        share = max(abs(m) for m in miss) / max(1.0, sum(targets))
        if share <= tolerance or r == rounds:
            break
        rate = F.greatest(F.lit(0.0), rate - _total(F.col(f"p{i}") * F.lit(miss[i] / mass[i] if mass[i] > 0 else 0.0) for i in k))
        if r % 10 == 9:  # keeps the expression short
            df = freeze(df.withColumn("rate", rate), "mixing-rates")
            rate = F.col("rate")
    return df.withColumn("rate", rate), share


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str, anchor_rate: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rates that give the domains their weights: row, doc_id, digest, n_tokens, p_<domain>.., rate, copies, miss.

    labelled: (id, domain). The token budget is such that the anchor domain keeps anchor_rate times its expected
    tokens. copies is the rate rounded up or down by a hash of id and text, so that it is right on average; miss is the same in all rows (see fit_rates).
    """
    domains = list(weights)
    table, prior, calibration = learn(docs, labelled, domains, id_col=id_col, text_col=text_col)
    members = posteriors(docs, table, prior, id_col, text_col, calibration)
    a = domains.index(anchor)
    expected = members.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{a}")), F.lit(0.0)).alias("t")).first()["t"]
    share = sum(weights.values())
    budget = anchor_rate * expected / (weights[anchor] / share)
    rated, miss = fit_rates(members, [budget * weights[d] / share for d in domains])
    draw = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "digest"), F.lit(1 << 30)) / float(1 << 30)
    return rated.select("row", "doc_id", "digest", "n_tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate", F.floor(F.col("rate") + draw).cast("long").alias("copies"), F.lit(miss).alias("miss"))


def resample(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str, anchor_rate: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs as many times as its copies in `mix`, columns unchanged."""
    rated = mix(docs, labelled, weights, anchor, anchor_rate, id_col, text_col)
    key = lambda i, digest: F.struct(F.coalesce(i, F.lit(0)).alias("id"), i.isNull().alias("none"), digest.alias("digest")).alias("key")
    copies = rated.groupBy(key(F.col("doc_id"), F.col("digest"))).agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    rows = docs.select(key(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))), row_of(docs))
    return rows.join(copies, "key").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")


def domains_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: toxic, low (quality 0) or clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("toxic") == 0) & (F.col("quality") == 1), "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")
