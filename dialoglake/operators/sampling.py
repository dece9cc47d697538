"""Seeded sampling, balancing, quotas and limits.

A sample is the first rows in the order of md5(seed|key), so it doesn't depend on how the data are partitioned. Ranks
inside a stratum are filtered by a literal bound, which Spark pushes below the shuffle: of a stratum of any size only
that many rows per task are ever sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.storage import global_rank


def seeded(seed: str, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *key).cast("binary"))


def first_k(df: DataFrame, strata: list[str], order: list[Column | str], k: int, rank: str = "__rank") -> DataFrame:
    """The first k rows of each stratum in the given order, with their rank."""
    w = Window.partitionBy(*(strata or [F.lit(0)])).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def reservoir(df: DataFrame, strata: list[str], key: str, k: int, seed: str = "42") -> DataFrame:
    """k rows of each stratum, with eligible: how many the stratum has."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("eligible"))
    return first_k(df, strata, [seeded(seed, key), key], k).drop("__rank").join(counts, strata)


def quota_two_pools(df: DataFrame, pool: str, a: str, b: str, n: int, ratio: float, key: str, seed: str = "42") -> DataFrame:
    """n rows: round(n * ratio) (half to even) from pool a and the rest from pool b; a short pool is made up from the
    other; fails if both are short."""
    have = {r[pool]: r["count"] for r in df.where(F.col(pool).isin(a, b)).groupBy(pool).count().collect()}
    want_a = min(round(n * ratio), have.get(a, 0))
    want_b = min(n - want_a, have.get(b, 0))
    want_a = min(n - want_b, have.get(a, 0))
    if want_a + want_b < n:
        raise ValueError(f"{n} rows wanted, {want_a + want_b} there")
    order = [seeded(seed, key), F.col(key)]
    return first_k(df.where(F.col(pool) == a), [], order, want_a).unionByName(first_k(df.where(F.col(pool) == b), [], order, want_b)).drop("__rank")


def sample_until(df: DataFrame, scan_order: list[Column], max_scan: int, pool: str, a: str, b: str, n: int, ratio: float, key: str, seed: str = "42") -> DataFrame:
    """quota_two_pools over the first max_scan rows in scan order. On a cluster nothing ends a scan early; the bound is
    on which rows count."""
    return quota_two_pools(df.orderBy(*scan_order).limit(max_scan), pool, a, b, n, ratio, key, seed)


def first_k_per_class(df: DataFrame, caps: DataFrame, classes: list[str], order: list[str]) -> DataFrame:
    """The first rows of each class in scan order, up to the cap that caps (classes.., cap) names; classes without a cap have none."""
    most = caps.agg(F.max("cap")).first()[0] or 0
    ranked = first_k(df.join(F.broadcast(caps), classes), classes, order, most)
    return ranked.where(F.col("__rank") <= F.col("cap")).drop("__rank", "cap")


def downsample_exact(df: DataFrame, label: str, k: int, key: str, seed: str = "42") -> DataFrame:
    """Exactly k rows of each class; fails if a class has fewer."""
    short = df.groupBy(label).count().where(F.col("count") < k).limit(1).collect()
    if short:
        raise ValueError(f"class {short[0][0]} has {short[0]['count']} rows, {k} wanted")
    return first_k(df, [label], [seeded(seed, key), key], k).drop("__rank")


def _order_of(group: str, order: list[str]) -> Column:
    return reduce(lambda out, kv: F.when(F.col(group) == kv[1], kv[0]).otherwise(out), enumerate(order), F.lit(len(order)))


def round_robin(df: DataFrame, group: str, order: list[str], n: int, key: str, seed: str = "42") -> DataFrame:
    """n rows, one from each group in turn, groups in the given order; pick_no counts the picks of a group."""
    ranked = first_k(df, [group], [seeded(seed, key), key], n, "pick_no")
    return ranked.orderBy("pick_no", _order_of(group, order), group).limit(n)


def balanced_topics(df: DataFrame, topic: str, order: list[str], n: int, key: str, seed: str = "42") -> DataFrame:
    """n // #topics of each topic; what is then missing from n is taken in turn from topics that have more."""
    per = n // max(1, len(order))
    ranked = first_k(df, [topic], [seeded(seed, key), key], n, "pick_no")
    base = ranked.where(F.col("pick_no") <= per)
    rest = ranked.where(F.col("pick_no") > per).orderBy("pick_no", _order_of(topic, order), topic).limit(n - base.count())
    return base.unionByName(rest)


def cap_per_bucket(df: DataFrame, bucket: str, most: int, most_other: int, most_total: int, key: str, seed: str = "42", other: str = "other") -> DataFrame:
    """At most `most` rows of a bucket (most_other of the bucket `other`) and most_total in all; 0 or less: no cap."""
    order = [seeded(seed, key), F.col(key)]
    named, rest = df.where(F.col(bucket) != other), df.where(F.col(bucket) == other)
    parts = [first_k(d, [bucket], order, k).drop("__rank") if k > 0 else d for d, k in ((named, most), (rest, most_other))]
    out = parts[0].unionByName(parts[1])
    return out.orderBy(*order).limit(most_total) if most_total > 0 else out


def largest_remainder(n: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole quotas that add up to n: floors first, then one more for the largest remainder, of equals the later."""
    total = sum(weights.values())
    exact = {k: n * w / total for k, w in weights.items()}
    quota = {k: int(x) for k, x in exact.items()}
    places = {k: i for i, k in enumerate(weights)}
    for _ in range(n - sum(quota.values())):
        quota[max(exact, key=lambda k: (exact[k] - quota[k], places[k]))] += 1
    return quota


def match_length(pos: DataFrame, neg: DataFrame, quotas: dict[int, int], key: str, bin_chars: int = 20, seed: str = "42") -> DataFrame:
    """Positives and negatives (key, n_turns, chars) paired one to one inside a class of length: n_turns, bin, pick_no,
    pos_key, neg_key. Bins take turns until the quota of their number of turns is reached."""
    most = max(quotas.values(), default=0)

    def ranked(df: DataFrame, name: str) -> DataFrame:
        d = df.where(F.col("n_turns").isin(list(quotas))).select("n_turns", F.floor(F.col("chars") / bin_chars).alias("bin"), F.col(key).alias(name))
        return first_k(d, ["n_turns", "bin"], [seeded(seed, name), name], most, "pick_no")

    pairs = ranked(pos, "pos_key").join(ranked(neg, "neg_key"), ["n_turns", "bin", "pick_no"])
    quota = reduce(lambda out, kv: F.when(F.col("n_turns") == kv[0], kv[1]).otherwise(out), quotas.items(), F.lit(0))
    turn = first_k(pairs, ["n_turns"], ["pick_no", "bin"], most)
    return turn.where(F.col("__rank") <= quota).drop("__rank")


def top_up(pool: DataFrame, used: DataFrame, bins: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n unused rows of the pool (key, bin), those of the given bins first; fails if there are fewer."""
    free = pool.join(used.select(key).distinct(), key, "left_anti").join(bins.select("bin", F.lit(0).alias("__far")).distinct(), "bin", "left")
    got = free.orderBy(F.coalesce("__far", F.lit(1)), seeded(seed, key), key).limit(n).drop("__far")
    if got.count() < n:
        raise ValueError(f"fewer than {n} rows left")
    return got


def top_pool_then_sample(df: DataFrame, score: str, key: str, pool: int, n: int, seed: str = "42") -> DataFrame:
    """n rows, by seeded hash, of the `pool` rows with the highest score (of equals the smaller key)."""
    return df.orderBy(F.desc(score), key).limit(pool).orderBy(seeded(seed, key), key).limit(n)


def seeded_order(df: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """All rows with their place in a seeded shuffle, in parallel."""
    return global_rank(df, [seeded(seed, key), F.col(key)], "place")


def write_batches(df: DataFrame, order: list[Column], size: int = 20) -> DataFrame:
    """Adds batch_id: rows in the given order, `size` to a batch."""
    return global_rank(df, order, "__n").withColumn("batch_id", F.floor((F.col("__n") - 1) / size)).drop("__n")
