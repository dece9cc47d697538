"""Operator 13, embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

A holds one centred vector a row. The method takes turns between p = Av - beta u (one number a row) and
r = A'u - alpha v (one number a dimension); the alphas and betas are a small bidiagonal matrix whose singular vectors
turn the v into the principal components. Both products of a step are made in one pass over the rows, as sums of what
each task has read, combined by Spark.

No vector as long as the table is stored: every left vector is u = Aw for a w of a few numbers that the driver keeps, so
a task makes its rows' part of all u anew, takes the new p against them (full reorthogonalisation, repeated if what it
takes away isn't small) and returns sums alone. The v are reorthogonalised on the driver. If a step leaves nothing, it
goes on from a new start vector at right angles to all before, so repeated and zero eigenvalues are found as well. All
dimensions are gone through up to 512; beyond that it ends when the wanted components have converged.

Entries become whole numbers, x = floor(scale * c) + shift, so sums and deviations are exact.

Defined results: rows whose vector is null or holds a null, a NaN, an infinity or an entry of 2^52 / scale or more (which
has no exact whole number) are left out; so are vectors of another length than the most frequent (ties: the longest).
Components whose eigenvalue is not above 1e-13 of the largest are numerically zero and not returned, so equal vectors
alone, or empty vectors, give no rows, as does an empty table. Repeated rows and repeated or null ids are rows of their
own. Where a deviation does not fit a long it is null. Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import freeze

#: Dimensions up to which every step is made, without a test of convergence.
FULL = 512


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # per dimension
    components: np.ndarray  # dimension x component, unit columns
    eigenvalues: np.ndarray
    explained: np.ndarray


def whole_numbers(table: DataFrame, scale: int, shift: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, x array<long>) of the rows that remain."""
    c = F.col(vec_col).cast("array<double>")
    sound = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(2**52 // scale)))
    x = F.transform(c, lambda v: F.floor(v * scale).cast("long") + F.lit(shift).cast("long"))
    rows = freeze(table.where(sound).select(F.col(id_col).cast("long").alias("id"), x.alias("x")), "whitening-vectors")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (usual[0]["d"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean, as double: the mean's whole part is taken away first, as whole numbers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * w) / n for s, w in zip(sums, whole.tolist())])
    return (x - whole) - rest


def _summed(rows: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> dict[int, float]:
    """The sums over all rows of what of_batch makes of each batch: a vector of the same length for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = of_batch(_matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    got = rows.select("x").mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))
    return {r["place"]: r["value"] for r in got.collect()}


def _vector(sums: dict[int, float]) -> np.ndarray:
    return np.array([sums[k] for k in range(len(sums))])


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum per dimension (high and low parts are added apart, so nothing overflows)."""
    low = (1 << 24) - 1
    got = _summed(rows, lambda x: np.concatenate([[len(x)], (x & low).sum(0), (x >> 24).sum(0)]).astype(np.int64), "long")
    d = (len(got) - 1) // 2
    return got.get(0, 0), [got[1 + k] + (got[1 + d + k] << 24) for k in range(d)]


def bidiagonalise(d: int, product: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors v (columns) and the upper bidiagonal matrix B with AV = UB.

    product(q, w) gives, for p = Aq: its squared length, the products of p with every column of Aw, and A'p.
    """
    rng = np.random.default_rng(13)

    def start(v: np.ndarray) -> np.ndarray:
        x = rng.standard_normal(d)
        for _ in range(3):
            x -= v @ (v.T @ x)
            x /= np.linalg.norm(x)
        return x

    v, w, back = start(np.zeros((d, 0)))[:, None], np.zeros((d, 0)), np.zeros((d, 0))
    alphas, betas, largest = [], [], 0.0
    while True:
        j = len(alphas)
        q = v[:, j] - (betas[-1] * w[:, -1] if j else 0.0)
        for _ in range(4):
            squared, c, z = product(q, w)
            q, z, left = q - w @ c, z - back @ c, squared - c @ c
            if c @ c <= 1e-14 * squared:
                break
        alpha = np.sqrt(max(0.0, left))
        largest = max(largest, alpha)
        if alpha <= 1e-9 * largest:
            alpha, q, z = 0.0, np.zeros(d), np.zeros(d)
        alphas.append(alpha)
        w = np.column_stack([w, q / alpha if alpha else q])
        back = np.column_stack([back, z / alpha if alpha else z])
        if len(alphas) == d:
            break
        r = back[:, -1] - alpha * v[:, j] if alpha else np.zeros(d)
        for _ in range(2):
            r -= v @ (v.T @ r)
        beta = np.linalg.norm(r)
        if d > FULL and len(alphas) > wanted:
            left_vectors, s, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            if (beta * np.abs(left_vectors[-1, :wanted]) <= 1e-15 * s[0]).all():
                break
        new = beta > 1e-9 * largest
        betas.append(beta if new else 0.0)
        v = np.column_stack([v, r / beta if new else start(v)])
    return v, np.diag(alphas) + np.diag(betas, 1)


def fit(rows: DataFrame, most: int) -> Whitening:
    """rows: (x array<long>), all of one length."""
    n, sums = column_sums(rows)
    d = len(sums)
    if not d:
        return Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros(0))

    def product(q: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def of_batch(x: np.ndarray) -> np.ndarray:
            a = _centred(x, n, sums)
            p = a @ q
            return np.concatenate([[p @ p], (a @ w).T @ p, a.T @ p])

        got = _vector(_summed(rows, of_batch))
        return got[0], got[1 : 1 + w.shape[1]], got[1 + w.shape[1] :]

    spread = _vector(_summed(rows, lambda x: (_centred(x, n, sums) ** 2).sum(0))).sum()
    if spread <= 0:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    v, b = bidiagonalise(d, product, min(d, most))
    _, s, turned = np.linalg.svd(b)
    e = s**2 / n
    live = np.flatnonzero(e > 1e-13 * e[0])[:most]
    return Whitening(n, sums, v @ turned.T[:, live], e[live], e[live] * n / spread)


def _whitener(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    turn = model.components / np.sqrt(model.eigenvalues)
    return lambda x: _centred(x, model.n, model.sums) @ turn


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - sum)^2, exactly; None where it doesn't fit a long."""
    whole = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole)]
    y = x - np.array(whole, np.int64)
    if float(np.abs(y).max(initial=0) + 1) ** 2 * float(n) ** 2 * len(sums) < 2.0**62:
        return ((n * y - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest)) for row in y.tolist()]
    return [z if z < 2**63 else None for z in exact]


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity."""
    k, whiten = len(model.eigenvalues), _whitener(model)

    def of_batch(x: np.ndarray) -> np.ndarray:
        w = whiten(x)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    got = _vector(_summed(rows, of_batch)) / model.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def whiten(table: DataFrame, most: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component, up to `most` components by falling eigenvalue: vec_id, component (from
    1), n, deviation, whitened, explained (share of the whole variance), identity_error (one value)."""
    rows = whole_numbers(table, scale, shift, id_col, vec_col)
    model = fit(rows, most)
    k = len(model.eigenvalues)
    error = identity_error(rows, model) if k else 0.0
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        turned = _whitener(m)
        for b in batches:
            if b.num_rows and k:
                x = _matrix(b.column(1))
                parts = pa.FixedSizeListArray.from_arrays(pa.array(turned(x).ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_deviations(x, m.n, m.sums), pa.int64()), parts], ["vec_id", "deviation", "parts"])

    done = rows.select("id", "x").mapInArrow(run, "vec_id long, deviation long, parts array<double>")
    shares = F.array(*(F.lit(float(s)) for s in model.explained)).cast("array<double>")
    each = done.select("vec_id", "deviation", F.posexplode("parts").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
