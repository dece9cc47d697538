"""Operator 6, toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, pairs of neighbouring words and pairs with one word between, hashed to 2^22
places. FTRL-proximal keeps a learning rate per coordinate and, by its L1 term, leaves most weights at zero, so the
model is a short list of places and weights that is broadcast to score all documents.

The model is fitted in one task on at most about `max_rows` labelled rows (a documented bound): labelled rows are
taken by a hash of their id, each class up to half of the bound, and thinned by another hash where their texts are so
long that they have more than about `max_places` features together. The sampled ids are broadcast to the documents, so
only the texts of the sample leave the tasks that read them; their features are made in parallel and stored, and the
fitting task reads those alone. Scoring reads every text whole.

Defined results: null and empty texts score the bias alone; several labels of a document count as the highest, null
labels don't count; of several texts of a labelled id that with the smallest hash is learned; without labels every score is 0.5 less a hair (no evidence, predicted 0); repeated rows and
repeated or null ids are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import drop_frozen, freeze, held_out

PLACES = 1 << 22
_WORD = re.compile(r"\w+")
_CACHE_WORDS = 500_000
_hash_of: dict[str, int] = {}
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_TO_PLACE = np.uint64(64 - 22)


def features(text: str | None) -> np.ndarray:
    """Places of the distinct words, neighbour pairs and skip pairs of a text, ascending."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int32)
    if len(_hash_of) > _CACHE_WORDS:
        _hash_of.clear()
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        x = _hash_of.get(w)
        if x is None:
            raw = w.encode()
            x = _hash_of[w] = zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)
        h[i] = x
    parts = [h * _A, (h[:-1] * _A + h[1:]) * _B, (h[:-2] * _B + h[2:]) * _C]
    return np.unique((np.concatenate(parts) >> _TO_PLACE).astype(np.int32))


def fit_ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = 8, alpha: float = 3.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and weights that are not zero, and the bias (which carries no L1 term)."""
    z, n = np.zeros(PLACES), np.zeros(PLACES)
    bz = bn = 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            idx, y = rows[i]
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            bias = -bz / ((beta + bn**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            grown = np.sqrt(ni + g * g)
            z[idx] = zi + g - (grown - root) / alpha * w
            n[idx] = ni + g * g
            step = ((bn + g * g) ** 0.5 - bn**0.5) / alpha
            bz, bn = bz + g - step * bias, bn + g * g
    live = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[live]) * l1 - z[live]) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return live, w.astype(np.float32), float(-bz / ((beta + bn**0.5) / alpha + l2))


def thinned(sample: DataFrame, max_places: int) -> DataFrame:
    """All rows (doc_id, places), or by a hash of the id as many as have about max_places places together."""
    size = sample.agg(F.sum(F.size("places"))).first()[0] or 0
    draw = F.pmod(F.xxhash64(F.lit("toxicity-places"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return sample.where(draw < max_places / size) if size > max_places else sample


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 24_000, max_places: int = 60_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on labelled rows outside the held-out fifth; see fit_ftrl for the result."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    per_class = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not per_class:
        return np.empty(0, np.int64), np.empty(0, np.float32), -1e-9
    share = lambda y: min(1.0, max_rows / 2 / max(1, per_class.get(y, 0)))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    taken = known.where(draw < F.when(F.col("y") == 1, share(1)).otherwise(share(0)))
    # At most about max_rows ids, so they may be broadcast.
    taken = freeze(taken, "toxicity-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "y", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            places = b.column(2)
            flat, ends = places.flatten().to_numpy(), np.cumsum(places.value_lengths().to_numpy())
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), np.split(flat, ends[:-1]))
        rows.sort(key=lambda r: r[:2])
        if rows:
            idx, w, bias = fit_ftrl([(f, y) for _, y, f in rows])
            idx, w = np.append(idx, -1), np.append(w, bias)
            yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.array(w, pa.float64())], ["place", "weight"])

    sample = freeze(one.select("doc_id", "y", "t.text").mapInArrow(measure, "doc_id long, y int, places array<int>"), "toxicity-sample")
    model = thinned(sample, max_places).coalesce(1).mapInArrow(run, "place long, weight double").toArrow()
    drop_frozen(taken, sample)
    idx, w = model.column("place").to_numpy(), model.column("weight").to_numpy()
    if not len(idx):
        return np.empty(0, np.int64), np.empty(0, np.float32), -1e-9
    return idx[idx >= 0], w[idx >= 0].astype(np.float32), float(w[idx < 0][0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, w, bias = shared.value
        table = np.zeros(PLACES, np.float32)
        table[idx] = w
        for b in batches:
            margins = np.array([table[features(t)].sum() + bias for t in b.column(2).to_pylist()], dtype=np.float64)
            s = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
