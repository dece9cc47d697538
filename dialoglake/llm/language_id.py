"""Operator 9, language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary naive-Bayes classifier over hashed byte bigrams and trigrams
tells the languages whose bit is 1 from the others. A text's margins are decoded by loss: each codeword pays, per bit,
the logistic loss of the margin in its direction, weighted by how well that bit's classifier does on the rows it was
fitted on; the cheapest codeword wins, and a small lead over the second flags ambiguity.

The classifiers are fitted on at most `max_rows_a_language` rows of each language (a documented bound), taken by a
hash of the id; their counts are summed by Spark. Of more than `max_languages` values of the language column (a documented
bound, for dirty columns) the most frequent are learned. Prediction reads every text whole.

Defined results: null texts and texts without a letter are `und` with score 0; if no row has a language to learn from,
all are; with a single learned language that is the prediction; repeated rows and repeated or null ids are rows of
their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import freeze, fresh, held_out

PLACES = 1 << 14


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # place x bit
    bias: np.ndarray  # per bit
    trust: np.ndarray  # per bit


def grams(text: str) -> np.ndarray:
    """Hashed places of the byte bigrams and trigrams of the lower-cased text between two blanks."""
    b = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    return np.concatenate([two * np.uint32(0x9E3779B1) >> np.uint32(18), three * np.uint32(0x85EBCA6B) >> np.uint32(18)])


def codewords(n: int) -> np.ndarray:
    """n codewords: the exhaustive code up to 5 languages, else the best of a few random codes by smallest distance."""
    if n <= 5:
        bits = max(1, (1 << (n - 1)) - 1)
        return np.array([[1 if (b + 1) >> k & 1 else -1 for b in range(bits)] for k in range(n - 1)] + [[-1] * bits], dtype=np.int8) if n > 1 else np.ones((1, 1), np.int8)
    bits = 6 * int(np.ceil(np.log2(n)))
    rng, best = np.random.default_rng(11), None
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), size=(n, bits))
        apart = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        if (np.abs(c.sum(0)) < n).all() and (best is None or apart > best[0]):
            best = (apart, c)
    return best[1]


def fit(docs: DataFrame, max_rows_a_language: int = 4_000, max_languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on rows with text and language outside the held-out fifth; None if there are none."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), (F.pmod(F.xxhash64(F.lit("language"), F.col(id_col).cast("long")), F.lit(1 << 20)) / float(1 << 20)).alias("draw")
    )
    count = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).select("lang", (F.lit(float(max_rows_a_language)) / F.col("count")).alias("share"))
    taken = rows.join(F.broadcast(freeze(count, "language-shares")), "lang").where("draw < share").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = np.bincount(grams(text), minlength=PLACES)
                sums[lang] = sums[lang] + g if lang in sums else g
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(s[at], pa.int64())], ["lang", "place", "n"])

    # At most languages x PLACES rows.
    got = taken.mapInArrow(run, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    names = got.column("lang").to_pylist()
    languages = sorted(set(names))
    seen = np.zeros((len(languages), PLACES))
    seen[[languages.index(x) for x in names], got.column("place").to_numpy()] = got.column("n").to_numpy()
    # Every language counts alike, however many rows it had.
    p = (seen + 0.5) / (seen + 0.5).sum(1, keepdims=True)
    codes = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, codes, np.zeros((PLACES, 1)), np.ones(1), np.ones(1))
    mean = lambda b, sign: p[codes[:, b] == sign].mean(0)
    weights = np.stack([np.log(mean(b, 1)) - np.log(mean(b, -1)) for b in range(codes.shape[1])], axis=1)
    # How far a gram of each language moves each bit in the right direction, on average: bits that tell more weigh more.
    pull = ((p @ weights) * codes).min(0).clip(1e-3)
    return Model(languages, codes, weights, np.zeros(codes.shape[1]), pull / pull.sum() * len(pull))


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins (text x bit) -> index of the language, score in 0..1, and whether the second is within a factor of 3."""
    loss = (np.logaddexp(0, -margins[:, None, :] * model.codes[None]) * model.trust).sum(2)
    chance = np.exp(loss.min(1, keepdims=True) - loss)
    chance /= chance.sum(1, keepdims=True)
    best = loss.argmin(1)
    top = np.sort(chance, axis=1)
    second = top[:, -2] if top.shape[1] > 1 else np.zeros(len(top))
    return best, top[:, -1], top[:, -1] < 3 * second


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row, and the row's other columns under their names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _predictor(docs, model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def _predictor(docs: DataFrame, model: Model | None, carried: list[str], text_col: str = "text"):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            langs, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), [False] * len(texts)
            spoken = [i for i, t in enumerate(texts) if m and t and any(map(str.isalpha, t))]
            if spoken:
                margins = np.empty((len(spoken), m.codes.shape[1]))
                for k, i in enumerate(spoken):
                    g = grams(texts[i])
                    if len(g) < 3000:
                        margins[k] = m.weights[g].sum(0) + m.bias
                    else:
                        margins[k] = np.bincount(g, minlength=PLACES) @ m.weights + m.bias
                best, score, ambiguous = decode(margins, m)
                for i, l, s, a in zip(spoken, best, score, ambiguous):
                    langs[i], scores[i], unsure[i] = m.languages[l], s, bool(a)
            kept = [b.column(b.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs), pa.array(scores), pa.array(unsure)], [*carried, "lang_pred", "score", "ambiguous"])

    return run


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, columns unchanged, whose text has a predicted language that is not ambiguous."""
    names, lang, score, unsure = docs.columns, *(fresh(docs, x) for x in ("lang_pred", "score", "ambiguous"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {lang} string, {score} double, {unsure} boolean"
    predictor = _predictor(docs, model, names, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in predictor(batches):
            yield b.rename_columns([*names, lang, score, unsure])

    return docs.mapInArrow(run, schema).where((F.col(lang) != "und") & ~F.col(unsure)).select(*(f"`{c}`" for c in names))
