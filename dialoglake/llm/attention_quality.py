"""Operator 11, a quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Every passage is encoded: hashed trigrams of character classes, hashed words and
a few shares (repeated words, capitals, symbols and so on). A layer of tanh units makes a representation h of each, a
gated attention (w . (tanh(Vh) * sigmoid(Uh)), softmax over the text's passages) weighs them, and a logistic unit scores
the weighted sum. Only documents are labelled; which passages decide is learned, all weights together, by Adam.

The model is fitted in one task on at most `max_rows` labelled rows and `max_passages` passages (documented bounds): each
class gives up to half of the rows, in the order of a hash of the id, and weights bring the classes back to their shares,
so the score is a chance. A labelled text that alone has more passages than are left isn't learned from. Texts of the
sample are encoded in parallel and stored. Scoring reads every text whole, a stretch of characters at a time, with a
running softmax, so a text of any length needs bounded memory.

Defined results: null and empty texts, and texts of blanks, have no passage and score the bias alone; several labels of
a document count as the lowest, null labels don't count; of several texts of a labelled id that with the smallest hash is
learned; without labels every score is 0.5; repeated rows and repeated or null ids are rows of their own; a word
of more than 2^20 code points counts as several; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.llm.common import drop_frozen, freeze

PASSAGE_WORDS = 64
STRETCH = 1 << 20
SHAPES, WORDS, SHARES = 256, 128, 8
WIDTH = SHAPES + WORDS + SHARES
HIDDEN, GATES = 24, 12
_OWN = "!#*$%&|"


def _class_of(c: int) -> int:
    """0 blank, 1 line end, 2 letter, 3 capital, 4 digit, 5 common punctuation, 6 other, 7 letters without case, 8 and
    on the signs of _OWN."""
    ch = chr(c)
    if ch in "\n\r":
        return 1
    if ch.isspace():
        return 0
    if ch in _OWN:
        return 8 + _OWN.index(ch)
    kind = unicodedata.category(ch)
    if kind[0] == "L":
        return 3 if kind in ("Lu", "Lt") else 7 if kind == "Lo" else 2
    return 4 if kind[0] == "N" else 5 if ch in ".,;:'\"?()-" else 6


_CLASSES = np.array([_class_of(c) for c in range(0x3001)], np.uint8)
_CLASSES[-1] = 7  # for all beyond
_PLACE = ((np.arange(4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _shares(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))


def _encoded(cp: np.ndarray, kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Passage x WIDTH, of code points from the first word on, their classes and the places of the words' starts."""
    blank = kinds < 2
    word = np.zeros(len(cp), np.int64)
    word[starts[1:]] = 1
    word = np.cumsum(word)
    passage_of_word = np.arange(len(starts)) // PASSAGE_WORDS
    m = int(passage_of_word[-1]) + 1
    passage = passage_of_word[word]
    wide = kinds.astype(np.int64)
    three = wide[:-2] << 8 | wide[1:-1] << 4 | wide[2:]
    inside = passage[:-2] == passage[2:]
    shapes = np.bincount((passage[:-2] * SHAPES + _PLACE[three])[inside], minlength=m * SHAPES).reshape(m, SHAPES)
    low = np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint64)
    mixed = (low + (np.arange(len(cp)) - starts[word]).astype(np.uint64) * np.uint64(0x110000)) * _M1
    mixed = (mixed ^ mixed >> np.uint64(29)) * _M2
    mixed[blank] = 0
    h = np.add.reduceat(mixed, starts)
    h ^= h >> np.uint64(31)
    words = np.bincount(passage_of_word * WORDS + (h >> np.uint64(8) & np.uint64(WORDS - 1)).astype(np.int64), minlength=m * WORDS).reshape(m, WORDS)
    held = np.bincount(passage_of_word, minlength=m).astype(float)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (passage_of_word[1:] == passage_of_word[:-1])
    key = np.unique(passage_of_word.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))
    by_kind = np.bincount(passage * 16 + kinds, minlength=m * 16).reshape(m, 16)
    chars = np.maximum(1, by_kind[:, 2:].sum(1))
    shares = np.stack(
        [
            np.bincount(passage_of_word, again, minlength=m) / held,
            np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=m) / held,
            chars / held / 10,
            by_kind[:, 3] / chars,
            by_kind[:, 8:].sum(1) / chars,
            by_kind[:, 4] / chars,
            by_kind[:, 1] / held,
            held / PASSAGE_WORDS,
        ],
        axis=1,
    )
    return np.concatenate([_shares(shapes), _shares(words), shares], axis=1).astype(np.float32)


def passages(text: str | None, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """Encoded passages of a text, at most a stretch of its characters at a time."""
    text, at = text or "", 0
    while at < len(text):
        piece = text[at : at + stretch]
        cp = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _CLASSES[np.minimum(cp, len(_CLASSES) - 1)]
        solid = kinds >= 2
        starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
        end, last = len(piece), at + len(piece) >= len(text)
        if not last and len(starts) > PASSAGE_WORDS:
            # Whole passages only; the rest is read again with what follows.
            whole = (len(starts) - 1) // PASSAGE_WORDS * PASSAGE_WORDS
            end, starts = int(starts[whole]), starts[:whole]
        if len(starts):
            first = int(starts[0])
            yield _encoded(cp[first:end], kinds[first:end], starts - first)
        at += end


class Net:
    """Weights by name; see the module's text for what they do."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w

    @staticmethod
    def fresh() -> Net:
        rng = np.random.default_rng(5)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return Net({"encode": draw(WIDTH, HIDDEN), "shift": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATES), "u": draw(HIDDEN, GATES), "gate": draw(GATES), "out": draw(HIDDEN), "bias": np.zeros(1, np.float32)})

    def seen(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Representations, the two gates and the attention before the softmax."""
        h = np.tanh(x @ self.w["encode"] + self.w["shift"])
        t, g = np.tanh(h @ self.w["v"]), 1 / (1 + np.exp(-(h @ self.w["u"])))
        return h, t, g, (t * g) @ self.w["gate"]

    def score(self, parts: Iterator[np.ndarray]) -> float:
        """Of one text: a softmax over all its passages, kept up from part to part."""
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in parts:
            h, _, _, s = self.seen(x)
            new = max(top, float(s.max()))
            a = np.exp(s - new)
            shrink = np.exp(top - new)
            top, total, z = new, total * shrink + a.sum(), z * shrink + a @ h
        o = (z / total if total else z) @ self.w["out"] + self.w["bias"][0]
        return float(1 / (1 + np.exp(-np.clip(o, -30, 30))))

    def loss(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean log loss of bags (their passages one after the other, at least one each) and its gradients."""
        w = self.w
        at, bag = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(sizes)), sizes)
        h, t, g, s = self.seen(x)
        a = np.exp(s - np.maximum.reduceat(s, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at)
        p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["bias"][0], -30, 30)))
        total = weight.sum()
        value = -(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / total
        do = weight * (p - y) / total
        dz = (do[:, None] * w["out"])[bag]
        da = (h * dz).sum(1)
        ds = a * (da - np.add.reduceat(a * da, at)[bag])
        dgate = ds[:, None] * w["gate"]
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
        return float(value), {"encode": x.T @ dh, "shift": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "gate": (t * g).T @ ds, "out": z.T @ do, "bias": np.array([do.sum()])}


def fit_net(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 16, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> Net:
    net, rng = Net.fresh(), np.random.default_rng(11)
    one = {k: np.zeros_like(v) for k, v in net.w.items()}
    two = {k: np.zeros_like(v) for k, v in net.w.items()}
    step, steps = 0, epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), batch):
            take, step = order[at : at + batch], step + 1
            _, grads = net.loss(np.concatenate([bags[i] for i in take]), np.array([len(bags[i]) for i in take]), y[take], weight[take])
            for k, g in grads.items():
                g = g + decay * net.w[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                move = rate * (1 - step / (steps + 1)) * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
                net.w[k] = (net.w[k] - move).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id hashes as the empty text (crc32 0), so it isn't held out, but it
    has no label either."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, max_passages: int = 80_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Net | None:
    """Fits on labelled rows that aren't held out; None if there are none."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.min(label_col) > 0).cast("int").alias("y"))
    per_class = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not per_class:
        return None
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    share = lambda y: int((1 << 30) * min(1.0, max_rows / 2 / max(1, per_class.get(y, 0))))
    taken = known.withColumn("draw", draw).where(F.col("draw") < F.when(F.col("y") == 1, share(1)).otherwise(share(0)))
    taken = freeze(taken, "quality-ids")  # about max_rows ids at most, so they may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "y", "draw").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, y, draw, t in zip(*(c.to_pylist() for c in b.columns)):
                size, kept = 0, []
                for x in passages(t):
                    size += len(x)
                    kept = [*kept, x] if size <= max_passages else []
                flat = np.concatenate(kept).ravel() if kept else np.empty(0, np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([draw], pa.int64()), pa.array([size], pa.int64()), pa.array([flat], pa.list_(pa.float32()))], ["doc_id", "y", "draw", "size", "x"])

    sample = freeze(one.select("doc_id", "y", "draw", "t.text").mapInArrow(encode, "doc_id long, y int, draw long, size long, x array<float>"), "quality-sample")
    # The sample has a bound, so a running sum over it may be made in one task.
    so_far = F.sum("size").over(Window.orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fitting = sample.where((F.col("size") > 0) & (F.col("size") <= max_passages)).select("doc_id", "size", so_far.alias("so_far")).where(F.col("so_far") <= max_passages).select("doc_id")
    names = list(Net.fresh().w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, y, x.values.to_numpy().reshape(-1, WIDTH)) for b in batches for i, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
        if rows:
            rows.sort(key=lambda r: r[0])
            y = np.array([r[1] for r in rows], float)
            all_labels = sum(per_class.values())
            weight = np.array([per_class[int(k)] / all_labels / np.mean(y == k) for k in y])
            net = fit_net([r[2] for r in rows], y, weight)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([net.w[k].ravel().tolist() for k in names], pa.list_(pa.float32()))], ["name", "weights"])

    got = sample.join(F.broadcast(fitting), "doc_id").select("doc_id", "y", "x").coalesce(1).mapInArrow(run, "name string, weights array<float>").toArrow()
    drop_frozen(taken, sample)
    if not got.num_rows:
        return None
    shapes = {k: v.shape for k, v in Net.fresh().w.items()}
    return Net({k: np.array(v, np.float32).reshape(shapes[k]) for k, v in zip(got.column("name").to_pylist(), got.column("weights").to_pylist())})


def score(docs: DataFrame, model: Net | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            s = np.array([0.5 if net is None else net.score(passages(t)) for t in b.column(2).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
