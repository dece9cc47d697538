"""Attention-based quality classifier: gradients, streaming softmax, held-out accuracy and edge cases."""

import random
import zlib

import numpy as np

from dialoglake.llm import attention_quality as A


def bags(rng, n):
    return [rng.random((int(rng.integers(1, 5)), A.WIDTH)).astype(np.float32) for _ in range(n)]


def plain_loss(w, bag_list, y, weight):
    """Bag by bag and passage by passage, as the method is published."""
    total = 0.0
    for x, t, k in zip(bag_list, y, weight):
        h = [np.tanh(row @ w["encode"] + w["shift"]) for row in x.astype(float)]
        s = [w["gate"] @ (np.tanh(v @ w["v"]) / (1 + np.exp(-(v @ w["u"])))) for v in h]
        a = np.exp(s) / np.exp(s).sum()
        p = 1 / (1 + np.exp(-(sum(c * v for c, v in zip(a, h)) @ w["out"] + w["bias"][0])))
        total -= k * (np.log(p) if t else np.log(1 - p))
    return total / sum(weight)


def test_loss_and_gradients_against_a_plain_version():
    rng = np.random.default_rng(2)
    x, y, weight = bags(rng, 6), np.array([0, 1, 1, 0, 1, 0.0]), np.array([1, 2, 1, 0.5, 1, 1.0])
    net = A.Net({k: v.astype(float) + 0.1 for k, v in A.Net.fresh().w.items()})
    value, grads = net.loss(np.concatenate(x), np.array([len(b) for b in x]), y, weight)
    assert abs(value - plain_loss(net.w, x, y, weight)) < 1e-9
    for name, g in grads.items():
        flat = net.w[name].reshape(-1)
        for at in rng.integers(0, len(flat), 5):
            kept, ends = flat[at], []
            for step in (1e-5, -1e-5):
                flat[at] = kept + step
                ends.append(plain_loss(net.w, x, y, weight))
            flat[at] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - g.reshape(-1)[at]) < 1e-7, name


def test_score_in_parts_is_the_score_of_the_whole():
    rng = np.random.default_rng(3)
    net = A.Net({k: v + 0.2 for k, v in A.Net.fresh().w.items()})
    x = rng.random((300, A.WIDTH)).astype(np.float32) * 3
    whole = net.score(iter([x]))
    assert abs(whole - net.score(iter([x[:7], x[7:200], x[200:]]))) < 1e-6
    assert abs(-np.log(whole) - plain_loss(net.w, [x], [1], [1.0])) < 1e-4


def test_passages_of_a_text_do_not_depend_on_the_stretch():
    rng = random.Random(4)
    text = "  ".join("".join(rng.choices("abÉ1!|", k=rng.randint(1, 9))) for _ in range(2_000))
    one = np.concatenate(list(A.passages(text)))
    many = np.concatenate(list(A.passages(text, stretch=2_000)))
    assert one.shape == many.shape == (32, A.WIDTH) and np.abs(one - many).max() < 1e-6
    assert list(A.passages(None)) == list(A.passages("")) == list(A.passages(" \n ")) == []
    assert sum(len(x) for x in A.passages("x" * 5_000, stretch=1_000)) == 5


def prose(rng, n):
    return " ".join("".join(rng.choices(["the", "an", "er", "ing", "ou", "st", "re"], k=rng.randint(1, 3))) for _ in range(n))


def damaged(rng, n):
    kind = rng.randrange(3)
    words = prose(rng, n).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["###", "***", "%%%"]) for w in words)
    return " ".join(w for w in words[: n // 10] for _ in range(10))


def test_held_out_rows(spark):
    """Low documents are damaged in one stretch only, of one to three passages among up to eight."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1200):
        n, low = rng.randint(40, 500), rng.random() < 0.2
        text = prose(rng, n)
        if low:
            text = f"{prose(rng, n // 2)} {damaged(rng, rng.randint(64, 190))} {prose(rng, n // 2)}"
        rows.append((i, text, "x"))
        labels.append((i, int(not low)))
    extra = [(5000, None, "x"), (5001, "", "x"), (5002, prose(rng, 60_000), "x"), (None, "the", "x"), (5003, "!" * 3_000_000, "x"), (7, rows[7][1], "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string").repartition(4)
    labelled = spark.createDataFrame([*labels, (1, None), (None, 0)], "doc_id long, quality int")
    model = A.fit(docs, labelled)
    got = A.score(docs, model).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and np.mean([p == y for p, y in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score and by[5002].predicted == 1 and by[5003].predicted == 0
    none = A.score(docs, A.fit(docs, labelled.limit(0))).collect()
    assert {r.score for r in none} == {0.5} and A.score(docs.limit(0), model).collect() == []
    few = A.fit(docs, labelled, max_rows=200, max_passages=300)
    assert few is not None
    one_class = A.score(docs, A.fit(docs, labelled.where("quality = 1"), max_rows=100)).collect()
    assert all(0 <= r.score <= 1 for r in one_class)
