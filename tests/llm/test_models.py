"""Toxicity and language ID: held-out accuracy and edge cases."""

import random

import numpy as np

from dialoglake.llm import language_id as L
from dialoglake.llm import toxicity as T
from dialoglake.llm.common import held_out


def prose(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def test_held_out_is_crc32_modulo_5(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(__import__("pyspark").sql.functions.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_toxicity_finds_marked_words(spark):
    rng = random.Random(3)
    syl = ["the", "an", "er", "ing", "ou", "st", "re"]
    rows, labels = [], []
    for i in range(1500):
        words = prose(rng, syl, 60).split()
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(60)] = rng.choice(["vile", "rotten", "filthy"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "vile", "x"), (5002, "vile rotten filthy " * 3000, "x"), (5002, "calm", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(labels + [(1, None), (2, None)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert len(model[0]) < 5000
    got = T.score(docs, model).collect()
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.97
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(not r.predicted for r in got if r.doc_id in (5000, 5001))
    none = T.score(docs, T.fit(docs, labels.limit(0))).collect()
    assert len(none) == len(rows) and not any(r.predicted for r in none)


def test_ftrl_against_a_plain_version():
    """Coordinate by coordinate, with dictionaries, as the method is published."""
    rng = random.Random(6)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randint(0, 8))), np.int32), rng.randint(0, 1)) for _ in range(60)]
    alpha, beta, l1, l2, epochs = 0.7, 1.0, 0.3, 0.1, 3
    got = T.fit_ftrl(rows, epochs, alpha, beta, l1, l2)
    z, n, order = {}, {}, np.random.default_rng(7)

    def weight(i, thinned):
        if abs(z.get(i, 0.0)) <= thinned:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * thinned) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            places, y = rows[k]
            used = [(int(i), weight(int(i), l1)) for i in places] + [("bias", weight("bias", 0.0))]
            g = 1 / (1 + np.exp(-sum(w for _, w in used))) - y
            for i, w in used:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before**0.5) / alpha * w
    want = {i: weight(i, l1) for i in z if i != "bias" and weight(i, l1)}
    assert dict(zip(got[0].tolist(), got[1].tolist())).keys() == want.keys()
    assert all(abs(w - want[i]) < 1e-6 for i, w in zip(got[0].tolist(), got[1].tolist()))
    assert abs(got[2] - weight("bias", 0.0)) < 1e-9


def test_codewords_are_apart():
    for n in (2, 3, 5, 6, 17):
        c = L.codewords(n)
        assert c.shape[0] == n and len({tuple(x) for x in c.tolist()}) == n
        assert all(set(c[:, b].tolist()) == {-1, 1} for b in range(c.shape[1]))


def test_language_id_on_held_out_rows(spark):
    rng = random.Random(4)
    kinds = {"en": ["the", "ing", "and", "th"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "é", "que", "ou"], "es": ["ción", "ñ", "los", "que"], "it": ["gli", "zione", "che", "ò"], "pl": ["szcz", "ów", "nie", "ł"]}
    rows = [(i, prose(rng, kinds[k], rng.randint(3, 80)), k, "x") for i, k in enumerate(rng.choices(list(kinds), k=900))]
    extra = [(5000, None, "en", "x"), (5001, "12 34 !?", "en", "x"), (5002, "the and thing", None, "x"), (None, "eau que", "fr", "x"), (5003, "the ing " * 9000, "en", "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")
    model = L.fit(docs)
    got = L.predict(docs, model).collect()
    truth = {i: k for i, _, k, _ in rows}
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5000].lang_pred == by[5001].lang_pred == "und" and by[5000].score == 0
    assert by[5002].lang_pred == by[5003].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {5000, 5001} & {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in L.predict(docs, L.fit(docs.limit(0))).collect()} == {"und"}
    assert L.predict(docs.limit(0), model).collect() == []
    one = L.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in L.predict(docs.where("doc_id < 50"), one).collect()} == {"de"}


def test_sample_of_very_long_texts_is_thinned(spark):
    sample = spark.range(2_000).selectExpr("id as doc_id", "sequence(1, 500) as places")
    kept = T.thinned(sample, 250_000).selectExpr("sum(size(places))").first()[0]
    assert 200_000 < kept < 300_000
    assert T.thinned(sample, 1_000_000).count() == 2_000
    assert T.thinned(sample.limit(0), 10).count() == 0
