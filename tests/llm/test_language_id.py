import math
import random
import zlib

import numpy as np

from dialoglake.llm import language_id as G


def plain_grams(text):
    b = b" " + text.lower().encode() + b" "
    two = [(b[i] << 8 | b[i + 1]) * 0x9E3779B1 % 2**32 >> 18 for i in range(len(b) - 1)]
    three = [((b[i] << 8 | b[i + 1]) << 8 | b[i + 2]) * 0x85EBCA6B % 2**32 >> 18 for i in range(len(b) - 2)]
    return two + three


def corpus():
    rng = random.Random(3)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "fghij", "dd": "üñçéa"}
    rows = []
    for i in range(120):
        lang = rng.choice(list(letters))
        rows.append((i, " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 6))) for _ in range(rng.randint(1, 30))), lang))
    return rows + [(200, "x y", None), (201, None, "aa"), (202, "", "bb"), (None, "zzz", "cc")]


def plain_fit(rows):
    languages = sorted({lang for i, t, lang in rows if learned(i, t, lang)})
    seen = {lang: [0.5] * G.PLACES for lang in languages}
    for i, t, lang in rows:
        if learned(i, t, lang):
            for g in plain_grams(t):
                seen[lang][g] += 1
    p = {lang: [x / sum(s) for x in s] for lang, s in seen.items()}
    return languages, p


def learned(i, text, lang):
    return i is not None and text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5 != 0


def test_fit_and_decode_against_plain_versions(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = G.fit(docs)
    languages, p = plain_fit(rows)
    assert model.languages == languages == ["aa", "bb", "cc", "dd"]
    bits = model.codes.shape[1]
    weights = np.zeros((G.PLACES, bits))
    for b in range(bits):
        ones, others = ([p[lang] for lang, c in zip(languages, model.codes) if c[b] == s] for s in (1, -1))
        for g in range(G.PLACES):
            weights[g, b] = math.log(sum(x[g] for x in ones) / len(ones)) - math.log(sum(x[g] for x in others) / len(others))
    assert np.allclose(model.weights, weights, atol=1e-9)
    pull = [min(sum(x * weights[g, b] for g, x in enumerate(p[lang])) * c[b] for lang, c in zip(languages, model.codes)) for b in range(bits)]
    trust = [max(x, 1e-3) for x in pull]
    assert np.allclose(model.trust, [x / sum(trust) * bits for x in trust])

    got = {r.doc_id: r for r in G.predict(docs, model).collect()}
    for i, text, _ in rows:
        if not text:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        margin = [sum(weights[g, b] for g in plain_grams(text)) for b in range(bits)]
        loss = {lang: sum(t * math.log1p(math.exp(-m * c)) if m * c > -30 else t * -m * c for m, c, t in zip(margin, code, model.trust)) for lang, code in zip(languages, model.codes.tolist())}
        low = min(loss.values())
        chance = {lang: math.exp(low - x) for lang, x in loss.items()}
        best = min(loss, key=loss.get)
        first, second = sorted(chance.values())[::-1][:2]
        assert got[i].lang_pred == best
        assert abs(got[i].score - first / sum(chance.values())) < 1e-6
        assert got[i].ambiguous == (first < 3 * second)
