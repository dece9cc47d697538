import collections
import random
import re

from dialoglake.llm import quality_rules as Q

SPACE = r"[\x20\x09-\x0D]+"


def brute(t):
    t = t or ""
    words = [w for w in re.split(SPACE, t) if w]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if [w for w in re.split(SPACE, line) if w]:
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(marked)


def test_counts_against_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a a a a", "x\nx\n x\nx", "é ñ\x85ü　y #*$%&|<>", "a b c\r\na b c\r\n"]
    texts += ["".join(rng.choices(["a ", "b ", "c\n", "\n", "#", "d\t"], k=rng.randint(1, 120))) for _ in range(200)]
    for t in texts:
        assert Q.text_counts(t)[:5] == brute(t), t


def test_binomial_tail():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (40, 0, 0.01), (7, 7, 0.5), (60, 5, 0.05)):
        assert abs(Q.binomial_tail(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def documents(spark, n=6000):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = ["w%d" % rng.randint(0, 5000) for _ in range(80)]
        if bad:
            words = [w + "%%" for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), "x"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(None, None, None, "x"), (n, "short", "en", "x"), (n, "short", "en", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_remove_bad_and_keep_the_promised_share_of_good(spark):
    docs, labels = documents(spark)
    got = Q.apply_rules(docs, labels).collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(got) == docs.count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    rest = [r for r in got if not r.base_failed]
    lost = sum(not r.kept for r in rest if r.doc_id in good) / len(good)
    removed = sum(not r.kept for r in rest if r.doc_id not in good) / max(1, sum(r.doc_id not in good for r in rest))
    assert lost <= 0.05 and removed > 0.9


def test_without_labels_only_base_rules(spark):
    docs, labels = documents(spark, 60)
    got = Q.apply_rules(docs, labels.limit(0)).collect()
    assert len(got) == 63 and all(r.kept != r.base_failed for r in got)
    assert Q.apply_rules(docs.limit(0), labels).collect() == []


def test_binomial_tail_of_many_rows():
    from fractions import Fraction
    from math import comb

    for n in (1, 7, 60, 200):
        for p in (0.01, 0.05, 0.5):
            for k in range(0, n, max(1, n // 9)):
                want = float(sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
                assert abs(Q.binomial_tail(k, n, p) - want) <= 1e-9 * max(want, 1e-12) + 1e-300
    assert Q.binomial_tail(9_800_000, 10**9, 0.01) < 1e-12 < 0.999 < Q.binomial_tail(10_200_000, 10**9, 0.01)
