import random

import pytest

from dialoglake.llm import mixing as M


def test_rates_match_targets(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(500):
        p = [rng.random() ** 3 for _ in range(3)]
        rows.append((rng.randint(0, 400), *(x / sum(p) for x in p)))
    df = spark.createDataFrame(rows, "n_tokens long, p0 double, p1 double, p2 double")
    mass = [sum(r[0] * r[1 + k] for r in rows) for k in range(3)]
    for factors in ((1, 1, 1), (1.3, 0.7, 0.9), (1.0, 0.6, 1.2)):
        targets = [m * f for m, f in zip(mass, factors)]
        rated, miss = M.fit_rates(df, targets, rounds=200)
        got = rated.collect()
        assert miss <= 1e-4
        assert all(r.rate >= 0 for r in got)
        for k in range(3):
            assert sum(r.rate * r.n_tokens * r[f"p{k}"] for r in got) == pytest.approx(targets[k], rel=2e-3)


def test_rates_of_a_dropped_domain_reach_zero(spark):
    df = spark.createDataFrame([(10, 1.0, 0.0)] * 5 + [(10, 0.0, 1.0)] * 5, "n_tokens long, p0 double, p1 double")
    got = M.fit_rates(df, [100.0, 0.0])[0].collect()
    assert [round(r.rate, 3) for r in got] == [2.0] * 5 + [0.0] * 5


def test_mix_learns_the_labelled_table(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        rows.append((i, " ".join(rng.choice(["spam!!", "click", "buy"] if bad and rng.random() < 0.4 else ["w%d" % k for k in range(200)]) for _ in range(50)), "x"))
        labels.append((i, "bad" if bad else "good"))
    rows += [(None, None, "x"), (9999, "", "x"), (9999, "spam!! " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    labelled = spark.createDataFrame(labels[:400] + [(3, None)], "doc_id long, domain string")
    got = M.mix(docs, labelled, {"good": 0.9, "bad": 0.1}, anchor="good").collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    right = [(r.p_bad > 0.5) == (truth[r.doc_id] == "bad") for r in got if r.doc_id in truth]
    assert sum(right) > 0.95 * len(right)
    total = sum(r.rate * r.n_tokens for r in got)
    assert sum(r.rate * r.n_tokens * r.p_good for r in got) == pytest.approx(0.9 * total, rel=5e-3)
    assert all(abs(r.copies - r.rate) < 1 for r in got)
    assert M.mix(docs.limit(0), labelled, {"good": 0.9, "bad": 0.1}, anchor="good").collect() == []
    assert len(M.mix(docs, labelled.limit(0), {"good": 0.9, "bad": 0.1}, anchor="good").collect()) == len(rows)


def test_a_missed_target_is_told(spark):
    df = spark.createDataFrame([(10, 0.5, 0.5)] * 5, "n_tokens long, p0 double, p1 double")
    assert M.fit_rates(df, [50.0, 0.0])[1] > 0.2


def test_rates_against_plain_projected_gradient(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 300), (p := rng.random()), 1 - p) for _ in range(200)]
    rated = M.fit_rates(spark.createDataFrame(rows, "n_tokens long, p0 double, p1 double"), [20_000.0, 4_000.0], rounds=25, tolerance=0.0)[0]
    got = sorted((r.n_tokens, r.p0, r.rate) for r in rated.collect())
    mass = [sum(n * p[k] for n, *p in rows) for k in range(2)]
    rates = [1.0] * len(rows)
    for _ in range(25):
        miss = [sum(r * n * p[k] for r, (n, *p) in zip(rates, rows)) - t for k, t in enumerate((20_000, 4_000))]
        rates = [max(0.0, r - sum(p[k] * miss[k] / mass[k] for k in range(2))) for r, (_, *p) in zip(rates, rows)]
    want = sorted((n, p, r) for r, (n, p, _) in zip(rates, rows))
    assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want))


def test_posteriors_against_plain_naive_bayes(spark):
    from math import exp, log

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "d"], [1, 1 + 5 * (i % 2), 1, 1], k=30))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(60)], "doc_id long, domain string")
    table, prior = M.learn_table(docs, labelled, ["odd", "even"], min_rows=1, min_apart=-1.0)
    got = {r.doc_id: r.p0 for r in M.posteriors(docs, table, prior).collect()}

    def marks(t):
        w = t.split()
        return {*w, f"distinct-share:{10 * len(set(w)) // len(w)}"}

    seen = [marks(t) for _, t in rows]
    share = {m: [sum(m in seen[i] for i in range(60) if i % 2 == k) for k in (1, 0)] for m in set().union(*seen)}
    for i, t in rows:
        logit = [log(31 / 62)] * 2
        for m in seen[i]:
            n = share[m]
            if sum(n):
                for k in range(2):
                    logit[k] += log((n[k] + 0.25) / 30.5 + 1e-6) - log((sum(n) + 0.5) / 60.5 + 1e-6)
        assert abs(got[i] - 1 / (1 + exp(logit[1] - logit[0]))) < 1e-9


def test_resample_repeats_rows_of_any_id(spark):
    rows = [(i, "good words here", "x") for i in range(50)] + [(None, f"null id {k}", "y") for k in range(50)] + [(7, "good words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies string")
    labelled = spark.createDataFrame([(i, "good") for i in range(50)], "doc_id long, domain string")
    got = M.resample(docs, labelled, {"good": 1.0}, anchor="good", anchor_rate=2.0)
    assert got.columns == docs.columns and got.count() == 2 * len(rows)
    assert M.resample(docs.limit(0), labelled, {"good": 1.0}, anchor="good").collect() == []


def test_calibration_against_plain_gradient_descent(spark):
    from math import asinh, exp, log

    rng = random.Random(11)
    rows = []
    for _ in range(300):
        k = rng.choice((0, 0, 1))
        rows.append(("ab"[k], *(sinh_tenth(rng, 1.0 if i == k else -0.5) for i in range(2))))
    prior = [log(2 / 3), log(1 / 3)]
    got = M.calibrate(spark.createDataFrame(rows, "domain string, s0 double, s1 double"), ["a", "b"], prior)
    x = [(asinh(a), asinh(b), 1.0) for _, a, b in rows]
    start = [[1.0, 0.0, prior[0]], [0.0, 1.0, prior[1]]]
    theta = [list(r) for r in start]
    for _ in range(3000):
        slope = [[0.1 * (theta[k][j] - start[k][j]) for j in range(3)] for k in range(2)]
        for (d, *_), v in zip(rows, x):
            z = [sum(t * u for t, u in zip(theta[k], v)) for k in range(2)]
            p1 = 1 / (1 + exp(z[0] - z[1]))
            for k, p in enumerate((1 - p1, p1)):
                for j in range(3):
                    slope[k][j] += (p - (d == "ab"[k])) * v[j]
        theta = [[theta[k][j] - 0.004 * slope[k][j] for j in range(3)] for k in range(2)]
    assert all(abs(got[k][j] - theta[k][j]) < 1e-3 for k in range(2) for j in range(3))
    assert M.calibrate(spark.createDataFrame([], "domain string, s0 double, s1 double"), ["a", "b"], prior) == start


def sinh_tenth(rng, centre):
    """A score whose asinh is a whole number of tenths, so that nothing is rounded away."""
    from math import sinh

    return sinh(round(rng.gauss(centre, 1.0), 1))


def test_posteriors_hold_on_rows_set_apart(spark):
    """Words of a language go together: one language is a little commoner among bad documents, none of it is evidence."""
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(3000):
        bad = rng.random() < 0.2
        tongue = "x" if rng.random() < (0.5 if bad else 0.35) else "y"
        words = [f"{tongue}{rng.randint(0, 120)}" for _ in range(80)] + ["awful", "nasty"] * bad
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, "bad" if bad else "good"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table, prior, calibration = M.learn(docs, spark.createDataFrame(labels[:2000], "doc_id long, domain string"), ["good", "bad"])
    got = {r.doc_id: r.p1 for r in M.posteriors(docs, table, prior, calibration=calibration).collect()}
    assert len(got) == len(rows)
    good = [got[i] for i, d in labels[2000:] if d == "good"]
    bad = [got[i] for i, d in labels[2000:] if d == "bad"]
    assert max(good) < 0.1 and min(bad) > 0.9
    rated = M.mix(docs, spark.createDataFrame(labels[:2000], "doc_id long, domain string"), {"good": 0.97, "bad": 0.03}, anchor="good", anchor_rate=1.02).collect()
    kept = [r.copies > 0 for r in rated if labels[r.doc_id][1] == "good"]
    assert sum(kept) > 0.99 * len(kept) and rated[0].miss < 1e-3
