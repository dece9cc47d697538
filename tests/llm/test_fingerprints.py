import hashlib
import random
import re

from pyspark.sql import functions as F

from dialoglake.llm import fingerprints as P


def test_edited_text_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_RANGES", 7)
    rng = random.Random(1)
    texts = ["", None, "one", "a b", "ñandú été 日本 x\ty\nz", *(" ".join(rng.choices(["the", "of", "longer", "wörds", "here"], k=rng.randint(1, 60))) for _ in range(60))]
    ids = rng.sample(range(-50, 100_000), len(texts) - 3) + [7_000_000, 7_000_001, 7_000_002]
    rows = list(zip(ids, texts, ["clash"] * len(texts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    got = {r.doc_id: r for r in P.with_edited_text(docs).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert got[order[(k + 1) % len(order)][0]].fingerprint and r.near_next == 1 - bin(int(r.fingerprint, 16) ^ int(got[order[(k + 1) % len(order)][0]].fingerprint, 16)).count("1") / 128
    by_text = {}
    for i, t in order:
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_votes_against_brute_force(spark):
    texts = ["", "solo", "a b a b a b", "the quick brown fox the quick", " \n lead and trail \t "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.f0, r.f1) for r in P.fingerprints(docs).collect()}
    pairs = {i: list(zip(w, w[1:])) or [(w[0], "")] if (w := re.split(r"\s+", t.strip())) != [""] else [] for i, t in enumerate(texts)}
    flat = spark.createDataFrame([(i, *p) for i, ps in pairs.items() for p in ps], "i long, a string, b string")
    h = flat.select("i", "a", "b", F.xxhash64("a", "b").alias("h0"), F.xxhash64(F.xxhash64("a", "b")).alias("h1")).collect()
    for i in range(len(texts)):
        votes = [(r.h0, r.h1, min(16, len(r.a) + len(r.b))) for r in h if r.i == i]
        total = sum(v[2] for v in votes)
        want = tuple(sum(1 << b for b in range(64) if 2 * sum(v[2] for v in votes if v[k] >> b & 1) > total) for k in range(2))
        assert tuple(x & (1 << 64) - 1 for x in got[i]) == want


def test_likeness_tells_copies_from_strangers(spark):
    rng = random.Random(4)
    vocabulary = ["v%d" % k for k in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(40)], "doc_id long, text string")
    got = P.with_edited_text(docs).collect()
    assert all(r.near_edited > r.near_next for r in got)


def test_ties_nulls_and_empty_tables(spark):
    rows = [(None, "b"), (None, "a"), (3, "x y"), (3, "x y"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.with_edited_text(docs).collect()
    assert len(got) == 5 and sorted(str(r.doc_id) for r in got) == ["3", "3", "3", "None", "None"]
    lone = P.with_edited_text(docs.where("text = 'a'")).first()
    assert lone.near_next == 1.0
    assert P.with_edited_text(docs.limit(0)).collect() == []


def test_within_radius_against_brute_force(spark):
    rng = random.Random(9)
    base = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(20)]
    fps = set(base)
    for f0, f1 in base:
        for _ in range(6):
            x = f0 | f1 << 64
            for b in rng.sample(range(126), rng.randint(1, 5)):
                x ^= 1 << (b if b < 63 else b + 1)
            fps.add((x & (1 << 63) - 1, x >> 64 & (1 << 63) - 1))
    fps = sorted(fps)
    df = spark.createDataFrame(fps, "f0 long, f1 long")
    got = {(r.q0, r.q1, r.f0, r.f1): r.distance for r in P.within_radius(df.limit(40), df, radius=3).collect()}
    queries = [(r.f0, r.f1) for r in df.limit(40).collect()]
    apart = lambda a, b: bin(a[0] ^ b[0]).count("1") + bin(a[1] ^ b[1]).count("1")
    assert got == {(*q, *f): apart(q, f) for q in queries for f in fps if apart(q, f) <= 3}


def test_ranges_hold_outlying_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_RANGES", 16)
    rng = random.Random(2)
    ids = [*range(400), 10**15, *([None] * 300), *([77] * 300)]
    rows = [(i, f"text {k} of {rng.random()}") for k, i in enumerate(ids)]
    ranged = P._ranges(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sizes = {}
    for r in ranged:
        sizes[r.part] = sizes.get(r.part, 0) + 1
    assert len(ranged) == len(rows) and max(sizes.values()) < len(rows) / 4
    assert sorted((r.doc_id or 0, r.text) for r in ranged) == sorted((i or 0, t) for i, t in rows)
    order = sorted(ranged, key=lambda r: (r.part, r.pos))
    assert [(r.doc_id is not None, r.doc_id or 0) for r in order] == sorted((i is not None, i or 0) for i in ids)
    assert P.with_edited_text(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


def test_neighbours_against_brute_force(spark):
    rng = random.Random(3)
    words = ["w%d" % k for k in range(50)]
    base = [rng.choices(words, k=300) for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(i // 12):
            w[rng.randrange(300)] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(60, None), (80, ""), (None, "")]
    marked = P.with_edited_text(spark.createDataFrame(rows, "doc_id long, text string"))
    got = P.neighbours(marked, F.col("doc_id") % 20 == 0).collect()
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    for r in got:
        want = sum(apart(r.fingerprint, x.fingerprint) <= 3 for x in got)
        assert r.near_count == (want if r.doc_id is not None and r.doc_id % 20 == 0 else None)
    assert len(got) == len(rows) and max(r.near_count or 0 for r in got) > 2
