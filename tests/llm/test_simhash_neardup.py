import random
import tracemalloc

import pytest
import xxhash
from pyspark.sql import functions as F

from dialoglake.llm import simhash_neardup as S
from dialoglake.llm.components import connected_components


def brute_fp(text, k=3):
    w = (text or "").encode()
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    words = [x for x in "".join(chr(b) if b in (32, 9, 10, 11, 12, 13) else chr(b) for b in w).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    words = [x.encode("latin-1") for x in words]
    sh = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(ids, fps, radius):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "Beta", "gamma", "délta", "eps"]) for _ in range(n)) for n in (0, 1, 2, 3, 40, 40, 300)]
    texts = [None, "", " \t\n", *base, *base]
    long = ["word%d" % rng.randint(0, 400) for _ in range(400)]
    for cut in range(12):
        w = list(long)
        w[cut * 7] = "changed%d" % cut
        texts.append(" ".join(w) if cut % 2 else "\n".join(w))
    rows = [(i * 3 % 101, t, "fp") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicate_components(docs).collect()}
    ids = sorted(i for i, _, _ in rows)
    fp = {i: brute_fp(t) for i, t, _ in rows}
    want = brute_components(ids, [fp[i] for i in ids], 2)
    assert got == {i: (f"{fp[i]:016x}", c) for i, c in zip(ids, want)}
    assert any(c != i for i, c in zip(ids, want))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_ball_links_find_every_component(spark, radius):
    rng = random.Random(radius)
    fps = {rng.getrandbits(63)}
    for _ in range(60):
        f = rng.choice(list(fps))
        for b in rng.sample(range(64), rng.randint(1, radius + 2)):
            f ^= 1 << b
        f &= (1 << 64) - 1
        fps.add(f - (1 << 64) if f >= 1 << 63 else f)
    fps = sorted(fps)
    links = S.ball_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius)
    comp = {r.node: r.component for r in connected_components(links).collect()}
    want = brute_components(fps, [f & (1 << 64) - 1 for f in fps], radius)
    assert [comp.get(f, f) for f in fps] == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (None, 4), (500, 450), (450, -7)] + [(1000, 1000 + k) for k in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 200: 100, 500: -7, 450: -7, -7: -7} | {1000 + k: 1000 for k in range(50)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_near_copies_keeps_distinct_texts_apart(spark):
    rng = random.Random(8)
    vocabulary = ["w%d" % k for k in range(900)]
    texts, group = [], []
    for g in range(25):
        w = rng.choices(vocabulary, k=rng.randint(120, 400))
        for copy in range(4):
            x = list(w)
            for _ in range(copy * len(w) // 250):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            texts.append(" ".join(x))
            group.append(g)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_copies(docs).collect()}
    assert all(group[i] == group[c] for i, c in got.items())

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def similarity(i, j):
        x, y = shingles(texts[i]), shingles(texts[j])
        return len(x & y) / len(x | y)

    near = [(i, j) for i in range(len(texts)) for j in range(i) if group[i] == group[j] and similarity(i, j) >= 0.8]
    assert sum(got[i] == got[j] for i, j in near) >= 0.95 * len(near) and near
    # Verified exactly: whoever is in a group has a partner of that similarity there.
    for i, c in got.items():
        members = [j for j in got if got[j] == c and j != i]
        assert not members or max(similarity(i, j) for j in members) >= 0.8
    assert S.near_copies(docs.limit(0)).collect() == []


def test_near_copies_of_odd_rows(spark):
    rows = [(None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (5, None), (6, ""), (7, "ONE two"), (8, "one two"), (9, "one three")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = sorted((r.doc_id or -1, r.component_id) for r in S.near_copies(docs).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9)]


def test_near_copies_of_one_original(spark):
    rng = random.Random(12)
    vocabulary = ["w%d" % k for k in range(5000)]
    original = rng.choices(vocabulary, k=400)
    texts = []
    for _ in range(1000):
        x = list(original)
        for at in rng.sample(range(400), 8):
            x[at] = "e%d" % rng.randrange(1 << 30)
        texts.append(" ".join(x))
    texts.insert(500, " ".join(original))
    texts += [" ".join(rng.choices(vocabulary, k=400)) for _ in range(100)]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for t in texts]
    near = [i for i in range(1001) if len(sets[i] & sets[500]) >= 0.8 * len(sets[i] | sets[500])]
    assert len(near) >= 900
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_copies(docs).collect()}
    found = sum(got[i] == got[500] for i in near)
    print(f"{found} of {len(near)} texts of the original's group found")
    assert found >= 0.99 * len(near)
    assert all(got[i] == i for i in range(1001, 1101))


def template_texts(n, own):
    """n texts of one template of 400 words with `own` words of their own; with 50 they have a similarity of 0.76."""
    base = [f"word{k}" for k in range(400)]
    return [" ".join([*base[:200], *(f"own{i}x{k}" for k in range(own)), *base[200:]]) for i in range(n)]


def shingle_tables(spark, texts):
    sets = spark.createDataFrame([(i, [int(x) for x in S.shingle_set(S.word_hashes(t), 5).view("<i8")]) for i, t in enumerate(texts)], "node long, shingles array<long>")
    return sets.select("node", F.col("node").alias("component")), sets


def test_texts_that_just_miss_make_no_joined_rows(spark):
    counts = []
    for n in (60, 120):
        rest, sets = shingle_tables(spark, template_texts(n, 50))
        counts.append(seen_rows(spark, lambda: S._apart_still(rest, sets, 0.8)))
    # Rows grow with the texts, not with their pairs: twice the texts, at most about twice the rows.
    assert counts[1][1] <= 2.2 * max(counts[0][1], 1) and counts[0][0] == counts[1][0] == 0


def seen_rows(spark, make):
    """(pairs found, most rows that any join made): the joins of the last stored table are made again without their
    conditions."""
    met = {}
    real = S.freeze

    def watch(df, name):
        out = real(df, name)
        met[name] = out
        return out

    S.freeze = watch
    try:
        pairs = make().count()
    finally:
        S.freeze = real
    rows = met["near-copy-met"]
    share = 0.8 / 1.8
    left = F.col("size") - F.col("place") + 1
    stand = rows.where(left >= 2 * share * F.col("size") - 1e-6).groupBy("token").agg(F.count(F.lit(1)).alias("s"))
    seek = rows.where(left / share - F.col("size") >= F.col("size") * 0.8).groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    return pairs, stand.join(seek, "token").agg(F.coalesce(F.sum(F.col("s") * F.col("k")), F.lit(0))).first()[0]


def test_exact_search_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    texts = template_texts(6, 12)
    for _ in range(60):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 25)):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 2)] = [f"new{rng.randrange(30)}"] * rng.randint(0, 3)
        texts.append(" ".join(words))
    texts += ["a b c", "a b c d e f", "a b c d e f g", "x"]
    sets = [set(S.shingle_set(S.word_hashes(t), 5).tolist()) for t in texts]
    rest, tables = shingle_tables(spark, texts)
    got = {(r.a, r.b) for r in S._apart_still(rest, tables, 0.8).collect()}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want and want <= got
    # With two large components only pairs between them count.
    halves = rest.withColumn("component", F.when(F.col("node") % 3 == 0, 1).otherwise(0).cast("long"))
    got = {(r.a, r.b) for r in S._apart_still(halves, tables, 0.8).collect()}
    across = {(i, j) for i, j in want if (i % 3 == 0) != (j % 3 == 0)}
    assert across <= got and all((i % 3 == 0) != (j % 3 == 0) for i, j in got)


def test_wider_keys_find_the_same_near_texts(spark):
    assert [S._extra_bits(n) for n in (0, 1, 1 << 27, (1 << 27) + 1, 1 << 34)] == [0, 0, 0, 1, 7]
    base = " ".join(f"some{k} words{k % 7} of prose" for k in range(200))
    rows = [(1, base), (2, base + " end"), (3, base.replace("some7 ", "")), (4, "quite another text of its own words")]
    marks = S._marks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5).withColumn("node", F.col("doc_id"))
    for extra in (0, 7, 24):
        pairs, crowd, members = S._colliding(marks, 2, extra)
        crowd = crowd.join(members, "half")
        met = {(r.a, r.b) for r in pairs.collect()}
        for key in {r["key"] for r in crowd.collect()}:
            nodes = sorted(r["node"] for r in crowd.where(F.col("key") == key).select("node").distinct().collect())
            met |= {(a, b) for a in nodes for b in nodes if a < b}
        assert {(1, 2), (1, 3), (2, 3)} & met and not any(4 in p for p in met)


def test_keys_do_not_depend_on_the_size_of_the_input(spark, monkeypatch):
    widths, colliding = [], S._colliding
    monkeypatch.setattr(S, "ROOMY", 0)
    monkeypatch.setattr(S, "_colliding", lambda nodes, radius, extra=0: widths.append(extra) or colliding(nodes, radius, extra))
    docs = spark.createDataFrame([(k, f"text {k} has words of its own {k * k}") for k in range(9)], "doc_id long, text string")
    assert S.near_copies(docs).count() == 9
    assert S.near_copies(docs, extra_bits=3).count() == 9
    assert widths == [0, 3]


def test_hashing_words_keeps_none_of_them():
    """A worker serves many stages, so what it keeps adds up."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for k in range(50):
            assert len(S.word_hashes(" ".join(f"w{k}x{i}" for i in range(1000)))) == 1000
        assert tracemalloc.get_traced_memory()[0] - before < 100_000
    finally:
        tracemalloc.stop()


def test_halves_stand_for_all_their_nodes(spark):
    """Every group of nodes that meets on a variant is found, and no other: against the balls of all nodes one by one."""
    rng = random.Random(11)
    shared = [rng.getrandbits(32) for _ in range(3)]
    half = lambda: rng.choice(shared) ^ (1 << rng.randrange(32) if rng.random() < 0.5 else 0) if rng.random() < 0.7 else rng.getrandbits(32)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    lanes = [[half() | half() << 32 for _ in S._LANE] for _ in range(40)]
    nodes = spark.createDataFrame([(k, *map(signed, row)) for k, row in enumerate(lanes)], ", ".join(f"{c} long" for c in ["node", *S._LANE]))
    pairs, crowd, members = S._colliding(nodes, 2)
    two, more = set(), set()
    for lane in range(S.LANES):
        for side in (0, 32):
            at = {}
            for k, row in enumerate(lanes):
                h = row[lane] >> side & 0xFFFFFFFF
                for v in [h, *(h ^ 1 << b for b in range(32))]:
                    at.setdefault(v, set()).add(k)
            two |= {tuple(sorted(s)) for s in at.values() if len(s) == 2}
            more |= {tuple(sorted(s)) for s in at.values() if len(s) > 2}
    assert {(r.a, r.b) for r in pairs.collect()} == two and two
    found = {}
    for r in crowd.join(members, "half").collect():
        found.setdefault((r.key, r.n), []).append(r.node)
    assert {tuple(sorted(s)) for s in found.values()} == more and all(n == len(s) for (_, n), s in found.items())
    assert crowd.count() < sum(map(len, found.values()))


def test_only_meeting_halves_are_looked_up(spark, monkeypatch):
    """Variants of which one node alone knows are counted slim: texts that meet nobody leave no rows behind them."""
    stored, real = {}, S.freeze
    monkeypatch.setattr(S, "freeze", lambda df, name: stored.setdefault(name, []).append(0) or stored[name].append((out := real(df, name)).count()) or out)
    rng = random.Random(21)
    lanes = [[rng.getrandbits(64) - (1 << 63) for _ in S._LANE] for _ in range(60)]
    nodes = spark.createDataFrame([(k, *row) for k, row in enumerate(lanes)], ", ".join(f"{c} long" for c in ["node", *S._LANE]))
    S._colliding(nodes, 2)
    assert sum(stored["near-copy-halves"]) == 600 and sum(stored["near-copy-variants"]) == 0


def test_members_of_a_group_are_tried_against_one_pivot_first(spark, monkeypatch):
    rng, tried, links = random.Random(22), [], S._Verifier.links
    monkeypatch.setattr(S._Verifier, "links", lambda self, pairs: tried.append(pairs.count()) or links(self, pairs))
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(100):
        at = rng.randrange(400)
        texts.append(" ".join([*base[:at], f"e{rng.randrange(1 << 30)}", *base[at + 1 :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in S.near_copies(docs).collect()} == {0}
    assert sum(tried) <= 2 * len(texts)


def test_rows_are_dealt_once_for_join_and_grouping(spark):
    docs = spark.createDataFrame([(1, "a text"), (1, "a text"), (2, "another one")], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.keep_one_copy(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One of the rows, one of what is kept.
    assert plan.count("Exchange hashpartitioning") == 2


def test_joins_on_halves_make_rows_by_members_not_by_variants(spark, monkeypatch):
    """A half meets others on up to 33 variants; joins on it make a row for each of its nodes, not for each variant too."""
    stored, real, kind, counted = {}, S.freeze, type(spark.range(1)), []
    join = kind.join

    def watch(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, str) and on == "half" and how is None:
            counted.append(out.count())
        return out

    monkeypatch.setattr(S, "freeze", lambda df, name: stored.setdefault(name, []).append(out := real(df, name)) or out)
    monkeypatch.setattr(S, "drop_frozen", lambda *tables: None)
    monkeypatch.setattr(kind, "join", watch)
    rng = random.Random(31)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    texts = [" ".join(base)]
    for _ in range(150):
        at = rng.randrange(100)
        texts.append(" ".join([*base[:at], f"e{rng.randrange(1 << 30)}", *base[at + 1 :]]))
    _, classes = S._near_copy_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 5, 0.8, 2, 0)
    monkeypatch.undo()
    members = stored["near-copy-members"][0].count()
    print(f"{members} members of halves, {sum(counted)} rows of joins on halves: {counted}")
    assert classes.select("component").distinct().count() == 1
    assert members > 500 and sum(counted) <= 5 * members


def test_pivots_of_variants(spark):
    """Pivot, components and those without the half's best node, against a plain version."""
    rng = random.Random(14)
    node_of = {h: rng.sample(range(40), rng.randint(1, 6)) for h in range(25)}
    keys_of = {h: rng.sample(range(100, 112), rng.randint(1, 5)) for h in node_of}
    size = {k: sum(len(node_of[h]) for h in node_of if k in keys_of[h]) for k in range(100, 112)}
    crowd = spark.createDataFrame([(k, h, size[k]) for h in keys_of for k in keys_of[h]], "key long, half long, n long")
    members = spark.createDataFrame([(h, x) for h in node_of for x in node_of[h]], "half long, node long")
    seats = S._seats(crowd, members)
    weight = {x: sum(size[k] for h in node_of if x in node_of[h] for k in keys_of[h]) for x in range(40)}
    assert {(r.half, r.node, r.weight) for r in seats.collect()} == {(h, x, weight[x]) for h in node_of for x in node_of[h]}
    best = {h: max((weight[x], x) for x in node_of[h]) for h in node_of}
    pivot = {k: max(best[h] for h in node_of if k in keys_of[h]) for k in {k for ks in keys_of.values() for k in ks}}
    got = S._at_variants(seats.withColumn("component", F.col("node") % 3)).collect()
    ends = lambda c: (min(c), max(c)) if c else (None, None)
    want = {(k, h, best[h][1], *ends([x % 3 for x in node_of[h]]), *ends([x % 3 for x in node_of[h] if x != best[h][1]]), (*pivot[k], pivot[k][1] % 3)) for h in keys_of for k in keys_of[h]}
    assert {(r.key, r.half, r.best, r.lo, r.hi, r.rest_lo, r.rest_hi, tuple(r.pivot)) for r in got} == want and len(got) == len(want)
