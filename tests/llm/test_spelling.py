"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from dialoglake.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain(docs, shortest=6, least=5, factor=5, damage=199):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= shortest and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def corpus(seed, size):
    """Words with variants of words with variants, in few letters, so that runs and ties are many."""
    rng = random.Random(seed)
    letters = "abÀÿ" if seed % 2 else "abc"
    words = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(size)]
    for w in list(words[: size // 2]):
        k = rng.randrange(len(w))
        words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    docs = []
    for i in range(60):
        picked = [w if rng.random() < 0.8 else w.upper() for w in rng.choices(words, [1 / (1 + k) for k in range(len(words))], k=400)]
        docs.append((i, rng.choice([" ", ", ", "1 "]).join(picked)))
    return docs


@pytest.mark.parametrize("seed, block_words", [(0, 5_000), (1, 20), (2, 3), (3, 1)])
def test_against_all_pairs(spark, seed, block_words):
    docs = corpus(seed, 150) + [(None, "nullid nullid nullid nullid nullid nullix " * 5), (7, None), (8, ""), (8, "12 !?")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = S.variants(df, block_words=block_words).collect()
    want = plain(docs)
    assert len(got) == len(want) > 50 and sum(v[0] is not None for v in want.values()) > 5
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want


def test_chain_of_forms_long_words_and_damage(spark):
    long = "ab" * 20_000
    text = " ".join(["kitten"] * 700 + ["kittens"] * 130 + ["kittenst"] * 25 + ["kittexst"] * 5 + [long] * 40 + [long + "c"] * 6 + ["aloneÄä"] * 9)
    df = spark.createDataFrame([(3, text), (3, text)], "doc_id long, text string")
    got = {r.word: r for r in S.variants(df, damage=10**12).collect()}
    assert got["kittexst"].root == "kitten" and got["kittexst"].form == "kittenst" and got["kitten"].root == "kitten"
    assert got[long + "c"].form == long and got[long].n_near == 1 and got["aloneÄä"].n == 18
    docs = [(i, "stones " * 9) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.variants(df).collect()} == plain(docs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(none).collect() == []
    assert S.variants(spark.createDataFrame([(1, "too few words here")], "doc_id long, text string")).collect() == []


def test_acceptor_is_minimal_and_ranks_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "s"})
    a = S.Acceptor(words)
    # Right languages that differ: of "" (start), "s", "st", "sto"/"t"-branches, what takes p, s? and the end.
    assert len(set(a.states)) == len(a.states)

    def run(w):
        p, rank = a.start, 0
        for c in w:
            if c not in a.arcs[p]:
                return None
            p, at = a.arcs[p][c]
            rank += at
        return rank if a.states[p][0] else None

    assert [run(w) for w in words] == list(range(len(words))) and run("to") is None
    taps, tops = a.arcs[a.arcs[a.start]["t"][0]]["a"][0], a.arcs[a.arcs[a.start]["t"][0]]["o"][0]
    assert taps == tops
