"""Operator 2, SimHash near-dedup by meet-in-the-middle ball hashing.

A text becomes a 64-bit fingerprint: every shingle's XXH64 votes on each bit. Two fingerprints that differ in at most
r bits have a common neighbour within ceil(r/2) bits of each. So every distinct fingerprint emits all variants within
that half radius, the variants are shuffled, and fingerprints that meet on a variant are verified by their distance.

Why it holds at scale: only distinct fingerprints emit variants, so a group of exact copies, however large, emits
once. All fingerprints that meet on a variant are within the half radius of it, so a full-length search has at most
65 of them there. Within a variant each member is linked to the member before it, never to all others: members of one
ball are all within the radius of each other, so a chain loses no component.

Defined results: null text is the empty text; no word gives fingerprint zero, which is linked like any other; fewer
words than a shingle give one shingle of all of them; repeated rows and repeated or null ids are kept as rows of
their own; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dialoglake.llm.common import drop_frozen, freeze, row_of
from dialoglake.llm.components import connected_components

_BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_PLACE = np.arange(8) * 256
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def word_shingles(words: list[bytes], k: int) -> list[bytes]:
    """All runs of k words, repeats included; the whole sequence if there are fewer than k words."""
    if not words:
        return []
    if k == 1:
        return words
    if len(words) < k:
        return [b" ".join(words)]
    return [b" ".join(t) for t in zip(*(words[i:] for i in range(k)))]


def _hashes(shingles: list[bytes], seed: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(s, seed) for s in shingles], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; signed, as Spark's long."""
    if not len(hashes):
        return 0
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
    votes = (seen @ _BITS_OF_BYTE).ravel()
    return int(np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 hash bits from the same hash (multiply and fold)."""
    x = (hashes ^ (hashes >> np.uint64(29))) * _SPREAD[lane]
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [majority(_hashes(word_shingles((t or "").encode().lower().split(), shingle_words), seed)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def _flips(bits: list[int], half_radius: int) -> list[int]:
    """No bit and all choices of up to half_radius of these bits, as Spark's longs."""
    flips = [0]
    masks = [1 << b for b in bits]
    for depth in range(1, half_radius + 1):
        flips += [sum(c) for c in _choose(masks, depth)]
    return [f - (1 << 64) if f >= 1 << 63 else f for f in flips]


def _ball(key: Column, bits: list[int], half_radius: int) -> Column:
    """Array of the key and its variants with up to half_radius of these bits flipped."""
    return F.array(*(key.bitwiseXOR(F.lit(f).cast("long")) for f in _flips(bits, half_radius)))


def _choose(items: list[int], n: int, start: int = 0):
    if n == 0:
        yield ()
        return
    for i in range(start, len(items)):
        for rest in _choose(items, n - 1, i + 1):
            yield (items[i], *rest)


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (fp) -> pairs (a, b) that connect all fingerprints within radius bits of each other.

    A bucket is the ball around one variant, so each member is within the radius of its neighbour in the bucket when
    radius is even; the distance is verified in any case. For an odd radius each member is also paired with the
    bucket's centre if that is a fingerprint itself.
    """
    half = (radius + 1) // 2
    near = fps.select("fp", F.explode(_ball(F.col("fp"), list(range(64)), half)).alias("variant"))
    w = Window.partitionBy("variant").orderBy("fp")
    if radius % 2 == 0:
        met = near.select("fp", F.lag("fp").over(w).alias("other"))
    else:
        members = near.groupBy("variant").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
        met = members.select("m", F.explode("m").alias("fp")).select("fp", F.explode("m").alias("other")).where("other < fp")
    return met.where(F.col("other").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)).select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lower-case hex digits), component_id (the smallest doc_id that
    links of at most radius bits reach, its own included; null if all ids there are null)."""
    fp = freeze(fingerprints(docs, id_col, text_col, shingle_words, seed), "simhash")
    firsts = freeze(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-firsts")
    comp = connected_components(ball_links(firsts.select("fp"), radius))
    linked = firsts.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = freeze(linked.join(lowest, "component").select("fp", "component_id"), "simhash-classes")
    return fp.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies of a stated similarity, for filtering -----------------------------------------------------------

LANES = 5
_LANE = [f"f{k}" for k in range(LANES)]
_MARKS = ["set0", "set1", *_LANE]


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of every word of the text, A-Z lower-cased."""
    words, h = (text or "").encode().lower().split(), xxhash.xxh64_intdigest
    return np.fromiter((h(w, 42) for w in words), np.uint64, len(words))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the runs of k words, from the words' hashes; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = words[:n].copy()
    for j in range(1, min(k, len(words))):
        h = h * _SPREAD[0] + words[j : j + n]
    return np.unique(_mixed(h, 1))


def _marks(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(doc_id, digest of the text, set0 and set1: digest of the set of its shingles, f0..f4: votes of its distinct
    pairs of neighbouring words)."""
    names = ["doc_id", "digest", *_MARKS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[] for _ in _MARKS]
            for t in b.column(2).to_pylist():
                words = word_hashes(t)
                shingles, pairs = shingle_set(words, shingle_words), shingle_set(words, 2)
                sums = (int(x.sum(dtype=np.uint64).view(np.int64)) for x in (shingles, _mixed(shingles, 2)))
                for x, v in zip(out, (*sums, *(majority(_mixed(pairs, k)) for k in range(LANES)))):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in out)], names)

    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return picked.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in names]))


#: Rows of (node, id, digest) that are broadcast at most, 32 bytes each; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(node, shingles: hashes of the distinct shingles) of the document that stands for each wanted node.
    wanted: (node, rep: doc_id and digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(word_hashes(t), shingle_words).view("<i8") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    of = freeze(wanted.select("node", F.col("rep.doc_id").alias("w_id"), F.col("rep.digest").alias("w_digest")), "near-copy-wanted")
    side = F.broadcast(of) if of.count() <= BROADCAST_ROWS else of
    met = rows.join(side, (F.col("digest") == F.col("w_digest")) & F.col("id").eqNullSafe(F.col("w_id"))).select("node", "text")
    return freeze(met.dropDuplicates(["node"]).mapInArrow(run, "node long, shingles array<long>"), "near-copy-shingles")


class _Verifier:
    """Tests candidate pairs (a, b) of nodes by the exact Jaccard similarity of their shingle sets. Sets are taken from
    the texts when a pair first needs them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float):
        self.nodes, self.similarity = nodes, similarity
        self.sets: DataFrame | None = None
        #: Tables that can go when the last pair is tested.
        self.stored: list[DataFrame] = []
        self.fetch = lambda wanted: _shingle_sets(docs, wanted, id_col, text_col, shingle_words)
        # Votes farther apart than those of sets of half the similarity: such pairs needn't be verified.
        half = similarity / 2
        self.most_bits = int(64 * LANES * acos(2 * half / (1 + half)) / pi)

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes, and of those wanted before."""
        missing = self.nodes.join(wanted, "node", "left_semi")
        if self.sets is None:
            self.sets = self.fetch(missing)
            self.stored.append(self.sets)
        elif not (missing := missing.join(self.sets, "node", "left_anti")).isEmpty():
            more = self.fetch(missing)
            self.stored.append(more)
            self.sets = self.sets.union(more)
        return self.sets

    def links(self, pairs: DataFrame) -> DataFrame:
        left = self.nodes.select(F.col("node").alias("a"), *(F.col(x).alias(f"l_{x}") for x in _LANE))
        right = self.nodes.select(F.col("node").alias("b"), *_LANE)
        apart = sum((F.bit_count(F.col(f"l_{x}").bitwiseXOR(F.col(x))) for x in _LANE), F.lit(0))
        near = freeze(pairs.join(left, "a").join(right, "b").where(apart <= self.most_bits).select("a", "b"), "near-copy-candidates")
        self.stored.append(near)
        sets = self.sets_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        shared = F.size(F.array_intersect("sa", "sb"))
        met = near.join(x, "a").join(y, "b").select("a", "b", shared.alias("n"), (F.size("sa") + F.size("sb") - shared).alias("all"))
        return freeze(met.where(F.col("n") >= F.col("all") * self.similarity - 1e-9).select("a", "b"), "near-copy-links")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


#: Nodes, as a power of two, up to which keys of 32 bits suffice: chance meetings on a variant stay few.
ROOMY = 27


def _extra_bits(nodes: int) -> int:
    """A guide for a caller's extra_bits, never followed by itself (results would then depend on the size of the input):
    how many bits of another lane a key takes beside its half so that the nodes that meet on a variant by chance don't grow
    with the corpus. One more for each doubling beyond 2^ROOMY nodes; at most 24, so that table and key fit a long."""
    return min(24, max(0, (max(1, nodes) - 1).bit_length() - ROOMY))


def _met(halves: DataFrame, bits: list[int], half_radius: int) -> DataFrame:
    """(half, keys: the variants on which it meets another half) of the halves that meet any.

    All variants of all halves are shuffled, by far the most rows of the search, so they carry little: a half is its
    variant with one choice of bits flipped, so the number of that choice tells it, and one long holds all that meet."""
    near = halves.select("half", F.posexplode(_ball(F.col("half"), bits, half_radius)).alias("flip", "key"))
    if len(_flips(bits, half_radius)) < 64:
        met = near.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, flip)")).alias("who")).where("bit_count(who) > 1")
        met = met.select("key", "who", F.posexplode(_ball(F.col("key"), bits, half_radius)).alias("flip", "half")).where("shiftright(who, flip) & 1 = 1")
    else:
        met = near.groupBy("key").agg(F.collect_set("half").alias("who")).where("size(who) > 1").select("key", F.explode("who").alias("half"))
    return met.groupBy("half").agg(F.collect_list("key").alias("keys"))


def _colliding(nodes: DataFrame, radius: int, extra: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes that meet on a variant: pairs (a, b) that are alone on theirs; rows (key, half, n) of the variants on which n
    nodes, three or more, meet; and the nodes (half, node) of these halves. Of variants on which the same nodes meet, one is
    kept.

    Each half of a lane is a table of its own, searched by ball hashing; with `extra` bits of the next lane behind it, which
    are within the radius like the others. Nodes that agree in a half meet the same others, so a distinct half emits its
    variants once and stands for all its nodes. Halves are counted with a combine before the shuffle, so one may hold any
    share of the nodes; what a variant's nodes are is looked up only for variants that two nodes meet on; and a lane's
    shuffle is gone before the next lane begins."""
    pairs, crowds, members = [], [], []
    width = 32 + extra
    for lane, name in enumerate(_LANE):
        f, other = F.col(name), F.col(_LANE[(lane + 1) % LANES])
        halves = []
        for h, x in enumerate((f.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f, 32))):
            if extra:
                x = F.shiftleft(x, extra).bitwiseOR(F.shiftrightunsigned(other, 64 - extra))
            halves.append(F.lit((2 * lane + h) << width).cast("long").bitwiseOR(x))
        of = nodes.select("node", F.explode(F.array(*halves)).alias("half"))
        sets = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"set{seed}") for seed in (0, 1)]
        one = freeze(of.groupBy("half").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n"), *sets), "near-copy-halves")
        bits, half_radius = list(range(width)), (radius + 1) // 2
        # A half of several nodes also meets them on a variant that no other half reaches, if there is one.
        keys = F.coalesce("keys", F.array().cast("array<long>"))
        own = F.when(F.col("n") > 1, F.array_min(F.array_except(_ball(F.col("half"), bits, half_radius), keys)))
        near = one.join(_met(one, bits, half_radius), "half", "left").where("n > 1 or keys is not null")
        near = near.withColumn("key", F.explode(F.array_compact(F.array_append(keys, own)))).drop("keys")
        near = freeze(near, "near-copy-variants")
        met = near.groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), *(F.bit_xor(s).alias(s) for s in ("set0", "set1")))
        met = freeze(met, "near-copy-keys")
        pairs.append(freeze(met.where("n = 2").select("a", "b").distinct(), "near-copy-pairs"))
        # Halves may meet on several variants: of variants with the same members one is enough.
        once = met.where("n > 2").groupBy("n", "a", "b", "set0", "set1").agg(F.min("key").alias("key"))
        crowds.append(freeze(near.select("key", "half").join(once.select("key", "n"), "key"), "near-copy-crowds"))
        drop_frozen(one, near, met)
        members.append(of.join(crowds[-1].select("half").distinct(), "half", "left_semi").select("half", "node"))
    return reduce(DataFrame.union, pairs).distinct(), reduce(DataFrame.union, crowds), freeze(reduce(DataFrame.union, members), "near-copy-members")


def _grouped(rows: DataFrame, group: DataFrame | None) -> DataFrame:
    """rows with a node -> with its component; a node without links is one of its own."""
    if group is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _seats(crowd: DataFrame, members: DataFrame) -> DataFrame:
    """(half, node, weight: how much the node meets in all its halves, keys: the half's variants) of all members. A half stands
    for all its nodes: its best, of the greatest weight, is the only one of them that can be a variant's pivot, and it alone
    has keys, so a half's variants are held and joined once, however many they and its nodes are."""
    held = crowd.groupBy("half").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("reach"))
    held = freeze(held, "near-copy-held")
    weights = members.join(held.select("half", "reach"), "half").groupBy("node").agg(F.sum("reach").alias("weight"))
    weighed = freeze(members.join(weights, "node").select("half", "node", "weight"), "near-copy-weighed")
    best = weighed.groupBy("half").agg(F.max(F.struct("weight", "node")).alias("best")).select("half", F.col("best.node").alias("best"))
    keys = F.when(F.col("node") == F.col("best"), F.col("keys")).alias("keys")
    seats = freeze(weighed.join(held.select("half", "keys").join(best, "half"), "half").select("half", "node", "weight", keys), "near-copy-seats")
    drop_frozen(held, weighed)
    return seats


def _at_variants(seats: DataFrame) -> DataFrame:
    """Seats with components -> rows (key, half, best: the half's best node, lo and hi: least and greatest component of its nodes,
    rest_lo and rest_hi: of all but the best, pivot: weight, node and component of the variant's pivot). The pivot is among
    the halves that meet on the variant, which are those of a ball (33 for one flipped bit of 32), so a window finds it."""
    is_best, other = F.col("keys").isNotNull(), F.when(F.col("keys").isNull(), F.col("component"))
    of_best = (F.max(F.when(is_best, F.col(c))).alias(c) for c in ("weight", "node", "component"))
    halves = seats.groupBy("half").agg(*of_best, F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(other).alias("rest_lo"), F.max(other).alias("rest_hi"), F.first("keys", ignorenulls=True).alias("keys"))
    rows = halves.withColumn("key", F.explode("keys")).withColumn("pivot", F.max(F.struct("weight", "node", "component")).over(Window.partitionBy("key")))
    return rows.select("key", "half", F.col("node").alias("best"), "lo", "hi", "rest_lo", "rest_hi", "pivot")


#: Sizes of sets in one class differ by this factor at most.
CLASS_STEP = 1.05


def _apart_still(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components, in rest (node, component), among which are all of at least the
    similarity. An exact prefix filter: with shingles ordered by how many of these texts have them, rarest first, two
    sets of the similarity share one of the first of both, and what both have left from the first shingle they share
    must suffice (positional filter).

    Both filters are part of the join, not a condition after it. Of two sets the larger seeks and the smaller stands
    (equal sizes do both). With a = similarity / (1 + similarity), a set of n shingles can share, from place p on, at
    most n - p + 1, and sets of n and m must share a (n + m). So a set stands at place p only if n - p + 1 reaches 2 a n,
    and it seeks only sizes m with a (n + m) <= n - p + 1, as classes of sizes that are part of the key. Texts of one
    template that all just miss each other stand nowhere, so they make no rows at all. A shingle that a large component has
    meets only the texts outside it, so no component's members are paired with each other."""
    size = F.size("shingles")
    tokens = freeze(sets.join(rest, "node").select("node", "component", size.alias("size"), F.explode("shingles").alias("token")), "near-copy-tokens")
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    share, n, left = similarity / (1 + similarity), F.col("size"), F.col("size") - F.col("place") + 1
    first = tokens.join(held, "token").withColumn("place", place).where((left >= F.ceil(n * similarity - 1e-9)) & (F.col("df") > 1))
    first = freeze(first.select("token", "node", "component", "size", "place"), "near-copy-prefixes")
    by = first.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("components"))
    met = freeze(first.join(by.where("components > 1").select("token", F.col("most.component").alias("major")), "token"), "near-copy-met")
    class_of = lambda m: F.floor(F.log(m) / F.log(F.lit(CLASS_STEP)) + 1e-9).cast("int")
    stand = met.where(left >= 2 * share * n - 1e-6).withColumn("class", class_of(n.cast("double")))
    smallest, largest = F.greatest(F.lit(1.0), n * similarity - 1e-6), F.least(n.cast("double"), left / share - n + 1e-6)
    seek = met.where(largest >= smallest).withColumn("class", F.explode(F.sequence(class_of(smallest), class_of(largest))))
    stand = stand.select("token", "class", F.col("node").alias("other"), F.col("component").alias("its"), F.col("size").alias("its_size"), F.col("place").alias("its_place"), (F.col("component") == F.col("major")).alias("its_major"))
    seek = seek.withColumn("is_major", F.col("component") == F.col("major"))
    enough = F.least(left, F.col("its_size") - F.col("its_place") + 1) >= (n + F.col("its_size")) * share - 1e-6
    fits = (F.col("its_size") <= n) & (F.col("its_size") >= n * similarity - 1e-9) & (F.col("component") != F.col("its")) & enough
    one = seek.join(stand.where("not its_major"), ["token", "class"]).where(fits)
    two = seek.where("not is_major").join(stand.where("its_major"), ["token", "class"]).where(fits)
    return freeze(one.select(*_ordered("node", "other")).union(two.select(*_ordered("node", "other"))).distinct(), "near-copy-apart")


def _near_copy_classes(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float, radius: int, extra_bits: int) -> tuple[DataFrame, DataFrame]:
    """The stored marks of all rows, and (set0, set1, component: a node, rep: the row that stands for this node)."""
    marks = freeze(_marks(docs, id_col, text_col, shingle_words), "near-copy-marks")
    # A node is a distinct set of shingles; copies share it and search once. Its first row stands for it.
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("rep")
    nodes = freeze(marks.groupBy(*_MARKS).agg(rep).withColumn("node", F.monotonically_increasing_id()), "near-copy-nodes")
    verifier = _Verifier(docs, nodes, id_col, text_col, shingle_words, similarity)
    pairs, crowd, members = _colliding(nodes, radius, extra_bits)
    # In every crowded variant, the member that meets most others against the rest: its pivot.
    seats = _seats(crowd, members)
    variants = _at_variants(_grouped(seats, None))
    # First each node with the greatest of its halves' pivots: that joins most of a group, and pairs within a component need
    # no test.
    top = variants.groupBy("half").agg(F.max("pivot").alias("pivot"))
    tops = seats.join(top, "half").where("node <> pivot.node").groupBy("node").agg(F.max("pivot").alias("pivot"))
    greatest = freeze(tops.select("node", F.col("pivot.node").alias("pivot")), "near-copy-greatest")
    links = verifier.links(greatest.select(*_ordered("node", "pivot")).union(pairs).distinct())
    group = freeze(connected_components(links), "near-copy-groups")
    # Then the pivots of other components than a node's own. A half whose nodes are all of its pivots' component makes no row.
    grouped = freeze(_grouped(seats, group), "near-copy-grouped")
    others = _at_variants(grouped).where("lo <> pivot.component or hi <> pivot.component").select("half", "pivot").distinct()
    apart = grouped.join(others, "half").where("component <> pivot.component").select("node", F.col("pivot.node").alias("pivot"))
    apart = freeze(apart.join(greatest, ["node", "pivot"], "left_anti").select(*_ordered("node", "pivot")).distinct(), "near-copy-untried")
    if not apart.isEmpty():
        links = links.union(verifier.links(apart))
        group = freeze(connected_components(links), "near-copy-groups")
        drop_frozen(grouped)
        grouped = freeze(_grouped(seats, group), "near-copy-grouped")
    # Variants that hold several groups even without their pivot: the members of these are searched exactly.
    is_pivot, variant = F.col("best") == F.col("pivot.node"), Window.partitionBy("key")
    placed = _at_variants(grouped).withColumn("x", F.when(is_pivot, F.col("rest_lo")).otherwise(F.col("lo"))).withColumn("y", F.when(is_pivot, F.col("rest_hi")).otherwise(F.col("hi")))
    unsettled = placed.select("half", "best", is_pivot.alias("is_pivot"), F.min("x").over(variant).alias("x"), F.max("y").over(variant).alias("y")).where("x <> y")
    # A best node that is the pivot of all these variants needs no search.
    sought = unsettled.groupBy("half").agg(F.max(F.when(~F.col("is_pivot"), 1)).alias("all"), F.max("best").alias("best"))
    rest = grouped.join(sought, "half").where("all = 1 or node <> best").select("node", "component").distinct()
    rest = freeze(rest, "near-copy-rest")
    drop_frozen(seats, greatest, grouped)
    if not rest.isEmpty():
        more = verifier.links(_apart_still(rest, verifier.sets_of(rest.select("node")), similarity))
        if not more.isEmpty():
            group = freeze(connected_components(links.union(more)), "near-copy-groups")
    classes = freeze(_grouped(nodes.select("node", "set0", "set1", "rep"), group).select("set0", "set1", "component", "rep"), "near-copy-classes")
    drop_frozen(nodes, members, crowd, pairs, apart, links, group, rest, *verifier.stored)
    return marks, classes


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, radius: int = 2, extra_bits: int = 0) -> DataFrame:
    """(doc_id, component_id) per input row: groups of near copies, texts whose sets of word shingles have at least the
    given Jaccard similarity, and whatever such links join. component_id is the smallest doc_id of the group.

    Candidates come from ball hashing. A text's distinct pairs of neighbouring words vote on five 64-bit fingerprints;
    each 32-bit half is a table in which texts within `radius` bits meet on a variant within half the radius. Pairs
    that meet are verified: by the distance of all 320 bits first, then by the similarity itself, exactly.

    No pair that meets is passed over unless links already join its texts. In a variant that several texts share, the
    member that meets most others is tried against the rest (the source of many edited copies is nearer to them than
    they are to each other). Where members of different groups remain, these are searched exactly, by a join on their
    rarest shingles. So a large group costs rows in proportion to its members, not to their pairs.

    The votes are random, so two texts of just the similarity can miss each other in all ten tables; the README states
    the measured recall. Keys are of the same width for any input: 32 bits and what the caller adds by extra_bits (fewer
    chance meetings, but also fewer of the pairs near the similarity). Texts without words are one group. Null ids come last: a group's id is null only if all its
    ids are.
    """
    marks, classes = _near_copy_classes(docs, id_col, text_col, shingle_words, similarity, radius, extra_bits)
    lowest = classes.groupBy("component").agg(F.min("rep.doc_id").alias("component_id"))
    ids = freeze(classes.join(lowest, "component").select("set0", "set1", "component_id"), "near-copy-ids")
    return marks.join(ids, ["set0", "set1"]).select("doc_id", "component_id")


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, radius: int = 2, extra_bits: int = 0) -> DataFrame:
    """One row of docs for each group of near_copies, columns unchanged: that with the smallest id (null ids last), of
    several rows with this id that with the smallest digest of the text, of equal rows one."""
    marks, classes = _near_copy_classes(docs, id_col, text_col, shingle_words, similarity, radius, extra_bits)
    kept = classes.groupBy("component").agg(F.min("rep").alias("rep"))
    kept = freeze(kept.select(F.coalesce("rep.doc_id", F.lit(0)).alias("id"), F.col("rep.none").alias("none"), F.col("rep.digest").alias("digest")), "near-copy-kept")
    drop_frozen(marks, classes)
    # Plain columns as keys, the same for join and grouping: the rows are dealt once for both.
    key, id_ = ["id", "none", "digest"], F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("none"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), row_of(docs))
    return rows.join(kept, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row")).select("row.*")
