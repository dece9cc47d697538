"""Operator 3, document fingerprints by SimHash, with built-in functions only.

Terms are pairs of neighbouring words. A term's weight is its length in code points (16 at most), so pairs of short
function words count less; repeats vote again. Every bit of a term's 128-bit hash votes for or against that bit. Two
vote counters share a long (32-bit lanes), so a row costs 64 additions inside generated code, and a text's votes are
summed where the text is read: no row per term is ever shuffled.

The likeness of two fingerprints is the share of bits in which they agree. `within_radius` finds all fingerprints in
a Hamming radius through permuted block tables; `neighbours` counts the documents in the radius of the queried ones.

`with_edited_text` needs each document's successor by doc_id. Rows are dealt into ranges of (doc_id, hash of the text),
64 MB of text each, and stored; the first row of a range is copied to the end of the range before, and a window inside
each range does the rest. Ranges are quantiles, so outlying ids, null ids and repeated ids don't crowd one range; only
rows that are equal in both stay together. The driver sees one number per range.

Defined results: null text is the empty text; a text without words has fingerprint zero, one of a single word is
hashed by that word; null ids come first; rows with equal ids follow each other in order of
a hash of their text; repeated rows
count as documents of their own; the last document's successor is the first, a lone document is its own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.llm.common import freeze

BITS = 128
_LANES = (1 << 32) | 1


def _terms(text: Column) -> Column:
    """Array of (a, b): neighbouring words; a lone word with an empty partner; null if there is no word."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n = F.size(words)
    pairs = F.arrays_zip(F.slice(words, F.lit(1), n - 1).alias("a"), F.slice(words, F.lit(2), n - 1).alias("b"))
    lone = F.array(F.struct(F.element_at(words, 1).alias("a"), F.lit("").alias("b")))
    return F.when(n > 1, pairs).when(F.element_at(words, 1) != "", lone)


def _votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """rows with keys and a text -> keys, f0, f1 (the two halves of the fingerprint). Keys must tell rows apart."""
    t = rows.select(*keys, F.explode_outer(_terms(F.col(text))).alias("t"))
    h = F.xxhash64("t.a", "t.b")
    t = t.select(*keys, h.alias("h0"), F.xxhash64(h).alias("h1"), F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.least(F.length("t.a") + F.length("t.b"), F.lit(16))).cast("long").alias("w"))
    lanes = [F.sum(F.shiftright(F.col(f"h{i}"), k).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"v{i}_{k}") for i in range(2) for k in range(32)]
    summed = t.groupBy(*keys).agg(F.sum("w").alias("total"), *lanes)

    def half(i: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            v = F.col(f"v{i}_{k}")
            out = out.bitwiseOR(F.when(2 * v.bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("total"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
            top = (1 << (k + 32)) - ((1 << 64) if k == 31 else 0)
            out = out.bitwiseOR(F.when(2 * F.shiftrightunsigned(v, 32) > F.col("total"), F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return summed.select(*keys, half(0).alias("f0"), half(1).alias("f1"))


def fingerprint_text(f0: str, f1: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f0), 16, "0")))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    apart = F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))
    return 1 - apart / F.lit(float(BITS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, f1) of each distinct (id, text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.sha2("text", 256).alias("sha"), "text").dropDuplicates(["doc_id", "sha"])
    return _votes(rows, ["doc_id", "sha"], "text").select("doc_id", "f0", "f1")


BYTES_A_RANGE = 64 << 20
LEAST_RANGES = 64
_PLACE = (1 << 33) - 1


def _ranges(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) -> stored with part, the number of their range, and pos, their place in it."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(max(LEAST_RANGES, size // BYTES_A_RANGE), *order).sortWithinPartitions(*order, "text")
    place = F.monotonically_increasing_id()
    return freeze(dealt.select(F.spark_partition_id().alias("part"), place.bitwiseAND(F.lit(_PLACE)).alias("pos"), "doc_id", "text"), "fingerprint-ranges")


def _with_copies(ranged: DataFrame) -> DataFrame:
    """Adds copy: false for the row itself, true for the copy of a range's first row at the end of the range before
    (of the first range: of the last)."""
    firsts = ranged.where("pos = 0")
    parts = sorted(r["part"] for r in firsts.select("part").collect())
    moves = ranged.sparkSession.createDataFrame([(p, parts[k - 1]) for k, p in enumerate(parts)], "part int, before int")
    copies = firsts.join(F.broadcast(moves), "part").select(F.col("before").alias("part"), "pos", "doc_id", "text", F.lit(True).alias("copy"))
    return ranged.withColumn("copy", F.lit(False)).unionByName(copies)


def with_edited_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last floor(n/2) code points are the first as many
    of the next document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("part").orderBy("copy", "pos")
    placed = _with_copies(_ranges(rows)).select("*", F.lead("text").over(w).alias("next_text"), F.length("text").cast("long").alias("n_chars"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    keys = ["part", "pos", "copy", "doc_id", "n_chars", "edited_sha256", "edited"]
    both = placed.withColumn("e", F.when(~F.col("copy"), edited)).select(
        "part", "pos", "copy", "doc_id", "n_chars", F.sha2("e", 256).alias("edited_sha256"),
        F.explode(F.when(F.col("copy"), F.array(F.struct(F.lit(False).alias("edited"), "text"))).otherwise(F.array(F.struct(F.lit(False).alias("edited"), "text"), F.struct(F.lit(True).alias("edited"), F.col("e").alias("text"))))).alias("x"),
    ).select(*keys[:-1], "x.edited", "x.text")
    fp = _votes(both, keys, "text")
    pick = lambda f, e: F.max(F.when(F.col("edited") == F.lit(e), F.col(f)))
    wide = fp.groupBy(*keys[:-1]).agg(pick("f0", False).alias("f0"), pick("f1", False).alias("f1"), pick("f0", True).alias("e0"), pick("f1", True).alias("e1"))
    order = Window.partitionBy("part").orderBy("copy", "pos")
    wide = wide.withColumns({"n0": F.lead("f0").over(order), "n1": F.lead("f1").over(order)}).where(~F.col("copy"))
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text("f0", "f1").alias("fingerprint"), fingerprint_text("e0", "e1").alias("edited_fingerprint"),
        likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"), likeness(("f0", "f1"), ("n0", "n1")).alias("near_next"),
    )


def neighbours(marked: DataFrame, queried: Column, radius: int = 3) -> DataFrame:
    """Adds near_count to rows with a fingerprint: for queried rows, the number of rows whose fingerprint is at most
    radius bits from theirs (their own included), else null. Equal fingerprints are searched once."""
    word = lambda at: F.conv(F.substring("fingerprint", at, 8), 16, 10).cast("long")
    half = lambda at: F.shiftleft(word(at), 32).bitwiseOR(word(at + 8))
    rows = marked.withColumn("__asked", F.coalesce(queried, F.lit(False)))
    sizes = freeze(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max("__asked").alias("asked")), "fingerprint-sizes")
    fps = sizes.select(half(17).alias("f0"), half(1).alias("f1"), "n", "asked")
    met = within_radius(fps.where("asked").select("f0", "f1"), fps.select("f0", "f1"), radius, blocks=radius + 1)
    counted = met.join(fps.select("f0", "f1", "n"), ["f0", "f1"]).groupBy("q0", "q1").agg(F.sum("n").alias("near_count"))
    found = freeze(counted.select(fingerprint_text("q0", "q1").alias("fingerprint"), "near_count"), "fingerprint-neighbours")
    joined = rows.join(found, "fingerprint", "left").withColumn("near_count", F.when(F.col("__asked"), F.col("near_count")))
    return joined.select(*marked.columns, "near_count")


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 8) -> DataFrame:
    """All pairs of a query fingerprint and a fingerprint at most radius bits apart, both tables (f0, f1), given
    distinct: q0, q1, f0, f1, distance.

    The 128 bits are cut into blocks. Two fingerprints within the radius agree on at least blocks - radius of them, so
    in one of the tables, each keyed by another choice of so many blocks, they have the same key. A pair is kept only
    in the first table in which it meets, so no distinct is needed.
    """
    if not 0 <= radius < blocks or blocks % 2 or 64 % (blocks // 2):
        raise ValueError("needs radius < blocks, and blocks that divide each half evenly")
    size, per = BITS // blocks, blocks // 2
    mask = F.lit((1 << size) - 1 if size < 64 else -1).cast("long")

    def block(p: str, b: int) -> Column:
        return F.shiftrightunsigned(F.col(f"{p}{b // per}"), (b % per) * size).bitwiseAND(mask)

    tables = list(combinations(range(blocks), blocks - radius))

    def dealt(df: DataFrame, p: str) -> DataFrame:
        keys = F.array(*(F.xxhash64(F.lit(t), *(block(p, b) for b in chosen)) for t, chosen in enumerate(tables)))
        return df.select(f"{p}0", f"{p}1", F.posexplode(keys).alias("t", "key"))

    met = dealt(queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")), "q").join(dealt(fps, "f"), ["t", "key"])
    apart = F.bit_count(F.col("q0").bitwiseXOR(F.col("f0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("f1")))
    first = F.coalesce(*(F.when(_all(block("q", b) == block("f", b) for b in chosen), F.lit(t)) for t, chosen in enumerate(tables)))
    return met.where((apart <= radius) & (F.col("t") == first)).select("q0", "q1", "f0", "f1", apart.alias("distance"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
