"""Operator 5, substring dedup by content-defined chunking with a gear rolling hash.

A text is cut after a blank where the gear hash of the last 16 bytes is low, so about every fifth word. Where no blank
stands in the last 32 bytes, as in scripts without blanks or long codes, any character may be cut at where the hash is
lower than at the 15 bytes before, about every 16 bytes; so a byte or short pattern that goes on and on, whichever it
is, is one chunk. A cut depends on the 32 bytes before it alone, and none is forced: text inserted before a passage
moves no cut inside it beyond the first few. Chunks are compared by a 128-bit digest. Of equal chunks the one in the
document with the smallest id stays, in its first place there; runs of neighbouring chunks that repeat an earlier one
and have at least `min_words` words are removed. Bytes without a blank in the 32 before them count as a word for eight.

Scale: texts are cut where they are read (twice, which is cheaper than storing all chunks). Chunk rows are shuffled by
digest once to find repeated digests (counts are combined first, so a digest that a third of all documents hold is one
row per task) and once to meet them (a join that the adaptive planner can split on a hot digest); only
repeated chunks are then gathered per document.

Defined results: null text stays null and has no chunks; rows with equal ids are parts of one document and
are not removed against each other, except that each row loses its own repeats; null ids come last;
repeated rows have the same spans; an empty table gives no rows; other columns are kept by `remove_repeats` and not
read by `repeated_spans`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.llm.common import drop_frozen, freeze, row_of

WINDOW = 16
UNBROKEN = 32
_LAST = (1 << 63) - 1
_GEAR = np.random.default_rng(2024).integers(0, 1 << 16, 256, dtype=np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _unbroken(blank: np.ndarray) -> np.ndarray:
    """Which bytes have UNBROKEN bytes and no blank before them."""
    seen = np.concatenate([[0], np.cumsum(blank)])
    out = np.zeros(len(blank), bool)
    out[UNBROKEN:] = seen[UNBROKEN:-1] == seen[: -1 - UNBROKEN]
    return out


def _lower_than_before(h: np.ndarray) -> np.ndarray:
    """Where a hash is lower than each of the WINDOW - 1 before it."""
    out = np.ones(len(h), bool)
    out[: WINDOW - 1] = False
    for k in range(1, WINDOW):
        out[k:] &= h[k:] < h[:-k]
    return out


def cuts(raw: bytes) -> np.ndarray:
    """Ends of the chunks of a text, in bytes; the last is its length."""
    b = np.frombuffer(raw, np.uint8)
    g = _GEAR[b]
    h = g.copy()
    for k in range(1, min(WINDOW, len(b))):
        h[k:] += g[:-k] << np.uint16(k)
    blank = _SPACE[b]
    ends = np.flatnonzero(blank & (h < 65536 // 5)) + 1
    if len(b) > UNBROKEN:
        inside = _unbroken(blank) & ((b & 0xC0) != 0x80)
        if inside.any():
            inside[1:] &= _lower_than_before(h)[:-1]
            ends = np.union1d(ends, np.flatnonzero(inside))
    return np.append(ends[(ends > 0) & (ends < len(b))], len(b)).astype(np.int64)


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests (n x 2 longs) of a text's chunks, where each stands (first code point << 32 | code points << 1 | 1 if no
    chunk before it in this text is equal), and how many words each has."""
    ends = cuts(raw)
    starts = np.concatenate([[0], ends[:-1]])
    b = np.frombuffer(raw, np.uint8)
    digests = [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
    seen: set[bytes] = set()
    first = np.array([not (d in seen or seen.add(d)) for d in digests], dtype=np.int64)
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    blank = _SPACE[b]
    eighths = 8 * (~blank & np.concatenate([[True], blank[:-1]])) + (_unbroken(blank) & ~blank if len(b) > UNBROKEN else 0)
    words = np.concatenate([[0], np.cumsum(eighths) // 8])
    place = chars[starts] << 32 | (chars[ends] - chars[starts]) << 1 | first
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), place.astype(np.int64), (words[ends] - words[starts]).astype(np.int64)


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _chunk_rows(docs: DataFrame, id_col: str, text_col: str, with_place: bool) -> DataFrame:
    names = ["doc", "row", "d0", "d1", "place", "words"] if with_place else ["doc", "d0", "d1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_, rows, texts = (c.to_pylist() for c in b.columns)
            step = 500
            for at in range(0, len(texts), step):
                kept = [(d, r, *chunks(t.encode())) for d, r, t in zip(docs_[at : at + step], rows[at : at + step], texts[at : at + step]) if t]
                if not kept:
                    continue
                sizes = [len(x[3]) for x in kept]
                digest = np.concatenate([x[2] for x in kept])
                cols = [np.repeat([x[0] for x in kept], sizes), digest[:, 0], digest[:, 1]]
                if with_place:
                    cols = [cols[0], np.repeat([x[1] for x in kept], sizes), *cols[1:], np.concatenate([x[3] for x in kept]), np.concatenate([x[4] for x in kept])]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in cols], names)

    picked = docs.select(_key(id_col).alias("doc"), _row(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return picked.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_spans(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans to remove, one row each: doc_id, row (hash of id and text), start and length (code points), n_words,
    first_doc_id (the smallest id of a document that keeps one of the span's chunks)."""
    return _spans(docs, _repeated_chunks(docs, id_col, text_col), min_words, id_col, text_col)


def _repeated_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d0, d1, keeper) of the chunks that there are several of, stored."""
    once = _chunk_rows(docs, id_col, text_col, with_place=False)
    return freeze(once.groupBy("d0", "d1").agg(F.min("doc").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-chunks")


def _spans(docs: DataFrame, known: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    every = _chunk_rows(docs, id_col, text_col, with_place=True)
    first = F.col("place").bitwiseAND(1) == 1
    again = every.join(known, ["d0", "d1"]).where((F.col("doc") != F.col("keeper")) | ~first)
    start, chars = F.shiftright("place", 32), F.shiftright("place", 1).bitwiseAND(0x7FFFFFFF)
    again = again.select("doc", "row", "keeper", start.alias("start"), (start + chars).alias("end"), "words")
    w = Window.partitionBy("doc", "row").orderBy("start")
    # A row that is there twice has each chunk twice; the second is dropped here.
    again = again.withColumn("before", F.lag("start").over(w)).where("before is null or before <> start")
    runs = again.withColumn("new", F.coalesce((F.col("start") != F.lag("end").over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.min("keeper").alias("keeper"))
    null_last = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return spans.where(F.col("n_words") >= min_words).select(
        null_last("doc").alias("doc_id"), "row", "start", (F.col("end") - F.col("start")).alias("length"), "n_words", null_last("keeper").alias("first_doc_id")
    )


def remove_repeats(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs with the repeated spans cut out of the text; all other columns as they were. drop_emptied leaves out rows
    of whose text nothing stays."""
    known = _repeated_chunks(docs, id_col, text_col)
    spans = _spans(docs, known, min_words, id_col, text_col)
    cut = spans.groupBy(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.col("row").alias("hash")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("cut"))
    # Stored, so that the shuffles of the chunks are gone before that of the texts begins.
    cut = freeze(cut, "repeated-spans")
    drop_frozen(known)
    rows = docs.select(_key(id_col).alias("doc"), _row(id_col, text_col).alias("hash"), F.col(text_col).alias("text"), row_of(docs))
    joined = rows.join(cut, ["doc", "hash"], "left")
    # What stays between the cut spans, joined again.
    n = F.size("cut")
    begin = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("cut", i - 1)["start"] + F.get("cut", i - 1)["length"])
    end = lambda i: F.when(i == n, F.length("text").cast("long")).otherwise(F.get("cut", i)["start"])
    left = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(F.col("text"), (begin(i) + 1).cast("int"), (end(i) - begin(i)).cast("int")))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(left, ""))
    if drop_emptied:
        joined = joined.where(F.col("cut").isNull() | (text != ""))
    return joined.select(*((text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
