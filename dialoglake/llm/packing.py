"""Operator 1, best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Best-fit decreasing places every piece, longest first, into the open sequence with the least room that still takes
it. Pieces of one length are alike, so the plan only needs how many pieces of each length there are: at most
`capacity` numbers, whatever the size of the corpus. A segment tree over the remaining capacities finds the tightest
open class of sequences in logarithmic time; sequences with the same room are handled as runs. The plan (runs of
places per length) is bounded by the capacity alone, so it is safe to broadcast. Spark then numbers the pieces of
each length, in salted groups of about a million pieces, so that one length may hold any share of the rows, and every
task looks up places. Pieces as long as a sequence fill one each and are not numbered at all.

Defined results: a null or empty text is one piece with the end id only; documents longer than a sequence are cut
into full pieces, the last may be shorter; repeated rows and repeated or null ids are packed as documents of their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.llm.common import freeze

PIECES_A_GROUP = 1_000_000
CACHE_WORDS = 600_000
_worker: dict[str, object] = {}


class _RoomTree:
    """Segment tree over remaining capacities 0..size: how many open sequences have that room."""

    def __init__(self, size: int):
        self.n = 1 << (size + 1).bit_length()
        self.sums = [0] * (2 * self.n)

    def add(self, room: int, count: int) -> None:
        i = room + self.n
        while i:
            self.sums[i] += count
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least need that an open sequence has."""
        i = need + self.n
        if self.sums[i]:
            return need
        while i > 1:
            if not i & 1 and self.sums[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Piece counts by length -> runs (length, first rank, pieces per sequence, first sequence, offset) in order of
    length and rank, and the number of sequences. Piece r of a run goes to sequence first + r // per, at offset +
    (r % per) * length."""
    tree, runs_of, runs, opened = _RoomTree(capacity), {}, [], 0

    def put_back(room: int, first: int, n: int) -> None:
        if n and room:
            tree.add(room, n)
            runs_of.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = runs_of[room].pop()
                tree.add(room, -n)
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, per, first, capacity - room))
                put_back(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            used = full
            if left and used < n:
                runs.append((length, rank, per, first + used, capacity - room))
                put_back(room - left * length, first + used, 1)
                used, left = used + 1, 0
            put_back(room, first + used, n - used)
    runs.sort()
    return runs, opened


def _tokenizer(path: str):
    if "tokenizer" not in _worker:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _worker["tokenizer"] = Tokenizer.from_file(path)
    return _worker["tokenizer"]


#: Words that are encoded as one text, and the control character between them.
WORDS_AT_ONCE = 500
_BETWEEN = b"\x01"


def _encode_words(words: set[bytes], path: str, cache: dict[bytes, bytes]) -> None:
    """Adds the ids of these words, as little-endian 32-bit numbers, to the cache. The tokenizer never joins
    characters across a blank, so a text's ids are its words' ids in a row. Many words with a mark between them cost about
    half of what they cost one by one; where a word holds the mark itself, or it isn't one id, they are taken one by one."""
    new, tokenizer = list(words), _tokenizer(path)
    encode = lambda texts: [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    mark = encode([_BETWEEN])[0]
    for i in range(0, len(new), WORDS_AT_ONCE):
        some = new[i : i + WORDS_AT_ONCE]
        ids = encode([(b" " + _BETWEEN + b" ").join(some)])[0]
        at = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else mark
        if len(at) == len(some) - 1:
            raw, ends = ids.tobytes(), (4 * at).tolist()
            cache.update(zip(some, (raw[a:b] for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)]))))
        else:
            cache.update((w, x.tobytes()) for w, x in zip(some, encode(some)))


def _words(text: str, special: list[bytes]) -> list[bytes]:
    """The words of a text, A-Z lower-cased as the tokenizer does itself, so that a word has one entry. It looks for its
    special tokens in the text as it stands, so words that hold one, in whatever case, stay as they are."""
    raw = text.encode().replace(b"\n", b" ")
    low = raw.lower()
    if not any(x in low for x in special):
        return low.split(b" ")
    return [w if any(x in w.lower() for x in special) else w.lower() for w in raw.split(b" ")]


def token_bytes(texts: list[str | None], path: str, end_id: int) -> Iterator[bytes]:
    """Each text's ids and the end id, as little-endian 32-bit numbers."""
    cache: dict[bytes, bytes] = _worker.setdefault("cache", {})
    special = [t.content.encode().lower() for t in _tokenizer(path).get_added_tokens_decoder().values()]
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 200
    for i in range(0, len(texts), step):
        split = [_words(t or "", special) for t in texts[i : i + step]]
        new = set().union(*split).difference(cache)
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = set().union(*split)
        if new:
            _encode_words(new, path, cache)
        for words in split:
            yield b"".join(map(cache.__getitem__, words)) + end


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity tokens: PIECES, and with keep_ids also their ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, raw in zip(b.column(0).to_pylist(), token_bytes(b.column(1).to_pylist(), tokenizer_path, end_id)):
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    for c, v in zip(cols, row):
                        c.append(v)
                    if keep_ids:
                        cols[5].append(np.frombuffer(part, "<u4").astype(np.int32))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types)], names[:n])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces with length and at (a number of the row). Sequences of
    one full piece have negative numbers."""
    # At most capacity rows, whatever the corpus holds.
    totals = {r["length"]: r["count"] for r in pieces.where(F.col("length") < capacity).groupBy("length").count().collect()}
    runs, _ = plan_best_fit(totals, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(runs)
    names = [c for c in pieces.columns if c != "at"]
    full = pieces.where(F.col("length") == capacity).select(*names, (-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salts = 1 + sum(totals.values()) // PIECES_A_GROUP
    salted = pieces.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = groups.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("at")) - 1)
    numbered = ranked.join(before, ["length", "salt"]).select(*names, (F.col("base") + F.col("rank")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "at") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        starts = [r[:2] for r in runs]
        for b in batches:
            seqs, offsets = [], []
            for length, rank in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("length", "rank"))):
                _, first_rank, per, first, offset = runs[bisect_right(starts, (length, rank)) - 1]
                q, r = divmod(rank - first_rank, per)
                seqs.append(first + q)
                offsets.append(offset + r * length)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Best-fit packing of whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut = cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids)
    return place_pieces(freeze(cut.withColumn("at", F.monotonically_increasing_id()), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids (array of int), n_tokens. A sequence
    holds at most `capacity` tokens, so a group is bounded."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))
