"""One giant JSON array read by many tasks.

Spark's text reader cuts a file into byte ranges and gives whole records up to a separator; with `}` as the separator an
array on a single line is cut as well as one of many lines. A first pass tells for each range, without knowing where it
begins, what it does to the state: it counts brackets and commas for both cases, begun inside a string or outside. From
one small row per range the driver adds these up to the state at each range's start: inside a string or not, depth, and
number of the element. A second pass then cuts the elements; what a range's ends leave open is joined by element number.

The driver holds one row per range (128 MB by default, so 8,000 rows per TB).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoglake.storage import stored

_SIGNS = re.compile(r'\\.|["{}\[\],]', re.S)
_DONE = re.compile(r'(?:[}\]"0-9]|true|false|null)\Z')


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.octet_length("value").cast("long").alias("bytes"), "value")


def _by_range(batches: Iterator[pa.RecordBatch], begin: Callable, step: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Runs begin(file, block, size), step(state, bytes, text) and end(state) over each range's records, which come in order."""
    key, state = None, None
    for b in batches:
        for file, block, size, n, text in zip(*(c.to_pylist() for c in b.columns)):
            if (file, block) != key:
                if state is not None:
                    yield from end(state)
                key, state = (file, block), begin(file, block, size)
            out = step(state, n, text)
            if out is not None:
                yield out
    if state is not None:
        yield from end(state)


class _Effect:
    """What a range does to the state; index 0 of each pair: if it begins outside a string, 1: inside."""

    def __init__(self, file: str, block: int, size: int):
        self.file, self.block, self.size, self.bytes = file, block, size, 0
        self.parity, self.depth, self.commas = 0, [0, 0], [Counter(), Counter()]
        self.first: str | None = None

    def read(self, n: int, text: str) -> None:
        self.bytes += n + 1
        if self.first is None and self.block == 0:
            self.first = (text.lstrip("\ufeff \t\r\n") + "}")[0]
            if self.first != "[":
                raise ValueError(f"no JSON array: {self.file}")
        for m in _SIGNS.finditer(text + "}"):
            c, p = m.group()[0], self.parity
            if c == '"':
                self.parity ^= 1
            elif c in "{[":
                self.depth[p] += 1
            elif c in "}]":
                self.depth[p] -= 1
            elif c == ",":
                self.commas[p][self.depth[p]] += 1

    def row(self) -> pa.RecordBatch:
        commas = pa.array([[list(c.items()) for c in self.commas]], pa.list_(pa.map_(pa.int64(), pa.int64())))
        values = [pa.array([x], pa.string() if k == 0 else pa.int64()) for k, x in enumerate((self.file, self.block, self.size, self.bytes, self.parity))]
        return pa.RecordBatch.from_arrays([*values, pa.array([self.depth], pa.list_(pa.int64())), commas], ["file", "block", "size", "bytes", "parity", "depth", "commas"])


def _starts(rows: list) -> dict[tuple[str, int], tuple[int, int, int, bool]]:
    """(inside a string, depth, element number, last record has no separator) at the start of each range."""
    found, by_file = {}, {}
    for r in rows:
        by_file.setdefault(r["file"], []).append(r)
    for file, ranges in by_file.items():
        inside = depth = element = 0
        ranges.sort(key=lambda r: r["block"])
        # Every record is taken to end in a separator; one byte too many means that the last one doesn't (the reader
        # leaves out a byte order mark of three).
        bare = sum(r["bytes"] for r in ranges) - ranges[0]["size"] in (1, -2)
        for r in ranges:
            found[file, r["block"]] = (inside, depth, element, bare and r is ranges[-1])
            element += r["commas"][inside].get(1 - depth, 0)
            depth += r["depth"][inside]
            inside ^= r["parity"]
    return found


class _Cutter:
    """Cuts the elements of a range, from its state at the start."""

    def __init__(self, file: str, block: int, start: tuple[int, int, int, bool]):
        self.file, self.block = file, block
        self.inside, self.depth, self.element, self.bare = start
        self.running = self.depth > 0  # the first element began before
        self.text: list[str] = []
        self.ended = False
        self.held: str | None = None
        self.out: list[tuple] = []

    def read(self, text: str) -> pa.RecordBatch | None:
        if self.held is not None:
            self._scan(self.held + "}")
        self.held = text
        return self._flush() if len(self.out) >= 1_000 else None

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            self._scan(self.held + ("" if self.bare else "}"))
        if self.depth > 0 and not self.ended:
            text = "".join(self.text)
            done = self.depth == 1 and not self.inside and bool(_DONE.search(text.rstrip()))
            self.out.append((self.file, self.element, self.block, False, False, done, text))
        if self.out:
            yield self._flush()

    def _close(self, text: str) -> None:
        self.text.append(text)
        self.out.append((self.file, self.element, self.block, not self.running, True, True, "".join(self.text)))
        self.running, self.text = False, []

    def _scan(self, text: str) -> None:
        if self.ended:
            return
        at = 0
        for m in _SIGNS.finditer(text):
            c = m.group()[0]
            if c == '"':
                self.inside ^= 1
            elif self.inside:
                continue
            elif c in "{[":
                self.depth += 1
                if self.depth == 1:
                    at = m.end()
            elif c in "}]":
                self.depth -= 1
                if self.depth == 0:
                    self._close(text[at : m.start()])
                    self.ended = True
                    return
            elif c == "," and self.depth == 1:
                self._close(text[at : m.start()])
                self.element += 1
                at = m.end()
        if self.depth > 0:
            self.text.append(text[at:])

    def _flush(self) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*self.out), kinds)]
        self.out = []
        return pa.RecordBatch.from_arrays(columns, ["file", "element", "block", "whole", "closed", "done", "text"])


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element: number from 0, text) of the arrays in the files; of a truncated array, the elements that are
    complete. What follows the array is ignored; a file that begins with anything else is an error."""
    pieces = _pieces(spark, path)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_range(batches, _Effect, lambda s, n, text: s.read(n, text), lambda s: [s.row()])

    schema = "file string, block long, size long, bytes long, parity long, depth array<long>, commas array<map<long, long>>"
    starts = _starts(pieces.mapInArrow(effects, schema).collect())
    shared = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_range(batches, lambda file, block, _: _Cutter(file, block, shared.value[file, block]), lambda s, n, text: s.read(text), lambda s: s.end())

    parts = stored(pieces.mapInArrow(cut, "file string, element long, block long, whole boolean, closed boolean, done boolean, text string"), "json-elements")
    whole = parts.where("whole").select("file", "element", "text")
    # The open ends of ranges: an element lies in few of them unless it is itself larger than a range.
    ends = parts.where("not whole").groupBy("file", "element").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("x"), F.bool_or("closed").alias("closed"), F.max_by("done", "block").alias("done"))
    joined = ends.where("closed or done").select("file", "element", F.array_join(F.transform("x", lambda p: p["text"]), "").alias("text"))
    return whole.unionByName(joined).where(F.trim(F.col("text"), F.lit(" \t\r\n")) != "")


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of the JSON arrays in the files, one array a file, each file as many tasks as it has ranges."""
    rows = elements(spark, path).select(F.from_json("text", schema).alias("x"))
    return rows.where("x is not null").select("x.*")
