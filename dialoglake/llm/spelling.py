"""Operator 12, spelling variant grouping by finite-state composition.

Two words are near if one edit (a code point inserted, deleted or replaced) turns one into the other. The pairs are the
paths of a composition: the minimised acceptor of the vocabulary, a transducer with the states "no edit yet" and "edit
made", and the acceptor again. A composed state is (p, edit made, q). While no edit is made p and q are the same state,
for both have read the same letters; after the edit both must read the same letters to the end. Of the equal places in a
run of one letter an insertion takes the last, so every pair has exactly one path.

How it is spread: the composition is cut at its initial states. Words that share a prefix are one partition, whose
prefix grows (1, 2, 4, ... code points) until it holds at most `block_words` words, so a letter that a third of the
vocabulary begins with is dealt out. Within a partition the acceptor of its words is built, minimised and composed. Paths
whose edit lies within a partition's prefix lead out of it: after the edit only the rest of the word is to be read, by
both in the same way, so these meet by a shuffle on what is left when that code point is taken out.

Words are counted per task and combined before the shuffle. No table is broadcast.

Defined results: a null text has no words; a null id is the empty text in the hashed name; repeated rows count as often as
they occur; an empty table, or one without frequent words, gives no rows; other columns are not read. Very long runs are
words like any other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.llm.common import drop_frozen, freeze

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A task's counts are passed on when it holds so many words.
_HELD_WORDS = 200_000


def lowered(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def word_counts(docs: DataFrame, damage: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all documents. Where crc32 of "<doc_id>:<run>" is divisible by `damage`, the run loses its code
    point crc32 % length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        bytes_of: dict[str, bytes] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            bytes_of.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in Counter(_RUN.findall(lowered(t))).items():
                    raw = bytes_of.get(w)
                    if raw is None:
                        raw = bytes_of[w] = w.encode()
                    h = zlib.crc32(raw, start)
                    if h % damage == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    counts[w] += n
                if len(counts) > _HELD_WORDS or len(bytes_of) > _HELD_WORDS:
                    yield flush()
        yield flush()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """Minimal acyclic acceptor of sorted, distinct words. A state is (is final, arcs); equal states are one. words_from
    counts the words that a state accepts, so a word's rank is the sum of what its path passes by."""

    def __init__(self, words: list[str]):
        self.states: list[tuple[bool, tuple[tuple[str, int], ...]]] = []
        self.words_from: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]
        before = ""

        def settle(final: bool, arcs: list[tuple[str, int]]) -> int:
            state = (final, tuple(arcs))
            if state not in known:
                known[state] = len(self.states)
                self.states.append(state)
                self.words_from.append(final + sum(self.words_from[to] for _, to in arcs))
            return known[state]

        for w in [*words, None]:
            same = 0
            if w is not None:
                most = min(len(w), len(before))
                while same < most and w[same] == before[same]:
                    same += 1
            while len(path) - 1 > same:
                done = settle(*path.pop())
                path[-1][1].append((before[len(path) - 1], done))
            if w is not None:
                path += [[False, []] for _ in w[same:]]
                path[-1][0] = True
                before = w
        self.start = settle(*path[0])
        #: For each state, letter -> (state behind it, rank of its first word).
        self.arcs: list[dict[str, tuple[int, int]]] = []
        for final, arcs in self.states:
            at, by = int(final), {}
            for letter, to in arcs:
                by[letter] = (to, at)
                at += self.words_from[to]
            self.arcs.append(by)


class Composition:
    """Acceptor, one-edit transducer, acceptor: pairs of ranks of near words, each pair once."""

    def __init__(self, a: Acceptor):
        self.a = a
        self.rest_of: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _met(self, p: int, q: int, but: str = "") -> list[tuple[str, tuple[int, int], tuple[int, int]]]:
        x, y = self.a.arcs[p], self.a.arcs[q]
        if len(x) > len(y):
            return [(c, x[c], to) for c, to in y.items() if c in x and c != but]
        return [(c, to, y[c]) for c, to in x.items() if c in y and c != but]

    def after_edit(self, p: int, q: int) -> list[tuple[int, int]]:
        """Paths from (p, edit made, q) to the end: ranks of what both accept."""
        if p == q:
            return [(k, k) for k in range(self.a.words_from[p])]
        todo = [(p, q)]
        while todo:
            x = todo[-1]
            if x in self.rest_of:
                todo.pop()
                continue
            met = self._met(*x)
            missing = [(m[0], o[0]) for _, m, o in met if m[0] != o[0] and (m[0], o[0]) not in self.rest_of]
            if missing:
                todo += missing
                continue
            self.rest_of[x] = self._joined(*x, met)
            todo.pop()
        return self.rest_of[p, q]

    def _joined(self, p: int, q: int, met: list) -> list[tuple[int, int]]:
        out = [(0, 0)] if self.a.states[p][0] and self.a.states[q][0] else []
        for _, (to, at), (other, its) in met:
            if to == other:
                out += [(at + k, its + k) for k in range(self.a.words_from[to])]
            else:
                out += [(at + i, its + j) for i, j in self.rest_of[to, other]]
        return out

    def edits_at(self, p: int) -> list[tuple[int, int]]:
        """Paths from (p, no edit yet, p) whose edit is the next arc."""
        out, arcs = [], list(self.a.arcs[p].items())
        for k, (c, (to, at)) in enumerate(arcs):
            for _, (other, its) in arcs[k + 1 :]:
                out += [(at + i, its + j) for i, j in self.after_edit(to, other)]
            # The word with c and the word without: what follows c isn't c again.
            met = self._met(to, p, but=c)
            for _, x, y in met:
                self.after_edit(x[0], y[0])
            out += [(at + i, j) for i, j in self._joined(to, p, met)]
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        edits: dict[int, np.ndarray] = {}
        parts, todo = [np.empty((0, 2), np.int64)], [(self.a.start, 0)]
        while todo:
            p, base = todo.pop()
            if p not in edits:
                edits[p] = np.array(self.edits_at(p), np.int64).reshape(-1, 2)
            if len(edits[p]):
                parts.append(edits[p] + base)
            todo += [(to, base + at) for to, at in self.a.arcs[p].values()]
        both = np.concatenate(parts)
        return both[:, 0], both[:, 1]


def near_in_block(words: list[str], n: np.ndarray, skip: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of sorted words, whose first `skip` code points are the same: ranks with near words here, how many these are, and
    the rank of the most frequent of them (ties: the first)."""
    x, y = Composition(Acceptor([w[skip:] for w in words])).pairs()
    if len(x):
        one, other = np.concatenate([x, y]), np.concatenate([y, x])
        order = np.lexsort((other, -n[other], one))
        one, other = one[order], other[order]
        first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
        yield one[first], np.diff(np.r_[first, len(one)]), other[first]


def _blocks(words: DataFrame, block_words: int) -> DataFrame:
    """(word, n, depth, block): block is the prefix of depth code points that at most block_words words share."""
    rest, done, depth = words, [], 1
    while True:
        dealt = rest.select("word", "n", F.substring("word", 1, depth).alias("block"))
        crowd = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("held"))
        dealt = freeze(dealt.join(crowd, "block").select("word", "n", F.lit(depth).alias("depth"), "block", "held"), "spelling-blocks")
        done.append(dealt.where(F.col("held") <= block_words).drop("held"))
        rest = dealt.where(F.col("held") > block_words)
        if rest.isEmpty():
            break
        depth *= 2
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _near_in_blocks(blocks: DataFrame) -> DataFrame:
    """(word, n_near, best: struct of -n and the word) from the composition within each block."""

    def solve(words: list[str], n: list[int], skip: int) -> Iterator[pa.RecordBatch]:
        for at, many, best in near_in_block(words, np.array(n, np.int64), skip):
            top = pa.StructArray.from_arrays([pa.array([-n[k] for k in best.tolist()], pa.int64()), pa.array([words[k] for k in best.tolist()], pa.string())], ["less", "form"])
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in at.tolist()], pa.string()), pa.array(many, pa.int64()), top], ["word", "n_near", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, n, skip = None, [], [], 0
        for b in batches:
            for w, k, d, x in zip(*(c.to_pylist() for c in b.columns)):
                if x != block:
                    if len(words) > 1:
                        yield from solve(words, n, skip)
                    block, words, n, skip = x, [], [], d
                words.append(w)
                n.append(k)
        if len(words) > 1:
            yield from solve(words, n, skip)

    dealt = blocks.repartition("block").sortWithinPartitions("block", "word")
    return dealt.select("word", "n", "depth", "block").mapInArrow(run, "word string, n_near long, best struct<less: long, form: string>")


def _best(n: str, word: str) -> Column:
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("form")).alias("best")


def _near_across(blocks: DataFrame) -> DataFrame:
    """The same for pairs whose edit lies within the prefix of their blocks: by the word without that code point."""
    at = F.explode(F.sequence(F.lit(0), F.least("depth", F.length("word")) - 1)).alias("at")
    cut = blocks.select("word", "n", at)
    letter = lambda k: F.expr(f"substring(word, at + {k}, 1)")
    cut = cut.select("word", "n", "at", F.expr("concat(substring(word, 1, at), substring(word, at + 2))").alias("rest"), (letter(1) != letter(2)).alias("last_of_run"))
    same = Window.partitionBy("rest", "at")
    down = same.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = cut.select("word", F.count(F.lit(1)).over(same).alias("held"), F.first(_best("n", "word")).over(down).alias("top"), F.nth_value(_best("n", "word"), 2).over(down).alias("second"))
    replaced = held.where("held > 1").select("word", (F.col("held") - 1).alias("n_near"), F.when(F.col("top.form") == F.col("word"), F.col("second")).otherwise(F.col("top")).alias("best"))
    longer = cut.where("last_of_run").select(F.col("word").alias("long_word"), F.col("n").alias("long_n"), F.col("rest").alias("word"))
    met = longer.join(blocks.select("word", "n"), "word")
    one = F.lit(1).cast("long").alias("n_near")
    return replaced.union(met.select("word", one, _best("long_n", "long_word"))).union(met.select(F.col("long_word"), one, _best("n", "word")))


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, damage: int = 199, block_words: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least `shortest` code points and `least` occurrences.
    form: the near word of largest n (ties: the smallest), if its n is at least `factor` times the word's; root: the end
    of the forms' chain, the word itself if it has no form."""
    counts = word_counts(docs, damage, id_col, text_col)
    words = freeze(counts.where((F.length("word") >= shortest) & (F.col("n") >= least)), "spelling-words")
    blocks = _blocks(words, block_words)
    near = _near_in_blocks(blocks).union(_near_across(blocks)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    form_n = -F.col("best.less")
    sure = F.coalesce(form_n >= factor * F.col("n"), F.lit(False))
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(sure, F.col("best.form")).alias("form"), F.when(sure, form_n).alias("form_n"))
    formed = freeze(formed, "spelling-forms")
    # n grows by the factor from form to form, so the longest chain is known; each round doubles the way.
    most = formed.agg(F.max("form_n")).first()[0]
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    chain = max(1, ceil(log(most / least, factor))) if most else 1
    for k in range(ceil(log2(chain))):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, links = links, freeze(links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        if k:
            drop_frozen(before)
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
