"""Operator 8, WARC archives with revisit records, and capture histories by external index merge.

Writing: payloads are compared by SHA-1; of equal ones the smallest id becomes a response record, the others revisit
it. Only digests that occur twice or more are joined to the pages, by a broadcast while they are few, so payloads are
shuffled only if repeats are many. Every task sorts its records by URL key and time and writes them as WARC/1.1 through Spark's writer (a record is a
row, the blank lines between records are the line separator), so each file is one locally sorted capture run and a
lost task leaves nothing behind. Files are bounded in bytes: pages of like size are written together, as many to a
file as 64 MB take. Reading: files are parsed by their Content-Length; a response's digest and
size are taken from the payload read, a revisit's from its header and the HTTP head that it repeats.

Histories: index entries are dealt by ranges of (URL key, time, id), as many ranges as keep each at about 200,000
entries; inside a range the runs that reach it are merged by a loser tree. A host or URL may hold any share of the captures, as ranges end anywhere in the triple.

Defined results: null html is the empty payload; a null URL has no target line and comes first; blanks and control
characters of a URL are percent-encoded; several rows of the smallest id are all responses; null ids come last; repeated
rows are records of their own; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglake.llm.common import drop_frozen, freeze, new_path, shuffles_end_here

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z, the first capture
_SPAN = 315_360_000
_CRLF = "\r\n"
INDEX = "run string, pos long, url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, record_bytes long"
_FIELDS = [x.split()[0] for x in INDEX.split(", ")]


def _base32(hex40: Column) -> Column:
    """Base32 of 40 hex digits: every five digits are four characters."""
    out = []
    for g in range(8):
        v = F.conv(F.substring(hex40, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), (F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1), F.lit(1)) for k in range(4)]
    return F.concat(*out)


def url_key(url: Column) -> Column:
    """Sort key: host labels reversed, then the path, lower-cased; scheme, port, www and fragment don't count."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r":\d*$", ""), r"^www\d*\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(F.regexp_extract(rest, r"^[^/?]*(.*)$", 1) == "", "/").otherwise(F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)))


#: Most payload bytes of a page and pages to a file.
FILE_CLASSES = [(32 << 10, 2_000), (1 << 20, 60), (16 << 20, 4), (1 << 62, 1)]
#: Repeated digests (36 bytes each) that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_DIGESTS = 500_000
ENTRIES_A_RANGE = 200_000


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records_a_file: int = 2_000) -> None:
    """Writes a WARC record for every row of pages (page_id, url, html) to files under path. Captures are dated by
    page_id, a second apart, as pages have no time of their own."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    digests = freeze(p.groupBy(F.unhex("sha").alias("digest"), "bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "warc-digests")
    repeated = digests.where("n > 1").select("digest", "first_id", F.lit(True).alias("again"))
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_DIGESTS else repeated
    j = p.withColumn("digest", F.unhex("sha")).join(side, "digest", "left")
    revisit = F.coalesce("again", F.lit(False)) & (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    date = F.date_format(F.timestamp_seconds(F.coalesce(F.pmod("page_id", F.lit(_SPAN)), F.lit(0)) + _EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    url = F.col("url")
    for c in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    url = F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), url).otherwise(F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    record = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", urn("page_id")), line("WARC-Date", date),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("sha")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("first_id")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(_CRLF), block,
    )
    runs = j.select(record.alias("value"), "bytes", url_key(url).alias("k"), date.alias("t"), "page_id")
    largest = digests.agg(F.max("bytes")).first()[0] or 0
    least = -1
    for most, records in FILE_CLASSES:
        of_class = digests.where((F.col("bytes") > least) & (F.col("bytes") <= most))
        if least < 0 or (largest > least and not of_class.isEmpty()):
            run = runs.where((F.col("bytes") > least) & (F.col("bytes") <= most)).sortWithinPartitions("k", "t", "page_id").select("value")
            with shuffles_end_here(pages.sparkSession):
                run.write.mode("append").option("lineSep", _CRLF * 2).option("maxRecordsPerFile", min(records, records_a_file)).text(path)
        least = most
    drop_frozen(digests)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        m = _HEAD.match(data, at)
        if not m:
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in m[1].decode().split(_CRLF) if x)}
        end = m.end() + int(head["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where it should")
        yield at, end + 4 - at, head, data[m.end() : end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    v = urn[len("<urn:page:") : -1] if urn else "none"
    return None if v == "none" else int(v)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records under path, in INDEX; url_key is null where a record has no target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for pos, (offset, size, head, block) in enumerate(parse_records(content.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if head["warc-type"] == "revisit":
                        n, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), head["warc-payload-digest"].removeprefix("sha1:")
                    else:
                        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if "sha1:" + digest != head["warc-payload-digest"]:
                            raise ValueError(f"{name}: payload at byte {offset} doesn't have its digest")
                    rows.append((name, pos, head.get("warc-target-uri"), head["warc-date"], _page(head["warc-record-id"]), head["warc-type"], _page(head.get("warc-refers-to")), n, digest, offset, size))
                cols = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (0, 2, 3, 5, 8) else pa.int64()) for k, c in enumerate(cols)], _FIELDS)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX).withColumn("url_key", url_key(F.col("url_key")))


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so the next winner costs one path of log k matches."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0 and building:
                self.tree[node] = i
                return
            if other >= 0 and self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def merge_runs(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """Stored index entries of many runs -> the same entries in the global order of (url_key, captured, page_id):
    partitions follow each other, and `place` counts inside a partition. A task holds one partition's entries, about
    ENTRIES_A_RANGE at most whatever the size of the index, and no payloads."""
    n = partitions or max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // ENTRIES_A_RANGE))
    order = [F.coalesce("url_key", F.lit("")), F.col("captured"), F.coalesce("page_id", F.lit((1 << 63) - 1)), F.col("run"), F.col("pos")]
    dealt = index.repartitionByRange(n, *order).sortWithinPartitions("run", "pos")
    names = [*index.columns, "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        keys = [t.column(c) for c in ("url_key", "captured", "page_id")]
        names_of_run = t.column("run").to_pylist()
        starts = [i for i in range(len(names_of_run)) if not i or names_of_run[i] != names_of_run[i - 1]]

        def entries(a: int, z: int) -> Iterator:
            for i in range(a, z):
                u, c, p = (k[i].as_py() for k in keys)
                yield u or "", c, (1 << 63) - 1 if p is None else p, i

        merged = [e[3] for e in LoserTree([entries(a, z) for a, z in zip(starts, [*starts[1:], len(names_of_run)])])]
        for at in range(0, len(merged), 10_000):
            part = t.take(pa.array(merged[at : at + 10_000])).append_column("place", pa.array(range(at, min(at + 10_000, len(merged))), pa.int64()))
            yield from part.combine_chunks().to_batches()

    return dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema) + ", place long").select(*names)


def archive_and_index(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC files in the shared folder, reads them back and merges their indexes; see merge_runs."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_bytes)
    return merge_runs(freeze(read_index(pages.sparkSession, path), "warc-index"))
