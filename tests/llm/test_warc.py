import base64
import hashlib
import random

import pytest

from dialoglake.llm import warc as W
from dialoglake.llm.common import new_path


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(W.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


ROWS = [
    (5, "http://www.Example.com/a b", "<p>é</p>", "z"), (2, "https://example.com:80/a", "<p>é</p>", "z"), (9, None, "x\r\n\r\nWARC/1.1\r\n", "z"), (3, "http://b.org", None, "z"),
    (4, "http://b.org/\n?q#f", "", "z"), (7, "http://a.org/", "<p>é</p>", "z"), (None, "http://a.org/", "lone", "z"), (11, "http://a.org/", "y" * 200_000, "z"), (11, "http://a.org/", "y" * 200_000, "z"), (12, "http://a.org/", "y" * 200_000, "z"),
]


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, record_type string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.archive_and_index(pages, min_bytes).collect()), key=str)
    first = {}
    for i, _, h, _ in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, _ in ROWS:
        raw = (h or "").encode()
        f = first.get(h or "")
        again = len(raw) >= min_bytes and i != f
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert got == sorted(want, key=str)


def test_files_are_valid_records_in_sorted_runs(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, x string")
    path = new_path(spark, "warc-test")
    W.write_warc(pages, path, records_a_file=3)
    files = spark.read.format("binaryFile").load(path).collect()
    records = [list(W.parse_records(bytes(f.content))) for f in files]
    assert sum(map(len, records)) == len(ROWS) and max(map(len, records)) <= 3
    for r, f in zip(records, files):
        assert sum(x[1] for x in r) == len(f.content)
    merged = W.merge_runs(W.read_index(spark, path), partitions=3).collect()
    keys = [(r.url_key or "", r.captured, r.page_id if r.page_id is not None else 1 << 63) for r in merged]
    assert keys == sorted(keys) and len(keys) == len(ROWS)
    assert W.archive_and_index(pages.limit(0)).collect() == []


def test_files_are_bounded_in_bytes(spark):
    rows = [(i, f"http://h.org/{i}", "m" * (2_500_000 + i)) for i in range(9)] + [(100 + i, f"http://h.org/s{i}", "s" * i) for i in range(50)]
    rows += [(200, "http://h.org/again", rows[4][2]), (201, "http://h.org/huge", "h" * 20_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "warc-test")
    W.write_warc(pages, path)
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert max(f.length for f in files) < 21_000_000 and len(files) == 5
    got = {r.page_id: r for r in W.merge_runs(W.read_index(spark, path), partitions=4).collect()}
    assert len(got) == len(rows) and all(got[i].payload_bytes == len(h) for i, _, h in rows)
    assert got[200].record_type == "revisit" and got[200].refers_to == 4


def test_repeats_are_joined_alike_with_and_without_a_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, record_type string")
    want = sorted(map(str, W.archive_and_index(pages).drop("run", "pos", "offset", "place").collect()))
    monkeypatch.setattr(W, "BROADCAST_DIGESTS", -1)
    assert sorted(map(str, W.archive_and_index(pages).drop("run", "pos", "offset", "place").collect())) == want


def test_url_key(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("http://www.Example.com/a?b=1#c",), ("https://m.x.org:8080",), ("plain",)], "u string")
    assert [r[0] for r in df.select(W.url_key(F.col("u"))).collect()] == ["com,example)/a?b=1", "org,x,m)/", "plain)/"]


def test_control_characters_of_urls_are_encoded(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://e.org/a\x01b c\r\nd\x7f\x00\x1fé%", "x")], "page_id long, url string, html string")
    W.write_warc(pages, f"file://{tmp_path}/w")
    lines = spark.read.text(f"file://{tmp_path}/w").collect()
    assert [r[0].strip() for r in lines if "Target" in r[0]] == ["WARC-Target-URI: http://e.org/a%01b%20c%0D%0Ad%7F%00%1Fé%"]
