import base64
import glob
import gzip
import hashlib
from collections import defaultdict

import pytest

from lexspan.llm import scratch, warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        last = max((x for x in groups[body] if x is not None), default=None)
        refers = last if len(groups[body]) > 1 and last is not None and i != last else None
        out.append((i, len(body), digest(body), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a.example.com/x?q=1", "<p>same</p>"), (2, "http://a.example.com/x?q=1", "<p>same</p>"), (3, "https://B.example.org", None),
    (4, None, ""), (5, "nonsense url with spaces\r\nInjected: yes", "é😀\r\n\r\nbody"), (6, "http://[bad", "z"), (6, "http://[bad", "z"), (None, "http://c.example.com", "alone"),
    *((100 + i, "http://same.example.com/", "<p>same</p>") for i in range(2500)),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, key string")
    out = warc.archive(df, scratch.mounted_folder(spark, "t"))
    got = out.collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(ROWS)
    texts = {i: h or "" for i, _, h in ROWS}
    assert all(r.html == texts[r.page_id] for r in got if r.record_type == "response")


def test_real_pages_and_plain_records(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    folder = scratch.mounted_folder(spark, "t")
    out = warc.archive(pages, folder)
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted([tuple(r)[:5] for r in out.collect()], key=str) == brute(rows)
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder}/archive/*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\n") == len(rows)


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive(df, scratch.mounted_folder(spark, "t"), least=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_attempts_write_files_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a", hashlib.sha1(b"a").hexdigest(), None)], "page_id long, url string, html string, digest string, refers_to long")
    first = warc.write_archives(df, str(tmp_path / "a")).collect()
    before = {r.file: open(r.file, "rb").read() for r in first}
    again = warc.write_archives(df, str(tmp_path / "a")).collect()
    assert not {r.file for r in first} & {r.file for r in again}
    assert all(open(f, "rb").read() == data for f, data in before.items())


def test_batches_are_cut_by_bytes(spark):
    """40 payloads of 1 MB come back in batches of about 8 MB."""
    rows = [((i,), 1 << 20) for i in range(40)]
    sizes = [b.num_rows for b in warc._batches(iter(rows), {"i": warc.pa.int64()})]
    assert sum(sizes) == 40 and max(sizes) <= 8
    df = spark.range(12).selectExpr("id as page_id", "concat('http://h', id) as url", "repeat(chr(65 + id), 1000000) as html")
    got = warc.archive(df.coalesce(1), scratch.mounted_folder(spark, "t")).collect()
    assert sorted((r.page_id, len(r.html)) for r in got) == [(i, 1_000_000) for i in range(12)]


def test_hot_digests_get_keys_of_their_own(spark):
    """All but a few pages share a payload; groups below the hot share go through the other join."""
    rows = [(i, f"u{i}", "hot" if i > 3 else "cold") for i in range(3000)]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch.mounted_folder(spark, "t"), texts=False)
    got = out.collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows) and all(r.html is None for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(df, scratch.mounted_folder(spark, "t")).count() == 0


def test_keys_and_damage():
    assert warc.url_key("https://WWW.Example.com:8080/A/b?C=d#e") == "com,example,www:8080)/a/b?c=d"
    member = warc.record(1, "u", b"body", digest(b"other"), None)
    assert digest(warc.parse(member)["payload"]) != warc.parse(member)["WARC-Payload-Digest"].removeprefix("sha1:")


@pytest.mark.parametrize("n", [1, 3500])
def test_lookup_reads_one_block(spark, tmp_path, n):
    lines = spark.createDataFrame([(f"com,h{i:05d})/", i, "f", i, 1) for i in range(n)], "key string, page_id long, file string, at long, size long")
    parts = sorted((r.key, r.id, r.part) for r in warc.write_index(lines, str(tmp_path / "i")).collect())
    index = warc.CaptureIndex(parts)
    assert index.find(f"com,h{n - 1:05d})/", n - 1) == [("f", n - 1, 1)] and index.blocks_read == 1
    assert index.find("com,none)/", 1) == []
