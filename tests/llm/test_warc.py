"""WARC archives as exact round trips, with payloads of one chunk and of many."""

import base64
import gzip
import hashlib
import glob

import pytest

from winnowry.llm import warc_records
from winnowry.session import scratch_path

SMALL = "/root/testdata/sf0.001"
TEXT = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>"


def plain(rows):
    """Expected rows, as a sorted list of tuples; of records that equal each other in key too, one is the response."""
    groups = {}
    for key, html in rows:
        groups.setdefault((html or "").encode(), []).append(key)
    out = []
    for data, keys in groups.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        keys = sorted(keys, key=lambda k: (k is not None, k or 0))
        out += [(k, len(data), digest, "revisit", keys[-1]) for k in keys[:-1]] + [(keys[-1], len(data), digest, "response", None)]
    return sorted(out, key=repr)


def shown(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_records_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    copies = pages.filter("page_id % 3 = 0").withColumn("page_id", pages.page_id + 1000)
    both = pages.unionByName(copies)
    got = shown(warc_records.op13_warc_records(both))
    assert got == plain([(r["page_id"], r["html"]) for r in both.collect()])
    assert warc_records.op13_warc_records(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "http://a b/é\n", TEXT), (2, None, TEXT), (2, None, TEXT), (3, "u", None), (4, "u", ""), (None, "u", ""), (None, None, "x"), (None, "v", "x"),
        (5, "u", TEXT * 900), (6, "u", TEXT * 900), (7, "u", "ab" * 64), (8, "u", "ab" * 64 + "a"), (9, "u", "\r\n\r\n"),
    ]
    return spark.createDataFrame([(*r, 1, b"2", "3") for r in rows], "page_id bigint, url string, html string, r int, data binary, key string")


def test_odd_pages(odd):
    assert shown(warc_records.op13_warc_records(odd)) == plain([(r["page_id"], r["html"]) for r in odd.collect()])


def test_oversized_payloads_in_segments(spark, odd):
    path = scratch_path(spark, "warc-test")
    warc_records.write_archives(odd, path, "page_id", "url", "html", chunk=64)
    found = warc_records.summary(spark, path)
    got = shown(found.selectExpr("cast(key as bigint)", "size", "digest", "kind", "cast(refers_to as bigint)"))
    assert got == plain([(r["page_id"], r["html"]) for r in odd.collect()])
    files = [gzip.open(f).read() for f in glob.glob(f"{path}/*.gz")]
    text = b"".join(files)
    assert all(f.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and f.endswith(b"\r\n\r\n") for f in files)
    assert text.count(b"\r\nWARC-Type: continuation\r\n") > 500 and text.count(b"WARC-Segment-Total-Length: ") == 4 - 1
    # No row of the record table is larger than a chunk, and each has the digest of what came before.
    chunks = warc_records.chunk_table(odd.filter("page_id = 5"), "page_id", "url", "html", 64).orderBy("chunk").collect()
    upto = hashlib.sha1()
    for c in chunks:
        upto.update(c["data"])
        assert len(c["data"]) <= 64 and c["sha1"] == upto.digest()
    assert chunks[-1]["last"] and chunks[-1]["upto"] == len((TEXT * 900).encode())


def test_revisits_only_from_a_size_on(spark, odd):
    path = scratch_path(spark, "warc-test")
    warc_records.write_archives(odd, path, "page_id", "url", "html", least_bytes=10)
    kinds = [(r["size"], r["kind"]) for r in warc_records.summary(spark, path).collect()]
    assert all(k == "response" for n, k in kinds if n < 10) and any(k == "revisit" for _, k in kinds)


def test_broken_and_plain_files():
    whole = warc_records._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>")], b"HTTP/1.1 200 OK\r\n\r\nabc") * 2
    for content in (whole, gzip.compress(whole), gzip.compress(whole[: len(whole) // 2]) + gzip.compress(whole[len(whole) // 2 :])):
        for piece in (1, 7, 1 << 18):
            found = [(f["warc-type"], b"".join(warc_records._payload(p, True))) for f, p in warc_records._records(content, piece)]
            assert found == [("response", b"abc")] * 2
    with pytest.raises(ValueError):
        [list(p) for _, p in warc_records._records(whole[:-6], 7)]
    with pytest.raises(ValueError):
        [list(p) for _, p in warc_records._records(b"HTTP/1.1\r\n\r\n", 7)]
