import gzip
import hashlib
from glob import glob

import pytest
from pyspark.sql import functions as F

from callweave.llm import warc

BIG = "é" * 700
ROWS = [
    (1, "http://a/1", BIG), (5, "http://b\r\nX: y", BIG), (3, None, BIG), (7, "u", None), (8, "u", ""), (9, "u", "short"), (10, "u", "short"),
    (None, "u", BIG), (5, "http://b", BIG), (11, "u", "\r\n\r\n" * 500), (12, "u", "x" * 999), (13, "u", "x" * 999), (14, "u", "y" * 1000),
    (15, "u", "y" * 1000), (16, "u", "\x00\x1f\x8b" * 400), (17, "u", "long " * 400_000),
]


def brute(rows):
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == payload and k is not None]
        original = max(same) if len(payload) >= 1000 and key is not None else key
        out.append((key, len(payload), hashlib.sha1(payload).hexdigest(), original))
    return out


@pytest.fixture
def captures(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string").withColumn("payload_digest", F.lit("clash"))


@pytest.mark.parametrize("archive_bytes", [1, 1 << 30])
def test_records_equal_brute_force(spark, captures, archive_bytes):
    out = warc.deduplicated_records(captures.repartition(3), archive_bytes=archive_bytes).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in out) == sorted((str(k), n, d) for k, n, d, _ in brute(ROWS))
    originals = {(k, d): o for k, _, d, o in brute(ROWS)}
    for r in out:
        assert (r.record_type == "revisit") == (r.refers_to is not None)
        assert r.refers_to in (None, originals[r.page_id, r.payload_digest])
        if originals[r.page_id, r.payload_digest] != r.page_id:
            assert r.record_type == "revisit"
    # of the two equal rows with key 5 one is the response
    assert sorted(r.record_type for r in out if r.page_id == 5) == ["response", "revisit"]


def test_archives_are_gzip_members_with_fresh_headers(spark, captures, tmp_path):
    warc.deduplicated_records(captures, folder=f"file://{tmp_path}/w").collect()
    captured, resolved = (b"".join(gzip.open(p).read() for p in glob(f"{tmp_path}/w-{kind}/*.warc.gz")) for kind in ("captured", "resolved"))
    assert captured.count(b"WARC-Type: response") == len(ROWS) and b"revisit" not in captured
    assert resolved.count(b"\r\nWARC-Type: revisit") == 4 and resolved.count(b"WARC-Refers-To: <urn:capture:5>") == 3
    assert resolved.count(BIG.encode()) == 2
    assert b"\r\nX: y" not in resolved


def test_string_keys_and_no_rows(spark):
    df = spark.createDataFrame([("a b/é", "u", BIG), ("z>", "u", BIG)], "page_id string, url string, html string")
    out = {r.page_id: (r.record_type, r.refers_to) for r in warc.deduplicated_records(df).collect()}
    assert out == {"a b/é": ("revisit", "z>"), "z>": ("response", None)}
    assert warc.deduplicated_records(df.limit(0)).collect() == []


def test_damaged_payload_is_noticed(spark, tmp_path):
    archive = warc.Archive(f"file://{tmp_path}")
    archive.add(*warc.response("1", "u", b"payload", hashlib.sha1(b"other").digest()))
    archive.close()
    paths = spark.createDataFrame([(archive.uri,)], "path string")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(spark, paths).collect()
