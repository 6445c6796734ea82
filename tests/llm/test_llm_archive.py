from __future__ import annotations

import base64
import glob
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tillroll.llm import archive as A
from tillroll.session import run_folder

PAGES = [
    (1, "http://a/1", "<p>same é</p>"), (5, "http://a/5", "<p>same é</p>"), (3, None, "<p>same é</p>"),
    (2, "http://a/2\r\nWARC-Type: forged", "WARC-Type: forged\r\nWARC-Refers-To: <urn:page:9>\r\n\r\n"),
    (4, "http://a/4", None), (6, "http://a/6 WARC-Type: x", ""), (7, "http://a/7", "one"), (7, "http://a/7", "one"), (8, "http://a/8", "two"),
    (None, "http://a/n", "two"), (None, "http://a/m", "three"),
]


@pytest.fixture(scope="module")
def folder(spark):
    target = run_folder(spark, "archive")
    A.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), target)
    return target


def expected(pages, least=0):
    best = {}
    for page, _, body in pages:
        if page is not None:
            best[body or ""] = max(page, best.get(body or "", page))
    for page, _, body in pages:
        raw = (body or "").encode()
        response = len(raw) < least or page == best.get(body or "")
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        yield page, len(raw), digest, "response" if response else "revisit", None if response else best[body or ""]


def told(df):
    return sorted(map(str, (tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))


def test_records(spark, folder):
    records = A.read_records(spark, folder)
    assert told(records) == sorted(map(str, expected(PAGES)))
    assert {r["url"] for r in records.where("page_id in (2, 3)").collect()} == {"http://a/2%0D%0AWARC-Type: forged", None}


def test_payloads_are_stored_once(spark, folder):
    rows = spark.read.parquet(f"{folder}/payloads").collect()
    assert sorted(bytes(r["payload"]).decode() for r in rows) == sorted({body or "" for *_, body in PAGES})
    assert all(hashlib.sha256(r["payload"]).digest() == bytes(r["digest"]) for r in rows)


def test_small_payloads_are_never_revisited(spark):
    target = run_folder(spark, "archive")
    A.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), target, least_bytes=4)
    assert told(A.read_records(spark, target)) == sorted(map(str, expected(PAGES, 4)))


def test_reconstruction_and_files(spark, folder, tmp_path):
    whole = A.reconstruct(spark, folder).collect()
    assert sorted((str(r["page_id"]), r["payload"]) for r in whole) == sorted((str(p), b or "") for p, _, b in PAGES)
    A.export_warc(spark, folder, str(tmp_path / "warc"))
    found = []
    for name in glob.glob(str(tmp_path / "warc" / "part-*")):
        raw = open(name, "rb").read()
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            length = int(fields["Content-Length"])
            body, raw = rest[:length], rest[length:]
            assert raw.startswith(b"\r\n\r\n")
            raw = raw[4:]
            page = re.match("<urn:page:(.*)>", fields["WARC-Record-ID"])[1]
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            else:
                assert body == b""
            found.append((page, fields["WARC-Type"]))
    assert sorted(found) == sorted((str(p) if p is not None else "", kind) for p, _, _, kind, _ in expected(PAGES))


def test_damage_is_noticed(spark, folder):
    target = run_folder(spark, "archive")
    rows = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    rows.write.parquet(f"{target}/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{target}/headers")
    with pytest.raises(Exception, match="differs from its digest"):
        A.read_records(spark, target).collect()


def test_base32(spark):
    texts = ["", "a", "abc", "é" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.base32(F.sha1("t")).alias("b"))
    assert all(r["b"] == base64.b32encode(hashlib.sha1(r["t"].encode()).digest()).decode() for r in df.collect())


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 1000", "url", "html"))
    target = run_folder(spark, "archive")
    A.write_archive(pages, target)
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert told(A.read_records(spark, target)) == sorted(map(str, expected(rows)))
