import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from grantlens.llm import warc
from grantlens.llm.common import Scratch

ROWS = [(5, "http://a", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, None), (10, "u\r\nX: y", ""), (11, "c", "x" * 100_000), (12, "d", "<p>é</p>"), (12, "d", "<p>é</p>"), (None, "e", "solo")]


def archive(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sha256", "2 AS payload")
    scratch = Scratch(spark, "t")
    warc.write_archive(pages, scratch, **options)
    return scratch, warc.read_archive(spark, scratch.path("headers"), scratch.path("payloads"))


def test_round_trip(spark):
    scratch, back = archive(spark, ROWS)
    got = back.collect()
    assert len(got) == len(ROWS)
    assert spark.read.parquet(scratch.path("payloads")).count() == 4
    html = {(i, u): (h or "").encode() for i, u, h in ROWS}
    for r in got:
        header, block = next(warc.parse_records(bytes(r.record_bytes)))
        assert header == bytes(r.header) and bytes(r.payload) in html.values()
        assert block == (bytes(r.payload) if r.record_type == "response" else b"")
        sha = base64.b32encode(hashlib.sha1(bytes(r.payload)).digest())
        assert b"WARC-Payload-Digest: sha1:" + sha + b"\r\n" in header
        assert header.count(b"\r\n\r\n") == 1
    assert any(b"WARC-Target-URI: u%0D%0AX: y\r\n" in bytes(r.header) for r in got)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "response", None), (3, "response", None), (5, "revisit", 3), (9, "response", None), (10, "revisit", 9), (11, "response", None), (12, "revisit", 3), (12, "revisit", 3)]


def test_files_of_records(spark):
    _, back = archive(spark, ROWS[:3])
    data = b"".join(bytes(r.record_bytes) for r in back.collect())
    assert len(list(warc.parse_records(data))) == 3 == len(list(warc.parse_records(gzip.compress(data))))


def test_small_payloads_are_no_revisits(spark):
    _, back = archive(spark, ROWS, least_bytes=1000)
    assert back.where("record_type = 'revisit'").count() == 0


def test_damage_is_noticed(spark):
    scratch, _ = archive(spark, ROWS[:3])
    bad = scratch.save(spark.read.parquet(scratch.path("payloads")).withColumn("payload", F.lit(b"other")), "bad")
    assert bad.count()
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, scratch.path("headers"), scratch.path("bad")).collect()


def test_empty(spark):
    assert archive(spark, [])[1].count() == 0


def test_report_comes_from_header_bytes(spark, monkeypatch, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    kinds = lambda: sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op1_warc(spark, str(tmp_path)).collect())
    assert kinds() == [(0, 4, "response", None), (3, 9, "response", None), (5, 9, "revisit", 3), (9, 0, "response", None), (10, 0, "revisit", 9), (11, 100_000, "response", None), (12, 9, "revisit", 3), (12, 9, "revisit", 3)]
    made = warc.records

    def changed(old, new):
        header = F.encode(F.replace(F.col("header").cast("string"), F.lit(old), F.lit(new)), "UTF-8")
        monkeypatch.setattr(warc, "records", lambda *a, **k: made(*a, **k).withColumn("header", header))

    changed("Refers-To: <urn:page:3>", "Refers-To: <urn:page:77>")
    assert [k[3] for k in kinds()] == [None, None, 77, None, 9, None, 77, 77]
    for old, new in (("Content-Length: 9", "Content-Length: 8"), ("Digest: sha1:", "Digest: sha1:A"), ("WARC-Type: revisit", "WARC-Type: response")):
        changed(old, new)
        with pytest.raises(Exception, match="header does not match"):
            kinds()
