import base64
import hashlib

from pyspark.sql import functions as F

from ticketlens.llm import warc
from ticketlens.llm.common import Scratch

TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.1\r\n"


def archive(spark, rows, min_bytes=0):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    path = Scratch(spark, "t").path("warc")
    warc.write_archive(warc.records(df.repartition(3), min_bytes=min_bytes), path)
    return path


def test_round_trip_and_revisits(spark):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(["same", "é漢😀", TRICKY, "", "same", None, "x" * 300_000, "same", TRICKY])]
    rows.append((20, None, "no\nurl"))
    rows.append((21, "http://evil\r\nWARC-Type: x", "u"))
    path = archive(spark, rows)
    stored = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    html = {r[0]: (r[2] or "").encode() for r in rows}
    last = {}
    for i, h in html.items():
        last[h] = max(i, last.get(h, i))
    assert len(stored) == len(rows)
    for i, r in stored.items():
        assert bytes(r.payload) == (html[i] if last[html[i]] == i else b"")
    assert stored[21].uri == "http://evil WARC-Type: x" and stored[20].uri is None
    for r in warc.read_resolved(spark, path).collect():
        h = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[h] == r.page_id else ("revisit", last[h]))


def test_small_payloads_null_ids_and_repeats(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (4, "u", "abcdef"), (None, "u", "abcdef"),
            (None, "u", "only"), (None, "u", "only")]
    out = warc.read_resolved(spark, archive(spark, rows, min_bytes=3)).collect()
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in out)
    assert got == sorted([("1", "response", None), ("2", "response", None), ("3", "revisit", 4), ("4", "response", None),
                          ("4", "response", None), ("None", "revisit", 4), ("None", "response", None), ("None", "response", None)])


def test_empty_table(spark):
    path = archive(spark, [(1, "u", "x")])
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(df).collect() == []
    empty = Scratch(spark, "t").path("warc")
    warc.write_archive(warc.records(df), empty)
    assert warc.read_resolved(spark, empty).collect() == [] and path
