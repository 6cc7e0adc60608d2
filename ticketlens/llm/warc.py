"""WARC archives with revisit resolution.

``write_archive`` writes pages as records into gzip part files with Spark's
text writer (the record end is the line separator); ``read_archive`` reads them
through Spark's text reader, split at the version line, and glues fragments to
the length that Content-Length names, so a payload may hold any text, also one
that looks like a record.  gzip files are read by one task each, as a stream.

``resolve`` shuffles headers only (page id, digest, length): copies of a payload
are counted map-side, the largest page id stays a response and the others
become revisits.  Reading back joins revisit records to their responses.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import Scratch

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"       # fixed: RFC 4648
CRLF = "\r\n"
RECORD = ("record_id string, warc_type string, page_id long, uri string, refers_to_id string, "
          "header_digest string, payload binary, payload_bytes long, payload_digest string")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column (160 bits: 32 digits, no padding)."""
    hexes = F.sha1(payload)
    digits = []
    for i in range(8):                               # 20 bits a time
        v = F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Originals of payloads that occur twice or more: (payload_digest, payload_bytes, original).

    ``headers`` has page_id, payload_digest, payload_bytes.  The largest page
    id of a payload is its original; payloads shorter than ``min_bytes`` and
    groups whose ids are all null have none.
    """
    return (headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
            .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
            .where("copies > 1 and original is not null").drop("copies"))


def record_id(page_id: Column, digest: Column) -> Column:
    """A record's URN: made from page id and digest, so a retried task writes the same one."""
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                                                     F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html",
            min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One text column ``value``: a WARC record per page, revisits of copies without their payload.

    Defined cases: null html is an empty payload; a null url has no target
    URI, and line breaks in a url become spaces; a page with a null id is never
    the original of a page with one; repeated rows that tie for the largest
    id are all responses.
    """
    body = F.coalesce(pages[html], F.lit(""))
    p = pages.select(pages[page_id].alias("page_id"), F.regexp_replace(pages[url], r"[\r\n]+", " ").alias("uri"),
                     body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"),
                     base32_sha1(F.encode(body, "UTF-8")).alias("payload_digest"))
    originals = resolve(p.select("page_id", "payload_digest", "payload_bytes"), min_bytes)
    p = p.join(originals, ["payload_digest", "payload_bytes"], "left")
    p = p.withColumn("revisit", F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    line = lambda name, v: F.concat(F.lit(name + ": "), v, F.lit(CRLF))
    optional = lambda name, v: F.coalesce(line(name, v), F.lit(""))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    head = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))), line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", F.col("uri")), optional("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", digest), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.encode("block", "UTF-8")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To-Date", F.lit(date)),
                                          line("WARC-Refers-To", record_id(F.col("original"), F.col("payload_digest")))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF))
    return p.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))


def write_archive(recs: DataFrame, path: str) -> None:
    """Part files of ``recs`` (one text column) under ``path``; each record ends in an empty line pair."""
    recs.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def _parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for ln in head.decode("utf-8", "replace").split(CRLF):
        k, _, v = ln.partition(":")
        fields[k.strip().lower()] = v.strip()
    block = rest[:int(fields.get("content-length", 0))]
    payload = block.partition(b"\r\n\r\n")[2]
    pid = fields.get("x-page-id")
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return (fields.get("warc-record-id"), fields.get("warc-type"), int(pid) if pid else None, fields.get("warc-target-uri"),
            fields.get("warc-refers-to"), declared, payload, len(payload),
            base64.b32encode(hashlib.sha1(payload).digest()).decode())


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def _missing(raw: bytes) -> int:
    """Bytes that a record still lacks (its header may itself be incomplete)."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return 1
    m = _LENGTH.search(raw, 0, end)
    return end + 4 + (int(m[1]) if m else 0) - len(raw)


def _records_of(batches, keep_payload: bool):
    """Glue fragments of each file into records; a record cut short by its file's end is not returned."""
    sep = (VERSION + CRLF).encode()
    state: dict = {"file": None, "parts": [], "lacks": 0}
    rows: list = []

    def close():
        if state["parts"] and state["lacks"] <= 0:
            rows.append(_parse(b"".join(state["parts"])))
        state["parts"] = []

    def table():
        cols = list(zip(*rows))
        if not keep_payload:
            cols[6] = [None] * len(rows)
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        rows.clear()
        return out

    for b in batches:
        for value, name in zip(b.column(0), b.column(1)):
            raw, name = value.as_py(), name.as_py()
            if name != state["file"]:
                close()
                state.update(file=name, parts=[], lacks=0)
                continue                       # what stands before the first version line
            if state["parts"] and state["lacks"] > 0:
                state["parts"] += [sep, raw]
                state["lacks"] -= len(sep) + len(raw)
                if state["lacks"] <= 0:        # exact only once the header is complete
                    state["lacks"] = _missing(b"".join(state["parts"]))
            else:
                close()
                state.update(parts=[raw], lacks=_missing(raw))
        if rows:
            yield table()
    close()
    if rows:
        yield table()


def read_archive(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of an archive folder; payload digest and length are of the payload that is stored."""
    frags = (spark.read.option("lineSep", VERSION + CRLF).text(path)
             .select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file")))
    return frags.mapInArrow(lambda it: _records_of(it, keep_payload), RECORD)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to.

    A revisit takes length and digest from the response that its
    WARC-Refers-To names; the digest in its own header must agree, else both
    are null.
    """
    scratch = Scratch(spark, "warc-read")
    recs = scratch.write(read_archive(spark, path, keep_payload=False).drop("payload"), "records")    # one pass over the archives
    resp = scratch.write(recs.where("warc_type = 'response'").groupBy(F.col("record_id").alias("o_id")).agg(
        F.first("page_id").alias("o_page"), F.first("payload_bytes").alias("o_bytes"), F.first("payload_digest").alias("o_digest")),
        "responses")
    # a join of two written tables: Spark can split the revisits of one very frequent response
    r = recs.join(resp, F.col("refers_to_id") == F.col("o_id"), "left")
    rev, same = F.col("warc_type") == "revisit", F.col("header_digest") == F.col("o_digest")
    return r.select(
        "page_id", F.when(rev, F.when(same, F.col("o_bytes"))).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(rev, F.when(same, F.col("o_digest"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.when(rev, F.col("o_page")).alias("refers_to"), "uri", "record_id")
