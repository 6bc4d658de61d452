"""WARC archives: written with revisits, segments and chunked payloads, and read back.

Archives are plain files that Spark's text writer makes in a folder all
executors share; one row is one record.  Long blocks are cut into a first
segment and continuation records.  Reading groups continuations by the record
they continue, orders them by number, checks the total length and takes the
chunked transfer framing off.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from treegauge.joins import lookup

from .common import batches, bytes_of, folder_for, table

#: Longest block of a record; longer ones are segmented.
SEGMENT = 32 << 10
#: Longest chunk of a payload.
CHUNK = 8 << 10
#: Payloads from this size on are written once; later ones revisit.
REVISIT = 1000

#: Fixed values of the format.
_VERSION = b"WARC/1.1\r\n"
_LENGTH = re.compile(rb"Content-Length: *(\d+)", re.I)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing.

    A chunk also ends inside every occurrence of the version line, so no
    payload can look like the start of a record.
    """
    ends = {m.start() + 4 for m in re.finditer(re.escape(_VERSION), payload)}
    ends |= set(range(size, len(payload), size)) | ({len(payload)} if payload else set())
    out, begin = [], 0
    for end in sorted(ends):
        out.append(b"%x\r\n" % (end - begin) + payload[begin:end] + b"\r\n")
        begin = end
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def records(page: bytes, uri: bytes, payload: bytes, digest: bytes, original: bytes | None,
            nonce: bytes, segment: int = SEGMENT) -> list[bytes]:
    """The record or segment records of one page, without version line and end.

    `original` is the page a revisit refers to.  Identifiers are
    `<urn:page:PAGE#NONCE>`; the nonce tells repeated rows apart.
    """
    name = b"urn:page:" + page + b"#" + nonce
    common = b"WARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: " + uri + (
        b"\r\nWARC-Payload-Digest: sha1:" + digest + b"\r\n")
    if original is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [b"WARC-Type: revisit\r\nWARC-Record-ID: <" + name + b">\r\n" + common
                + b"WARC-Refers-To: <urn:page:" + original + b">\r\n"
                b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                b"Content-Type: application/http;msgtype=response\r\n"
                b"Content-Length: %d\r\n\r\n" % len(block) + block]
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload))
    parts = cut(block, segment)
    out = []
    for number, part in enumerate(parts, 1):
        head = b"WARC-Type: " + (b"response" if number == 1 else b"continuation") + b"\r\n"
        head += b"WARC-Record-ID: <" + name + (b"/%d" % number if number > 1 else b"") + b">\r\n"
        head += common
        if len(parts) > 1:
            head += b"WARC-Segment-Number: %d\r\n" % number
            if number > 1:
                head += b"WARC-Segment-Origin-ID: <" + name + b">\r\n"
            if number == len(parts):
                head += b"WARC-Segment-Total-Length: %d\r\n" % len(block)
        if number == 1:
            head += b"Content-Type: application/http;msgtype=response\r\n"
        out.append(head + b"Content-Length: %d\r\n\r\n" % len(part) + part)
    return out


def cut(block: bytes, segment: int) -> list[bytes]:
    return [block[i:i + segment] for i in range(0, len(block), segment)]


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT,
                   revisit: int = REVISIT) -> None:
    """One record (or segment records) per row of `pages` (page_id, url, html) in `folder`.

    The payload is the html in UTF-8, null as empty.  Of equal payloads of at
    least `revisit` bytes the one with the greatest page_id is a response and
    the others revisit it; equal page_ids with equal payloads, and payloads
    whose page_ids are all null, are each a response.  Only digests are
    grouped and joined beforehand, and a payload that a third of all pages
    share is split over tasks.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    dug = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("digest"))
    newest = dug.where(F.octet_length("payload") >= revisit).groupBy("digest").agg(
        F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = lookup(dug, newest, ["digest"]).select(
        F.col("page_id").cast("string").alias("page"), F.col("url").cast("string").alias("uri"),
        "payload", "digest",
        F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("newest")),
               F.col("newest")).cast("string").alias("original"))

    def work(columns: dict) -> dict:
        out = []
        get = [bytes_of(columns[n]) for n in ("page", "uri", "payload", "digest")]
        originals = columns["original"].cast(pa.binary()).to_pylist()
        for page, uri, payload, digest, original in zip(*get, originals, strict=True):
            uri = uri.replace(b"\r", b"%0D").replace(b"\n", b"%0A")
            out += records(page, uri, payload, digest, original, uuid.uuid4().hex.encode(), segment)
        return {"record": out}

    made = batches(known, work, "record binary", text="payload")
    # The text writer puts bytes as they are, each row followed by the separator.
    made.select(F.concat(F.lit(_VERSION), "record").cast("string").alias("value")).write.option(
        "lineSep", "\r\n\r\n").text(folder, compression="gzip")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(head, block, whole): every record of the archives, plain or compressed.

    Records are told apart by the version line, so large plain files are read
    in splits and none is held as a whole.
    `whole` is false where a block is shorter than its Content-Length.
    """
    raw = spark.read.option("lineSep", _VERSION.decode()).text(folder).select(
        F.col("value").cast("binary").alias("raw")).where(F.octet_length("raw") > 0)

    def work(columns: dict) -> dict:
        heads, blocks, whole = [], [], []
        for raw in columns["raw"].to_pylist():
            head, _, rest = raw.partition(b"\r\n\r\n")
            found = _LENGTH.search(head)
            size = int(found.group(1)) if found else 0
            heads.append(head)
            blocks.append(rest[:size])
            whole.append(len(rest) >= size and found is not None)
        return {"head": heads, "block": blocks, "whole": whole}

    return batches(raw, work, "head binary, block binary, whole boolean", text="raw")


def field(name: str):
    """A named field of the head, null where it has none."""
    found = F.regexp_extract(F.col("head").cast("string"), r"(?i)(?:^|\r\n)%s: *([^\r\n]*)" % name, 1)
    return F.when(found != "", found)


def reassembled(read: DataFrame) -> DataFrame:
    """(type, id, uri, digest, refers, payload, complete): one row per original record.

    Records without segments pass through.  Segments are grouped by the record
    they belong to, a group being no more than one record, ordered by their
    number and joined.  `complete` is false, and the payload null, if a
    segment is missing, repeated or cut, or the total length differs; a
    continuation without its first segment is such a row too.
    """
    named = read.select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"),
        field("WARC-Target-URI").alias("uri"), field("WARC-Payload-Digest").alias("digest"),
        field("WARC-Refers-To").alias("refers"),
        field("WARC-Segment-Number").try_cast("int").alias("number"),
        field("WARC-Segment-Origin-ID").alias("origin"),
        field("WARC-Segment-Total-Length").try_cast("long").alias("total"), "block", "whole")
    single = named.where("number is null").select(
        "type", "id", "uri", "digest", "refers", F.array("block").alias("blocks"),
        F.col("whole").alias("complete"))
    grouped = named.where("number is not null").withColumn(
        "origin", F.coalesce("origin", "id")).groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"), F.min("whole").alias("whole"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
          for c in ("type", "id", "uri", "digest", "refers")])
    joined = grouped.select(
        "type", F.coalesce("id", "origin").alias("id"), "uri", "digest", "refers",
        F.col("parts.block").alias("blocks"),
        (F.col("whole") & (F.col("parts.number") == F.sequence(F.lit(1), F.size("parts")))
         & F.col("total").isNotNull() & (F.col("total") == F.aggregate(
             "parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))))
        .alias("complete"))

    def work(columns: dict) -> dict:
        payloads, sizes, complete = [], [], []
        for kind, blocks, good in zip(columns["type"].to_pylist(), columns["blocks"].to_pylist(),
                                      columns["complete"].to_pylist(), strict=True):
            payload, size = None, None
            if good:
                head, _, body = b"".join(blocks).partition(b"\r\n\r\n")
                length = _LENGTH.search(head)
                if kind == "revisit":
                    size = int(length.group(1)) if length else None
                else:
                    framed = re.search(rb"(?i)Transfer-Encoding: *chunked", head)
                    try:
                        payload = unchunked(body) if framed else body
                    except ValueError:
                        good = False
                    size = None if payload is None else len(payload)
            payloads.append(payload)
            sizes.append(size)
            complete.append(bool(good))
        return {**{c: columns[c] for c in ("type", "id", "uri", "digest", "refers")},
                "payload": payloads, "payload_bytes": sizes, "complete": complete}

    return batches(single.unionByName(joined), work,
                   "type string, id string, uri string, digest string, refers string, "
                   "payload binary, payload_bytes bigint, complete boolean")


def results(found: DataFrame) -> DataFrame:
    """What `reassembled` says of every page; a record that is not whole has no size and no digest.

    The digest is that of the payload read back; a revisit, which has none, names its own.
    """
    page = lambda c: F.regexp_extract(c, r"urn:page:([^#>]*)", 1).try_cast("long")
    named = F.regexp_extract("digest", r"sha1:(\w+)", 1)
    return found.select(
        page("id").alias("page_id"), F.when(F.col("complete"), F.col("payload_bytes")).alias("payload_bytes"),
        F.when(F.col("complete"), F.when(F.col("type") == "revisit", named).otherwise(F.sha1("payload"))).alias(
            "payload_digest"),
        F.col("type").alias("record_type"), page("refers").alias("refers_to"))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through an archive and back: payload length, digest, type, what it refers to."""
    folder = folder_for(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return results(reassembled(read_records(spark, folder)))
