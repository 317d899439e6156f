"""WARC archives: writing captures, and assembling them from request, response and metadata records.

Writing.  Each row of pages becomes one capture: a ``response`` record, or a
``revisit`` record when an equal payload (of at least ``smallest`` bytes) is
captured under a smaller ``page_id``, with a ``request`` and a ``metadata`` record
that name it in WARC-Concurrent-To.  A WARC record of UTF-8 text is itself text, so
the files are written by Spark's own text writer (record separator CR LF CR LF,
gzip) to any file system that Spark reaches, under Spark's commit protocol: a
lost task leaves nothing behind.  Digests travel alone to find the first page of
each payload; payloads are shuffled once, to meet their capture's decision.

Reading.  Every archive file is one row of Spark's binary reader; a task inflates
it as a stream and cuts records by their Content-Length, so payloads may hold
blank lines or anything else.  The writer starts a new file after ``FILE_BYTES``
of records, which bounds what a reader holds (a larger record has a file of its own).

Assembly.  Requests and metadata meet their response or revisit through the
concurrent-to id, one nested row per capture; where several claim the same
capture, the one with the smallest record id counts.  Revisits are resolved by
joining the record that they refer to.

Results
-------
One capture per row.  A null html is an empty payload; a null url is written as
``urn:page:<page_id>`` and comes back as null; line ends in a url are
percent-encoded.  Rows that repeat page_id and payload are captures of their own,
told apart by a running number; the first is the response.  A null page_id sorts
after all others.  Captures without request or metadata records have nulls there.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import spread_join

SEPARATOR = "\r\n\r\n"
#: The alphabet of base 32, and the profile of revisits with an equal payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records after which a writing task begins another file (a larger record has one of its own).
FILE_BYTES = 64_000_000
#: Bytes of payload that a reading task holds before it passes rows on.
HELD_BYTES = 4_000_000

RECORD_SCHEMA = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
                 "stated_digest string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>")


def base32(digest: Column) -> Column:
    """Upper-case base 32 of a 20-byte digest given in hex: eight symbols for every five bytes."""
    symbols = []
    for group in range(4):
        value = F.conv(F.substring(digest, 10 * group + 1, 10), 16, 10).cast("long")
        symbols += [F.substring(F.lit(BASE32), (F.shiftright(value, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
                    for k in range(8)]
    return F.concat(*symbols)


def record_id(page_key: Column, digest: Column, copy: Column, role: str) -> Column:
    """A record id that follows from the capture alone, so that a revisit can name its response."""
    h = F.md5(F.concat_ws("|", page_key, digest, copy.cast("string"), F.lit(role)))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(kind: str, headers: dict[str, Column], block: Column) -> Column:
    """Text of one record without its closing separator; headers with a null value are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")) for name, value in headers.items()]
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), *lines, F.lit("\r\nContent-Length: "),
                    F.octet_length(block).cast("string"), F.lit(SEPARATOR), block)


def captures(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Pages with ``digest``, ``copy`` and, where an earlier capture has the payload, ``lead`` (its page key)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"page_key": F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
                             "digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    keys = rows.groupBy("page_id", "page_key", "digest", "size").agg(F.count("*").alias("uses"))
    shared = (keys.where(F.col("size") >= smallest).groupBy("digest")
              .agg(F.min(F.struct(F.col("page_id").isNull().alias("unknown"), F.col("page_id"), F.col("page_key"))).alias("least"),
                   F.sum("uses").alias("uses"))
              .where("uses > 1").select("digest", F.col("least.page_key").alias("lead")))
    decided = keys.select("page_key", "digest").join(shared, "digest")
    numbered = rows.withColumn("copy", F.row_number().over(Window.partitionBy("page_key", "digest").orderBy("url")) - 1)
    joined = numbered.join(decided, ["page_key", "digest"], "left")
    first = (F.col("lead") == F.col("page_key")) & (F.col("copy") == 0)
    return joined.withColumn("lead", F.when(~first, F.col("lead")))


def records(found: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``value``: the text of each record, three a capture."""
    key, digest, copy = F.col("page_key"), F.col("digest"), F.col("copy")
    own = record_id(key, digest, copy, "capture")
    url = F.coalesce(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.concat(F.lit("urn:page:"), key))
    host = F.regexp_extract(url, r"^https?://([^/?#\s]+)", 1)
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^https?://[^/?#]+([^#\s]*)", 1), F.lit("")), F.lit("/"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(SEPARATOR))
    stated = F.concat(F.lit("sha1:"), base32(digest))
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": url}
    answer = {"Content-Type": F.lit("application/http; msgtype=response"), "WARC-Payload-Digest": stated}
    response = record("response", {"WARC-Record-ID": own, **common, **answer}, F.concat(head, F.col("html")))
    refers = record_id(F.col("lead"), digest, F.lit(0), "capture")
    revisit = record("revisit", {"WARC-Record-ID": own, **common, **answer, "WARC-Profile": F.lit(PROFILE), "WARC-Refers-To": refers}, head)
    request = record("request", {"WARC-Record-ID": record_id(key, digest, copy, "request"), "WARC-Concurrent-To": own, **common,
                                 "Content-Type": F.lit("application/http; msgtype=request")},
                     F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(SEPARATOR)))
    metadata = record("metadata", {"WARC-Record-ID": record_id(key, digest, copy, "metadata"), "WARC-Concurrent-To": own, **common,
                                   "Content-Type": F.lit("application/warc-fields")},
                      F.concat(F.lit("page-id: "), key, F.lit("\r\n")))
    return found.select(F.explode(F.array(request, F.when(F.col("lead").isNull(), response).otherwise(revisit), metadata)).alias("value"))


def _parts(found: DataFrame, file_bytes: int) -> DataFrame:
    """The records with ``part``, which counts up inside a task after every ``file_bytes`` of records."""
    def run(batches):
        part, size = 0, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False)
            parts = np.empty(len(sizes), dtype=np.int32)
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > file_bytes:
                    part, size = part + 1, 0
                size += n
                parts[i] = part
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(parts)], names=["value", "part"])
    return found.mapInArrow(run, "value string, part int")


def write(pages: DataFrame, path: str, smallest: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write the captures of ``pages`` as gzip-compressed WARC files of about ``file_bytes`` (before compression) under the folder ``path``."""
    (_parts(records(captures(pages, smallest)), file_bytes).write.mode("overwrite").option("lineSep", SEPARATOR).option("compression", "gzip")
     .partitionBy("part").text(path))


def inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, or of a plain file, piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        inflate = zlib.decompressobj(31)
        while at < len(view) and not inflate.eof:
            piece = view[at:at + step]
            at += len(piece)
            yield inflate.decompress(piece)
        at -= len(inflate.unused_data)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case; ``type`` line excluded) and block of every record of one archive file."""
    held, at, more = bytearray(), 0, inflated(content)

    def fill(n: int) -> bool:
        nonlocal held, at
        while len(held) - at < n:
            piece = next(more, None)
            if piece is None:
                return False
            if at > 1 << 20:
                del held[:at]
                at = 0
            held += piece
        return True

    while True:
        while fill(2) and held[at:at + 2] == b"\r\n":
            at += 2
        if not fill(9):
            if bytes(held[at:]).strip():
                raise ValueError("the archive ends within a record")
            return
        if held[at:at + 5] != b"WARC/":
            raise ValueError("a record does not begin with its version line")
        end = held.find(b"\r\n\r\n", at)
        while end < 0:
            if not fill(len(held) - at + 1):
                raise ValueError("the archive ends within a record's headers")
            end = held.find(b"\r\n\r\n", at)
        headers = {}
        for line in bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", "0"))
        at = end + 4
        if not fill(size):
            raise ValueError("the archive ends within a record's block")
        block = bytes(held[at:at + size])
        at += size
        yield headers, block


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in a folder; ``payloads=False`` leaves out the bytes but still measures and digests them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    arrow = pa.schema([*((n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date",
                                                    "stated_digest", "payload_digest")),
                       ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])

    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind, payload, fields = headers.get("warc-type", ""), None, None
        if kind in ("response", "request"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif kind == "metadata":
            fields = [(n.strip(), v.strip()) for n, _, v in (s.partition(":") for s in block.decode("utf-8", "replace").split("\r\n") if s)]
        digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        stated = headers.get("warc-payload-digest")
        return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                headers.get("warc-target-uri"), headers.get("warc-date"), stated and stated.removeprefix("sha1:"), digest,
                None if payload is None else len(payload), payload if payloads else None, fields)

    def run(batches):
        held, size = [], 0
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in parse(content.as_buffer().to_pybytes()):
                    held.append(row(headers, block))
                    size += len(block)
                    if size > HELD_BYTES or len(held) >= 4000:
                        yield table(held)
                        held, size = [], 0
        if held:
            yield table(held)
    return files.mapInArrow(run, RECORD_SCHEMA)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``target_uri``, ``response`` (record type, payload and digests), ``request``,
    ``metadata``, and ``refers_to`` (the capture referred to, with its payload's size and digest and its metadata)."""
    main = found.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "target_uri",
        F.struct(F.col("type"), "date", "payload", "payload_bytes", "payload_digest", "stated_digest").alias("response"),
        F.col("refers_to").alias("__refers"))

    def side(kind: str, *columns: str) -> DataFrame:
        return (found.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("capture_id"))
                .agg(F.min_by(F.struct("record_id", "date", *columns), "record_id").alias(kind)))
    whole = main.join(side("request"), "capture_id", "left").join(side("metadata", "fields"), "capture_id", "left")
    target = (whole.where("response.type = 'response'")
              .select(F.col("capture_id").alias("__refers"),
                      F.struct(F.col("capture_id"), "response.payload_bytes", "response.payload_digest",
                               F.col("metadata.fields").alias("fields")).alias("refers_to")))
    # a response names nothing: it takes its own id as the key, so that nulls do not meet in one task
    keyed = whole.withColumn("__refers", F.coalesce("__refers", "capture_id"))
    joined = spread_join(keyed, target, "__refers", found.count(), ["capture_id"], "left").drop("__refers")
    return joined.withColumn("refers_to", F.when(F.col("response.type") == "revisit", F.col("refers_to")))
