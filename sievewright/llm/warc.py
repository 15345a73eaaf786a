"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as a request, a response (or a revisit, where a record with the same payload is
the response) and a metadata record; request and metadata name the capture by WARC-Concurrent-To.
Files are gzip members of whole record sequences, written by Spark's own committer, so tasks
can run again. Reading cuts records by Content-Length; assembly follows the concurrent-to
identifiers, in either direction and over one record between, and emits one nested row per capture. What a revisit refers to is found by its record id among the
captures read; an id that no capture has gives null.

Null html is an empty payload; a null url is written as an empty target; a null page_id is written empty
and read back as null, and counts as smaller than any id. Rows that repeat page_id and payload
are captures of their own with equal ids; of equal payloads the largest page_id is the response, ties are such rows. Payloads of any length are written and read whole (a record
is in memory at once); an empty table writes no record and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 0


def _id(kind: str, page: str = "page_id") -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col(page).cast("string"), F.lit("")), F.col("sha")))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def base32_of_hex(h: Column) -> Column:
    """Base32 of 40 hex digits: eight groups of five digits, each four letters."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    out = []
    for g in range(8):
        n = F.conv(F.substring(h, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.element_at(letters, F.shiftright(n, s).bitwiseAND(31) + 1) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record(kind: Column, rid: Column, extra: Column, block_type: Column, block: Column) -> Column:
    """All but the last line feed, which the text writer adds."""
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), rid, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("uri"), extra)
    return F.concat(head, F.lit("\r\nContent-Type: "), block_type, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write_archives(pages: DataFrame, path: str, scratch: Scratch, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(F.coalesce(F.col("url"), F.lit("")), "\r\n", "").alias("uri"), html.alias("html"), F.sha1(html).alias("sha"))
    keys = scratch.save(rows.select("page_id", "sha", F.octet_length("html").alias("size")), "keys")
    shared = keys.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = keys.join(shared, "sha").where("first is not null and (page_id is null or page_id < first)").select(F.coalesce("page_id", F.lit(-1)).alias("_p"), F.col("page_id").isNull().alias("_null"), F.col("sha").alias("_sha"), "first").distinct()
    rows = rows.join(later, (F.coalesce("page_id", F.lit(-1)) == F.col("_p")) & (F.col("page_id").isNull() == F.col("_null")) & (F.col("sha") == F.col("_sha")), "left")
    revisit = F.col("first").isNotNull()
    me, text = _id("capture"), F.lit
    rows = rows.withColumn("me", me)
    refers = F.concat(text("\r\nWARC-Refers-To: "), _id("capture", "first"), text("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    digest = F.concat(text("\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha")))
    http = F.concat(text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), text("\r\n\r\n"))
    beside = F.concat(text("\r\nWARC-Concurrent-To: "), F.col("me"))
    host, rest = F.regexp_extract("uri", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("uri", "^[a-z]+://[^/?#]*([^#]*)", 1)
    get = F.concat(text("GET "), F.when(rest == "", "/").otherwise(rest), text(" HTTP/1.1\r\nHost: "), host, text("\r\n\r\n"))
    note = F.concat(text("page-id: "), F.coalesce(F.col("page_id").cast("string"), text("")), text("\r\n"))
    records = F.array(
        _record(text("request"), _id("request"), beside, text("application/http;msgtype=request"), get),
        F.when(revisit, _record(text("revisit"), F.col("me"), F.concat(digest, refers), text("application/http;msgtype=response"), http)).otherwise(
            _record(text("response"), F.col("me"), digest, text("application/http;msgtype=response"), F.concat(http, F.col("html")))
        ),
        _record(text("metadata"), _id("metadata"), beside, text("application/warc-fields"), note),
    )
    rows.select(F.explode(records).alias("value")).write.mode("overwrite").option("lineSep", "\n").option("compression", "gzip").text(path)


def _pieces(content: bytes):
    """Uncompressed bytes of an archive, whatever its gzip members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data
    return b"".join(out)


def parse_records(data: bytes):
    """(headers with lower-case names, block) of each record; concurrent-to may repeat and comes as a list."""
    at, view = 0, memoryview(data)
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at:at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        heads: dict = {"warc-concurrent-to": []}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            name, value = name.strip().lower().decode(), value.strip().decode("utf-8", "replace")
            if name == "warc-concurrent-to":
                heads[name].append(value)
            else:
                heads[name] = value
        size = int(heads["content-length"])
        yield heads, view[end + 4:end + 4 + size]
        at = end + 4 + size


RECORD = "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, header_digest string, payload_bytes long, payload_digest string, fields map<string,string>"


def _read(with_payload: bool):
    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for h, block in parse_records(_pieces(content)):
                    kind, size, digest, fields, payload = h.get("warc-type"), None, None, None, None
                    if kind in ("response", "revisit"):
                        raw = bytes(block)
                        head, _, payload = raw.partition(b"\r\n\r\n")
                        if kind == "response":
                            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        else:
                            payload = None
                            size = next((int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    elif kind == "metadata":
                        pairs = (x.partition(": ") for x in bytes(block).decode("utf-8", "replace").split("\r\n") if x)
                        fields = [(a, b) for a, _, b in pairs]
                    told = h.get("warc-payload-digest")
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h["warc-concurrent-to"], h.get("warc-refers-to"), told and told.partition(":")[2], size, digest, fields, payload))
                types = [pa.string()] * 4 + [pa.list_(pa.string())] + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
                names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                n = len(names) if with_payload else len(names) - 1
                yield pa.RecordBatch.from_arrays(cols[:n], names=names[:n])

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (gzip or plain)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(_read(with_payload), RECORD + ", payload binary" * with_payload)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, captures (how often its id was written), main, request, metadata.

    A capture is a response or revisit record; records that reach none stay out.
    """
    main = records.where("type in ('response', 'revisit')")
    cols = [c for c in records.columns]
    mains = main.groupBy(F.col("record_id").alias("capture_id")).agg(F.count("*").alias("captures"), F.max_by(F.struct(*cols), F.col("payload_bytes")).alias("main"))
    side = records.where("type not in ('response', 'revisit')")
    direct = side.select(F.struct(*cols).alias("r"), F.explode_outer("concurrent_to").alias("to"))
    # what a capture itself points to, and records that point to such a record
    named = main.select(F.explode("concurrent_to").alias("to"), F.col("record_id").alias("capture_id"))
    own = side.select(F.col("record_id").alias("to"), F.struct(*cols).alias("r")).join(named, "to").select("capture_id", "r")
    hop = direct.select("to", "r").join(side.select(F.col("record_id").alias("to"), F.explode("concurrent_to").alias("capture_id")), "to").select("capture_id", "r")
    linked = direct.select(F.col("to").alias("capture_id"), "r").union(own).union(hop).where("capture_id is not null")
    sides = linked.groupBy("capture_id").agg(
        F.first(F.when(F.col("r.type") == "request", F.col("r")), ignorenulls=True).alias("request"), F.first(F.when(F.col("r.type") == "metadata", F.col("r")), ignorenulls=True).alias("metadata")
    )
    return mains.join(sides, "capture_id", "left")


def archive_digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = f"{scratch.root}/archives"
    write_archives(pages, path, scratch)
    records = scratch.save(read_records(spark, path, with_payload=False), "records")
    page = F.nullif(F.col("metadata.fields")["page-id"], F.lit("")).cast("long")
    found = assemble(records).select(
        "capture_id", "captures", page.alias("page_id"), F.col("main.payload_bytes").alias("payload_bytes"), F.coalesce("main.payload_digest", "main.header_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("to"), F.col("main.uri").alias("url"),
    )
    found = scratch.save(found, "found")
    named = scratch.save(found.where("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to")), "named")
    found = found.join(named, "to", "left")  # both sides written: the revisits of one response can be split
    each = found.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("captures").cast("int"))))
    return each.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
