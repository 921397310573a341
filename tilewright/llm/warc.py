"""Legacy archive converter: ARC to WARC.

An ARC file begins with a ``filedesc://`` record whose second line names the
version; each further record has one header line (five fields in version 1, ten
in version 2, told apart by that line) and as many bytes as its last field
declares. The converter walks records by these lengths, then synthesises what
WARC needs: record ids (name-based UUIDs of URL, date and block), ISO dates,
block and payload digests, and record types: ``warcinfo`` for the filedesc
record, ``response`` for HTTP messages, ``resource`` for others such as DNS
answers, and ``revisit``, without payload, for messages whose payload equals
that of one with a smaller page id. Files may be gzipped, whole or by record.

Archives are parsed once, into a written table; the duplicate search shuffles its
digests and ids only. Every WARC record is a gzip member of its own. Spark's
text writer writes the bytes: its separator is the byte 0 that a member of less
than 16 MB ends in, which is left out before; longer records are several
members. Files end at about ``warc_bytes``. They are read back through the
binary file source, a file at a time, and parsed by declared lengths.

Defined cases: null HTML is an empty payload; payloads may be any bytes; a null or
blank URL is written as ``-``, white space in it is percent-encoded; page ids may
have any type that casts to and from string; among equal payloads rows that
share the smallest page id are all responses; a null page id never makes a
revisit's target unless all are null, in which case all are responses; a very long
payload is one record, in memory once; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, discard, materialise, read_table, shared_dir
from .decontaminate import BROADCAST_ROWS, bounded

#: Field names of the two versions' header lines.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20010203040506"
ID_HEADER = "X-Page-Id"
ARCHIVE_BYTES = 4 << 20
WARC_BYTES = 32 << 20
MEMBER_BYTES = 15 << 20
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122


#: Two letters of base 32 for each number of ten bits: the standard encoder takes thrice the digest's own time.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: the alphabet of RFC 4648
_PAIRS = [a + b for a in _LETTERS for b in _LETTERS]


def base32_sha1(data: bytes) -> str:
    n = int.from_bytes(hashlib.sha1(data).digest(), "big")
    return "".join([_PAIRS[n >> shift & 1023] for shift in range(150, -1, -10)])


# ---- ARC ----


def arc_header(version: int) -> bytes:
    body = f"{version} 0 tilewright\n{FIELDS[version]}\n".encode()
    line = f"filedesc://pages.arc 0.0.0.0 {DATE} text/plain" + (" 200 - - 0 pages.arc" if version == 2 else "")
    return f"{line} {len(body)}\n".encode() + body + b"\n"


def arc_line(version: int, offset: int, url: str | None, content_type: str, n: int) -> bytes:
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"
    more = f" 200 - - {offset} pages.arc" if version == 2 else ""
    return f"{url} 127.0.0.1 {DATE} {content_type}{more} {n}\n".encode()


def arc_record(version: int, offset: int, page_id: str | None, url: str | None, payload: bytes) -> bytes:
    of_page = f"{ID_HEADER}: {urllib.parse.quote(str(page_id))}\r\n" if page_id is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{of_page}Content-Length: {len(payload)}\r\n\r\n".encode()
    return b"".join([arc_line(version, offset, url, "text/html", len(head) + len(payload)), head, payload, b"\n"])


def build_arcs(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(content): ARC files of about ``archive_bytes``, by turns of version 1 and 2, of pages whose html is text or bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size = 1, [], 0
        for batch in batches:
            for page, address, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    parts, size = [arc_header(version)], len(arc_header(version))
                parts.append(arc_record(version, size, page, address, payload or b""))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])
                    version, parts = 3 - version, []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])

    return arrow_batches(pages.select(F.col(page_id).cast("string"), F.col(url).cast("string"), F.col(html).cast("binary"))).mapInArrow(run, "content binary")


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, the filedesc record first: header fields and ``block``; raises where a declared length is wrong."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, fields = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace")
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file begins with a filedesc record")
            n = int(line.rsplit(" ", 1)[1])
            first, names = data[end + 1 : end + 1 + n].decode().split("\n")[:2]
            version = int(first.split(" ")[0])
            fields = names.split(" ")
            if FIELDS.get(version) != names:
                raise ValueError(f"unknown ARC version line: {first}")
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line of version {version} has {len(fields)} fields: {line[:100]}")
        n = int(values[-1])
        if end + 1 + n > len(data):
            raise ValueError("an ARC record is longer than its file")
        yield dict(zip(fields, values, strict=True)) | {"block": data[end + 1 : end + 1 + n]}
        at = end + 1 + n
        if data[at : at + 1] != b"\n":
            raise ValueError("an ARC record's declared length is wrong")
        at += 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers with the blank line, and payload."""
    head, sep, body = block.partition(b"\r\n\r\n")
    return (head + sep, body) if sep and block.startswith(b"HTTP/") else (b"", block)


def page_of(http: bytes) -> str | None:
    found = re.search(rf"\r\n{ID_HEADER}: ([^\r\n]*)\r\n".encode(), http)
    return urllib.parse.unquote(found[1].decode()) if found else None


RECORDS = "page string, kind string, url string, ip string, date string, content_type string, http binary, payload binary, payload_digest string, payload_bytes long, block_digest string, head_digest string, record_id string, info_id string"
KINDS = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in ddl.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def arc_records(arcs: DataFrame) -> DataFrame:
    """Records of ARC files (column ``content``) with synthesised types, ids and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, info, size = [], None, 0
                for r in parse_arc(content.as_py()):
                    http, payload = split_http(r["block"])
                    page = page_of(http)
                    digest = base32_sha1(r["block"])
                    name = f"urn:uuid:{uuid.uuid5(NAMES, ' '.join((r['URL'], r['Archive-date'], str(page), digest)))}"
                    kind, content_type = ("response", "application/http; msgtype=response") if http else ("resource", r["Content-type"])
                    if info is None:
                        info, kind, content_type = name, "warcinfo", "application/warc-fields"
                        payload = f"software: tilewright\r\nformat: WARC File Format 1.1\r\nconverted-from: {r['URL']}\r\narc-fields: {r['block'].decode().splitlines()[1]}\r\n".encode()
                        digest = base32_sha1(payload)
                    rows.append((page, kind, r["URL"], r["IP-address"], r["Archive-date"], content_type, http, payload, base32_sha1(payload), len(payload), digest, base32_sha1(http), name, info))
                    size += len(payload)
                    if size >= 1 << 20:
                        yield batch_of(rows, RECORDS)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows, RECORDS)

    return arcs.mapInArrow(run, RECORDS)


# ---- WARC ----


def warc_rows(records: DataFrame, min_bytes: int = 0, id_type: str = "long", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(head, block): each record as WARC bytes; ``records`` is a written table of ``arc_records``."""
    known = records.where("kind = 'response'").select(F.col("page").cast(id_type).alias("page_id"), "payload_digest", "payload_bytes", "record_id")
    first = known.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))).alias("known_"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and known_ is not null").select("payload_digest", "payload_bytes", F.col("known_.page_id").alias("refers_to"), F.col("known_.record_id").alias("refers_id"))
    later = known.join(first, ["payload_digest", "payload_bytes"]).where("page_id is null or page_id != refers_to").select(F.col("record_id").alias("record_id_"), "refers_to", "refers_id").distinct()
    later = bounded(materialise(later, "warc-revisits"), broadcast_rows)
    both = records.join(later, records["record_id"] == later["record_id_"], "left")
    again, info = F.col("refers_id").isNotNull(), F.col("kind") == "warcinfo"
    size = F.octet_length("http") + F.when(again, 0).otherwise(F.octet_length("payload"))
    iso = F.concat(*(F.concat(F.substring("date", a, n), F.lit(sep)) for a, n, sep in ((1, 4, "-"), (5, 2, "-"), (7, 2, "T"), (9, 2, ":"), (11, 2, ":"), (13, 2, "Z"))))
    sha1 = lambda c: F.concat(F.lit("sha1:"), c)
    name = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    lines = [
        (F.lit("WARC-Type"), F.when(again, "revisit").otherwise(F.col("kind"))),
        (F.lit("WARC-Record-ID"), name("record_id")),
        (F.lit("WARC-Date"), iso),
        (F.lit("WARC-Target-URI"), F.when(~info, F.col("url"))),
        (F.lit("WARC-IP-Address"), F.when(~info, F.col("ip"))),
        (F.lit("WARC-Warcinfo-ID"), F.when(~info, name("info_id"))),
        (F.lit("WARC-Block-Digest"), sha1(F.when(again, F.col("head_digest")).otherwise(F.col("block_digest")))),
        (F.lit("WARC-Payload-Digest"), F.when(~info, sha1("payload_digest"))),
        (F.lit("X-Payload-Length"), F.col("payload_bytes").cast("string")),
        (F.lit("WARC-Refers-To"), name("refers_id")),
        (F.lit("X-Refers-To-Page"), F.url_encode(F.col("refers_to").cast("string"))),
        (F.lit("WARC-Profile"), F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        (F.lit("Content-Type"), F.col("content_type")),
        (F.lit("Content-Length"), size.cast("string")),
    ]
    head = F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(F.concat(k, F.lit(": "), v, F.lit("\r\n")), F.lit("")) for k, v in lines), F.lit("\r\n"))
    return both.select(head.cast("binary").alias("head"), "http", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(2, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write_warcs(rows: DataFrame, path: str, warc_bytes: int = WARC_BYTES) -> None:
    """Writes (head, http, payload) rows as gzipped WARC files of about ``warc_bytes`` under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in batches:
            out = []
            for parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = b"".join([*parts, b"\r\n\r\n"])
                packed = b"".join(member(data[i : i + MEMBER_BYTES]) for i in range(0, len(data), MEMBER_BYTES))
                out.append((size // warc_bytes, packed[:-1]))  # the writer adds the last byte, 0
                size += len(packed)
            if out:
                yield batch_of(out, "file int, member binary")

    packed = arrow_batches(rows).mapInArrow(run, "file int, member binary")
    packed.select("file", F.col("member").cast("string").alias("value")).write.partitionBy("file").option("lineSep", "\0").text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("a WARC record ends in its header")
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[key] = value
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record's declared length is wrong")
        yield headers, block


READ = "page string, payload_bytes long, payload_digest string, record_type string, refers string, record_id string, url string"


def read_warcs(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Records of the archives under ``path`` but warcinfo: page_id, payload_bytes, payload_digest, record_type, refers_to,
    record_id, url; digests of blocks and full payloads are computed again and must match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())), 1 << 16)):
                    if base32_sha1(block) != headers["WARC-Block-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"block and digest differ: {headers['WARC-Record-ID']}")
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    if kind != "revisit" and (base32_sha1(payload) != digest or len(payload) != size):
                        raise ValueError(f"payload and digest differ: {headers['WARC-Record-ID']}")
                    target = headers.get("X-Refers-To-Page")
                    rows.append((page_of(http), size, digest, kind, None if target is None else urllib.parse.unquote_plus(target), headers["WARC-Record-ID"].strip("<>"), headers["WARC-Target-URI"]))
                if rows:
                    yield batch_of(rows, READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    read = files.mapInArrow(run, READ)
    return read.select(F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"), "record_id", "url")


def convert_arcs(arcs: DataFrame, path: str, min_bytes: int = 0, id_type: str = "long", warc_bytes: int = WARC_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """Writes the records of ARC files (column ``content``) as WARC archives under ``path``."""
    records = materialise(arc_records(arcs), "arc-records")
    write_warcs(warc_rows(records, min_bytes, id_type, broadcast_rows), path, warc_bytes)
    discard(records)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC records, converted to WARC archives and read back."""
    pages = read_table(spark, sf_dir, "pages")
    path, id_type = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", pages.schema["page_id"].dataType.simpleString()
    convert_arcs(build_arcs(pages), path, id_type=id_type)
    return read_warcs(spark, path, id_type).drop("record_id", "url")


OP7_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, upper(sha1(coalesce(html, ''))) as h, url,
         coalesce(html, '') as html
  from pages),
g as (select h, n, min(page_id) as least_id from p group by h, n)
select page_id, cast(n as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: list_reduce(list_transform([32768, 1024, 32, 1], lambda d:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(p.h, cast(i * 5 + 1 as integer), 5) as bigint) // d) % 32 + 1 as integer), 1)), lambda a, b: a || b)), '') as payload_digest,
       case when page_id = least_id then 'response' else 'revisit' end as record_type,
       case when page_id = least_id then null else least_id end as refers_to
from p join g using (h, n)
"""
