"""Media columns: signature sniffing with an Aho-Corasick automaton.

One automaton finds every magic number of the known formats in a byte string in
one pass. A hit is only a candidate: a validator for its format walks headers,
chunks and declared lengths, and what it confirms gives the true type and
extent. A confirmed hit at offset 0 corrects the declared type; further ones
are carved as embedded media. Rows are independent, so the work is one narrow
map over Arrow batches without a shuffle.

Defined cases: null content gives null type, ``valid`` false and no carved
media; empty content likewise with length 0; repeated rows give repeated
results; a very long content is one row, searched and carved whole; extra columns of
the input are not touched and may have any name.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, arrow_batches, read_table

#: Magic numbers (bytes to look for, offset of the file's start before them, type).
MAGIC = [
    (b"RIFF", 0, "audio/wav"),
    (b".snd", 0, "audio/basic"),
    (b"BM", 0, "image/bmp"),
    (b"P5\n", 0, "image/x-portable-graymap"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]

FRAME = 576
WIDTH = 24
RATE = 8000
#: Declared type of stored rows, wrong on purpose: the sniffer has to correct it.
DECLARED = "application/octet-stream"


# ---- validators: (buffer, start) -> (end, data start, data end, facts) or None ----


def check_wav(b: bytes, at: int):
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, fmt, data = at + 12, None, None
    while pos + 8 <= end:
        kind, n = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + n > end:
            return None
        if kind == b"fmt " and n >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, pos + 8)
        elif kind == b"data":
            data = (pos + 8, pos + 8 + n)
        pos += 8 + n + (n & 1)
    if not fmt or not data or not fmt[1] or fmt[4] != fmt[1] * ((fmt[5] + 7) // 8) or fmt[3] != fmt[2] * fmt[4]:
        return None
    return end, *data, f"channels={fmt[1]} rate={fmt[2]} bits={fmt[5]} samples={(data[1] - data[0]) // fmt[4]}"


def check_au(b: bytes, at: int):
    if len(b) < at + 24:
        return None
    start, n, code, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    if start < 24 or not 1 <= code <= 27 or not 1 <= channels <= 64 or not rate or at + start + n > len(b):
        return None
    return at + start + n, at + start, at + start + n, f"channels={channels} rate={rate} encoding={code}"


def check_bmp(b: bytes, at: int):
    if len(b) < at + 54:
        return None
    size, _, start, head, w, h, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if planes != 1 or head < 40 or bits not in (1, 4, 8, 16, 24, 32) or packed or w <= 0 or not h or start < 14 + head:
        return None
    n = (w * bits + 31) // 32 * 4 * abs(h)
    if start + n > size or at + size > len(b):
        return None
    return at + size, at + start, at + start + n, f"width={w} height={abs(h)} bits={bits}"


def check_pgm(b: bytes, at: int):
    words, pos = [], at + 2
    while len(words) < 3:
        stop = pos + 1
        while stop < len(b) and 48 <= b[stop] <= 57:
            stop += 1
        if b[pos : pos + 1] not in (b"\n", b" ", b"\t") or not 1 < stop - pos < 11:
            return None
        words.append(int(b[pos + 1 : stop]))
        pos = stop
    w, h, top = words
    if b[pos : pos + 1] not in (b"\n", b" ", b"\t") or not w or not h or not 0 < top < 65536:
        return None
    end = pos + 1 + w * h * (1 if top < 256 else 2)
    return (end, pos + 1, end, f"width={w} height={h} bits={8 if top < 256 else 16}") if end <= len(b) else None


def check_png(b: bytes, at: int):
    pos, size, data = at + 8, None, []
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        if pos + 12 + n > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        if size is None:
            if kind != b"IHDR" or n != 13:
                return None
            size = struct.unpack_from(">IIBB", b, pos + 8)
        elif kind == b"IDAT":
            data += [pos + 8, pos + 8 + n]
        pos += 12 + n
        if kind == b"IEND":
            return (pos, data[0], data[-1], f"width={size[0]} height={size[1]} bits={size[2]}") if data else None
    return None


def check_gif(b: bytes, at: int):
    def blocks(pos: int) -> int | None:
        while pos < len(b):
            if not b[pos]:
                return pos + 1
            pos += 1 + b[pos]
        return None

    if len(b) < at + 14:
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    pos: int | None = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    first = None
    while pos is not None and pos < len(b):
        if b[pos] == 0x3B:
            return (pos + 1, first, pos, f"width={w} height={h} bits=8") if first and w and h else None
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            first = first or pos
            local = b[pos + 9]
            pos = blocks(pos + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
        else:
            return None
    return None


def check_jpeg(b: bytes, at: int):
    pos, size = at + 2, None
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        kind, n = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2 or pos + 2 + n > len(b):
            return None
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and n >= 8:
            size = struct.unpack_from(">BHH", b, pos + 4)
        pos += 2 + n
        if kind == 0xDA:
            stop = b.find(b"\xff\xd9", pos)
            return (stop + 2, pos, stop, f"width={size[2]} height={size[1]} bits={size[0]}") if size and stop >= 0 else None
    return None


def check_gzip(b: bytes, at: int):
    try:
        unpack, n, left = zlib.decompressobj(31), 0, b[at:]
        while left and not unpack.eof:  # bounded memory, whatever it expands to
            n += len(unpack.decompress(left, 1 << 20))
            left = unpack.unconsumed_tail
        if not unpack.eof:
            return None
        end = len(b) - len(unpack.unused_data)
    except zlib.error:
        return None
    return end, at + 10, end - 8, f"unpacked={n}"


VALIDATORS = {
    "audio/wav": check_wav,
    "audio/basic": check_au,
    "image/bmp": check_bmp,
    "image/x-portable-graymap": check_pgm,
    "image/png": check_png,
    "image/gif": check_gif,
    "image/jpeg": check_jpeg,
    "application/gzip": check_gzip,
}


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, back, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic) + back - 1, kind))
    a.make_automaton()
    return a


def sniff(content: bytes) -> list[tuple]:
    """Confirmed media in a byte string, by offset: (type, start, end, data start, data end, facts).

    The outermost file at offset 0 comes first if there is one; of the others none overlaps another.
    """
    found, free = [], 0
    for last, (back, kind) in automaton().iter(content.decode("latin-1")):
        at = last - back
        if at and at < free:
            continue
        if got := VALIDATORS[kind](content, at):
            found.append((kind, at, *got))
            free = got[0] if at else free
    return found


# ---- storing a payload as 8-bit samples ----


def to_media(payload: bytes) -> bytes:
    """A payload of a multiple of 576 bytes as an 8-bit WAV, BMP or PGM file; its checksum picks which."""
    n = len(payload)
    kind = zlib.crc32(payload) % 3
    if kind == 0:
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload
    if kind == 1:  # rows of 24 bytes need no padding; a negative height keeps them in order
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 1078 + n, 0, 1078, 40, WIDTH, -(n // WIDTH), 1, 8, 0, n, 2835, 2835, 256, 256) + grey + payload
    return b"P5\n%d %d\n255\n" % (WIDTH, n // WIDTH) + payload


def store_as_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media, declared_type: each text's UTF-8, padded with 255 to a multiple of 576, as a media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for raw in batch.column(1):
                raw = raw.as_py() or b""
                sizes.append(len(raw))
                media.append(to_media(raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array([DECLARED] * len(sizes))], ["doc_id", "n_bytes", "media", "declared_type"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("raw"))
    out = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)]).add("n_bytes", "long").add("media", "binary").add("declared_type", "string")
    return arrow_batches(rows).mapInArrow(run, out)


CARVED = pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
SNIFFED = (
    T.StructType().add("media_type", "string").add("valid", "boolean").add("length", "long").add("corrected", "boolean").add("facts", "string").add("data", "binary")
    .add("carved", T.ArrayType(T.StructType().add("media_type", "string").add("offset", "long").add("length", "long")))
)


def sniff_media(df: DataFrame, content: str, declared: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (with ``_`` behind a name that a result has, too), then what the bytes of ``content`` really are.

    media_type (the declared one where nothing is confirmed at offset 0), valid, length of the
    confirmed file, corrected (the declared type was wrong), facts, data (the sample bytes) and
    carved: confirmed media at other offsets.
    """
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, said in zip(batch.column(n), batch.column(n + 1).to_pylist(), strict=True):
                raw = raw.as_py()
                found = sniff(raw) if raw else []
                first = found[0] if found and not found[0][1] else None
                rest = [{"media_type": f[0], "offset": f[1], "length": f[2] - f[1]} for f in found if f[1]]
                if first:
                    rows.append((first[0], True, first[2], first[0] != said, first[5], raw[first[3] : first[4]], rest))
                else:
                    rows.append((None if raw is None else said, False, None if raw is None else len(raw), False, None, None, rest))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), CARVED]
            out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *out], [f"c{i}" for i in range(n + 7)])

    rows = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate([*keep, content, declared])))
    out = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)])
    for i, f in enumerate(SNIFFED.fields):
        out = out.add(f"c{n + i}", f.dataType)
    return arrow_batches(rows).mapInArrow(run, out).toDF(*apart(keep, SNIFFED.names), *SNIFFED.names)


def feature() -> Column:
    """Type, facts and carved media of a sniffed row as one string."""
    carved = F.transform("carved", lambda c: F.concat_ws("@", c["media_type"], c["offset"].cast("string")))
    return F.concat_ws(" ", "media_type", "facts", F.concat(F.lit("carved="), F.concat_ws(",", carved)))


def op10_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a media file, sniffed, read back and digested."""
    docs = read_table(spark, sf_dir, "documents")
    found = sniff_media(store_as_media(docs), "media", "declared_type", ["doc_id", "n_bytes", "media"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("data").cast("long").alias("payload_bytes"),
        F.sha2("data", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(data, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature().alias("feature"),
    )
