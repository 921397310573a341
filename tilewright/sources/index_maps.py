"""Index maps as PNG files: a tile's pixels hold the number of the component that owns them, 0 for none.

Files are written by the tasks that paint them, one for each tile, under names that a repeated task writes again,
and read with Spark's ``binaryFile`` source. A file that cannot be read gives a row with its issue instead of pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grids import mask_runs
from .staged import file_system

#: Fixed values of the format.
SIGNATURE, DEPTH, GREY, PALETTE = b"\x89PNG\r\n\x1a\n", 8, 0, 3


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(labels: np.ndarray) -> bytes:
    """An indexed PNG of numbers below 256; each row is stored as the difference to the one above, which label maps repeat."""
    if labels.size and (labels.min() < 0 or labels.max() > 255):
        raise ValueError("an indexed image holds numbers from 0 to 255")
    rows = labels.astype(np.uint8)
    above = np.concatenate([np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]])
    stored = np.concatenate([np.full((len(rows), 1), 2, np.uint8), rows - above], axis=1)
    header = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], DEPTH, PALETTE, 0, 0, 0)
    colours = bytes(v for i in range(256) for v in (37 * i % 256, 91 * i % 256, 151 * i % 256))
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"PLTE", colours) + _chunk(b"IDAT", zlib.compress(stored.tobytes(), 6)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while True:
        if at + 12 > len(data):
            raise ValueError("truncated")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise ValueError("truncated")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"wrong checksum in {kind.decode('latin-1')}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def _paeth(left: int, up: int, corner: int) -> int:
    guess = left + up - corner
    return min((abs(guess - v), i, v) for i, v in enumerate((left, up, corner)))[2]


def _unfiltered(stored: np.ndarray) -> np.ndarray:
    """Rows of one byte a pixel from stored ones, which begin with the number of their filter."""
    out = np.zeros((len(stored) + 1, stored.shape[1] - 1), np.uint8)
    for y, (kind, row) in enumerate(zip(stored[:, 0].tolist(), stored[:, 1:], strict=True), 1):
        if kind == 0:
            out[y] = row
        elif kind == 1:
            out[y] = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            out[y] = row + out[y - 1]
        elif kind in (3, 4):
            above, now, left, corner = out[y - 1].tolist(), [], 0, 0
            for v, up in zip(row.tolist(), above, strict=True):
                left = (v + ((left + up) // 2 if kind == 3 else _paeth(left, up, corner))) % 256
                corner = up
                now.append(left)
            out[y] = now
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:]


def decode(data: bytes) -> np.ndarray:
    """The numbers of an indexed or grey PNG of eight bits without interlacing; ValueError says what is wrong with others."""
    header, packed = None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = header
    if depth != DEPTH or colour not in (GREY, PALETTE) or interlaced:
        raise ValueError("only eight bits, one channel and no interlacing are read")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError("pixels cannot be decompressed") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of pixels")
    return _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def painted(ids: np.ndarray, y: np.ndarray, xa: np.ndarray, xb: np.ndarray, height: int, width: int) -> np.ndarray:
    """Runs painted in order of their numbers, later ones over earlier ones."""
    out = np.zeros((height, width), np.int64)
    for k in np.argsort(ids, kind="stable").tolist():
        out[y[k], xa[k] : xb[k] + 1] = ids[k]
    return out


def write_index_maps(runs: DataFrame, path: str, height: int, width: int) -> DataFrame:
    """Writes a PNG for each tile of (tile_id, component_id, y, xa, xb) to ``path``; the result, which has to be run, lists tiles, files and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(path)
        system.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for tile, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(painted(*(rows.values.field(k).to_numpy() for k in ("component_id", "y", "xa", "xb")), height, width))
                names.append(f"tile-{tile}.png")
                sizes.append(len(data))
                with system.open_output_stream(f"{base}/{names[-1]}") as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["tile_id", "file", "bytes"])

    # the runs of one tile: 512 rows of a few components
    lists = runs.groupBy("tile_id").agg(F.collect_list(F.struct("component_id", "y", "xa", "xb")).alias("runs"))
    return lists.mapInArrow(run, "tile_id long, file string, bytes long")


def read_index_maps(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, component_id, y, xa, xb, issue): runs of equal numbers in every PNG of a folder, or the file's issue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    labels, issue = decode(data.as_py()).astype(np.int64), None
                except ValueError as e:
                    labels, issue = np.zeros((0, 0), np.int64), str(e)
                # runs end where the number changes, too
                parts = [(k, *mask_runs(labels == k)) for k in np.unique(labels).tolist() if k]
                column = lambda i, parts=parts: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)
                ids = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                n = len(ids)
                numbers = [pa.array(c, pa.int32()) for c in (ids, column(1), column(2), column(3))] if n or issue is None else [pa.nulls(1, pa.int32())] * 4
                n = n if issue is None else 1
                yield pa.RecordBatch.from_arrays([pa.array([tile] * n, pa.int64()), *numbers, pa.array([issue] * n, pa.string())], ["tile_id", "component_id", "y", "xa", "xb", "issue"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "tile-*.png").load(path)
    named = files.select(F.regexp_extract("path", r"tile-(-?[0-9]+)\.png$", 1).cast("long").alias("tile_id"), "content")
    return named.mapInArrow(run, "tile_id long, component_id int, y int, xa int, xb int, issue string")
