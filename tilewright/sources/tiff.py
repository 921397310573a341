"""TIFF images of tiles with world files beside them, and the metadata of TIFF files without their pixels.

Files are written by the tasks that paint them under names that a repeated task writes again. Metadata is read by tasks in
ranges of bytes: the header, the first directory and values stored outside it. Damaged files give a row with their issue; Spark's
listing leaves out files without any bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index_maps import painted
from .staged import file_system, read_range

#: Fixed values of the format: numbers of the two versions, bytes of a value by type, letters of unsigned types, Deflate.
CLASSIC, BIG = 42, 43
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
UNSIGNED = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}
DEFLATE = 8
#: Tags by name, and what holds without them.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_bytes": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_bytes": 325}
DEFAULTS = {"bits": 1, "compression": 1, "photometric": 1, "samples": 1, "planar": 1, "predictor": 1}
NUMBERS = ("width", "height", "bits", "samples", "compression", "photometric", "planar", "predictor", "tile_width", "tile_height", "rows_per_strip", "n_parts")
METADATA = "tile_id long, little boolean, big_tiff boolean, tiled boolean, " + ", ".join(f"{n} long" for n in NUMBERS) + ", issue string"
#: Pixel size of the world files.
STEP = 0.5


def encode(pixels: np.ndarray, order: str = "<", big: bool = False, tile: int | None = None, strip: int = 64) -> bytes:
    """A grey image of eight bits, deflated in strips of ``strip`` rows or square tiles."""
    height, width = pixels.shape
    if tile:
        padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
        padded[:height, :width] = pixels
        parts = [padded[y : y + tile, x : x + tile] for y in range(0, len(padded), tile) for x in range(0, padded.shape[1], tile)]
    else:
        parts = [pixels[y : y + strip].astype(np.uint8) for y in range(0, height, strip)]
    packed = [zlib.compress(np.ascontiguousarray(p).tobytes(), 1) for p in parts]
    packed = [p + b"\0" * (len(p) % 2) for p in packed]
    word, inline, start = ("Q", 8, 16) if big else ("I", 4, 8)
    sizes = np.array([len(p) for p in packed])
    offsets = (start + np.cumsum(sizes) - sizes).tolist()
    values = {"width": [width], "height": [height], "bits": [8], "compression": [DEFLATE], "photometric": [1], "samples": [1]}
    values |= {"tile_width": [tile], "tile_height": [tile], "tile_offsets": offsets, "tile_bytes": sizes.tolist()} if tile else {"rows_per_strip": [strip], "strip_offsets": offsets, "strip_bytes": sizes.tolist()}
    outside, entries, at = b"", b"", start + int(sizes.sum())
    for tag, found in sorted((TAGS[n], v) for n, v in values.items()):
        data = struct.pack(f"{order}{len(found)}{word}", *found)
        if len(data) > inline:
            place, outside = at + len(outside), outside + data
            data = struct.pack(order + word, place)
        entries += struct.pack(f"{order}HH{word}", tag, 16 if big else 4, len(found)) + data
    first = at + len(outside)
    mark = b"II" if order == "<" else b"MM"
    header = mark + (struct.pack(f"{order}HHHQ", BIG, 8, 0, first) if big else struct.pack(f"{order}HI", CLASSIC, first))
    return header + b"".join(packed) + outside + struct.pack(order + ("Q" if big else "H"), len(values)) + entries + bytes(inline)


def metadata(read: Callable[[int, int], bytes], size: int) -> dict:
    """Metadata of the first image of a file of ``size`` bytes by its ranges of bytes; ValueError says what is wrong."""

    def part(begin: int, n: int) -> bytes:
        if begin + n > size:
            raise ValueError("values beyond the end of the file")
        return read(begin, begin + n)

    if size < 8:
        raise ValueError("truncated header")
    head = read(0, min(16, size))
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("no byte order")
    magic = struct.unpack_from(order + "H", head, 2)[0]
    if magic not in (CLASSIC, BIG):
        raise ValueError(f"version {magic}")
    big = magic == BIG
    word, count, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    if big and (len(head) < 16 or struct.unpack_from(order + "H", head, 4)[0] != 8):
        raise ValueError("offsets not of eight bytes")
    at = struct.unpack_from(order + word, head, 8 if big else 4)[0]
    n_entries = struct.unpack(order + count, part(at, struct.calcsize(count)))[0]
    directory = part(at + struct.calcsize(count), n_entries * entry)
    names, found = {v: k for k, v in TAGS.items()}, {}
    for k in range(0, len(directory), entry):
        tag, kind, n = struct.unpack_from(f"{order}HH{word}", directory, k)
        if tag in names and kind in UNSIGNED and n:
            if names[tag].endswith(("offsets", "bytes")):
                found[names[tag]] = n  # only how many there are
            else:
                length = TYPE_BYTES[kind]
                data = directory[k + entry - inline : k + entry] if length * n <= inline else part(struct.unpack_from(order + word, directory, k + entry - inline)[0], length)
                found[names[tag]] = struct.unpack_from(order + UNSIGNED[kind], data)[0]
    if "width" not in found or "height" not in found:
        raise ValueError("no width or height")
    tiled = "tile_width" in found and "tile_height" in found
    found["n_parts"] = found.get("tile_offsets" if tiled else "strip_offsets")
    return {"little": order == "<", "big_tiff": big, "tiled": tiled} | {n: found.get(n, DEFAULTS.get(n)) for n in NUMBERS}


def world_lines(tile: int, left: int, top: int) -> str:
    """A world file: steps and turns, then the centre of the first pixel."""
    return "\n".join(map(repr, (STEP, 0.0, 0.0, -STEP, tile * 256 + left * STEP, 1000 - top * STEP))) + "\n"


def write_images(runs: DataFrame, path: str) -> DataFrame:
    """Writes an image of each tile's box of (tile_id, component_id, y, xa, xb), with its world file; the result, which has to be run, lists them.

    Tiles take turns of byte order, version, and strips or tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(path)
        system.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for tile, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, y, xa, xb = (rows.values.field(k).to_numpy() for k in ("component_id", "y", "xa", "xb"))
                top, left = int(y.min()), int(xa.min())
                pixels = painted(ids, y - top, xa - left, xb - left, int(y.max()) - top + 1, int(xb.max()) - left + 1)
                data = encode(pixels % 256, "<" if tile % 2 else ">", tile % 3 == 0, 128 if tile % 5 < 2 else None)
                sizes.append(len(data))
                for ending, content in (("tif", data), ("tfw", world_lines(tile, left, top).encode())):
                    with system.open_output_stream(f"{base}/tile-{tile}.{ending}") as out:
                        out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["tile_id", "bytes"])

    # the runs of one tile: 512 rows of a few components
    lists = runs.groupBy("tile_id").agg(F.collect_list(F.struct("component_id", "y", "xa", "xb")).alias("runs"))
    return lists.mapInArrow(run, "tile_id long, bytes long")


def _tile_of(ending: str):
    return F.regexp_extract("path", rf"tile-(-?[0-9]+)\.{ending}$", 1).cast("long").alias("tile_id")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``METADATA`` of every TIFF file of a folder; Spark lists the files, their pixels stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tile, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = at.removeprefix("file:") if "://" not in at else file_system(at)[1]
                try:
                    rows.append({"tile_id": tile, **metadata(lambda a, b, name=name: read_range(path, name, a, b), size), "issue": None})
                except ValueError as e:
                    rows.append({"tile_id": tile, "issue": str(e)})
            kinds = [pa.int64(), *[pa.bool_()] * 3, *[pa.int64()] * len(NUMBERS), pa.string()]
            names = ["tile_id", "little", "big_tiff", "tiled", *NUMBERS, "issue"]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    listing = spark.read.format("binaryFile").option("pathGlobFilter", "tile-*.tif").load(path).select(_tile_of("tif"), "path", "length")
    return listing.mapInArrow(run, METADATA)


def read_world_files(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, a, d, b, e, c, f, issue) of every world file of a folder; one that does not hold six numbers has an issue."""
    whole = spark.read.option("pathGlobFilter", "tile-*.tfw").text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    numbers = whole.select(_tile_of("tfw"), F.transform(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda w: w.try_cast("double")).alias("v"))
    good = (F.size("v") == 6) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    return numbers.select("tile_id", *(F.when(good, F.get("v", F.lit(i))).alias(n) for i, n in enumerate("adbecf")), F.when(~good, "not six numbers").alias("issue"))
