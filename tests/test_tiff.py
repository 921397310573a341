"""TIFF metadata in both byte orders and versions, damaged files, world files."""

import struct

import numpy as np
import pytest

from tilewright.sources import tiff as T


def of(data):
    return T.metadata(lambda a, b: data[a:b], len(data))


def test_both_orders_and_versions():
    pixels = np.arange(200 * 150).reshape(200, 150) % 251
    for order in "<>":
        for big in (False, True):
            got = of(T.encode(pixels, order, big, strip=48))
            assert got == {"little": order == "<", "big_tiff": big, "tiled": False, "width": 150, "height": 200, "bits": 8, "samples": 1, "compression": 8, "photometric": 1, "planar": 1, "predictor": 1, "tile_width": None, "tile_height": None, "rows_per_strip": 48, "n_parts": 5}
            got = of(T.encode(pixels, order, big, tile=64))
            assert (got["tiled"], got["tile_width"], got["tile_height"], got["n_parts"], got["rows_per_strip"]) == (True, 64, 64, 12, None)


def test_only_directories_are_read():
    data = T.encode(np.random.default_rng(1).integers(0, 256, (512, 512)), tile=64)
    read = []

    def part(a, b):
        read.append(b - a)
        return data[a:b]

    assert T.metadata(part, len(data))["n_parts"] == 64 and sum(read) < 400 < len(data)


def test_values_of_other_types():
    """Short values, three of them outside the directory, a tag of text, one that is unknown."""
    outside = struct.pack(">3H", 16, 16, 16)
    tags = [(256, 3, 1, struct.pack(">HH", 9, 0)), (257, 4, 1, struct.pack(">I", 7)), (258, 3, 3, struct.pack(">I", 8)), (270, 2, 4, b"abc\0"), (277, 3, 1, struct.pack(">HH", 3, 0)), (65000, 99, 1, bytes(4))]
    data = b"MM" + struct.pack(">HI", 42, 14) + outside + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, n) + v for t, k, n, v in tags)
    got = of(data)
    assert (got["width"], got["height"], got["bits"], got["samples"], got["compression"], got["n_parts"]) == (9, 7, 16, 3, 1, None)


def test_damaged_files():
    good = T.encode(np.ones((5, 5)))
    no_size = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 0)
    for data, reason in ((b"", "truncated"), (b"XX" + good[2:], "byte order"), (good[:2] + b"\x07\0" + good[4:], "version 7"), (good[:-20], "beyond"), (no_size, "no width"), (b"II" + struct.pack("<HHHQ", 43, 4, 0, 16), "eight bytes"), (b"II" + struct.pack("<HI", 42, 1 << 31), "beyond")):
        with pytest.raises(ValueError, match=reason):
            of(data)


def test_files_come_back(spark, tmp_path):
    path = str(tmp_path / "images")
    runs = [(1, 1, 10, 5, 40), (1, 2, 12, 0, 3), (6, 1, 0, 0, 300), (6, 3, 200, 0, 0)]
    assert T.write_images(spark.createDataFrame(runs, "tile_id long, component_id int, y int, xa int, xb int"), path).count() == 2
    (tmp_path / "images" / "tile-9.tif").write_bytes(b"II*")
    (tmp_path / "images" / "tile-9.tfw").write_text("1\n2\n3\n4\n5\nx\n")
    (tmp_path / "images" / "tile-8.tfw").write_text("\n")
    got = {r.tile_id: r for r in T.read_metadata(spark, path).collect()}
    assert (got[1].width, got[1].height, got[1].little, got[1].big_tiff, got[1].tiled) == (41, 3, True, False, True)
    assert (got[6].width, got[6].height, got[6].little, got[6].big_tiff, got[6].n_parts) == (301, 201, False, True, 6)
    assert got[9].issue == "truncated header" and got[9].width is None
    world = {r.tile_id: tuple(r)[1:] for r in T.read_world_files(spark, path).collect()}
    assert world[1] == (0.5, 0.0, 0.0, -0.5, 256.0, 995.0, None) and world[6] == (0.5, 0.0, 0.0, -0.5, 1536.0, 1000.0, None)
    assert world[8] == world[9] == (None,) * 6 + ("not six numbers",)
