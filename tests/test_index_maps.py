"""Indexed PNG files: round trips, all row filters, damaged files; order of JSON lines."""

import struct
import zlib

import numpy as np
import pytest

from tilewright.sources import files
from tilewright.sources import index_maps as M


def filtered(labels, kinds):
    """Rows stored by given filters, pixel by pixel."""
    out, above = bytearray(), [0] * labels.shape[1]
    for kind, row in zip(kinds, labels.tolist(), strict=True):
        out.append(kind)
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        above = row
    return bytes(out)


def png(labels, raw, **header):
    h = {"depth": 8, "colour": 3, "interlaced": 0} | header
    ihdr = struct.pack(">IIBBBBB", labels.shape[1], labels.shape[0], h["depth"], h["colour"], 0, 0, h["interlaced"])
    packed = zlib.compress(raw)
    return M.SIGNATURE + M._chunk(b"IHDR", ihdr) + M._chunk(b"IDAT", packed[:5]) + M._chunk(b"tEXt", b"a\0b") + M._chunk(b"IDAT", packed[5:]) + M._chunk(b"IEND", b"")


def test_round_trip_and_filters():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (5, 9), (64, 40)):
        labels = rng.integers(0, 256, shape)
        assert (M.decode(M.encode(labels)) == labels).all()
        for kind in range(5):
            assert (M.decode(png(labels, filtered(labels, [kind] * len(labels)))) == labels).all()
        assert (M.decode(png(labels, filtered(labels, rng.integers(0, 5, len(labels)).tolist()), colour=0)) == labels).all()
    with pytest.raises(ValueError):
        M.encode(np.array([[256]]))


def test_damaged_files():
    labels = np.arange(12).reshape(3, 4)
    good, raw = M.encode(labels), filtered(labels, [0] * 3)
    bad = bytearray(good)
    bad[-20] ^= 1
    for data, reason in ((b"", "not a PNG"), (b"GIF89a..", "not a PNG"), (good[:-5], "truncated"), (good[:60], "truncated"), (bytes(bad), "checksum"), (png(labels, raw, interlaced=1), "interlacing"), (png(labels, raw, depth=4), "eight bits"), (png(labels, raw[:-1]), "number of pixels"), (png(labels, b"\x07" + raw[1:]), "filter")):
        with pytest.raises(ValueError, match=reason):
            M.decode(data)


def test_files_come_back(spark, tmp_path):
    runs = [(1, 1, 0, 0, 9), (1, 1, 1, 2, 3), (1, 2, 0, 4, 5), (-4, 7, 63, 0, 63), (9, 255, 5, 5, 5)]
    df = spark.createDataFrame(runs, "tile_id long, component_id int, y int, xa int, xb int")
    written = M.write_index_maps(df, str(tmp_path / "maps"), 64, 64).collect()
    assert sorted(r.file for r in written) == ["tile--4.png", "tile-1.png", "tile-9.png"]
    (tmp_path / "maps" / "tile-12.png").write_bytes(b"nothing")
    got = sorted((tuple(r) for r in M.read_index_maps(spark, str(tmp_path / "maps")).collect()), key=str)
    want = [(1, 1, 0, 0, 3, None), (1, 1, 0, 6, 9, None), (1, 1, 1, 2, 3, None), (1, 2, 0, 4, 5, None), (-4, 7, 63, 0, 63, None), (9, 255, 5, 5, 5, None), (12, None, None, None, None, "not a PNG file")]
    assert got == sorted(want, key=str)


def test_json_lines_are_in_order(spark, tmp_path):
    """Within each folder the lines of all files, by name, ascend; a large folder has several files."""
    rows = spark.range(20_000).selectExpr("id % 7919 as b", "'x' || id as a", "case when id % 50 = 0 then 'few' else 'most' end as split")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or small partitions are joined
    files.write_json_lines(rows, str(tmp_path / "lines"), "split")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = 0
    for folder in sorted((tmp_path / "lines").glob("split=*")):
        parts = sorted(folder.glob("part-*"))
        lines = [line for p in parts for line in p.read_text().splitlines()]
        assert lines == sorted(lines)
        assert len(parts) > 1 or "few" in folder.name
        total += len(lines)
    assert total == 20_000
    back = files.read_json_lines(spark, str(tmp_path / "lines"), "a string, b long, split string")
    assert back.count() == 20_000 and back.where("split = 'few'").count() == 400
