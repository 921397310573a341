"""dBASE tables: round trips over slices of every size, flags, damaged files."""

import datetime
import struct

import pytest

from tilewright.session import ship
from tilewright.sources import dbase

ROWS = [
    (1, "a b", 1.5, datetime.date(2024, 2, 29), True, 7, False),
    (-2, None, None, None, None, None, None),
    (3, "  x ", -0.25, datetime.date(1999, 12, 31), False, -8, True),
    (3, "", 1e6, datetime.date(2024, 2, 29), True, 0, False),
    (10**17, "long " * 50, 0.000001, None, None, 2**31 - 1, False),
]


def table(fields, records, n=None, end=b"\r", record=None):
    head = b"".join(name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([length, places]) + bytes(14) for name, kind, length, places in fields)
    size = 1 + sum(f[2] for f in fields) if record is None else record
    return struct.pack("<4BIHH20x", 3, 124, 1, 1, len(records) if n is None else n, 32 + len(head) + len(end), size) + head + end + b"".join(records)


def read(spark, path, **options):
    ship(spark)
    spark.dataSource.register(dbase.DbaseSource)
    return spark.read.format("dbase").options(**options).load(str(path))


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "a long, text string, x double, day date, yes boolean, small int, gone boolean").repartition(2)
    ship(spark)
    dbase.write_dbase(df, str(tmp_path / "t"), deleted="gone")
    want = sorted(((r[0], (r[1] or "").strip() or None, *r[2:6]) for r in ROWS if not r[6]), key=str)
    for size in (1, 50, 333, 1 << 20):
        back = read(spark, tmp_path / "t", bytes=size)
        assert [t for _, t in back.dtypes] == ["bigint", "string", "double", "date", "boolean", "bigint", "string", "bigint", "array<string>"]
        got = back.collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == want
        assert all(r._issues == [] for r in got)


def test_refused_tables(spark, tmp_path):
    for schema, row in (("a string", ("x" * 255,)), ("a_long_name1 int, a_long_name2 int", (1, 2)), ("a array<int>", ([1],))):
        with pytest.raises(ValueError):
            dbase.write_dbase(spark.createDataFrame([row], schema), str(tmp_path / "no"))


def test_damaged_files(spark, tmp_path):
    fields = [("n", "N", 4, 0), ("x", "F", 5, 2), ("d", "D", 8, 0), ("y", "L", 1, 0), ("s", "C", 3, 0)]
    rows = [b"   12  1.520240229Tab ", b"*  13  1.520240229Tab ", b" 12a   1,520240230Z\xff  ", b"?+7.9  -.5        ?   ", b" " * 21 + b"\0"]
    assert all(len(r) == 22 for r in rows)
    (tmp_path / "a.dbf").write_bytes(table(fields, rows))
    (tmp_path / "b.dbf").write_bytes(table(fields, [rows[0], rows[0][:9]]))
    (tmp_path / "c.dbf").write_bytes(b"\x03short")
    (tmp_path / "d.dbf").write_bytes(table(fields[:1], [b"    5"], end=b""))
    (tmp_path / "e.dbf").write_bytes(table(fields[:1], [b"    6xx"], record=7))
    (tmp_path / "f.dbf").write_bytes(b"")
    (tmp_path / "g.dbf").write_bytes(table([("s", "C", 2, 0)], []))
    (tmp_path / "h.dbf").write_bytes(table(fields, rows[:1], record=10))
    got = {}
    for r in read(spark, tmp_path).collect():
        got.setdefault(r._file[0], []).append((r._record, r.n, r.x, r.d, r.y, r.s, r._issues))
    day = datetime.date(2024, 2, 29)
    first = (0, 12, 1.5, day, True, "ab", [])
    assert sorted(got["a"]) == [
        first,
        (2, None, None, None, None, "�", ["n is not of type N", "x is not of type F", "d is not of type D", "y is not of type L"]),
        (3, 7, -0.5, None, None, None, ["unknown flag"]),
        (4, None, None, None, None, None, []),
    ]
    assert got["b"][0][0] is None and got["b"][0][6] == ["2 records need 237 bytes, the file has 224"]
    assert got["b"][1:] == [first, (1, None, None, None, None, None, ["truncated record"])]
    assert got["c"] == got["f"] == [(None,) * 6 + (["truncated header"],)]
    assert [r[6] for r in got["d"]] == [["fields without their end mark"], []] and got["d"][1][:2] == (0, 5)
    assert got["e"][0][6] == ["fields need 5 bytes a record, the header says 7"] and got["e"][1][:2] == (0, 6)
    assert "g" not in got
    assert got["h"] == [(None,) * 6 + (["fields need 22 bytes a record, the header says 10"],)]
    assert sorted(read(spark, tmp_path, bytes=3).collect(), key=str) == sorted(read(spark, tmp_path).collect(), key=str)


def test_empty_folder(spark, tmp_path):
    assert read(spark, tmp_path).collect() == []
