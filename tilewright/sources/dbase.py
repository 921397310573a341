"""dBASE tables: ``spark.read.format("dbase").load(folder)`` and ``write_dbase``.

Tasks read ranges of bytes of the files of a folder. Rows flagged as deleted are left out. Field types N and F become
numbers, D dates, L booleans, others trimmed text; empty fields are null. Each row has ``_file``, ``_record`` (from 0 in its file) and ``_issues``:
values that are not of their type (the field is null then), an unknown flag, a truncated record (all fields null).
What is wrong with a file's header comes as a row of its own without ``_record``; of a file whose header cannot be read it is the only row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from .staged import Slice, Staging, Written, listed, new_name, read_range

#: Fixed values of the format: version, end of the fields, end of the file, flags of live and deleted rows, longest text.
VERSION, FIELDS_END, FILE_END, LIVE, DELETED, LONGEST = 3, 13, 26, 32, 42, 254
OWN = StructType([StructField("_file", StringType()), StructField("_record", LongType()), StructField("_issues", ArrayType(StringType()))])
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]{1,18}$"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    length: int
    decimals: int

    def type(self) -> DataType:
        if self.kind in "NF":
            return DoubleType() if self.decimals or self.length > 18 else LongType()
        return {"D": DateType(), "L": BooleanType()}.get(self.kind, StringType())


@dataclass(frozen=True)
class Header:
    n_records: int
    size: int
    record: int
    fields: tuple[Field, ...]
    issues: tuple[str, ...]


def parse_header(data: bytes, size: int) -> Header:
    """The header at the beginning of ``data`` of a file of ``size`` bytes; ValueError if it cannot be read at all."""
    if len(data) < 32:
        raise ValueError("truncated header")
    n_records, header, record = struct.unpack_from("<IHH", data, 4)
    fields, issues, at = [], [], 32
    while at + 32 <= min(len(data), header) and data[at] != FIELDS_END:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii", "replace").strip()
        fields.append(Field(name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    if not fields or not record:
        raise ValueError("no fields")
    if at >= len(data) or data[at] != FIELDS_END:
        issues.append("fields without their end mark")
    computed = 1 + sum(f.length for f in fields)
    if computed != record:
        issues.append(f"fields need {computed} bytes a record, the header says {record}")
    if computed > record:
        raise ValueError(issues[-1])
    if len({f.name for f in fields}) < len(fields):
        issues.append("fields of equal names, the first is read")
    if header + n_records * record > size:
        issues.append(f"{n_records} records need {header + n_records * record} bytes, the file has {size}")
    return Header(n_records, header, record, tuple(fields), tuple(issues))


def texts(column: np.ndarray, encoding: str) -> pa.Array:
    """Trimmed text of fixed-width bytes, null where empty."""
    n, width = column.shape
    if not width:
        return pa.nulls(n, pa.string())
    raw = np.ascontiguousarray(column)
    if (raw < 128).all():
        text = pc.utf8_trim(pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(raw)]).cast(pa.binary()).cast(pa.string()), characters=" \t\r\n\0")
    else:
        text = pa.array([bytes(r).decode(encoding, "replace").strip(" \t\r\n\0") for r in raw], pa.string())
    return pc.if_else(pc.equal(text, ""), None, text)


def typed(text: pa.Array, kind: DataType) -> pa.Array:
    """Values of ``text``, null where it is not of the type."""
    keep = lambda pattern: pc.replace_substring_regex(pc.if_else(pc.match_substring_regex(text, pattern), text, None), r"^\+", "")
    if isinstance(kind, DoubleType):
        return keep(NUMBER).cast(pa.float64())
    if isinstance(kind, LongType):
        whole = keep(INTEGER).cast(pa.int64())
        number = keep(NUMBER).cast(pa.float64())
        near = pc.if_else(pc.less(pc.abs(number), 2.0**63), pc.trunc(number), None)  # as far as a long holds it
        return pc.coalesce(whole, near.cast(pa.int64()))
    if isinstance(kind, DateType):
        found = pc.strptime(keep(r"^[0-9]{8}$"), format="%Y%m%d", unit="s", error_is_null=True).cast(pa.date32())
        # such a reading may roll over the end of a month
        return pc.if_else(pc.equal(pc.strftime(found, format="%Y%m%d"), text), found, None)
    if isinstance(kind, BooleanType):
        return pc.if_else(pc.is_in(text, pa.array(list("YyTt"))), True, pc.if_else(pc.is_in(text, pa.array(list("NnFf"))), False, pa.scalar(None, pa.bool_())))
    return text


class DbaseReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int, encoding: str):
        self.path, self.schema, self.split, self.encoding = path, schema, split, encoding

    def partitions(self) -> list[Slice]:
        found = [Slice(name, size, at, at + self.split) for name, size in listed(self.path, ".dbf") for at in range(0, max(size, 1), self.split)]
        return found or [Slice("", 0, 0, 0)]

    def batch(self, file: str, records: list, issues: list, columns: dict) -> pa.RecordBatch:
        own = {"_file": pa.array([file.rsplit("/", 1)[-1]] * len(records), pa.string()), "_record": pa.array(records, pa.int64()), "_issues": pa.array(issues, pa.list_(pa.string()))}
        kinds = {LongType: pa.int64(), DoubleType: pa.float64(), DateType: pa.date32(), BooleanType: pa.bool_()}
        arrays = [own[f.name] if f.name in own else columns.get(f.name, pa.nulls(len(records), kinds.get(type(f.dataType), pa.string()))) for f in self.schema]
        return pa.RecordBatch.from_arrays(arrays, self.schema.names)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        """Records that begin in the slice; its first one reports the header."""
        if not partition.file:
            return
        head = read_range(self.path, partition.file, 0, 1 << 16)
        try:
            header = parse_header(head, partition.size)
        except ValueError as e:
            if partition.begin == 0:
                yield self.batch(partition.file, [None], [[str(e)]], {})
            return
        if partition.begin == 0 and header.issues:
            yield self.batch(partition.file, [None], [list(header.issues)], {})
        first, last = (min(max(0, -((header.size - at) // header.record)), header.n_records) for at in (partition.begin, min(partition.end, partition.size)))
        if first < last:
            begin = header.size + first * header.record
            yield from self.rows(partition, header, first, last, read_range(self.path, partition.file, begin, begin + (last - first) * header.record))

    def rows(self, partition: Slice, header: Header, first: int, last: int, data: bytes) -> Iterator[pa.RecordBatch]:
        whole = len(data) // header.record
        table = np.frombuffer(data, np.uint8, whole * header.record).reshape(whole, header.record)
        live = table[:, 0] != DELETED
        records, table = first + np.flatnonzero(live), table[live]
        issues = [[] for _ in records]
        for k in np.flatnonzero(table[:, 0] != LIVE).tolist():
            issues[k].append("unknown flag")
        wanted = {f.name: f.dataType for f in self.schema}
        columns, at = {}, 1
        for field in header.fields:
            if field.name in wanted and field.name not in columns:
                text = texts(table[:, at : at + field.length], self.encoding)
                columns[field.name] = value = typed(text, wanted[field.name])
                unset = pc.is_in(text, pa.array(["?"])) if field.kind == "L" else pa.array([False] * len(text), pa.bool_())
                wrong = pc.and_(pc.and_(pc.is_valid(text), pc.is_null(value)), pc.invert(unset))
                for k in np.flatnonzero(wrong.to_numpy(zero_copy_only=False)).tolist():
                    issues[k].append(f"{field.name} is not of type {field.kind}")
            at += field.length
        if len(records):
            yield self.batch(partition.file, records.tolist(), issues, columns)
        if whole < last - first:  # the file ends here; only the record that was begun is a row
            yield self.batch(partition.file, [first + whole], [["truncated record"]], {})


class DbaseWriter(Staging, DataSourceArrowWriter):
    """Files of at most ``rows`` records for each task."""

    def __init__(self, path: str, schema: StructType, fields: list[Field], deleted: str | None, rows: int, encoding: str):
        self.path, self.names, self.fields, self.deleted, self.rows, self.encoding = path, schema.names, fields, deleted, rows, encoding

    def header(self, n_records: int) -> bytes:
        parts = [f.name.encode("ascii").ljust(11, b"\0") + f.kind.encode() + bytes(4) + bytes([f.length, f.decimals]) + bytes(14) for f in self.fields]
        size = 32 + 32 * len(parts) + 1
        return struct.pack("<4BIHH20x", VERSION, 0, 1, 1, n_records, size, 1 + sum(f.length for f in self.fields)) + b"".join(parts) + bytes([FIELDS_END])

    def cell(self, field: Field, value) -> bytes:
        if value is None:
            text = b""
        elif field.kind == "D":
            text = value.strftime("%Y%m%d").encode()
        elif field.kind == "L":
            text = b"T" if value else b"F"
        elif field.kind == "N":
            text = (f"{value:.{field.decimals}f}" if field.decimals else str(value)).encode()
        else:
            text = value.encode(self.encoding, "replace")
        if len(text) > field.length:
            raise ValueError(f"{field.name} needs {len(text)} bytes, its field has {field.length}")
        return text.rjust(field.length) if field.kind == "N" else text.ljust(field.length)

    def records(self, batch: pa.RecordBatch) -> list[bytes]:
        data = [n for n in self.names if n != self.deleted]
        columns = [[self.cell(f, v) for v in batch.column(n).to_pylist()] for f, n in zip(self.fields, data, strict=True)]
        flags = batch.column(self.deleted).to_pylist() if self.deleted else [False] * batch.num_rows
        return [bytes([DELETED if gone else LIVE]) + b"".join(cells) for gone, *cells in zip(flags, *columns, strict=True)]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done, held = [], []
        flush = lambda rows: done.append(self.put(f"{new_name()}.dbf", [self.header(len(rows)), *rows, bytes([FILE_END])]))
        for batch in batches:
            held += self.records(batch)
            while len(held) >= self.rows:
                flush(held[: self.rows])
                held = held[self.rows :]
        if held:
            flush(held)
        return Written(done)


class DbaseSource(DataSource):
    """Options: ``path``; ``bytes`` of a reading task; ``encoding``; ``rows`` of a written file. Without a schema given, the fields of the first file, by name, are the columns."""

    @classmethod
    def name(cls) -> str:
        return "dbase"

    def schema(self) -> StructType:
        for name, size in listed(self.options["path"], ".dbf"):
            try:
                fields = parse_header(read_range(self.options["path"], name, 0, 1 << 16), size).fields
            except ValueError:
                continue
            kinds = {}
            for f in fields:
                kinds.setdefault(f.name, f.type())
            return StructType([*(StructField(n, t) for n, t in kinds.items()), *OWN])
        return OWN

    def reader(self, schema: StructType) -> DataSourceReader:
        return DbaseReader(self.options["path"], schema, int(self.options.get("bytes", 64 << 20)), self.options.get("encoding", "ascii"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        fields = [Field(*(v if i in (0, 1) else int(v) for i, v in enumerate(f.split(":")))) for f in self.options["fields"].split(",")]
        return DbaseWriter(self.options["path"], schema, fields, self.options.get("deleted") or None, int(self.options.get("rows", 250_000)), self.options.get("encoding", "ascii"))


def write_dbase(df: DataFrame, path: str, deleted: str | None = None, decimals: int = 6, encoding: str = "ascii") -> None:
    """Writes ``df`` as dBASE files; rows whose boolean column ``deleted`` is true are flagged as deleted.

    Names are cut to ten characters, which must stay distinct. Widths of text come from one pass over the table; text of over 254
    bytes and other types than text, numbers, dates and booleans raise ValueError. Numbers keep ``decimals`` places.
    """
    columns = [f for f in df.schema if f.name != deleted]
    names = [f.name[:10] for f in columns]
    if len(set(names)) < len(names):
        raise ValueError("names are equal in their first ten characters")
    of_text = [f.name for f in columns if isinstance(f.dataType, StringType)]
    # a character that the encoding lacks is written as one byte
    size = (lambda c: F.octet_length(c)) if encoding.replace("-", "").lower() == "utf8" else (lambda c: F.char_length(c))
    widest = df.agg(F.lit(1), *(F.max(size(F.col(f"`{n}`"))).alias(n) for n in of_text)).first().asDict()
    fields = []
    for name, f in zip(names, columns, strict=True):
        if isinstance(f.dataType, StringType):
            width = max(1, widest[f.name] or 0)
            if width > LONGEST:
                raise ValueError(f"{f.name} holds a text of {width} bytes, a field has {LONGEST} at most")
            fields.append(Field(name, "C", width, 0))
        elif isinstance(f.dataType, (LongType, IntegerType, ShortType)):
            fields.append(Field(name, "N", 18 if isinstance(f.dataType, LongType) else 11, 0))
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            fields.append(Field(name, "N", 24 + decimals, decimals))
        elif isinstance(f.dataType, (DateType, BooleanType)):
            fields.append(Field(name, "D", 8, 0) if isinstance(f.dataType, DateType) else Field(name, "L", 1, 0))
        else:
            raise ValueError(f"{f.name}: no field for type {f.dataType.simpleString()}")
    df.sparkSession.dataSource.register(DbaseSource)
    options = {"fields": ",".join(f"{f.name}:{f.kind}:{f.length}:{f.decimals}" for f in fields), "deleted": deleted or "", "encoding": encoding}
    df.write.format("dbase").options(**options).mode("append").save(path)
