"""Token-ID / binary output: best-fit-decreasing packing.

Each task tokenises its documents, appends an end id, splits what is longer
than a row losslessly and packs the pieces best-fit-decreasing: the bins are
kept by remaining capacity in a segment tree, which finds the fullest bin that
still takes a piece in O(log capacity). Packing runs over a buffer of bounded
size (``buffer_tokens``) inside the task, so nothing is shuffled and memory
does not grow with the partition.

Defined cases: a null or empty text is the single end id; null ids stay null in
``doc_ids``, which has the ids' own type; repeated rows are packed once each; pieces
of equal length go by their order in the partition, into the bin that last came to
a capacity; very long texts are split into whole rows and a rest; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_batches, read_table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_ID = 50256
ROW = 2048
BUFFER_TOKENS = 4_000_000
#: Distinct units that a worker keeps with their ids.
CACHE = 400_000
#: Fixed value: the public split pattern of this tokenizer's vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the pattern may join a space to what stands before it: double spaces, and a space between white space, or behind it at the end.
JOINED = r"  |[\s\v\x{85}\pZ] (?:[\s\v\x{85}\pZ]|$)"


@functools.cache
def load_tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_units: dict[str, np.ndarray] = {}


def unit_ids(path: str, unit: str) -> np.ndarray:
    got = _units.get(unit)
    if got is None:
        got = np.array(load_tokenizer(path).encode_ordinary(unit), np.int32)
        if len(unit) <= 40:
            if len(_units) >= CACHE:
                _units.clear()
            _units[unit] = got
    return got


@functools.cache
def leads(path: str) -> np.ndarray:
    """Which token ids begin with a space."""
    enc = load_tokenizer(path)
    return np.array([raw[:1] == b" " for raw in map(enc.decode_single_token_bytes, range(enc.max_token_value + 1))])


def spaced_ids(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words, none of them empty, with a space or with white space at an end, each behind a space, on end, and the words' token counts.

    All are encoded as one text; the one token of each word that has its space begins with it.
    """
    ids = np.array(load_tokenizer(path).encode_ordinary("".join(" " + w for w in words)), np.int32)
    return ids, np.diff(np.append(np.flatnonzero(leads(path)[ids]), len(ids)))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of slices [start, start + len)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def encode_texts(texts: pa.Array, path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts on end, and the texts' token counts; the same ids as the tokenizer gives for each whole text.

    The split pattern joins a single space to what stands before it only where that is white space and
    no word follows, so other words with their leading space can be encoded once each; such texts, and those with double spaces, go whole.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    whole = pc.match_substring_regex(texts, JOINED).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(pc.if_else(pa.array(whole), pa.scalar(""), texts), " ")
    offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py() if len(parts) else np.zeros(1, np.int64)
    flat = parts.flatten().dictionary_encode()
    starts_text = np.zeros(len(flat), bool)
    starts_text[offsets[:-1]] = True
    size = len(flat.dictionary)
    code = flat.indices.to_numpy().astype(np.int64) + size * starts_text
    used = np.zeros(2 * size, bool)
    used[code] = True
    words = flat.dictionary.to_pylist()
    plain = [w != "" and w == w.strip() for w in words]
    behind, first = np.flatnonzero(used[:size]).tolist(), np.flatnonzero(used[size:]).tolist()  # words behind a space, and first words of texts
    inside = [i for i in behind if plain[i]]
    others = [(i, " " + words[i]) for i in behind if not plain[i]] + [(i + size, words[i]) for i in first]
    table, n = spaced_ids(path, [words[i] for i in inside])
    more = [unit_ids(path, unit) for _, unit in others]
    order = np.array(inside + [i for i, _ in others], np.int64)
    n = np.concatenate([n, np.array([len(x) for x in more], np.int64)])
    lens, starts = np.zeros((2, 2 * size), np.int64)
    lens[order], starts[order] = n, np.cumsum(n) - n
    table = np.concatenate([table, *more])
    n = lens[code]
    out = table[ragged(starts[code], n)]
    counts = np.add.reduceat(np.append(n, 0), offsets[:-1]) * (np.diff(offsets) > 0) if len(texts) else np.zeros(0, np.int64)
    if whole.any():
        ends = np.cumsum(counts)
        pieces, at = [], 0
        for i in np.flatnonzero(whole):
            got = np.array(load_tokenizer(path).encode_ordinary(texts[int(i)].as_py()), np.int32)
            pieces += [out[at : ends[i]], got]
            at = ends[i]
            counts[i] = len(got)
        out = np.concatenate([*pieces, out[at:]])
    return out, counts


class CapacityTree:
    """Bins by remaining capacity 0..top; ``fit`` finds the least capacity that is at least n."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        i = capacity + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def fit(self, n: int) -> tuple[int, int] | None:
        i = n + self.size
        if not self.any[i]:
            while i & 1 or not self.any[i + 1]:  # up, until the right neighbour has bins
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.size:  # down to its least capacity
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.size
        bin_ = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return capacity, bin_


def pack(lengths: np.ndarray, row: int) -> list[list[int]]:
    """Best-fit-decreasing: the pieces of each row, by index, in order of placement."""
    order = np.argsort(-lengths, kind="stable")
    tree, rows = CapacityTree(row), []
    for i in order.tolist():
        n = int(lengths[i])
        if got := tree.fit(n):
            capacity, b = got
            rows[b].append(i)
        else:
            capacity, b = row, len(rows)
            rows.append([i])
        if capacity > n:
            tree.add(capacity - n, b)
    return rows


def schema(id_type: T.DataType) -> T.StructType:
    """Of packed rows, with document ids of the given type."""
    head = T.StructType().add("pack_id", "long").add("n_tokens", "integer").add("input_ids", "binary").add("cu_seqlens", T.ArrayType(T.IntegerType())).add("position_ids", "binary")
    return head.add("doc_ids", T.ArrayType(id_type)).add("token_starts", T.ArrayType(T.IntegerType()))


def pack_buffer(ids: np.ndarray, counts: np.ndarray, doc_ids: list, row: int, first_id: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Packed rows of the documents of one buffer."""
    begins = np.cumsum(counts) - counts
    pieces = -(-counts // row)
    doc = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = nth * row
    length = np.minimum(row, counts[doc] - start)
    rows = pack(length, row)
    for low in range(0, len(rows), 512):
        part = rows[low : low + 512]
        matrix = np.full((len(part), row), END_ID, np.uint16)
        position = np.zeros((len(part), row), np.uint16)
        out: list[list] = [[], [], [], []]
        for r, inside in enumerate(part):
            ends = np.concatenate([[0], np.cumsum(length[inside])])
            for p, at in zip(inside, ends.tolist(), strict=False):
                n, b = int(length[p]), int(begins[doc[p]] + start[p])
                matrix[r, at : at + n] = ids[b : b + n]
                position[r, at : at + n] = np.arange(n)
            for x, value in zip(out, (int(ends[-1]), ends.tolist(), [doc_ids[doc[p]] for p in inside], [int(start[p]) for p in inside]), strict=True):
                x.append(value)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(first_id + low, first_id + low + len(part)), pa.int64()),
                pa.array(out[0], pa.int32()),
                pa.array([x.tobytes() for x in matrix], pa.binary()),
                pa.array(out[1], pa.list_(pa.int32())),
                pa.array([x.tobytes() for x in position], pa.binary()),
                pa.array(out[2], arrow.field("doc_ids").type),
                pa.array(out[3], pa.list_(pa.int32())),
            ],
            schema=arrow,
        )


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: int = ROW, buffer_tokens: int = BUFFER_TOKENS, tokenizer: str = TOKENIZER) -> DataFrame:
    """Packed rows: pack_id, n_tokens, input_ids and position_ids (little-endian uint16, ``row`` each, padded with
    the end id and 0), cu_seqlens (cumulative lengths from 0), doc_ids and token_starts (first token within its
    document) of each segment."""

    out_schema = schema(docs.schema[doc_id].dataType)
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 40
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held, size
            if held:
                for out in pack_buffer(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]], row, next_id, arrow):
                    yield out
                    last = out.column(0)[len(out) - 1].as_py()
                next_id = last + 1
            held, size = [], 0

        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                ids, counts = encode_texts(part.column(1), tokenizer)
                ids = np.insert(ids, np.cumsum(counts), END_ID)
                held.append((ids, counts + 1, part.column(0).to_pylist()))
                size += len(ids)
                if size >= buffer_tokens:
                    yield from flush()
        yield from flush()

    return arrow_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, out_schema)


def unpack_documents(packed: DataFrame, row: int = ROW, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, token_start and text bytes of each segment, read back from packed rows."""
    out_schema = T.StructType().add("doc_id", packed.schema["doc_ids"].dataType.elementType).add("token_start", "integer").add("raw", "binary")
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_tokenizer(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["input_ids"], np.uint16)
                for a, b, d, s in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["token_starts"], strict=False):
                    out.append((d, s, enc.decode_bytes([x for x in ids[a:b].tolist() if x != END_ID])))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return packed.select("input_ids", "cu_seqlens", "doc_ids", "token_starts").mapInArrow(run, out_schema)


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2048 ids."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
