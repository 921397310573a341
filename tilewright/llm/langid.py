"""Language identification with error-correcting output codes.

Each language gets a codeword; each bit of it has a binary classifier over
hashed byte 3- and 4-grams (a log-odds table between the languages with that
bit set and those without). The tables come from n-gram counts over every
labelled training text, summed in Spark; a second pass measures how well each
bit separates each language. Decoding takes the codeword with the least loss,
each bit weighted by its measured accuracy for that language, and flags texts
whose two nearest codewords are about as near.

The driver holds one count per language and bucket (``max_languages`` times
32,768 at most), whatever the corpus; executors hold one broadcast table of 131 KB
for each bit: 1 MB for four languages, 13 MB for a thousand.

Defined cases: a null text or one without a letter is ``und`` with score 0;
without any labelled row everything is ``und``; languages with equal loss go by
name; repeated rows get equal results; a very long text is read in slices and
predicted whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, arrow_batches, held_out, read_table

UNKNOWN = "und"
BITS = 14
BUCKETS = 2 << BITS  # a half for each order; one more row stands for no n-gram
MAX_LANGUAGES = 1000
SLICE = 1 << 18
SCALE = 1e6

#: ASCII letters and all bytes of non-ASCII characters stay, anything else is a break.
KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts on end, two breaks around each, and where each begins."""
    padded = pc.binary_join_element_wise(pa.scalar("  "), pc.utf8_lower(pc.fill_null(texts, "")), pa.scalar("  "), "")
    raw = pc.cast(padded, pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(raw) else np.zeros(0, np.uint8)
    return KEEP[data], offsets[:-1] - offsets[0]


def grams(data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-grams and 4-grams that begin at [low, high); BUCKETS where two breaks begin it."""
    b = data[low : high + 3]
    if len(b) < high - low + 3:
        b = np.concatenate([b, np.full(high - low + 3 - len(b), 32, np.uint8)])
    b = b.astype(np.uint32)
    n = high - low
    three = b[:n] << 16 | b[1 : n + 1] << 8 | b[2 : n + 2]
    none = (b[:n] == 32) & (b[1 : n + 1] == 32)
    four = (three << 8 | b[3 : n + 3]) * np.uint32(2246822519) >> np.uint32(32 - BITS)
    three = three * np.uint32(2654435761) >> np.uint32(32 - BITS)
    three, four = three.astype(np.int32), four.astype(np.int32) + (1 << BITS)
    three[none] = four[none] = BUCKETS
    return three, four


def pieces(starts: np.ndarray, total: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(low, high, first text, starts within) of slices of bounded size."""
    for low in range(0, total, SLICE):
        high = min(total, low + SLICE)
        first = int(np.searchsorted(starts, low, "right")) - 1
        last = int(np.searchsorted(starts, high, "left"))
        yield low, high, first, np.concatenate([[0], starts[first + 1 : last] - low]).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    table: np.ndarray  # buckets + 1 x bits + 1; the last column counts n-grams
    middle: np.ndarray | None = None
    slope: np.ndarray | None = None
    weight: np.ndarray | None = None  # languages x bits

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Mean log-odds of each text (rows) for each bit."""
        data, starts = batch_bytes(texts)
        total = np.zeros((len(texts), self.table.shape[1]))
        for low, high, first, at in pieces(starts, len(data)):
            for buckets in grams(data, low, high):
                total[first : first + len(at)] += np.add.reduceat(self.table[buckets], at, axis=0)
        return total[:, :-1] / np.maximum(total[:, -1:], 1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the nearest codeword, its share against all, and the loss by which the next one is farther."""
        z = (self.slope * (margins - self.middle)).clip(-30, 30)
        loss = np.stack([(np.log1p(np.exp(-c * z)) * w).sum(1) / w.sum() for c, w in zip(self.code, self.weight, strict=True)], 1)
        best = loss.argmin(1)
        least = loss[np.arange(len(loss)), best]
        share = 1 / np.exp(-self.code.shape[1] * (loss - least[:, None])).sum(1)
        other = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, share, other - least


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """An exhaustive code for up to 7 languages, else random codewords of 10 log2(n) bits, any two of which differ in a fifth of them."""
    if n <= 7:
        bits = [[1, *((c >> i & 1) * 2 - 1 for i in range(n - 1))] for c in range(2 ** (n - 1))]
        return np.array([b for b in bits if n == 1 or -1 in b], float).T
    rng = np.random.default_rng(seed)
    bits = math.ceil(10 * math.log2(n))
    while True:
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart_ = (bits - code @ code.T) / 2 + bits * np.eye(n)  # Hamming distances, none to itself
        if apart_.min() >= bits / 5 and (np.abs(code.sum(0)) < n).all():
            return code


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                data, _ = batch_bytes(batch.column(1).filter(pc.equal(langs.indices, k)))
                have = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for low in range(0, len(data), SLICE):
                    for buckets in grams(data, low, min(len(data), low + SLICE)):
                        have += np.bincount(buckets, minlength=BUCKETS + 1)
        for lang, have in counts.items():
            at = np.flatnonzero(have[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(have[at], pa.int64())], ["lang", "bucket", "n"])

    return arrow_batches(rows).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """The model of all rows with a language and a text; None without such rows."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    found = count_grams(rows).limit(max_languages * BUCKETS + 1).toPandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    if len(found) > max_languages * BUCKETS or len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["lang"].map({k: i for i, k in enumerate(languages)}), found["bucket"]] = found["n"]
    share = np.concatenate([(h + smoothing) / (h + smoothing).sum(1, keepdims=True) for h in np.split(counts, 2, axis=1)], axis=1)
    code = codewords(len(languages))
    table = np.zeros((BUCKETS + 1, code.shape[1] + 1), np.float32)
    table[:BUCKETS, -1] = 1
    for b, bit in enumerate(code.T):
        if (bit < 0).any():
            table[:BUCKETS, b] = np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0))
    model = Model(languages, code, table)
    return calibrate(model, rows)


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Adds each bit's threshold and slope, and its accuracy for each language, from the margins of all rows."""
    index = {k: i for i, k in enumerate(model.languages)}
    n_bits = model.code.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(index), 2 * n_bits + 1), np.int64)
        for batch in batches:
            z = model.margins(batch.column(1))
            at = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            np.add.at(sums, at, np.column_stack([np.ones(len(z)), z * SCALE, z * z * SCALE]).round().astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(index)), sums.shape[1]), pa.int32()), pa.array(np.tile(np.arange(sums.shape[1]), len(index)), pa.int32()), pa.array(sums.ravel(), pa.int64())], ["k", "c", "v"])

    got = arrow_batches(rows).mapInArrow(run, "k int, c int, v long").groupBy("k", "c").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((len(index), 2 * n_bits + 1))
    sums[got["k"], got["c"]] = got["v"]
    n = np.maximum(sums[:, :1], 1)
    mean = sums[:, 1 : n_bits + 1] / n / SCALE
    var = np.maximum(sums[:, n_bits + 1 :] / n / SCALE - mean**2, 1e-4)
    high = np.array([mean[c > 0, b].mean() for b, c in enumerate(model.code.T)])
    low = np.array([mean[c < 0, b].mean() if (c < 0).any() else -1.0 for b, c in enumerate(model.code.T)])
    model.middle = (high + low) / 2
    model.slope = (high - low) / var.mean(0)
    right = model.code * (mean - model.middle) / np.sqrt(var)
    model.weight = np.maximum(np.array([[0.5 * (1 + math.erf(x / math.sqrt(2))) for x in row] for row in right]), 0.01)
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", margin: float = 0.02) -> DataFrame:
    """The columns ``keep``, then lang_pred, score (0 to 1) and ambiguous of each whole text; a kept column
    of one of these names gets ``_`` behind its own."""
    n = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``max_languages`` times 10 log2(max_languages) bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            known = batch.column(n + 1).to_numpy(zero_copy_only=False).astype(bool)
            if model is None:
                names, share, unsure = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.ones(len(batch), bool)
            else:
                best, share, gap = model.decode(model.margins(batch.column(n)))
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                share = np.where(known, share, 0.0).clip(0, 1)
                unsure = ~known | (gap < margin)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(unsure, pa.bool_())], [f"c{i}" for i in range(n + 3)])

    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(text).alias("text_"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter_"))
    out = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)])
    out = out.add(f"c{n}", "string").add(f"c{n + 1}", "double").add(f"c{n + 2}", "boolean")
    outputs = ["lang_pred", "score", "ambiguous"]
    return arrow_batches(rows).mapInArrow(run, out).toDF(*apart(keep, outputs), *outputs)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, ["doc_id", "held_out"])
