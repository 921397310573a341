"""Language-model scoring with a gated recurrent network.

Counts of every training token are gathered in Spark. The most frequent words
get an output of their own, in classes of about equal root mass; every other
word falls into one of ``n_tails`` classes by the digest of its last two bytes,
inside which its share is (c + 1) / (words + different words + 1), so that the
shares of all words, unknown ones included, sum to 1. The network predicts the
class and, for frequent words, the word in it.

Training is data-parallel and one pass long: documents are dealt by a hash of
their kept columns and text to shards of about ``shard_tokens`` tokens, and the
shards to ``rounds`` rounds. In each round its shards run truncated
backpropagation in numpy from the same weights, and the weights are averaged in
a tree of small groups. So every training document is trained on once, whole,
whatever the size of the corpus. All documents are scored whole, state carried across
windows; words outside the ``lookup`` most frequent ones meet their counts in a
join, so the full vocabulary is never broadcast or collected.

Defined cases: a null or empty text is its end alone; a null id is not held out;
without training documents every count is 0; repeated rows are scored each and
trained on in one shard; a very long text is one row of its shard, cut into
lanes in training and scored window by window; words with equal counts are
ranked by name; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import arrow_batches, ascii_lower, discard, held_out, materialise, read_table
from .neardup import slices

WORDS = 2047
CLASSES = 32
N_TAILS = 32
HIDDEN = 32
LOOKUP = 200_000
SHARD_TOKENS = 1_000_000
ROUNDS = 3
FAN = 32
BLOCK = 16_384
#: Bytes of text that are looked up at a time; of what was looked up before, four bytes a word are kept.
PART_BYTES = 1 << 23
#: Tokens that are scored together, as many as 32 MB of text have; their texts are gone by then.
SCORED_TOKENS = 5_000_000


def tail_class(word: Column, n_tails: int) -> Column:
    return F.crc32(F.substring(F.encode(word, "UTF-8"), -2, 2)) % n_tails


def tail_table(n_tails: int) -> np.ndarray:
    """Tail class by the number that ``last_two`` gives."""
    one = [zlib.crc32(bytes([b])) % n_tails for b in range(256)]
    two = [zlib.crc32(bytes([a, b])) % n_tails for a in range(256) for b in range(256)]
    return np.array(two + one, np.int32)


def last_two(words: pa.Array) -> np.ndarray:
    """a * 256 + b of the last two bytes of each word, 65536 + b of words of one byte."""
    raw = pc.cast(words, pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
    b = data[offsets[1:] - 1].astype(np.int32)
    short = np.diff(offsets) < 2
    a = data[np.maximum(offsets[1:] - 2, 0)].astype(np.int32)
    return np.where(short, 65536 + b, a * 256 + b)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts on end, and each text's number of words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values[offsets[0] : offsets[-1]] if len(parts) else parts.values[:0]
    full = pc.greater(pc.binary_length(flat), 0)
    real = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), np.diff(real[offsets - offsets[0]])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all words of ``text``, counted by batch before they are grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(tokens(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "c"])

    return arrow_batches(docs.select("text"), "32m").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The ``lookup`` most frequent words with their counts, what the rest sums up to, and the output classes."""

    def __init__(self, words: pa.Array, counts: np.ndarray, n_docs: int, tail_sums: np.ndarray, total: int, distinct: int, n_words: int, n_classes: int, n_tails: int, hidden: int):
        self.words, self.counts, self.n_tails, self.total, self.distinct = words, counts, n_tails, total, distinct
        k = min(n_words, len(words))
        mass = np.sqrt(counts[:k])
        cut = np.searchsorted(np.cumsum(mass), np.arange(1, n_classes) / n_classes * mass.sum()) if k else []
        self.shape = gru.Shape(hidden, np.unique([0, 1, *(int(c) + 1 for c in cut), k + 1]), n_tails)
        self.tails = tail_table(n_tails)
        rest = np.zeros((n_tails, 2), np.int64)  # words and different words of each tail class
        rest += tail_sums
        if k:
            at = self.tails[last_two(words[:k])]
            np.subtract.at(rest, at, np.stack([counts[:k], np.ones(k, np.int64)], 1))
        self.norm = rest.sum(1) + 1
        self.start_counts = np.concatenate([[n_docs], counts[:k], rest[:, 0]])
        #: token id of each lookup word, and log10 of its share in its tail class (0 for words of their own)
        self.ids = np.arange(1, len(words) + 1, dtype=np.int32)
        self.share = np.zeros(len(words))
        if len(words) > k:
            at = self.tails[last_two(words[k:])]
            self.ids[k:] = k + 1 + at
            self.share[k:] = np.log10((counts[k:] + 1) / self.norm[at])
        self.k = k

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Token ids, words of each text, lookup positions (-1: none) and the words as such."""
        words, lengths = tokens(texts)
        at = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = self.ids[at] if len(self.words) else np.zeros(len(at), np.int32)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            ids[unknown] = self.k + 1 + self.tails[last_two(words.take(pa.array(unknown)))]
        return ids, lengths, at, words


def looked_up(texts: pa.RecordBatch, vocabulary: Vocabulary, log_base: np.ndarray, part_bytes: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """Token ids of a column of texts on end, words of each text, and of each text: has (words in the lookup), base and share
    (sums of their log10), rare (the other words). A whole batch's words take too much memory at once, so texts go in parts."""
    ids, sizes, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
    for part in slices(texts, 0, part_bytes):
        part_ids, lengths, at, said = vocabulary.encode(part.column(0))
        known, m = at >= 0, len(lengths)
        doc, pos = np.repeat(np.arange(m), lengths)[known], at[known]
        rare = np.concatenate([[0], np.cumsum(~known)])[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(rare, pa.int32()), said.filter(pa.array(~known)))
        columns = (np.bincount(doc, minlength=m), np.bincount(doc, log_base[pos], m), np.bincount(doc, vocabulary.share[pos], m))
        rows.append(pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), lists], ["has", "base", "share", "rare"]))
        ids.append(part_ids)
        sizes.append(lengths)
        del part_ids, at, said, known, doc, pos, lists
    found = pa.Table.from_batches(rows).combine_chunks().to_batches()
    return np.concatenate(ids), np.concatenate(sizes), found[0] if found else rows[0]


def counted(lists: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """The different words of each list, and how often each is in it."""
    sizes = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    k = max(1, len(words.dictionary))
    pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * k + words.indices.to_numpy(), return_counts=True)
    ends = pa.array(np.searchsorted(pairs // k, np.arange(len(sizes) + 1)), pa.int32())
    return pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(pairs % k))), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))


def gathered(batches: Iterator[pa.RecordBatch], column: int, vocabulary: Vocabulary, log_base: np.ndarray, most: int = SCORED_TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """What ``looked_up`` gives of consecutive batches of about ``most`` tokens together, with their other columns in front.
    Of each batch the token ids are kept, not its texts, so batches can be small where the network wants many lanes."""
    ids, lengths, tables, size = [], [], [], 0
    for batch in batches:
        if len(batch):
            part_ids, n, of = looked_up(batch.select([column]), vocabulary, log_base)
            every = pa.array(np.arange(len(batch)))  # copies, as a column by itself would hold its whole batch
            others = {name: c.take(every) for i, (name, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if i != column}
            tables.append(pa.table(others | dict(zip(of.schema.names, of.columns, strict=True))))
            ids.append(part_ids)
            lengths.append(n)
            size += len(part_ids)
            del part_ids, of, others
        del batch
        if size >= most:
            yield np.concatenate(ids), np.concatenate(lengths), pa.concat_tables(tables)
            ids, lengths, tables, size = [], [], [], 0
    if tables:
        yield np.concatenate(ids), np.concatenate(lengths), pa.concat_tables(tables)


def average(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """(block, part) with the mean of weights (shard, tokens, block, part), in groups of ``fan`` shards at a time."""

    def mean(group):
        n = group["tokens"].to_numpy()
        sums = sum(np.frombuffer(x.as_buffer(), np.float32) * (k / n.sum()) for x, k in zip(group["part"], n, strict=True))
        return pa.table({"shard": group["shard"].slice(0, 1), "tokens": pa.array([int(n.sum())], pa.int64()), "block": group["block"].slice(0, 1), "part": pa.array([np.asarray(sums, np.float32).tobytes()], pa.binary())})

    while parts.select("shard").distinct().count() > 1:
        grouped = parts.withColumn("shard", F.floor(F.col("shard") / fan).cast("int"))
        merged = materialise(grouped.groupBy("shard", "block").applyInArrow(mean, parts.schema), "lm-mean")
        discard(parts)
        parts = merged
    return parts.select("block", "part")


def train_rounds(dealt: DataFrame, vocabulary: Vocabulary, rounds: int, n_shards: int) -> dict[str, np.ndarray]:
    """Weights after one pass over (shard, rank, text): each round trains on its shards, number modulo ``rounds``, and averages."""
    shape, spark = vocabulary.shape, dealt.sparkSession
    p = gru.initial(shape, vocabulary.start_counts)
    names = sorted(p)
    lines = materialise(encode_texts(dealt, vocabulary), "lm-lines")

    def learner(shared, rate):
        def learn(group):
            docs = [np.frombuffer(x.as_buffer(), np.int32) for x in group.sort_by([("rank", "ascending"), ("ids", "ascending")])["ids"]]
            lengths = np.array([len(d) for d in docs], np.int64)
            new = gru.train(shared.value, shape, np.concatenate(docs), np.cumsum(lengths) - lengths, lengths, rate=rate)
            flat = np.concatenate([new[n].ravel() for n in names]).astype(np.float32)
            blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            n = len(blocks)
            return pa.table({"shard": pa.array([group["shard"][0].as_py()] * n, pa.int32()), "tokens": pa.array([int(lengths.sum()) + len(docs)] * n, pa.int64()), "block": pa.array(range(n), pa.int32()), "part": pa.array(blocks, pa.binary())})

        return learn

    for k in range(rounds):
        mine = lines.where(F.col("shard") % rounds == k)
        shared = spark.sparkContext.broadcast(p)  # one set of weights, of a size that ``words`` and ``hidden`` fix
        one_each = mine.repartitionByRange(-(-n_shards // rounds), "shard")  # a shard a partition
        learned = materialise(one_each.groupBy("shard").applyInArrow(learner(shared, 0.1 / (1 + k / 2)), "shard int, tokens long, block int, part binary"), "lm-weights")
        found = average(learned).orderBy("block").collect()  # one set of weights
        shared.unpersist()
        if found:
            flat = np.concatenate([np.frombuffer(r.part, np.float32) for r in found])
            ends = np.cumsum([p[n].size for n in names])
            p = {n: flat[e - p[n].size : e].reshape(p[n].shape).copy() for n, e in zip(names, ends, strict=True)}
        discard(learned)
    discard(lines)
    return p


def encode_texts(dealt: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    shared = dealt.sparkSession.sparkContext.broadcast(vocabulary)  # ``lookup`` words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, _, _ = shared.value.encode(batch.column(2))
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)], pa.binary())], ["shard", "rank", "ids"])

    return arrow_batches(dealt.select("shard", "rank", "text")).mapInArrow(run, "shard int, rank long, ids binary")


def score_documents(docs: DataFrame, train: Column, keep: tuple[str, ...] = (), text: str = "text", seed: int = 5, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS, lookup: int = LOOKUP, words: int = WORDS, classes: int = CLASSES, n_tails: int = N_TAILS, hidden: int = HIDDEN) -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score and score of every document, learning from those where ``train``."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, train.alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learn = rows.where("train")
    counts = materialise(word_counts(learn), "lm-counts")
    n_docs = learn.count()
    sums = counts.groupBy(tail_class(F.col("word"), n_tails).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # n_tails rows
    tail_sums = np.zeros((n_tails, 2), np.int64)
    for r in sums:
        tail_sums[r.k] = r.c, r.v
    total, distinct = int(tail_sums[:, 0].sum()) + n_docs, int(tail_sums[:, 1].sum()) + (n_docs > 0)
    top = counts.orderBy(F.col("c").desc(), "word").limit(lookup).toArrow()  # lookup rows at most
    vocabulary = Vocabulary(top["word"].combine_chunks().cast(pa.string()) if len(top) else pa.array([], pa.string()), top["c"].to_numpy().astype(np.int64), n_docs, tail_sums, total, distinct, words, classes, n_tails, hidden)

    n_shards = max(1, math.ceil(total / shard_tokens))
    ranked = learn.withColumn("rank", F.xxhash64(F.lit(seed), "text", *(f"k{i}" for i in range(len(keep)))))
    dealt = ranked.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "rank"), F.lit(n_shards)).cast("int"))
    weights = train_rounds(dealt, vocabulary, rounds, n_shards)

    log_end = math.log10(((n_docs or 0) + 1) / (total + distinct + 1))
    out = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    n = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        log_base = np.log10((vocabulary.counts + 1) / (total + distinct + 1))
        for ids, lengths, of in gathered(batches, n, vocabulary, log_base):
            ends = np.cumsum(lengths)
            model = gru.score(weights, vocabulary.shape, ids, ends - lengths, lengths) / math.log(10) + of["share"].to_numpy()
            has, base = of["has"].to_numpy() + (n_docs > 0), of["base"].to_numpy() + log_end
            out = pa.table([*of.columns[:n], pa.array(lengths + 1, pa.int64()), pa.array(has, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64()), *counted(of["rare"].combine_chunks())], [*(f"k{i}" for i in range(n)), "n_tokens", "n_known", "base", "model", "rare", "times"])
            del ids, of
            pa.default_memory_pool().release_unused()
            yield from out.to_batches()

    scored = arrow_batches(rows.select(*(f"k{i}" for i in range(n)), "text")).mapInArrow(run, ", ".join([*out, "n_tokens long, n_known long, base double, model double, rare array<string>, times array<long>"]))
    scored = materialise(scored.withColumn("row_id", F.monotonically_increasing_id()), "lm-scores")

    # words outside the lookup meet their counts
    norm = F.array(*(F.lit(int(x)) for x in vocabulary.norm))
    rare = scored.where("size(rare) > 0").select("row_id", F.inline(F.arrays_zip("rare", "times")).alias("word", "n"))
    rare = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = rare.groupBy("row_id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / (total + distinct + 1))).alias("more_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.element_at(norm, (tail_class(F.col("word"), n_tails) + 1).cast("int")))).alias("more_model"),
    )
    zero = F.lit(0)
    return scored.join(more, "row_id", "left").select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", zero)).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 7))
    return score_documents(docs, ~F.col("held_out"), ("doc_id", "held_out"))
