"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources share all words by weight; a target stops at ``epochs`` times
its source's size and the excess is shared again by weight. The mix is then
made of equal blocks of words. The blocks go to sources by highest quotients
target / (2 seats + 1), and each source's blocks go to its shards the same way.
A shard takes no more than ``epochs`` passes; what is then left of a block goes
to the shards next in line, so the source as a whole takes all of its blocks. In a shard the documents of a
source lie in seeded order on one line that is cut into blocks; the quota takes whole
passes over the line and for the rest the first blocks in a seeded order.

Documents are dealt to shards of about ``shard_words`` words by hash, so a hot
source is split over all shards, and a small one over as many as leave each
``LEAST_BLOCKS`` blocks of it, and texts are read once and never shuffled.
The driver sees one row per source only (``max_sources`` at most). Quotas
within a source are found with one window over its shard summaries.

Defined cases: null or blank texts have size 0 and nothing is taken of them; a
null source is a source of its own, last in order; a null id is dealt like any
other; repeated rows are separate documents; rows that are alike in id and text
share what their copies are given in any order; a very long text is cut by word
ranges; an empty table gives no rows; extra columns are ignored. Results depend
on the rows and the seed alone.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, apart, materialise, read_table, space_word_count, whole_rows

BLOCK = 128
SHARD_WORDS = 2_000_000
LEAST_BLOCKS = 256
EPOCHS = 3
MAX_SOURCES = 100_000
SEED = 20240601


def targets(sizes: list[int], weights: list[int], epochs: int = EPOCHS) -> list[float]:
    """Shares of all words by weight, none above ``epochs`` times its size."""
    out = [0.0] * len(sizes)
    left, active = float(sum(sizes)), list(range(len(sizes)))
    while active:
        unit = left / sum(weights[i] for i in active)
        full = [i for i in active if unit * weights[i] > epochs * sizes[i]]
        if not full:
            for i in active:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(epochs * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 seats + 1); ties go to the earlier party.

    A party gets at least votes (seats - n / 2) / all - 1/2, so only the rest needs a heap.
    """
    total, n = sum(votes), len(votes)
    if total <= 0:
        return [0] * n
    got = [max(0, math.floor(v * (seats - n / 2) / total - 0.5)) for v in votes]
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def sized_rows(rows: DataFrame, doc_id: Column, text: Column, source: Column, seed: int, *more: Column) -> DataFrame:
    """The written table of (row_id, doc_id, source_, size, order_) and further columns that a plan starts from."""
    order = F.xxhash64(F.lit(seed), doc_id, text)
    return materialise(rows.select("row_id", doc_id.alias("doc_id"), source.alias("source_"), space_word_count(text).alias("size"), order.alias("order_"), *more), "mix-sizes")


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = (), seed: int = SEED, **options) -> DataFrame:
    """Per row: row_id, doc_id, ``keep``, size, source_size, target, taken, epochs and parts.

    ``epochs`` counts whole passes over the document, ``parts`` are the further word ranges
    (begin, end) that the mix takes of it; ``taken`` counts all words of both. A kept column
    with one of these names gets ``_`` behind its own.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(source).alias("s"), F.struct(F.lit(0).alias("none"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).alias("kept"))
    sized = sized_rows(rows, F.col("d"), F.col("t"), F.col("s"), seed, F.col("kept"))
    plan = plan_rows(sized, seed=seed, **options)
    names = apart(keep, [c for c in plan.columns if c != "kept"])
    return plan.select("row_id", "doc_id", *(F.col("kept")[f"k{i}"].alias(c) for i, c in enumerate(names)), "size", "source_size", "target", "taken", "epochs", "parts")


def plan_rows(sized: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, epochs: int = EPOCHS, seed: int = SEED, max_sources: int = MAX_SOURCES) -> DataFrame:
    """The plan of ``sized_rows``: its further columns, and those that ``mix_plan`` adds."""
    spark = sized.sparkSession
    more = [c for c in sized.columns if c not in ("row_id", "doc_id", "source_", "size", "order_")]
    found = sized.groupBy("source_").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources")
    found.sort(key=lambda r: (r.source_ is None, str(r.source_)))
    sizes = [r.n for r in found]
    aims = targets(sizes, [i % 3 + 1 for i in range(len(found))], epochs)
    total = sum(sizes)
    seats = sainte_lague(aims, round(total / block))
    shards = max(1, math.ceil(total / shard_words))
    kind = sized.schema["source_"].dataType.simpleString()
    by_source = F.broadcast(spark.createDataFrame([(r.source_, i, n, a, q, min(shards, max(1, int(n // (LEAST_BLOCKS * block))))) for i, (r, n, a, q) in enumerate(zip(found, sizes, aims, seats, strict=True))], f"source_ {kind}, src int, source_size long, target double, seats long, shards int"))  # max_sources rows at most

    dealt = sized.join(by_source, sized["source_"].eqNullSafe(by_source["source_"])).drop("source_", "seats")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order_"), F.col("shards")).cast("int")).drop("shards")

    # words of each source's shards, block by block
    shard_sizes = dealt.where("size > 0").groupBy("src", "shard").agg(F.sum("size").alias("n"))
    of_source = Window.partitionBy("src")
    votes = shard_sizes.join(by_source.select("src", "source_size", "seats"), "src").withColumn("m", F.count(F.lit(1)).over(of_source))
    votes = votes.withColumn("low", F.greatest(F.lit(0), F.least(F.floor(F.col("n") * (F.col("seats") - F.col("m") / 2) / F.col("source_size") - 0.5), F.floor(F.col("n") * epochs / block))))
    votes = votes.withColumn("high", F.floor(F.col("n") * (F.col("seats") + F.col("m") / 2) / F.col("source_size") + 0.5) + 1)
    seat = votes.withColumn("left", (F.col("seats") - F.sum("low").over(of_source)) * block).withColumn("seat", F.explode(F.sequence(F.col("low"), F.col("high"))))
    seat = seat.withColumn("give", F.greatest(F.lit(0), F.least(F.lit(block), F.col("n") * epochs - F.col("seat") * block)))
    in_line = of_source.orderBy((F.col("n") / (2 * F.col("seat") + 1)).desc(), "shard", "seat").rowsBetween(Window.unboundedPreceding, 0)
    seat = seat.withColumn("more", F.greatest(F.lit(0), F.least(F.col("give"), F.col("left") - F.sum("give").over(in_line) + F.col("give"))))
    quota = seat.groupBy("src", "shard").agg(F.first("n").alias("n"), (F.first("low") * block + F.sum("more")).alias("words"))
    quota = quota.withColumn("epochs", F.floor(F.col("words") / F.col("n")))

    # blocks of the rest, in seeded order
    blocks = quota.withColumn("rest", F.col("words") - F.col("epochs") * F.col("n")).where("rest > 0")
    blocks = blocks.select("src", "shard", "rest", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))).alias("block"))
    blocks = blocks.withColumn("length", F.least(F.lit(block), F.col("n") - F.col("block") * block))
    seeded = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "src", "shard", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("take", F.least(F.col("length"), F.col("rest") - F.sum("length").over(seeded) + F.col("length"))).where("take > 0").select("src", "shard", "block", "take")

    # documents on the line, piece by block
    line = Window.partitionBy("src", "shard").orderBy("order_", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("begin", F.sum("size").over(line) - F.col("size")).join(quota.select("src", "shard", "epochs").hint("merge"), ["src", "shard"], "left")
    laid = laid.withColumn("epochs", F.when(F.col("size") > 0, F.coalesce(F.col("epochs"), F.lit(0))).otherwise(0).cast("long"))
    piece = laid.where("size > 0").select("row_id", "src", "shard", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"))
    piece = piece.join(blocks.hint("merge"), ["src", "shard", "block"])  # as many blocks as words / block: never broadcast
    at = F.col("block") * block
    piece = piece.withColumn("from", F.greatest(at, F.col("begin")) - F.col("begin")).withColumn("to", F.least(at + F.col("take"), F.col("begin") + F.col("size")) - F.col("begin")).where(F.col("to") > F.col("from"))
    parts = piece.groupBy("row_id").agg(F.sum(F.col("to") - F.col("from")).alias("more"), F.sort_array(F.collect_list(F.struct(F.col("from").cast("long").alias("begin"), F.col("to").cast("long").alias("end")))).alias("parts"))
    out = laid.join(parts.hint("merge"), "row_id", "left")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return out.select("row_id", "doc_id", *more, F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", (F.col("epochs") * F.col("size") + F.coalesce(F.col("more"), F.lit(0))).cast("long").alias("taken"), "epochs", F.coalesce("parts", none).alias("parts"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document whole for each pass over it, and once more
    with the words of its further parts (joined by single spaces) if it has any."""
    rows = materialise(whole_rows(docs, F.monotonically_increasing_id().alias("row_id")), "mix-docs")
    at = lambda c: F.col("row")[c]
    plan = plan_rows(sized_rows(rows, at(doc_id), at(text), at(source), seed), seed=seed, **options).select("row_id", "epochs", "parts")
    both = rows.join(plan.where("epochs > 0 or size(parts) > 0").hint("merge"), "row_id")
    words = both.withColumn("words", F.when(F.size("parts") > 0, F.regexp_extract_all(at(text), F.lit(f"({SPACE_WORD})"), F.lit(1))))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("words", (p["begin"] + 1).cast("int"), (p["end"] - p["begin"]).cast("int")))), " ")
    copies = F.concat(F.array_repeat(F.lit(False), F.col("epochs").cast("int")), F.when(F.size("parts") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    spread = words.withColumn("part", F.explode(copies))
    return spread.select(*((F.when(F.col("part"), cut).otherwise(at(c)) if c == text else at(c)).alias(c) for c in docs.columns))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs")
