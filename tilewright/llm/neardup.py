"""Near-duplicate documents: BagMinHash signatures, banding, exact verification, connected classes.

Texts with equal words are one node. Nodes that share a band are candidates;
instead of all pairs of a bucket, each member is compared with a few centres:
first with one, the least node of all its buckets, then, while still in another
class, in rounds with one centre of each bucket, by turns the member with most
links and a seeded one, until fewer than ``ROUND_YIELD`` of a round's pairs are links. Buckets
that then still hold several classes compare the rest: those of at most
``small_bucket`` members a bounded number of pairs for each member, larger ones
all pairs that meet in a prefix of their shingles, rare ones first, which no pair
above the threshold can do without: no bucket is capped and no candidate is lost.
Every comparison is exact: the size of the multiset overlap of the five-word shingles against that of their union,
at least ``threshold``. Links make classes by contraction with pointer jumping;
a round links whole classes, not their members again. Every step is a join or
aggregation on written tables.

Defined cases: a null text is a class of its own row; wordless texts are equal
only if their bytes are; a text of fewer than five words is one shingle; ties
for the representative go to the least id, then the first row (null ids last);
repeated rows are copies; very long texts are read in slices of one text each,
and a pair's shingles meet in one row; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash as bag
from .common import arrow_batches, discard, materialise, read_table, unfold, whole_rows
from .decontaminate import BROADCAST_ROWS, bounded, text_key

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 42
ROWS = 6
SMALL_BUCKET = 64
ROUND_YIELD = 0.01
#: Members of a large bucket whose shingles order those of all.
SAMPLE = 256
#: Shingles before one in a prefix that tell whether a pair has met already.
BEFORE = 4
ROUNDING = 1e-9
SLICE_BYTES = 1 << 19


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text, one row at least."""
    low, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size >= most:
            yield batch.slice(low, i + 1 - low)
            low, size = i + 1, 0
    if low < len(batch):
        yield batch.slice(low)


def node_key(words: list[bytes], text: str) -> bytes:
    return hashlib.md5(b" ".join(words) if words else b"\x00" + text.encode()).digest()


def sign(docs: DataFrame, n_bands: int, rows: int, shingle: int) -> DataFrame:
    """(doc_id, tkey, node, n, bands) of rows (doc_id, tkey, text): n occurrences of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = part.column(2).to_pylist()
                words = [bag.normal_words(t) for t in texts]
                nodes = [None if t is None else node_key(w, t) for w, t in zip(words, texts, strict=True)]
                doc, h = bag.shingles(words, shingle)
                doc, h, weight, _ = bag.weighted(doc, h)
                n = np.bincount(doc, weight, len(words)).astype(np.int64)
                keys = bag.bands(bag.signatures(doc, h, weight, len(words), n_bands * rows), rows)
                full = n > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(full, n_bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(n), lists], ["doc_id", "tkey", "node", "n", "bands"])

    return arrow_batches(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tkey binary, node binary, n long, bands array<long>")


def unit_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, units) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = [bag.normal_words(t) for t in part.column(1).to_pylist()]
                doc, h = bag.shingles(words, shingle)
                doc, h, weight, nth = bag.weighted(doc, h)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, weight, len(words)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bag.units(h, weight, nth)))], ["node", "units"])

    return arrow_batches(texts).mapInArrow(run, "node binary, units array<long>")


def pairs_with(members: DataFrame, centre: Column, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of a member and its bucket's centre (struct of n and node) that their sizes allow."""
    c = members.withColumn("c", centre).where("node != c.node")
    c = c.where((F.least("n", "c.n") >= threshold * F.greatest("n", "c.n")))
    return c.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def hubs_of(large: DataFrame, passes: int = 2) -> DataFrame:
    """(band, hub): for each bucket of (band, node, degree) a node with many links, in or near it.

    Buckets first name their member with most links, then twice the best that one of
    their members has from any of its buckets, so that overlapping buckets agree on few.
    """
    hubs = large.groupBy("band").agg(F.max(F.struct("degree", "node")).alias("hub"))
    for _ in range(passes):
        of_node = large.join(hubs, "band").groupBy("node").agg(F.max("hub").alias("hub"))
        hubs = large.select("band", "node").join(of_node, "node").groupBy("band").agg(F.max("hub").alias("hub"))
    return materialise(hubs.select("band", F.col("hub.node").alias("hub")), "dup-hubs")


def met_pairs(met: DataFrame, threshold: float, more: DataFrame | None = None, allowed: Column | None = None) -> DataFrame:
    """Pairs (a, b) that meet in a shingle of (hub, unit, node, n, label, left, before, top), few of them twice: those that share one of the ``BEFORE``
    shingles before it in both orders meet there, too, with more shingles left, so they are not taken again."""
    key = ["hub", "unit"]
    one = met.where("label != top").drop("top")
    two = met.select(*key, *(F.col(c).alias(f"{c}_") for c in ("node", "n", "label", "left", "before")))
    enough = F.least("left", "left_") >= threshold / (1 + threshold) * (F.col("n") + F.col("n_")) - ROUNDING
    may = (F.col("label") != F.col("label_")) & enough & ~F.arrays_overlap("before", "before_")
    if more is not None:
        one, two, may = one.join(more, "node"), two.join(more.toDF(*(f"{c}_" for c in more.columns)), "node_"), may & allowed
    return one.join(two, key).where(may).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))


def prefix_pairs(large: DataFrame, sets: DataFrame, threshold: float, more: DataFrame | None = None, allowed: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """Distinct pairs (a, b) of different classes in a bucket of (band, node, n, label, degree) that can reach the threshold.

    The members of each hub's buckets order their shingles alike: by how many of a
    sample of these members have them, then by hash. A pair that overlaps enough has
    its first common shingle within either's prefix, with enough shingles left behind
    it, whatever the order; the sample only makes prefixes rare. Members of a
    shingle's largest class are not compared with each other. ``allowed`` is a further
    condition on both nodes' columns in ``more`` (node and others; the second node's end in ``_``).
    """
    hubs = hubs_of(large)
    of_hub = large.join(hubs, "band").select("hub", "node", "n", "label").distinct()
    of_hub = materialise(of_hub, "dup-hub-members")
    groups = of_hub.groupBy("hub").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("members"))
    wanted = F.greatest(F.lit(16), F.least(F.lit(sample), F.col("members") / 8))
    drawn = of_hub.join(groups, "hub").where(F.pmod(F.xxhash64("node"), "members") < wanted).join(sets, "node")
    common = drawn.select("hub", F.explode("units").alias("unit")).groupBy("hub", "unit").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    common = common.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("k", "unit")))["unit"].alias("common"))
    orders = materialise(groups.join(common, "hub", "left").select("hub", "least", F.coalesce("common", F.array().cast("array<bigint>")).alias("common")), "dup-orders")
    both = of_hub.join(sets, "node").join(orders, "hub")
    need = F.greatest(F.lit(threshold) * F.col("n"), F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("least")))
    length = (F.col("n") - F.ceil(need - ROUNDING) + 1).cast("int")
    both = both.withColumn("own", F.array_sort(F.array_except("units", "common")))
    prefix = both.withColumn("prefix", F.when(F.size("own") >= length, F.slice("own", F.lit(1), length)).otherwise(F.slice(F.concat("own", F.array_intersect("common", "units")), F.lit(1), length)))
    at = F.transform("prefix", lambda unit, i: F.struct(unit.alias("unit"), i.alias("at"), F.slice("prefix", F.greatest(i - BEFORE + 1, F.lit(1)), F.least(i, F.lit(BEFORE))).alias("before")))
    prefix = prefix.select("hub", "node", "n", "label", F.explode(at).alias("p"))
    prefix = materialise(prefix.select("hub", "p.unit", "node", "n", "label", (F.col("n") - F.col("p.at")).alias("left"), "p.before"), "dup-prefixes")
    key = ["hub", "unit"]
    sizes = prefix.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("k"))
    top = sizes.groupBy(*key).agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select(*key, "top")
    met = materialise(prefix.join(top, key), "dup-met")
    found = materialise(met_pairs(met, threshold, more, allowed).distinct(), "dup-tries")
    for table in (hubs, of_hub, orders, prefix, met):
        discard(table)
    return found


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose multisets overlap enough."""
    left = sets.select(F.col("node").alias("a"), F.col("units").alias("ua"))
    right = sets.select(F.col("node").alias("b"), F.col("units").alias("ub"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ua", "ub")).alias("both"), (F.size("ua") + F.size("ub")).alias("sum"))
    return both.where(F.col("both") >= threshold * (F.col("sum") - F.col("both"))).select("a", "b")


def rooted(parents: DataFrame) -> DataFrame:
    """(node, label) with each node's last parent, by pointer jumping over (node, label)."""
    now = materialise(parents, "dup-roots")
    while True:
        jump = now.join(now.select(F.col("node").alias("label"), F.col("label").alias("root")), "label").select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved"))
        old, now = now, materialise(jump, "dup-roots")
        discard(old)
        if now.where("moved").isEmpty():
            return now


def components(links: DataFrame) -> DataFrame:
    """(node, label): a node of each linked node's class, by contraction.

    In each round every node hangs below its least neighbour, trees become single
    nodes and links inside them go, so that the graph at least halves.
    """
    edges = materialise(links.union(links.select("b", "a")).distinct().toDF("node", "other"), "dup-edges")
    classes = None
    while True:
        roots = rooted(edges.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")))
        root = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
        old = classes
        classes = roots if old is None else materialise(old.join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "dup-labels")
        both = edges.join(roots.select("node", "label"), "node").join(root.toDF("other", "root"), "other")
        rest = materialise(both.where("label != root").select(F.col("label").alias("node"), F.col("root").alias("other")).distinct(), "dup-edges")
        discard(edges)
        if old is not None:
            discard(old)
            discard(roots)
        edges = rest
        if edges.isEmpty():
            discard(edges)
            return classes


def extend(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Classes (node, label) after the links ``found`` between some of their nodes; the old table goes."""
    of = lambda k: classes.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
    between = found.join(of("a"), "a").join(of("b"), "b").where("label_a != label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    root = components(between)
    more = materialise(classes.join(root.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "dup-labels")
    discard(classes)
    discard(root)
    return more


def link_nodes(signed: DataFrame, docs: DataFrame, threshold: float, shingle: int, small_bucket: int, broadcast_rows: int) -> DataFrame:
    """The classes (node, label) that verified links between different nodes make."""
    nodes = signed.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("tkey").alias("tkey"))
    nodes = materialise(nodes, "dup-nodes")
    spread = nodes.select("node", "n", F.explode("bands").alias("band")).repartition("band")
    buckets = spread.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("node", "n")).alias("first")).where("members > 1")
    members = materialise(spread.join(buckets, "band"), "dup-members")

    wanted = bounded(members.select("node").distinct().join(nodes, "node").select("tkey", "node"), broadcast_rows)
    texts = docs.select("tkey", "text").join(wanted, "tkey").dropDuplicates(["node"]).select("node", "text")
    sets = materialise(unit_sets(texts, shingle), "dup-sets")

    nearest = members.where("node != first.node").where(F.least("n", "first.n") >= threshold * F.greatest("n", "first.n")).groupBy("node").agg(F.min("first.node").alias("c"))
    tried = materialise(nearest.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct(), "dup-pairs")
    links = materialise(verify(tried, sets, threshold), "dup-links")
    classes = extend(materialise(sets.select("node", F.col("node").alias("label")), "dup-labels"), links)
    k = 0
    while True:
        labelled = members.select("band", "node", "n", "members").join(classes, "node")
        degree = links.select("a").union(links.select("b")).toDF("node").groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        labelled = labelled.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        rank = F.col("degree") if k % 2 == 0 else F.xxhash64(F.lit(k), "node")
        centre = labelled.groupBy("band").agg(F.max_by(F.struct("node", "n", "label"), F.struct(rank.alias("rank"), "node")).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        open_ = labelled.join(centre.select("band", "c"), "band").where("label != c.label")
        fresh = materialise(pairs_with(open_, F.col("c"), threshold).join(tried, ["a", "b"], "left_anti"), "dup-pairs")
        found = materialise(verify(fresh, sets, threshold), "dup-links")
        if found.isEmpty():
            break
        k += 1
        tried, links = tried.union(fresh), links.union(found)
        classes = extend(classes, found)
        if found.count() < ROUND_YIELD * fresh.count():
            break

    # larger buckets: pairs of different classes that share a shingle of their prefixes, as all pairs above the threshold do
    large = members.where(F.col("members") > small_bucket).select("band", "node", "n").join(classes, "node")
    several = large.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("band")
    degree = links.select("a").union(links.select("b")).toDF("node").groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    open_ = large.join(several, "band").join(degree, "node", "left").select("band", "node", "n", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
    open_ = materialise(open_, "dup-open")
    if not open_.isEmpty():
        tries = prefix_pairs(open_, sets, threshold)
        fresh = materialise(tries.join(tried, ["a", "b"], "left_anti"), "dup-pairs")
        discard(tries)
        found = materialise(verify(fresh, sets, threshold), "dup-links")
        tried = tried.union(fresh)
        if not found.isEmpty():
            classes = extend(classes, found)
    discard(open_)

    # small buckets: at most small_bucket pairs for each member
    labelled = members.where(F.col("members") <= small_bucket).select("band", "node", "n").join(classes, "node")
    other = labelled.select("band", F.col("node").alias("node_"), F.col("n").alias("n_"), F.col("label").alias("label_"))
    rest = labelled.join(other, (labelled["band"] == other["band"]) & (F.col("node") < F.col("node_")) & (F.col("label") != F.col("label_")) & (F.least("n", "n_") >= threshold * F.greatest("n", "n_")))
    rest = rest.select(F.col("node").alias("a"), F.col("node_").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    found = materialise(verify(rest, sets, threshold), "dup-links")
    if not found.isEmpty():
        classes = extend(classes, found)
    discard(sets)
    discard(members)
    return classes


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS, small_bucket: int = SMALL_BUCKET, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row: doc_id, tkey (digest of the text), class_id (least id of its class), class_size,
    keep (the one row of its class that stays)."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("tkey"), F.col(text).alias("text"))
    signed = materialise(sign(plain, n_bands, rows, shingle).withColumn("row_id", F.monotonically_increasing_id()), "dup-signed")
    classes = link_nodes(signed, plain, threshold, shingle, small_bucket, broadcast_rows)
    alone = F.encode(F.concat(F.lit("row "), F.col("row_id").cast("string")), "UTF-8")
    rows_ = signed.select("row_id", "doc_id", "tkey", "node").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node", alone))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    best = rows_.groupBy("label").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("class_size"))
    return rows_.join(best, "label").select("doc_id", "tkey", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row_id") == F.col("best.row_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, unchanged; of repeated rows that differ in
    other columns alone, the one with the least digest of them all."""
    key = lambda i, t: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), F.coalesce(F.hex(t), F.lit("-")))
    found = near_duplicates(docs, doc_id, text, broadcast_rows=broadcast_rows, **options).where("tkey is not null")
    by_key = materialise(found.where((~F.col("keep")) | (F.col("class_size") > 1)).groupBy(key(F.col("doc_id"), F.col("tkey")).alias("key")).agg(F.max("keep").alias("stays"), F.count(F.lit(1)).alias("copies")), "dup-drop")
    keyed = whole_rows(docs, key(docs[doc_id], text_key(docs[text])).alias("key"))
    touched = bounded(by_key.where("not stays or copies > 1").select("key"), broadcast_rows)
    repeated = bounded(by_key.where("stays and copies > 1").select("key"), broadcast_rows)
    once = keyed.join(touched, "key", "left_anti").select("row")
    copies = keyed.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")).select("row")
    return unfold(once.union(copies))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("tkey")
