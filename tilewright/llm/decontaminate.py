"""Benchmark decontamination: a prefix-filtered set join over word shingles.

Each item is cut into windows of ``window`` words (a shorter item is one
window), each window into shingles of ``shingle`` words. One scan of the
documents joins their shingle hashes with those of the items and keeps what
matches: its counts rank the shingles by rarity over all documents. A document
can hold a window only if it holds each of its shingles, so the window's rarest
one is its whole necessary prefix: only documents with that shingle are
candidates, at the one position it implies, if the window then lies inside the
document. Candidates are verified word by word against the text.

Everything is DataFrame expressions. The items' shingles are broadcast only
while they number at most ``broadcast_rows``; beyond that the same joins are
shuffled. Matches are keyed by the text's digest, so copies of a text are
verified once.

Defined cases: null or wordless texts and items hit nothing; an item with a
null id contaminates but is not listed or counted; repeated items count once by
id; equally rare shingles go by hash, then position; a very long text is one row of
all its shingles; repeated documents get equal rows; empty tables give no rows, or
no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, materialise, read_table, unfold, whole_rows

WINDOW = 10
SHINGLE = 5
#: Rows of a few hundred bytes at most that may be broadcast, after counting them.
BROADCAST_ROWS = 100_000


def text_key(text: Column) -> Column:
    """A digest that stands for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hashed(words: str, k: int) -> Column:
    """(p, h): position and hash of each shingle of k words."""
    starts = F.sequence(F.lit(0), F.size(words) - k)
    found = F.transform(starts, lambda i: F.struct(i.cast("int").alias("p"), F.xxhash64(F.slice(words, i + 1, k)).alias("h")))
    return F.when(F.size(words) >= k, found).otherwise(F.array().cast("array<struct<p:int,h:bigint>>"))


def windows_of(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(wkey, wl, item_id): each window's words joined by spaces, how many they are, and the items with it."""
    words = items.select(F.col(item_id).cast("string").alias("item_id"), alnum_words(F.col(text)).alias("words")).where("size(words) > 0")
    wl = F.least(F.lit(window), F.size("words"))
    at = words.select("item_id", "words", wl.alias("wl"), F.explode(F.sequence(F.lit(1), F.size("words") - wl + 1)).alias("at"))
    return at.select(F.array_join(F.expr("slice(words, at, wl)"), " ").alias("wkey"), "wl", "item_id").distinct()


def verified_windows(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: documents (``keep``, key, n_words); texts (key, n_hit, wkeys); windows (wkey, wl, item_id)."""
    windows = materialise(windows_of(items, item_id, item_text, window), "decon-windows")
    one = windows.select("wkey", "wl").distinct().withColumn("words", F.split("wkey", " "))
    sizes = sorted(r.k for r in one.select(F.least(F.lit(shingle), F.col("wl")).alias("k")).distinct().collect())  # at most ``shingle`` numbers
    parts = [one.where(F.least(F.lit(shingle), F.col("wl")) == k).select("wkey", "wl", F.inline(hashed("words", k))) for k in sizes]
    grams = parts[0] if parts else one.select("wkey", "wl", F.lit(0).alias("p"), F.lit(0).cast("long").alias("h"))
    for part in parts[1:]:
        grams = grams.unionByName(part)
    grams = materialise(grams, "decon-shingles")

    # one scan: each document once (p = -1, dealt by its own hash), and its shingles that some item has
    marker = F.array(F.struct(F.lit(-1).alias("p"), F.xxhash64(*keep, "text_").alias("h")))
    words = docs.select(*keep, F.col(text).alias("text_"), alnum_words(F.col(text)).alias("words"))
    arrays = words.select(*keep, text_key(F.col("text_")).alias("key"), F.size("words").alias("n_words"), F.concat(marker, *(hashed("words", k) for k in sizes)).alias("found"))
    spread = arrays.select(*keep, "key", "n_words", F.inline_outer("found"))  # inline would infer a filter that repeats the words for each shingle
    wanted = grams.select("h").distinct().withColumn("wanted", F.lit(True))
    matched = materialise(spread.join(bounded(wanted, broadcast_rows), "h", "left").where("p = -1 or wanted"), "decon-matches")
    documents = matched.where("p = -1").select(*keep, "key", F.col("n_words").cast("long").alias("n_words"))
    matches = matched.where("p >= 0").select("key", "n_words", "p", "h")

    # rarest shingle of each window that has all of its shingles somewhere
    rarity = matches.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    ranked = grams.join(bounded(rarity, broadcast_rows), "h", "left").groupBy("wkey", "wl").agg(F.min(F.struct("n", "h", "p")).alias("rarest"), F.count_if(F.col("n").isNull()).alias("missing")).where("missing = 0")
    prefix = ranked.select("wkey", "wl", F.col("rarest.h").alias("h"), F.col("rarest.p").alias("offset"))
    candidates = matches.distinct().join(bounded(prefix, broadcast_rows), "h").withColumn("start", F.col("p") - F.col("offset")).where("start >= 0 and start + wl <= n_words")
    of_text = materialise(candidates.groupBy("key").agg(F.collect_list(F.struct("start", "wl", "wkey")).alias("tries")), "decon-candidates")

    # verification against the words of candidate texts
    again = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text_")).join(bounded(of_text.select("key"), broadcast_rows), "key", "left_semi")
    again = again.dropDuplicates(["key"]).join(of_text, "key").select("key", "tries", alnum_words(F.col("text_")).alias("words"))
    true = F.filter("tries", lambda c: (c["start"] + c["wl"] <= F.size("words")) & (F.array_join(F.slice("words", c["start"] + 1, c["wl"]), " ") == c["wkey"]))
    hits = again.select("key", true.alias("hits"), F.size("words").alias("n"))
    places = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["wl"] - 1))))
    texts = hits.select("key", F.size(places).cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda c: c["wkey"])).alias("wkeys"))
    return documents, materialise(texts, "decon-texts").where("n_hit > 0"), windows  # a filter before would repeat the words for each try


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    renamed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    documents, texts, windows = verified_windows(renamed, items, "text", item_id, item_text, ("doc_id",), broadcast_rows=broadcast_rows, **options)
    listed = texts.select("key", F.explode("wkeys").alias("wkey")).join(bounded(windows.select("wkey", "item_id"), broadcast_rows), "wkey").select("key", "item_id").distinct()
    names = listed.groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    found = texts.select("key", "n_hit").join(names, "key", "left").select("key", "n_hit", F.size(F.coalesce("ids", F.array().cast("array<string>"))).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","), 256).alias("items_sha256"))
    found = bounded(materialise(found, "decon-found"), broadcast_rows)
    zero = F.lit(0).cast("long")
    return documents.join(found, "key", "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of ``docs`` without a hit, unchanged."""
    _, texts, _ = verified_windows(docs, items, text, broadcast_rows=broadcast_rows, **options)
    keyed = whole_rows(docs, text_key(docs[text]).alias("key"))
    return unfold(keyed.join(bounded(texts.select("key"), broadcast_rows), "key", "left_anti"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
with dw as (
  select row_number() over () as rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
bw as (
  select cast(item_id as varchar) as item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
bl as (select item_id, w, least(10, len(w)) as l from bw where len(w) > 0),
win as (
  select distinct item_id, l, array_to_string(w[p : p + l - 1], ' ') as s
  from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) as p from bl)),
lens as (select distinct l from win),
dp as (
  select rid, l, p, array_to_string(w[p : p + l - 1], ' ') as s
  from (select rid, w, l, unnest(range(1, len(w) - l + 2)) as p from dw, lens where len(w) >= l)),
hit as (select distinct rid, dp.l, p, item_id from dp join win on dp.s = win.s and dp.l = win.l),
pos as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + l)) as q from hit) group by rid),
ids as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from hit where item_id is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos using (rid) left join ids using (rid)
"""
